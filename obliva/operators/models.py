"""Model calls in batches, from a keyed store of answers.

Each distinct prompt is asked once.  Prompts that the store does not have are dealt over tasks, sorted by length, and
gathered into batches whose padded size stays within a budget.  A task writes each batch's answers to the store before
it asks for the next: whatever is lost later, they are not asked for again.  A worker loads its model once; a resource
profile sends the tasks to executors that have what the model needs; failed calls are repeated after a pause.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.operators.tokens import handle
from obliva.sources.shared import files, scratch, ship

Answer = Callable[[list[str]], list[str]]


def _batches(rows: list[tuple[str, str]], budget: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """Runs of (digest, prompt), shortest first, whose number times longest length is within the budget; a longer prompt is alone."""
    out: list[tuple[str, str]] = []
    for row in rows:
        if out and (len(out) == most or (len(out) + 1) * max(1, len(row[1])) > budget):
            yield out
            out = []
        out.append(row)
    if out:
        yield out


def _asked(answer: Answer, prompts: list[str], attempts: int, pause: float) -> list[str]:
    """The answers, after some attempts; the last failure is the task's."""
    for k in range(attempts):
        try:
            out = answer(prompts)
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            return out
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("no attempts")


def _store(root: str):
    """The store's file system and folder, as a task sees them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def ask(rows: DataFrame, prompt: str, name: str, load: Callable[[], Answer], *, store: str | None = None, budget: int = 1 << 15, most: int = 64, attempts: int = 3, pause: float = 1.0, tasks: int | None = None, profile=None) -> DataFrame:  # noqa: E501
    """rows with ``model_output``, null for null prompts.

    name: of the model and its settings: answers in the store are kept by it and the prompt.  store: a folder in the shared
    file system, a new one if not given.  budget: characters of a padded batch, most: its prompts.
    """
    spark = rows.sparkSession
    ship(spark)
    root = store or scratch(spark, "answers")
    # Where Spark and Arrow name a local folder alike.
    place = root.replace("file:///", "/", 1) if root.startswith("file:///") else root
    digest = F.sha2(F.concat_ws("\n", F.lit(name), F.col(prompt)), 256)
    keyed = rows.withColumn("_digest", F.when(F.col(prompt).isNotNull(), digest))
    wanted = keyed.where("_digest is not null").groupBy("_digest").agg(F.any_value(prompt).alias("_prompt"))
    fs, where = files(spark, root)
    fs.mkdirs(where)
    schema = "_digest string, model_output string"
    wanted = wanted.join(spark.read.schema(schema).parquet(root), "_digest", "left_anti")
    dealt = wanted.repartition(tasks, "_digest") if tasks else wanted.repartition("_digest")
    dealt = dealt.sortWithinPartitions(F.char_length("_prompt"), "_digest").select("_digest", "_prompt")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        from obliva.operators import models

        rows = ((d, p) for part in parts for d, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        system, folder = models._store(place)
        for batch in models._batches(rows, budget, most):
            # The same rows make the same batches, so that a repeated task finds what an earlier one has written.
            file = f"{folder}/{hashlib.sha256(''.join(d for d, _ in batch).encode()).hexdigest()}.parquet"
            if system.get_file_info(file).type.name == "NotFound":
                answers = models._asked(handle(f"model-{name}", load), [p for _, p in batch], attempts, pause)
                made = pa.table({"_digest": [d for d, _ in batch], "model_output": pa.array(answers, pa.string())})
                part = f"{folder}/_{uuid.uuid4().hex}"  # readers pass over names that begin so
                with system.open_output_stream(part) as out:
                    pq.write_table(made, out)
                system.move(part, file)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    dealt.mapInArrow(work, "n long", profile=profile).agg(F.sum("n")).collect()  # one number
    answers = spark.read.schema(schema).parquet(root).dropDuplicates(["_digest"])
    return keyed.join(answers, "_digest", "left").drop("_digest")
