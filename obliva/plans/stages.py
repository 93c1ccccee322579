"""Stages of a run as a graph of tables.

A stage names the stages it needs and its settings.  Beside each stage's table lies a manifest with a fingerprint of its
settings, of the given inputs and of all that it needs: a stage whose fingerprint is there already is read, any other
is run again, and so is all that follows from it.  Stages that do not need each other run at once, each in a
scheduler pool of its own name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from obliva.sources.shared import files

Work = Callable[[dict[str, DataFrame]], DataFrame]
MANIFEST = "_manifest.json"


@dataclass(frozen=True)
class Stage:
    """work: gets the tables that the stage needs, by name.  settings: a data class or anything that JSON can hold."""

    name: str
    work: Work
    needs: tuple[str, ...] = ()
    settings: object = None


@dataclass
class Run:
    """The tables by name, and the names of the stages that were run, in the order in which they ended."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)


def inputs_fingerprint(spark: SparkSession, *paths: str) -> list[list]:
    """Name, length and time of change of every file of the given tables."""
    out = []
    for path in paths:
        fs, where = files(spark, path)
        found = fs.listFiles(where, True)
        while found.hasNext():
            f = found.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def _fingerprint(stage: Stage, needed: dict[str, str], inputs: object) -> str:
    settings = asdict(stage.settings) if is_dataclass(stage.settings) else stage.settings
    return hashlib.sha256(json.dumps([stage.name, settings, sorted(needed.items()), inputs], sort_keys=True).encode()).hexdigest()


def _read_manifest(spark: SparkSession, path: str) -> str | None:
    """The fingerprint under which a stage's table was written to its end."""
    fs, where = files(spark, f"{path}/{MANIFEST}")
    if not fs.exists(where) or not fs.exists(files(spark, f"{path}/_SUCCESS")[1]):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["fingerprint"]
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, path: str, fingerprint: str) -> None:
    fs, where = files(spark, f"{path}/{MANIFEST}")
    out = fs.create(where, True)
    out.write(bytearray(json.dumps({"fingerprint": fingerprint}).encode()))
    out.close()


def ordered(stages: Sequence[Stage]) -> list[Stage]:
    """The stages, each after those it needs; needs that are missing or go round are errors."""
    by = {s.name: s for s in stages}
    if len(by) < len(stages):
        raise ValueError("two stages of one name")
    out: list[Stage] = []
    left = list(stages)
    while left:
        done = {s.name for s in out}
        free = [s for s in left if set(s.needs) <= done]
        if not free:
            missing = sorted({n for s in left for n in s.needs} - set(by))
            raise ValueError(f"unknown stages: {', '.join(missing)}" if missing else f"stages that need each other: {', '.join(s.name for s in left)}")
        out += free
        left = [s for s in left if s not in free]
    return out


def graph(spark: SparkSession, stages: Sequence[Stage], root: str, *, inputs: object = None, at_once: int = 4) -> Run:
    """Runs what is not there yet under its fingerprint.  After a failure no stage begins; those at work end, then the failure is raised."""
    plan = ordered(stages)
    prints: dict[str, str] = {}
    for s in plan:
        prints[s.name] = _fingerprint(s, {n: prints[n] for n in s.needs}, inputs)
    run = Run()

    def one(stage: Stage) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", stage.name)
        path = f"{root}/{stage.name}"
        table = stage.work({n: run.tables[n] for n in stage.needs})
        table.write.mode("overwrite").parquet(path)
        # Last of all: a table without its manifest is written again.
        _write_manifest(spark, path, prints[stage.name])

    left, busy, failure = list(plan), {}, None
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        while left or busy:
            for stage in [s for s in left if set(s.needs) <= set(run.tables)] if failure is None else []:
                left.remove(stage)
                if _read_manifest(spark, f"{root}/{stage.name}") == prints[stage.name]:
                    run.tables[stage.name] = spark.read.parquet(f"{root}/{stage.name}")
                else:
                    busy[pool.submit(inheritable_thread_target(spark)(one), stage)] = stage
            if not busy:
                if failure is not None:
                    break
                continue
            for done in wait(busy, return_when=FIRST_COMPLETED).done:
                stage = busy.pop(done)
                if done.exception() is None:
                    run.tables[stage.name] = spark.read.parquet(f"{root}/{stage.name}")
                    run.ran.append(stage.name)
                else:
                    failure = failure or done.exception()
    if failure is not None:
        raise failure
    return run


def run(spark: SparkSession, stages: Sequence[tuple[str, Work]], root: str) -> dict[str, DataFrame]:
    """A chain of (name, work): each stage needs all before it."""
    chain = [Stage(name, work, tuple(n for n, _ in stages[:k])) for k, (name, work) in enumerate(stages)]
    return graph(spark, chain, root, at_once=1).tables
