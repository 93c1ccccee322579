"""Writers.  All but ``json_array`` scale; that one is for small exports in the legacy layout."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.operators import evaluation
from obliva.sources.shared import files


def json_lines(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).json(path) if partition else df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, path: str, order: str, most: int = 1_000_000) -> None:
    """One file with one JSON array, in the order of a column; refuses more than ``most`` rows, which one task would have to hold."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write JSON lines instead")
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.struct("*").alias("row")))).alias("rows"))
    rows.select(F.to_json(F.transform("rows", lambda r: r["row"]))).coalesce(1).write.mode("overwrite").text(path)


def split_with_test(df: DataFrame, test: DataFrame, path: str) -> None:
    """A labelled split and its companion test set, by split and mode."""
    for name, part in (("sets", df), ("test", test)):
        part.write.mode("overwrite").partitionBy("split", "mode").parquet(f"{path}/{name}")


def attribute_files(df: DataFrame, path: str) -> None:
    """One folder of text lines for each attribute."""
    df.select("attribute", "value").write.mode("overwrite").partitionBy("attribute").text(path)


def attribute_file(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One file of text lines whose stem names the attribute; refuses more than ``most`` rows, which one task would have to write."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write attribute folders instead")
    fs, where = files(df.sparkSession, path)
    fs.delete(where, True)
    df.select("value").coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    parts = files(df.sparkSession, f"{path}.parts")[1]
    for status in fs.listStatus(parts):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), where)
    fs.delete(parts, True)


def results(detail: DataFrame, summary: DataFrame, path: str, *parameters: str) -> None:
    """Detail and summary tables; runs are told apart by parameter columns, a rerun replaces its own partitions only."""
    for name, df in (("detail", detail), ("summary", summary)):
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*parameters) if parameters else writer).parquet(f"{path}/{name}")


def variants(df: DataFrame, path: str) -> None:
    """A baseline's variants, a folder each, and the statistics of all of them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(f"{path}/detail")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/detail")
    evaluation.variant_statistics(written).write.mode("overwrite").parquet(f"{path}/statistics")


def token_notes(sets: DataFrame, path: str) -> None:
    """Position token sets (attribute, pos, token) as text, sorted."""
    sets.orderBy("attribute", "pos", "token").select(F.concat_ws("\t", "attribute", F.col("pos").cast("string"), F.col("token"))).write.mode("overwrite").text(path)


def run_record(log: DataFrame, settings: object, path: str) -> None:
    """A run's log history as JSON lines, and its settings (a data class) as one JSON object."""
    log.write.mode("overwrite").json(f"{path}/log_history")
    text = json.dumps(asdict(settings), sort_keys=True)
    log.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def legacy_results(detail: DataFrame, trailer: DataFrame, path: str, order: str, most: int = 1_000_000) -> None:
    """Detail rows in the order of a column, then the trailer rows, in one JSON array; columns that a row lacks are left out."""
    rows = detail.withColumn("_last", F.lit(0)).unionByName(trailer.withColumn("_last", F.lit(1)), allowMissingColumns=True)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    kept = [c for c in rows.columns if c not in ("_last", order)]
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("_last", F.col(order).alias("at"), F.struct(*kept).alias("row")))).alias("rows"))
    whole.select(F.to_json(F.transform("rows", lambda r: r["row"]))).coalesce(1).write.mode("overwrite").text(path)
