"""Checkpoint folders by an index: which are due, which are kept, and deletion in two phases.

The index is a table of events (run, step, folder, state) that only grows; a folder's state is the highest it has: LIVE once
its files are whole, DOOMED when a later step has pushed it out, GONE when its files are deleted.  A crash between
the phases leaves doomed folders, which the next sweep deletes; a live folder is never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.sources.shared import files

LIVE, DOOMED, GONE = 0, 1, 2
SCHEMA = "run string, step long, folder string, state int"


def due(step: Column, every: int) -> Column:
    """Whether a step's checkpoint is to be saved: every so many steps, none for step 0."""
    if every < 1:
        raise ValueError("every must be 1 at least")
    return (step > 0) & (step % every == 0)


def _append(events: DataFrame, root: str) -> None:
    events.select("run", F.col("step").cast("long"), "folder", F.col("state").cast("int")).write.mode("append").parquet(f"{root}/_index")


def record(folders: DataFrame, root: str) -> None:
    """Notes folders (run, step, folder) whose files are whole."""
    _append(folders.withColumn("state", F.lit(LIVE)), root)


def index(spark: SparkSession, root: str) -> DataFrame:
    """run, step, folder, state as it is now."""
    path = f"{root}/_index"
    fs, where = files(spark, path)
    events = spark.read.schema(SCHEMA).parquet(path) if fs.exists(where) else spark.createDataFrame([], SCHEMA)
    return events.groupBy("run", "step", "folder").agg(F.max("state").alias("state"))


def live(spark: SparkSession, root: str) -> DataFrame:
    return index(spark, root).where(F.col("state") == LIVE).drop("state")


def doom(spark: SparkSession, root: str, keep: int) -> None:
    """First phase: of each run, all live folders but those of the last ``keep`` steps are marked."""
    if keep < 1:
        raise ValueError("keep must be 1 at least")
    last = Window.partitionBy("run").orderBy(F.col("step").desc(), "folder")
    _append(live(spark, root).withColumn("_r", F.row_number().over(last)).where(F.col("_r") > keep).withColumn("state", F.lit(DOOMED)), root)


def sweep(spark: SparkSession, root: str) -> int:
    """Second phase: deletes the marked folders, notes each as gone, and says how many there were.  May be repeated at any time."""
    marked = index(spark, root).where(F.col("state") == DOOMED).orderBy("run", "step").select("run", "step", "folder").collect()  # folders that go now
    for row in marked:
        fs, where = files(spark, f"{root}/{row['folder']}")
        fs.delete(where, True)
    if marked:
        _append(spark.createDataFrame([(*r, GONE) for r in marked], SCHEMA), root)
    return len(marked)


def retire(spark: SparkSession, root: str, keep: int) -> int:
    """Both phases."""
    doom(spark, root, keep)
    return sweep(spark, root)
