"""Dense positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.functions.draws import order_key


def positions(df: DataFrame, seed: str, *keys: str, name: str = "pos", within: tuple[str, ...] = ()) -> DataFrame:
    """df with its place (from 0) in the hash order of unique keys, among the rows with its values of ``within``.

    Rows are numbered within the 4096 ranges of the order that three hex digits tell apart; the ranges' offsets are a
    running sum over at most as many rows.
    """
    rows = df.withColumn("_order", order_key(seed, *[F.col(k) for k in keys])).withColumn("_range", F.substring("_order", 1, 3))
    counts = rows.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ordered = Window.partitionBy(*within, "_range").orderBy("_order", *keys)
    numbered = rows.withColumn("_r", F.row_number().over(ordered)).join(F.broadcast(offsets), [*within, "_range"])  # 4096 rows at most for each value of ``within``
    return numbered.withColumn(name, F.col("_offset") + F.col("_r") - 1).drop("_order", "_range", "_r", "_offset")
