"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of the edges (a, b) of one integer type.

    Minima are pre-aggregated and joined, so that no neighbourhood is ever gathered.  Every round roughly halves the
    height of what is left; the rounds end when the edges are stars, which their number and checksum tell.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(old)
        after = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    # Stars now: every node but the centres has one edge, to its centre.
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._obliva_path = e._obliva_path
    return out
