"""Resharding at the least cost: a minimum-cost flow from old shard sizes to new capacities, then block transfers.

A sharded table lies in a folder, ``shard=S`` for each shard and a file for each of its blocks; its rows are the input's
rows as a struct ``row``, beside their size, the crc32 of their text, their block and their place in it.  ``reshard`` sums sizes by
block, solves the flow between shards (as many numbers as shards), and lays it over each shard's blocks in order: what
stays comes first, then each transfer in turn.  Most blocks go whole to one shard; the few that lie on a border are shared
out row by row, largest first, to the shard that lacks most.  Blocks that stay keep their files and their rows' slots; the rows
of all others are read, once, and written to their new shards.  The plan of blocks says for each piece where its slots begin.

Nothing is sorted or numbered over a whole shard: windows run over blocks (one row each), there are fewer border blocks than
old and new shards together, of at most ``ROWS`` rows, and rows are joined with the plan by block: by broadcast up to
``PLAN`` blocks, beyond by a shuffle.

Defined results: a null text has size 1 and crc32 0; rows count each by itself, whatever they repeat; an empty table gives
empty shards; extra columns are kept within ``row``, whatever their names.  Shards differ by about the smallest rows of the border
blocks, unless single rows exceed what a shard may hold.  Rows of one input split are in order, so reruns over the same
files with the same settings agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.llm.common import cut, scratch, ship

#: Rows of a block, and of its file, at most.
ROWS = 1 << 16
#: Blocks of a plan that is broadcast, some 40 bytes each.
PLAN = 1 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity at the least total cost, by successive shortest paths; all supply must fit."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold all supplies")
    n, m = len(supply), len(capacity)
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    while any(left):
        # Bellman-Ford over supplies (0..n-1) and capacities (n..n+m-1); back along an edge that carries flow at minus its cost.
        far = [0 if x else None for x in left] + [None] * m
        by: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    for a, b, c in ((i, n + j, cost[i][j]), (n + j, i, -cost[i][j])):
                        if far[a] is not None and (b >= n or flow[i][j]) and (far[b] is None or far[a] + c < far[b]):
                            far[b], by[b], changed = far[a] + c, a, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j], j))
        path = [n + end]
        while by[path[-1]] is not None:
            path.append(by[path[-1]])
        path.reverse()
        back = [flow[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n]
        most = min([left[path[0]], room[end], *back])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[path[0]] -= most
        room[end] -= most
    return flow


def even(total: int, shards: int) -> list[int]:
    """Capacities that add up to the total and differ by one at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def lay_out(docs: DataFrame, path: str, shards: int, *, text: str = "text", rows: int = ROWS) -> None:
    """Writes the rows as they are dealt over input splits: split p to shard p mod ``shards``, cut into blocks of ``rows`` rows."""
    within = F.col("n").bitwiseAND((1 << 33) - 1)
    split = F.shiftright("n", 33)
    laid = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("n", F.monotonically_increasing_id())
    held = F.col("row").getField(text)
    laid = laid.select(
        "row",
        text_bytes(held).alias("size"),
        text_crc(held).alias("crc"),
        (within % rows).cast("int").alias("place"),
        (split % shards).cast("int").alias("shard"),
        (F.shiftleft(split, 33) + F.floor(within / rows)).alias("block"),
    )
    # A split's rows are all of one shard: each file holds one block, and scans by block leave the others out.
    laid.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("shard").parquet(path)


@dataclass
class Resharded:
    """What became of a sharded table: its rows, its blocks' pieces, the flow of bytes between shards and the folder of rewritten rows."""

    rows: DataFrame
    pieces: DataFrame
    flow: list[list[int]]
    path: str | None


def _read(spark: SparkSession, path: str, row: str) -> DataFrame:
    return spark.read.schema(f"row {row}, size long, crc long, place int, block long, shard int").parquet(path)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _bands(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(shard, to, from byte, to byte) of each transfer: a shard's own first, in the order of its bytes."""
    out = []
    for i, to in enumerate(flow):
        at = 0
        for j in sorted(range(len(to)), key=lambda j: (j != i, j)):
            if to[j]:
                out.append((i, j, at, at + to[j]))
                at += to[j]
    return out


def _share(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of a border block to its takers, largest first, each to the taker that lacks most."""
    lacks = rows["lacks"].iloc[0]
    to, lack = np.array([x["to"] for x in lacks]), np.array([x["bytes"] for x in lacks], np.int64)
    rows = rows.sort_values(["size", "place"], ascending=[False, True], kind="stable")
    taker = np.zeros(len(rows), np.int64)
    for k, size in enumerate(rows["size"].to_numpy()):
        taker[k] = lack.argmax()
        lack[taker[k]] -= size
    out = rows[["shard", "block", "place", "size"]].assign(to=to[taker].astype(np.int32))
    out = out.sort_values("place", kind="stable")
    return out.assign(rank=out.groupby("to").cumcount().astype(np.int64))[["shard", "block", "place", "size", "to", "rank"]]


def reshard(spark: SparkSession, path: str, shards: int, *, row: str, capacity: list[int] | None = None, cost: list[list[int]] | None = None, into: str | None = None) -> Resharded:
    """Moves the fewest bytes so that ``shards`` shards hold their capacities (even ones if not given).

    row: the type of the rows' struct.  cost: of a byte from old shard i to new shard j; nothing to stay and 1 to move if not given.
    into: the folder for rewritten rows, a new one in the shared folder if not given; the old one's files are left as they are.
    rows: row, size, crc, shard, slot of every row, read from the files that stay and from the new ones.
    """
    old = _read(spark, path, row)
    blocks = cut(old.groupBy("shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sizes = {r["shard"]: r["bytes"] for r in blocks.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each shard
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    flow = min_cost_flow(supply, capacity or even(sum(supply), shards), cost or [[int(i != j) for j in range(shards)] for i in range(len(supply))])
    bands = spark.createDataFrame(_bands(flow), "of int, to int, lo long, hi long")

    # One row a block from here: where it lies within its shard, and which transfers it meets.
    order = Window.partitionBy("shard").orderBy("block")
    placed = blocks.withColumn("end", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("bytes"))
    on = (F.col("shard") == F.col("of")) & (F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo"))
    met = placed.join(F.broadcast(bands), on)  # as many bands as old and new shards together
    lack = F.least("end", "hi") - F.greatest("start", "lo")
    takers = cut(met.groupBy("shard", "block", "n").agg(F.array_sort(F.collect_list(F.struct(F.col("to"), lack.alias("bytes")))).alias("lacks")))  # at most one a shard
    border = takers.where(F.size("lacks") > 1).select("shard", "block", "lacks")
    torn_blocks = [(r["shard"], r["block"]) for r in border.select("shard", "block").collect()]  # fewer than bands
    torn_here = _any((F.col("shard") == s) & (F.col("block") == b) for s, b in torn_blocks)
    ship(spark)
    light = old.where(torn_here).select("shard", "block", "place", "size").join(F.broadcast(border), ["shard", "block"])
    shared = cut(light.groupBy("shard", "block").applyInPandas(_share, "shard int, block long, place int, size long, to int, rank long"))

    whole = takers.where(F.size("lacks") == 1).select("shard", "block", F.col("lacks")[0]["to"].alias("to"), "n", F.lit(False).alias("split"))
    parts = shared.groupBy("shard", "block", "to").agg(F.count("*").alias("n")).select("shard", "block", "to", "n", F.lit(True).alias("split"))
    pieces = whole.unionByName(parts).withColumn("stays", (F.col("shard") == F.col("to")) & ~F.col("split"))
    # Whole blocks that stay come first and keep their slots.
    slots = Window.partitionBy("to").orderBy(F.col("stays").desc(), "shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut(pieces.withColumn("base", F.coalesce(F.sum("n").over(slots), F.lit(0))))

    # A shard's blocks stay up to one of them: a bound for each shard is all that the scans need to leave files out.
    last = {r["shard"]: r["last"] for r in pieces.where("stays").groupBy("shard").agg(F.max("block").alias("last")).collect()}
    stays = _any((F.col("shard") == s) & (F.col("block") <= k) for s, k in last.items())
    plan = pieces.select("shard", "block", "to", "split", "base")
    if pieces.count() <= PLAN:
        plan = F.broadcast(plan)
    straight = old.where(~stays & ~torn_here).join(plan.where("not split"), ["shard", "block"]).withColumn("rank", F.col("place").cast("long"))
    torn = old.where(torn_here).join(F.broadcast(shared.drop("size")), ["shard", "block", "place"]).join(plan.where("split"), ["shard", "block", "to"])
    columns = ["row", "size", "crc", F.col("to").alias("shard"), (F.col("base") + F.col("rank")).alias("slot")]
    into = into or scratch(spark, "shards")
    straight.select(*columns).unionByName(torn.select(*columns)).write.mode("overwrite").partitionBy("shard").parquet(into)
    rewritten = spark.read.schema(f"row {row}, size long, crc long, shard int, slot long").parquet(into)
    kept = old.where(stays).join(plan.where("not split"), ["shard", "block"])
    rows = kept.select("row", "size", "crc", "shard", (F.col("base") + F.col("place")).alias("slot")).unionByName(rewritten.select("row", "size", "crc", "shard", "slot"))
    return Resharded(rows, pieces, flow, into)
