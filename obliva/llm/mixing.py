"""Mixing of sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target of words; a document of a source with target T and
size S is due T/S copies.  The whole part is certain; the fractional parts are
paired, and words move at random from one of the pair to the other until one of
them is integral, so that expectations and the source's total both hold.  The
pairs form a reduction tree: cells of about ``FAN`` documents fold to one open
document each, cells of open documents fold again, up to one for each source,
which a last draw settles.

Defined results: a null text has size 0; a document of size 0 is never taken;
null is a source of its own, last in order; a cell's documents fold
from the largest down, ties by hash and key; rows with one key, source and size are numbered and drawn each by itself,
in cells of their own; an empty table gives an empty table; no column of the input but those named is read.
The targets are found over one row for each source: their number is taken to be small against that of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.llm.common import cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents that one cell of the reduction tree folds, on average.
FAN = 96
#: Rows of one key, source and size that are numbered at once.
RUN = 1 << 16


def text_size(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, share: float, limit: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, n: a row for each source.

    The targets are min(limit * size, level * weight) with the level at which they add up to ``share`` of all words:
    what resharing the excess by weight, again and again, ends at.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each source from here: these windows see no documents.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(limit)).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.col("total") - before) / rest)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))
    ranked = ranked.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``, a number of its own for each of those that are alike."""
    alike = rows.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    copies = F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)
    return runs.select("key", "source", "size", F.explode(copies).alias("copy"))


def _item(x: Column, p: Column) -> Column:
    return F.struct(x["key"].alias("key"), x["copy"].alias("copy"), x["size"].alias("size"), x["whole"].alias("whole"), p.alias("p"))


def _fold(items: Column, kind: str) -> Column:
    """Folds a cell's documents (key, copy, size, whole, p, u) to the settled ones and one that is still open."""
    one = f"struct<key:{kind},copy:bigint,size:bigint,whole:bigint,p:double>"
    start = F.struct(F.lit(None).cast(one).alias("open"), F.array().cast(f"array<{one}>").alias("settled"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]

        def moved(m: Column) -> Column:
            def out(settled: Column, still: Column) -> Column:
                return F.struct(still.alias("open"), F.concat(acc["settled"], F.array(settled)).alias("settled"))

            a_first = m["give"] <= m["room"]
            b_first = m["lack"] <= m["have"]
            return F.when(
                m["forward"],
                F.when(a_first, out(_item(a, F.lit(0.0)), _item(b, F.least(F.lit(1.0), b["p"] + m["give"] / b["size"])))).otherwise(
                    out(_item(b, F.lit(1.0)), _item(a, F.greatest(F.lit(0.0), a["p"] - m["room"] / a["size"])))
                ),
            ).otherwise(
                F.when(b_first, out(_item(a, F.lit(1.0)), _item(b, F.greatest(F.lit(0.0), b["p"] - m["lack"] / b["size"])))).otherwise(
                    out(_item(b, F.lit(0.0)), _item(a, F.least(F.lit(1.0), a["p"] + m["have"] / a["size"])))
                )
            )

        give, room = a["p"] * a["size"], (1 - b["p"]) * b["size"]
        lack, have = (1 - a["p"]) * a["size"], b["p"] * b["size"]
        there, back = F.least(give, room), F.least(lack, have)
        pair = F.struct(give.alias("give"), room.alias("room"), lack.alias("lack"), have.alias("have"), (b["u"] * (there + back) < back).alias("forward"))
        return F.when(a.isNull(), F.struct(_item(b, b["p"]).alias("open"), acc["settled"].alias("settled"))).otherwise(_let(pair, moved))

    return F.aggregate(items, start, step)


def _uniform(*parts: Column) -> Column:
    """A draw in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0, seed: int = 42) -> DataFrame:
    """key, source, size, source_size, target, copies of each document."""
    kind = docs.schema[key].dataType.simpleString()
    sized = cut(_numbered(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), text_size(F.col(text)).alias("size"))))
    goal = cut(targets(sized, share, limit))
    cells = goal.select(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 1
    g = goal.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("n") / FAN).alias("cells"))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sized.join(g, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(due)).otherwise(F.lit(0)).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, due - F.floor(due)).otherwise(F.lit(0.0)))
        .withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "key", "size", "copy"), F.col("cells")))
    )
    fixed = ["source", "source_size", "target"]
    settled = rows.where("p = 0").select(*fixed, "key", "size", F.col("whole").alias("copies"))
    still = rows.where("p > 0").select(*fixed, "cell", "key", "copy", "size", "whole", "p")
    level = 0
    while True:
        u = _uniform(F.lit(seed), F.lit(level), F.col("key"), F.col("size"), F.col("copy"))
        # Large documents first: the many small ones after them absorb what is left open.
        item = F.struct((-F.col("size")).alias("at"), u.alias("u"), "key", "copy", "size", "whole", "p")
        # A cell holds FAN documents on average, dealt by hash: its list has a bound.
        cell = still.groupBy(*fixed, "cell").agg(F.array_sort(F.collect_list(item)).alias("items"))
        folded = cut(cell.select(*fixed, "cell", _fold(F.col("items"), kind).alias("f")))
        flat = folded.select(*fixed, F.inline("f.settled"))
        settled = settled.unionByName(flat.select(*fixed, "key", "size", (F.col("whole") + F.col("p").cast("long")).alias("copies")))
        still = folded.select(*fixed, "cell", "f.open.*")
        if cells <= 1:
            break
        cells, level = -(-cells // FAN), level + 1
        still = still.withColumn("cell", F.floor(F.col("cell") / FAN))
    last = _uniform(F.lit(seed), F.lit(-1), F.col("key"), F.col("size"), F.col("copy")) < F.col("p")
    return settled.unionByName(still.select(*fixed, "key", "size", (F.col("whole") + last.cast("long")).alias("copies"))).withColumnRenamed("key", key)
