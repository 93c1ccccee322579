"""Filter interaction audit: what each filter removes, alone and after others, for every order of the filters.

A document's outcome in any order depends on the set of filters that it fails alone.  So documents are counted by part and
by mask of failed filters, and the counts of all documents, of good ones and of toxic ones are stacked as rows of 2^f
numbers.  Integer matrices of 2^f rows and a column for each step of each order (32 by 600 for five filters) say which masks
are kept, removed, redundant, unique, and removed in how many orders; the rows times the matrices are the audit.

The texts are read once and go no further than their task: digests, masks and counts are all that is shuffled.  Equal
texts are found by SHA-256 and length.  Counts are pre-aggregated, so that a part, or a text, of a third of all rows is a
few rows a task.

Defined results: a null text is an empty one; a null part is the empty string; null ids have no smaller one and are no
smaller one; rows of one id and text are no copies of each other; of labels that repeat an id, one that says 1 counts; parts
are those of the documents: an empty table gives an empty table; no column but those named is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import cut, ship

WORD = r"[^\x20\x09-\x0D]+"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose products are made at once.
PARTS = 64


def masks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """key, part, mask, n: documents alike in these.  Bit i of the mask: the i-th filter fails; the last filter is that of repeated texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    # One pass over the text: words once, then numbers alone.
    seen = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(whole.cast("binary"), 256).alias("digest"),
        F.octet_length(whole).alias("bytes"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0].alias("w"),
        F.char_length(whole).alias("chars"),
        (F.char_length(whole) - F.char_length(F.regexp_replace(whole, "[A-Z]+", ""))).alias("upper"),
        whole.rlike(r"[#$%&*|]").alias("marked"),
    )
    fails = [F.col("w.all") < 200, F.col("w.distinct") * 100 < F.col("w.all") * 50, F.col("upper").cast("long") * 100 > F.col("chars").cast("long") * 2, F.col("marked")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    light = cut(seen.select("key", "part", "digest", "bytes", mask.alias("mask")).groupBy("key", "part", "digest", "bytes", "mask").agg(F.count("*").alias("n")))
    first = light.groupBy("digest", "bytes").agg(F.min("key").alias("key")).where("key is not null").withColumn("first", F.lit(True))
    flagged = light.join(first, ["digest", "bytes", "key"], "left")
    copy = F.col("first").isNull() & F.col("key").isNotNull()
    return flagged.groupBy("key", "part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask")).agg(F.sum("n").alias("n"))


def matrices(letters: str) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """The orders, the step's filter by column, and integer matrices: mask by (order, step)."""
    f = len(letters)
    orders = list(permutations(range(f)))
    mask = np.arange(1 << f)[:, None]
    fails = (mask >> np.arange(f) & 1).astype(bool)
    here = np.array(orders).reshape(-1)
    before = np.array([sum(1 << j for j in o[:k]) for o in orders for k in range(f)])
    earlier = (mask & before) > 0
    fail = fails[:, here]
    removed = fail & ~earlier
    # In how many orders a filter is the one that removes a mask.
    shares = np.stack([removed[:, here == j].sum(1) for j in range(f)], 1)
    out = {
        "kept": ~fail & ~earlier,
        "removed": removed,
        "redundant": fail & earlier,
        "unique_fails": mask == (1 << here),
        "shapley": shares[:, here],
    }
    return ["".join(letters[j] for j in o) for o in orders], here, {k: v.astype(np.int64) for k, v in out.items()}


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, filter_order, step, filter and the OUTCOMES: a row for each part, order and step."""
    ship(docs.sparkSession)
    letters = "ABCDE"
    seen = cut(masks(docs, key=key, text=text, part=part))
    says = labels.groupBy(F.col(key).alias("key")).agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    said = seen.join(says.where("good = 1 or toxic = 1"), "key")
    rows = [seen.select("part", "mask", F.lit("all").alias("row"), "n")]
    rows += [said.where(f"{name} = 1").select("part", "mask", F.lit(name).alias("row"), "n") for name in ("good", "toxic")]
    stacked = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("part", "mask", "row").agg(F.sum("n").alias("n"))
    wide = [F.sum(F.when((F.col("mask") == m) & (F.col("row") == name), F.col("n")).otherwise(0)) for name in ("all", "good", "toxic") for m in range(1 << len(letters))]
    histograms = stacked.groupBy("part").agg(F.array(*wide).alias("h"))
    orders, here, by = matrices(letters)
    names = [letters[j] for j in here]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PARTS):
                some = batch.slice(k, PARTS)
                h = np.array(some.column("h").to_pylist(), np.int64).reshape(-1, 3, 1 << len(letters))
                n, columns = len(h), len(here)
                out = {name: h[:, 0] @ by[name] for name in by}
                out |= {"good_lost": h[:, 1] @ by["removed"], "toxic_lost": h[:, 2] @ by["removed"]}
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").take(pa.array(np.repeat(np.arange(n), columns))),
                        pa.array(np.tile(np.repeat(np.array(orders), len(letters)), n)),
                        pa.array(np.tile(np.arange(columns, dtype=np.int32) % len(letters) + 1, n)),
                        pa.array(names * n),
                        *[pa.array(out[name].reshape(-1)) for name in OUTCOMES],
                    ],
                    ["part", "filter_order", "step", "filter", *OUTCOMES],
                )

    kinds = ", ".join(f"{name} long" for name in OUTCOMES)
    return histograms.mapInArrow(products, f"part string, filter_order string, step int, filter string, {kinds}")


#: The same table in DuckDB SQL.
AUDIT_SQL = r"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), judged as (
    select doc_id, part, concat(
        case when len(w) < 200 then 'A' else '' end,
        case when 100 * list_unique(w) < 50 * len(w) then 'B' else '' end,
        case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end,
        case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
        case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails
    from texts
), counted as (
    select part, fails, count(*) as n,
        count(*) filter (where doc_id in (select doc_id from labels where quality = 1)) as good,
        count(*) filter (where doc_id in (select doc_id from labels where toxic = 1)) as toxic
    from judged group by all
), letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
    select a.l || b.l || c.l || d.l || e.l as o from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (select o, k, substr(o, k, 1) as f, string_split(substr(o, 1, k - 1), '') as prior from orders, range(1, 6) r(k)),
met as (
    select part, o, k, f, n, good, toxic, fails, contains(fails, f) as fail, list_has_any(string_split(fails, ''), list_filter(prior, lambda x: x <> '')) as earlier
    from counted, steps
), summed as (
    select part, o, k, f,
        sum(case when not fail and not earlier then n else 0 end) as kept, sum(case when fail and not earlier then n else 0 end) as removed,
        sum(case when fail and earlier then n else 0 end) as redundant, sum(case when fails = f then n else 0 end) as unique_fails,
        sum(case when fail and not earlier then good else 0 end) as good_lost, sum(case when fail and not earlier then toxic else 0 end) as toxic_lost
    from met group by all
)
select part, o as filter_order, k::int as step, f as "filter", kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
    unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, f))::bigint as shapley
from summed
"""
