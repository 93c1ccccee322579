"""N-gram Jaccard join: grouped prefix join over word shingles.

Documents with equal shingle sets form a class, numbered by the first of its
rows.  A class's shingles are ordered from rare to frequent (counted in a sketch
of fixed size over the whole corpus, ties by hash) and its prefix is just long
enough that two sets which link share a shingle of it.  Classes with the same
prefix and size collapse into one group; groups meet on the shingles of their
prefixes; pairs of groups are filtered by size, by place, by what the two
prefixes can still have in common, and by parity maps (of a group: the bits in
which its members agree); the survivors expand to their members, whose sets are
compared.

Only components are asked for, so the pairs are taken in two passes, neither of
which drops one: first each group with its neighbour and the first group on
every shingle, a number linear in the postings; then all further pairs of
groups that are not of one component already.  Postings are sorted by range
over shingle and place, so a frequent shingle spreads over tasks; in the second
pass a shingle's postings are dealt by size band and in blocks, every two of
which meet in one task that puts out close pairs only.

Shingles are 64-bit hashes of lower-cased (A-Z) words, and whole hashes are
compared.  Defined results: a null or empty text has no shingles, and is its own
component; fewer than ``width`` words make one shingle; repeated rows are equal
sets, a row each; rows of one key with different texts keep a set each, and what
any of them links to is of one component; a null key takes no part in links;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import U64, chunks, cut, mix, release, ship, span_hashes, utf8, words
from obliva.llm.components import components

#: Counters of the frequency sketch, the slices in which it is summed, and how many partial sums one task adds up.  Fixed, whatever the input.
COUNTERS, SLICES, FAN = 1 << 18, 64, 128
#: Bits of a set's parity map (in longs), rows of a block of postings, and pairs that a task compares at once.
LONGS, SIDE, PAIRS = 16, 2048, 1 << 17


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and their n+1 offsets."""
    rows = len(offs) - 1
    s, e, row = words(data, offs)
    w = span_hashes(data, s, e, lower=True) if len(s) else np.zeros(0, U64)
    count = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(count)])
    # A row's shingles begin at all its words but the last width - 1; a shorter row has one, of all its words.
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], n)
    size = np.repeat(np.minimum(count, width), n)
    h = size.astype(U64)
    for k in range(width):
        live = size > k
        h[live] = mix(h[live] * U64(0x9E3779B97F4A7C15) + w[first[live] + k])
    owner = np.repeat(np.arange(rows), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    """(keys, hashes, offsets) of pieces of the batches."""
    for batch in batches:
        data, offs = utf8(batch.column(1))
        for i, j in chunks(offs):
            yield batch.column(0).slice(i, j - i), *shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)


def frequency_levels(docs: DataFrame, width: int) -> bytes:
    """Level (log2 of the count) of each counter: COUNTERS bytes, whatever the input.

    Partial sums are added up in a tree, FAN at a time up to FAN ** 3 partitions.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, h, _ in _batches(batches, width):
            total += np.bincount((h >> U64(46)).astype(np.int64), minlength=COUNTERS)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int64()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], ["slice", "part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"slice": group.column("slice").slice(0, 1), "part": pa.array([group.column("part")[0].as_py() // FAN]), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = docs.mapInArrow(count, "slice int, part long, counts binary")
    for _ in range(2):
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN)).applyInArrow(add, "slice int, part long, counts binary")
    sums = sums.groupBy("slice").applyInArrow(add, "slice int, part long, counts binary")
    got = {r["slice"]: np.log2(np.maximum(np.frombuffer(r["counts"], np.int64), 1)).astype(np.uint8).tobytes() for r in sums.collect()}
    return b"".join(got.get(k, bytes(COUNTERS // SLICES)) for k in range(SLICES))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of its n shingles that a set shares with any set that it links to."""
    return -(-percent * n // 100)


def _set_keys(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set."""
    some = np.flatnonzero(np.diff(offs))
    k1, k2 = np.zeros(len(offs) - 1, U64), np.zeros(len(offs) - 1, U64)
    if len(h):
        k1[some] = np.add.reduceat(mix(h + U64(1)), offs[some])
        k2[some] = np.bitwise_xor.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), offs[some])
    return k1, k2


def parity_maps(h: np.ndarray, offs: np.ndarray, rows: int = 1024) -> np.ndarray:
    """LONGS longs for each row: whether an odd number of its hashes falls on a bit.  ``rows`` of them at once."""
    size = LONGS * 64
    at = (mix(h + U64(3)) % U64(size)).astype(np.int64)
    out = [np.zeros(0, np.int64)]
    for i in range(0, len(offs) - 1, rows):
        part = offs[i : i + rows + 1]
        n = len(part) - 1
        spot = np.repeat(np.arange(n) * size, np.diff(part)) + at[part[0] : part[-1]]
        odd = (np.bincount(spot, minlength=n * size) & 1).astype(np.uint8)
        out.append(np.packbits(odd.reshape(n, size), axis=1).reshape(-1).view(np.int64))
    return np.concatenate(out)


def features(docs: DataFrame, width: int, percent: int, levels: bytes) -> DataFrame:
    """row (a number of its own), doc, n, k1, k2 (of the set), p1, p2 (of the prefix), prefix and bits (parity map of the set) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        number = TaskContext.get().partitionId() << 40
        for keys, h, offs in _batches(batches, width):
            rows = len(offs) - 1
            n = np.diff(offs)
            owner = np.repeat(np.arange(rows), n)
            some = np.flatnonzero(n)
            order = np.lexsort((h, level[(h >> U64(46)).astype(np.int64)], owner))
            length = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
            inside = np.arange(len(h)) - np.repeat(offs[:-1], n) < np.repeat(length, n)
            p = h[order][inside]
            ends = np.concatenate([[0], np.cumsum(length)])
            p1, p2 = np.zeros(rows, U64), np.zeros(rows, U64)
            if len(p):
                p1[some] = np.add.reduceat(mix(p + U64(2)), ends[some])
                p2[some] = np.bitwise_xor.reduceat(mix(p ^ U64(0x2545F4914F6CDD1D)), ends[some])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p.view(np.int64)))
            hashes = [pa.array(x.view(np.int64)) for x in (*_set_keys(h, offs), p1, p2)]
            bits = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * LONGS, pa.int32()), pa.array(parity_maps(h, offs)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + rows)), keys, pa.array(n, pa.int64()), *hashes, prefix, bits], ["row", "doc", "n", "k1", "k2", "p1", "p2", "prefix", "bits"])
            number += rows

    return docs.mapInArrow(run, f"row bigint, doc {_kind(docs)}, n bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, prefix array<bigint>, bits array<bigint>")


def _kind(docs: DataFrame) -> str:
    return docs.schema[0].dataType.simpleString()


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, set (its shingles, sorted, 8 bytes each) of the wanted classes (id, doc, n, k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, offs in _batches(batches, width):
            packed, cuts = h.tobytes(), (offs * 8).tolist()
            k1, k2 = _set_keys(h, offs)
            columns = [pa.array(x.view(np.int64)) for x in (np.diff(offs), k1, k2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["n", "k1", "k2", "set"])

    rows = docs.join(wanted.select(F.col("doc").alias(docs.columns[0])), docs.columns[0], "left_semi")
    sets = rows.mapInArrow(run, "n bigint, k1 bigint, k2 bigint, set binary").groupBy("n", "k1", "k2").agg(F.first("set").alias("set"))
    return sets.join(wanted, ["n", "k1", "k2"]).select("id", "set")


def neighbours(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (token, pos, n, gid) of shingles that more than one group has, with p and f: the group before and the first
    one on the shingle, where the two can link by size and place.

    Sorted by range, so that a frequent shingle lies in several tasks; each of them has a first group of its own.  A row that
    reaches the shingle early has few rarer ones of its own: among near copies it is the least changed, the best hub.
    """
    order = ["token", "pos", "n", "gid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the last row, whose run may go on
        before = first = None  # the row before it, and the first one of its run
        edge = True

        def emit(x: np.ndarray, last: bool) -> pa.RecordBatch:
            nonlocal before, first, edge
            token = x[0]
            same = np.concatenate([[before is not None and before[0] == token[0]], token[1:] == token[:-1]])
            after = np.concatenate([same[1:], [last]])
            head = np.maximum.accumulate(np.where(same, -1, np.arange(len(token))))
            start = np.where(head[None, :] >= 0, x[:, np.maximum(head, 0)], (first if first is not None else x[:, 0])[:, None])
            prior = np.concatenate([(before if before is not None else x[:, 0])[:, None], x[:, :-1]], axis=1)
            shared = same | after
            if edge:
                shared[0] = True
            edge = False
            n = len(token) if last else len(token) - 1

            def fits(o: np.ndarray) -> np.ndarray:
                return same & (np.minimum(x[2] - x[1], o[2] - o[1]) * (100 + percent) >= (x[2] + o[2]) * percent)

            p, f = fits(prior), fits(start) & (start[3] != prior[3])
            before, first = (x[:, -2] if len(token) > 1 else before), start[:, -1]
            keep = np.flatnonzero(shared[:n])
            out = [pa.array(x[k][keep]) for k in range(4)]
            out += [pa.array(o[3][keep], mask=~m[keep]) for o, m in ((prior, p), (start, f))]
            return pa.RecordBatch.from_arrays(out, [*order, "p", "f"])

        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
                if x.shape[1] > 1:
                    yield emit(x, False)
                held = x[:, -1:]
        if held.shape[1]:
            yield emit(held, True)

    return postings.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "token bigint, pos bigint, n bigint, gid bigint, p bigint, f bigint")


def _close(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows with one key that can link by size, place and parity map, and are not of one component already.

    rows: k1, k2 (the key), count (its rows), left, right, pos, id, n, cmin, cmax (components of its members), lo, hi (AND and
    OR of its members' maps).  A pair takes a left row and a right one; a row may be both.  A key's rows are dealt into blocks;
    every two blocks meet in one task.
    """
    parts = F.ceil(F.col("count") / SIDE).cast("int")
    own = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["k1", "k2", "i", "j"]
    dealt = own.select("k1", "k2", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "left", "right", "pos", "id", "n", "cmin", "cmax", "lo", "hi")
    sorted_ = dealt.repartition(*names).sortWithinPartitions(*names)

    def longs(t: pa.Table, name: str) -> np.ndarray:
        return np.asarray(t.column(name).combine_chunks().flatten()).view(U64).reshape(-1, LONGS)

    def heads(t: pa.Table) -> np.ndarray:
        keys = np.stack([t.column(c).to_numpy() for c in names], axis=1)
        return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))

    def ends(new: np.ndarray) -> np.ndarray:
        """Of rows of which some begin a run: where the run of each one ends."""
        at = np.append(np.flatnonzero(new), len(new))
        return np.repeat(at[1:], np.diff(at))

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of a table of whole groups, at most PAIRS pairs at a time.  Rows of one component lie together and are never paired."""
        n, pos, ids, low, high, part, i, j = (t.column(c).to_numpy() for c in ("n", "pos", "id", "cmin", "cmax", "own", "i", "j"))
        left, right = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        lo, hi = longs(t, "lo"), longs(t, "hi")
        begins = np.zeros(len(n), bool)
        begins[heads(t)] = True
        number = np.cumsum(begins)
        one = np.where(low == high, low, -1 - np.arange(len(n)))  # equal only for groups of one and the same component
        order = np.lexsort((one, number))
        same = one[order]
        begins[1:] |= same[1:] != same[:-1]
        after = ends(begins)
        count = ends(np.diff(number, prepend=0) > 0) - after
        total = np.concatenate([[0], np.cumsum(count)])
        rest, across = n - pos, i != j
        k = 0
        while k < len(n):
            z = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS, "right")) - 1)
            c = count[k:z]
            x = order[np.repeat(np.arange(k, z), c)]
            y = order[np.arange(total[z] - total[k]) + np.repeat(after[k:z] - total[k:z] + total[k], c)]
            k = z
            fit = np.minimum(rest[x], rest[y]) * (100 + percent) >= (n[x] + n[y]) * percent
            fit &= (left[x] & right[y]) | (right[x] & left[y])
            fit &= ~across[x] | (part[x] != part[y])
            x, y = x[fit], y[fit]
            near = np.zeros(len(x), bool)
            for c in range(0, len(x), 1 << 14):
                u, v = x[c : c + (1 << 14)], y[c : c + (1 << 14)]
                # The parity maps differ in no more bits than the sets in shingles.
                differ = np.bitwise_count((lo[u] & ~hi[v]) | (lo[v] & ~hi[u])).sum(1).astype(np.int64)
                most = (n[u] + n[v] - differ) // 2
                near[c : c + (1 << 14)] = most * 100 >= (n[u] + n[v] - most) * percent
            if near.any():
                a, b = ids[x[near]], ids[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of one group, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            last = int(heads(t)[-1])
            if last or (rest and any(rest[-1].column(c)[-1] != batch.column(c)[0] for c in names)):
                t = pa.Table.from_batches([*rest, batch])
                last = int(heads(t)[-1])
                yield from whole(t.slice(0, last))
                rest = t.slice(last).combine_chunks().to_batches()
            else:
                rest.append(batch)
        if rest:
            yield from whole(pa.Table.from_batches(rest))

    return sorted_.mapInArrow(run, "a bigint, b bigint")


def prefixes_fit(a: str, b: str, percent: int) -> Column:
    """Whether two sets can still link, given their prefixes.

    A shared shingle outside both prefixes' intersection lies beyond the prefix that ends first in the order.
    """
    c = {f"{x}{y}": F.col(f"{x}.{y}") for x in (a, b) for y in ("n", "prefix")}
    rest = F.greatest(c[f"{a}n"] - F.size(c[f"{a}prefix"]), c[f"{b}n"] - F.size(c[f"{b}prefix"]))
    most = F.least(F.size(F.array_intersect(c[f"{a}prefix"], c[f"{b}prefix"])) + rest, c[f"{a}n"], c[f"{b}n"])
    return most * 100 >= (c[f"{a}n"] + c[f"{b}n"] - most) * percent


def maps_fit(a: str, b: str, percent: int) -> Column:
    """Whether two sets can still link, given their parity maps."""
    differ = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.floor((both - differ) / 2)
    return most * 100 >= (both - most) * percent


def _fitting(pairs: DataFrame, named: DataFrame, percent: int, maps: bool) -> DataFrame:
    """The pairs (a, b) whose prefixes, and maps if asked for, allow a link."""
    own = named.select("id", "n", "prefix", *(["bits"] if maps else []))
    met = pairs.join(own.alias("x"), F.col("a") == F.col("x.id")).join(own.alias("y"), F.col("b") == F.col("y.id"))
    fit = prefixes_fit("x", "y", percent)
    return met.where(maps_fit("x", "y", percent) & fit if maps else fit).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = cut(whole_sets(docs, classes.join(ids, "id").select("id", "doc", "n", "k1", "k2"), width))
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(p.as_py(), U64), np.frombuffer(q.as_py(), U64)
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(common * 100 >= (len(u) + len(v) - common) * percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    out = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
    release(sets)
    return out


def _of_one_key(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a key that has rows of different texts."""
    least = rows.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc", "a")
    return rows.join(least, "doc").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles and component_id of each row: the least key that links reach."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(key), F.col(text).alias("_text" if key == "text" else "text"))
    feats = cut(features(slim, width, percent, frequency_levels(slim, width)))
    taking = feats.where("n > 0 and doc is not null")
    sets = taking.groupBy("n", "k1", "k2").agg(F.min("row").alias("id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    # Groups: classes of one prefix and size, named by their first member.
    grouped = sets.groupBy("n", "p1", "p2").agg(F.min("id").alias("gid"), F.count("*").alias("members"))
    classes = cut(sets.join(grouped, ["n", "p1", "p2"]).select("id", "gid", "members", "n", "k1", "k2"))
    named = cut(feats.select(F.col("row").alias("id"), "doc", "prefix", "bits").join(classes, "id"))
    # Prefixes and maps live on in ``named`` alone.
    wide, feats = feats, cut(feats.select("doc", "n", "k1", "k2").join(classes.select("id", "n", "k1", "k2"), ["n", "k1", "k2"], "left").select("doc", "n", "id"))
    release(wide)
    rows = feats.where("doc is not null and id is not null").select("doc", "id")
    info = named.select("id", "doc", "n", "k1", "k2")
    heads = named.where("id = gid")
    postings = cut(neighbours(heads.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint")), percent))

    # First pass: neighbours and the first group on each shingle, and every member with the first of its group.
    pairs = postings.select("gid", F.explode(F.array("p", "f")).alias("o")).where("o is not null")
    pairs = pairs.select(F.least("gid", "o").alias("a"), F.greatest("gid", "o").alias("b")).distinct()
    inside = named.where("id <> gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    first = cut(_fitting(pairs.unionByName(inside), named, percent, True))
    links = cut(verified(first, info, slim, width, percent).unionByName(_of_one_key(rows)))
    comps = components(links)

    # Second pass: group pairs that share a shingle and are not of one component already.
    members = named.select("id", "gid", "members", "n", "bits").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = cut(members)
    alone = members.where("members = 1").select("gid", "members", F.col("component").alias("cmin"), F.col("component").alias("cmax"), F.col("bits").alias("lo"), F.col("bits").alias("hi"))
    both = [f(F.col("bits")[k]).alias(f"{name}{k}") for name, f in (("lo", F.bit_and), ("hi", F.bit_or)) for k in range(LONGS)]
    several = members.where("members > 1").groupBy("gid").agg(F.first("members").alias("members"), F.min("component").alias("cmin"), F.max("component").alias("cmax"), *both)
    several = several.select("gid", "members", "cmin", "cmax", *[F.array(*[f"{name}{k}" for k in range(LONGS)]).alias(name) for name in ("lo", "hi")])
    groups = cut(alone.unionByName(several))
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9)).cast("bigint")
    # Sets that link lie in one band of sizes or in neighbouring ones: a row meets its own band, and visits the one above.
    met = postings.select("token", "pos", "n", "gid").join(groups.select("gid", "cmin", "cmax"), "gid").withColumn("band", band)
    met = met.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).select("token", (F.col("band") + F.col("up")).alias("k2"), (F.col("up") == 0).alias("right"), "pos", "n", "gid", "cmin", "cmax")
    open_ = met.groupBy("token", "k2").agg(F.min("cmin").alias("least"), F.max("cmax").alias("most"), F.count("*").alias("count"), F.max("right").alias("home")).where("least <> most and home").select("token", "k2", "count")
    shared = met.join(open_, ["token", "k2"]).join(groups.select("gid", "lo", "hi"), "gid")
    near = cut(_close(shared.select(F.col("token").alias("k1"), "k2", "count", F.lit(True).alias("left"), "right", "pos", F.col("gid").alias("id"), "n", "cmin", "cmax", "lo", "hi"), percent).distinct())
    fit = cut(_fitting(near, named, percent, False).join(groups.select(F.col("gid").alias("a"), F.col("members").alias("m")), "a").join(groups.select(F.col("gid").alias("b"), F.col("members").alias("w")), "b"))

    # Groups of one member are pairs already; the others expand, block by block, and meet within themselves too.
    def expanded(x: DataFrame, left: bool, right: bool) -> DataFrame:
        c = F.col("component")
        return x.join(members, "gid").select("k1", "k2", "count", F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(0).cast("bigint").alias("pos"), "id", "n", c.alias("cmin"), c.alias("cmax"), F.col("bits").alias("lo"), F.col("bits").alias("hi"))

    wide = fit.where("m > 1 or w > 1").select(F.col("a").alias("k1"), F.col("b").alias("k2"), (F.col("m") + F.col("w")).alias("count"))
    mixed = groups.where("members > 1 and cmin <> cmax").select("gid", F.col("gid").alias("k1"), F.lit(-1).cast("bigint").alias("k2"), F.col("members").alias("count"))
    dealt = expanded(wide.withColumn("gid", F.col("k1")), True, False).unionByName(expanded(wide.withColumn("gid", F.col("k2")), False, True)).unionByName(expanded(mixed, True, True))
    more = fit.where("m = 1 and w = 1").select("a", "b").unionByName(_close(dealt, percent)).distinct().join(first, ["a", "b"], "left_anti")
    rest = cut(more)
    if not rest.isEmpty():
        links = cut(links.unionByName(verified(rest, info, slim, width, percent)))
        comps = components(links)

    # A component is named by the least key of all its rows.
    of = rows.groupBy("id").agg(F.min("doc").alias("doc")).join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = cut(of.select("id", "doc", "component"))
    names = of.groupBy("component").agg(F.min("doc").alias("component_id"))
    out = feats.join(of.join(names, "component").select("id", "component_id"), "id", "left")
    lonely = F.col("id").isNull() | F.col("doc").isNull()
    out = cut(out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(lonely, F.col("doc")).otherwise(F.col("component_id")).alias("component_id")))
    release(feats, classes, named, postings, first, links, comps, members, groups, near, fit, rest, of)
    return out
