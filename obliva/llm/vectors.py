"""Approximate nearest neighbours by a permutation index, and near-duplicates by a subspace pigeonhole join.

Defined results of both: a vector that is null, zero, of another length than
the index's, or that holds null or non-finite components takes no part; ties go
to the smaller id; rows are vectors of their own, whether they repeat or share
an id with a different vector; null ids take no part; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.llm.common import cut, release, ship
from obliva.llm.components import components

#: Permutation index: pivots, how many of them order a vector, the lists a vector is posted in and a query walks (of PIVOTS), share of the rows that is reranked.
PIVOTS, ORDERED, POSTED, WALKED, RERANKED = 256, 128, 2, 112, 0.14
#: Vectors that pivots and a query's footrule limit are taken from; postings of one list, and queries that walk it, in one task.
SAMPLE, LIST, QUERIES = 2048, 8192, 8192
#: Pigeonhole join: blocks of the rotated vector, most pivots of a block, and rows of a cell on either side of a task.
BLOCKS, MOST, SIDE = 4, 8192, 4096
#: Steps of a block's values in what is dealt: 16 bits over [-1, 1].
STEPS = 32767
#: Room for rounding: of squared distances of parts of unit vectors, in single precision and of 16-bit values.
SLACK = 1e-4


def usable(v: Column) -> Column:
    def finite(x: Column) -> Column:
        return F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))

    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def sampled(vectors: DataFrame, most: int, *by: str) -> np.ndarray:
    """Up to ``most`` vectors of the commonest length among the rows of least hash of some columns: a bounded fetch."""
    rows = vectors.select("v", *by).orderBy(F.xxhash64(*by), *by).limit(most).collect()
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r["v"]) for r in rows]
    width = max(set(sizes), key=lambda s: (sizes.count(s), s))
    return np.array([r["v"] for r in rows if len(r["v"]) == width], float)


def permutation(x: np.ndarray, p: np.ndarray, ordered: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ordered`` nearest pivots of each row, nearest first, and the rank of every pivot (``ordered``: not among them)."""
    # einsum sums each product by itself, so that a vector's order depends on nothing else in the batch.
    d = (p * p).sum(1)[None, :] - 2 * np.einsum("nd,kd->nk", x, p)
    order = np.argsort(d, axis=1, kind="stable")[:, :ordered]
    rank = np.full(d.shape, ordered, np.int16)
    np.put_along_axis(rank, order, np.arange(ordered, dtype=np.int16)[None, :], 1)
    return order, rank


def closeness(ranks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row of ranks to an order of pivots: a constant less half the footrule, with absent pivots at rank len(order)."""
    n = len(order)
    return (n - np.maximum(ranks[:, order], np.arange(n, dtype=np.int16)[None, :])).sum(1, dtype=np.int64)


class List:
    """The postings of one pivot in one task: (row, id, vector, posts); equal vectors are one class."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, posts: np.ndarray, p: np.ndarray, ordered: int):
        x = np.ascontiguousarray(x + 0.0)  # one zero only
        _, first, of = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((rows, ids, of))
        self.rows, self.ids, self.x, self.posts = rows[order], ids[order], x[first], posts[first]
        self.size = np.bincount(of, minlength=len(first))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.of = dict(zip(rows.tolist(), of.tolist(), strict=True))
        self.ranks = permutation(self.x, p, ordered)[1]

    def search(self, row: int, q: np.ndarray, order: np.ndarray, pivot: int, walked: int, limit: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ids and distances of the k nearest postings that the query has not met in a list walked before."""
        place = np.full(self.ranks.shape[1], len(order), np.int64)
        place[order[:walked]] = np.arange(walked)
        near = np.flatnonzero((closeness(self.ranks, order) >= limit) & (place[self.posts].min(1) == place[pivot]))
        d = np.sqrt(((self.x[near] - q) ** 2).sum(1))
        size = self.size[near].copy()
        own = self.of.get(row)
        if own is not None:
            size[near == own] -= 1
        near, d, size = near[size > 0], d[size > 0], size[size > 0]
        if not len(near):
            return self.rows[:0], self.ids[:0], d
        # Classes up to the distance of the k-th row give their least ids.
        by = np.argsort(d, kind="stable")
        full = np.searchsorted(np.cumsum(size[by]), k)
        taken = by[: np.searchsorted(d[by], d[by[min(full, len(by) - 1)]], "right")]
        at = []
        for c in near[taken]:
            m = np.arange(self.start[c], min(self.start[c] + k + 1, self.start[c + 1]))
            at.append(m[self.rows[m] != row][:k])
        d = np.repeat(d[taken], [len(m) for m in at])
        at = np.concatenate(at)
        best = np.lexsort((self.rows[at], self.ids[at], d))[:k]
        return self.rows[at[best]], self.ids[at[best]], d[best]


def nearest(vectors: DataFrame, is_query: Column, *, key: str, vector: str, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every query row, its own row left out.

    A vector is posted in the inverted files of its POSTED nearest pivots, dealt by pivot in one shuffle (long lists in
    parts).  A query walks the lists of its nearest pivots; what is as close in footrule as the nearest RERANKED of a
    sample is reranked by distance, ties with the limit included.  A query that finds fewer than k that way, of a table
    that has them, is held against all lists without a limit.  Query rows that share an id have a ranking each.
    """
    ship(vectors.sparkSession)
    good = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = cut(good.withColumn("row", F.monotonically_increasing_id()))
    # By id and vector: the pivots are the same however the rows lie in files.
    some = sampled(good, SAMPLE, "id", "v")
    p = np.array(list(dict.fromkeys(map(tuple, some.tolist())))[:PIVOTS], float)
    out = "query_id long, rank int, vec_id long, score double"
    if not len(p):
        return good.sparkSession.createDataFrame([], out)
    width = p.shape[1]
    ordered, posted, walked = min(ORDERED, len(p)), min(POSTED, len(p)), -(-WALKED * len(p) // PIVOTS)
    sample_ranks = permutation(some, p, ordered)[1]
    at_least = min(len(some) - 1, max(int(RERANKED * len(some)), 4 * k))
    good = good.where(F.size("v") == width)

    def matrix(batch, name: str = "v") -> np.ndarray:
        return np.asarray(batch.column(name).combine_chunks().flatten().cast(pa.float64()) if isinstance(batch, pa.Table) else batch.column(name).flatten().cast(pa.float64())).reshape(-1, width)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts = permutation(matrix(batch), p, ordered)[0][:, :posted]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(posts) + 1) * posted, pa.int32()), pa.array(posts.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "posts"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = permutation(matrix(batch), p, ordered)[0]
            limits = [int(-np.partition(-closeness(sample_ranks, o), at_least)[at_least]) for o in order]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * ordered, pa.int32()), pa.array(order.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(limits, pa.int64())], [*batch.schema.names, "order", "limit"])

    kind = good.schema["v"].dataType.simpleString()
    base = good.select("row", "id", "v").mapInArrow(post, f"row long, id long, v {kind}, posts array<int>").withColumn("pivot", F.explode("posts"))
    # At most PIVOTS rows of two numbers.
    lengths = {r["pivot"]: -(-r["count"] // LIST) for r in base.groupBy("pivot").count().collect()}

    def by_pivot(counts: dict[int, int]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("pivot")), F.lit(1)) if counts else F.lit(1)

    parts = by_pivot(lengths)
    base = base.withColumn("part", F.pmod(F.xxhash64("row"), parts))
    asked = cut(good.where("q").select("row", "id", "v").mapInArrow(ask, f"row long, id long, v {kind}, order array<int>, limit long"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            pivot = left.column("pivot")[0].as_py()
            posts = np.asarray(left.column("posts").combine_chunks().flatten()).reshape(-1, posted)
            held = List(left.column("row").to_numpy(), left.column("id").to_numpy(), matrix(left), posts, p, ordered)
            orders = np.asarray(right.column("order").combine_chunks().flatten()).reshape(-1, ordered)
            for row, i, q, order, n, limit in zip(right.column("row").to_pylist(), right.column("id").to_pylist(), matrix(right), orders, right.column("walked").to_pylist(), right.column("limit").to_pylist(), strict=True):
                rows, ids, d = held.search(row, q, order, pivot, n, limit, k)
                for x, y in zip(got, ([row] * len(ids), [i] * len(ids), rows.tolist(), ids.tolist(), d.tolist()), strict=True):
                    x += y
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_row", "query_id", "row", "vec_id", "score"), got, kinds, strict=True)})

    def numbers(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)

    def found(queries: DataFrame, lists: Column) -> DataFrame:
        walking = queries.withColumn("pivot", F.explode(lists))
        # Both sides of a list go in parts, and every part of one meets every part of the other.
        askers = by_pivot({r["pivot"]: -(-r["count"] // QUERIES) for r in walking.groupBy("pivot").count().collect()})
        dealt = walking.withColumn("asker", F.pmod(F.xxhash64("row"), askers)).withColumn("part", F.explode(numbers(parts)))
        held = base.withColumn("asker", F.explode(numbers(askers)))
        keys = ["pivot", "part", "asker"]
        met = held.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, "query_row long, query_id long, row long, vec_id long, score double")
        met = met.dropDuplicates(["query_row", "row"])
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row")))
        return ranked.where(F.col("rank") <= k)

    ranked = cut(found(asked.withColumn("walked", F.lit(walked)), F.slice("order", 1, walked)))
    enough = min(k, good.count() - 1)
    full = ranked.groupBy("query_row").count().where(F.col("count") >= enough).select(F.col("query_row").alias("row"))
    short = cut(asked.join(full, "row", "left_anti"))
    if enough > 0 and not short.isEmpty():
        everywhere = F.array(*[F.lit(i) for i in range(len(p))])
        rest = found(short.withColumn("walked", F.lit(0)).withColumn("limit", F.lit(-1).cast("long")), everywhere)
        ranked = ranked.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(rest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated.  einsum sums each product by itself, so a vector's result depends on nothing else in the batch."""
    return np.einsum("nd,kd->nk", x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None], turn)


def _split(width: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), min(BLOCKS, width))


def _budget(least: float) -> float:
    """Squared distance of unit vectors of that cosine, with room for rounding."""
    return 2 - 2 * least + 1e-9


def block_pivots(some: np.ndarray, turn: np.ndarray, budget: float, most: int) -> list[np.ndarray]:
    """Of each block, up to ``most`` directions of the sample's parts, all of the block's mean norm, four radii apart at least.

    With one norm for all, no pivot near the centre takes more than its share.
    """
    y = _rotated(some, turn).astype(np.float32)
    out = []
    for dims in _split(y.shape[1]):
        own = y[:, dims]
        norm = np.sqrt((own * own).sum(1))
        own = own[norm > 0] / norm[norm > 0, None] * np.float32(np.sqrt(len(dims) / y.shape[1]))
        if not len(own):
            own = np.eye(1, len(dims), dtype=np.float32)
        apart = 16 * budget * len(dims) / y.shape[1]
        open_ = np.ones(len(own), bool)
        kept = []
        for i in range(len(own)):
            if open_[i] and len(kept) < most:
                kept.append(i)
                open_[i:] &= ((own[i:] - own[i]) ** 2).sum(1) >= apart
        out.append(own[kept])
    return out


def _cells(x: np.ndarray, turn: np.ndarray, pivots: list[np.ndarray], budget: float):
    """(block, its values, home, row, cell) of every cell of a block's pivots that a row is at home in or visits.

    Of two rows within the radius in different cells, one is within half of it of the plane between the cells' pivots.
    """
    y = _rotated(x, turn).astype(np.float32)
    for b, dims in enumerate(_split(x.shape[1])):
        own, p = y[:, dims], pivots[b]
        half = np.sqrt(budget * len(dims) / x.shape[1]) / 2 * (1 + 1e-4) + SLACK
        square = (p * p).sum(1)
        widest = 2 * np.sqrt(square.max())
        homes, rows, cells = [], [], []
        for k in range(0, len(own), 1024):
            part = own[k : k + 1024]
            d = square[None, :] - 2 * (part @ p.T)
            home = d.argmin(1)
            over = d - d[np.arange(len(part)), home][:, None]
            row, cell = np.nonzero(over <= 2 * half * widest + SLACK)
            gap = np.sqrt(((p[home[row]] - p[cell]) ** 2).sum(1))
            near = over[row, cell] <= 2 * half * gap + SLACK
            homes.append(home)
            rows.append(row[near] + k)
            cells.append(cell[near])
        yield b, own, *(np.concatenate(z) for z in (homes, rows, cells))


def _pairs(own: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the cell's rows that are close in the block, i at home and on the left side, j on the right; of two at home, i < j."""
    square = (own * own).sum(1)
    rows, others = np.flatnonzero(left & home), np.flatnonzero(right)
    for a in range(0, len(rows), 512):
        r = rows[a : a + 512]
        d = square[r][:, None] + square[others][None, :] - 2 * own[r] @ own[others].T
        i, j = np.nonzero((d <= limit + SLACK) & ((r[:, None] < others[None, :]) | ~home[others][None, :]))
        yield r[i], others[j]


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i and j; root holds each element's least one."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def near_duplicates(vectors: DataFrame, *, key: str, vector: str, label: str, least: float = 0.98) -> DataFrame:
    """key, n_links, component_id, kept of every row: links join vectors of one label with cosine >= ``least``.

    Equal vectors of a label are one class.  Unit vectors are rotated and split into BLOCKS blocks; two that link are within a
    block's share of the squared distance in one block at least.  Each block is a range join: its values lie in the cells of
    pivots drawn from the table (about twice the square root of its rows, MOST at most), and visit the cells within half the
    radius.  First ids and block values are dealt, and a cell tells which of its rows have a close partner; only these fetch
    their vectors, and are compared whole.  Cells of more than SIDE rows are dealt on both sides.  Counts of links are summed
    by class, so that no list of pairs is ever written.  A pair counts in the first block that has it close.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")))
    good = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = cut(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    budget = _budget(least)
    kind, values = (rows.schema[c].dataType.simpleString() for c in ("label", "v"))
    widths = {r["width"]: r["count"] for r in classes.groupBy("width").count().collect()}
    turns = {w: rotation(w) for w in widths}
    most = {w: min(MOST, int(np.ceil(2 * np.sqrt(n)))) for w, n in widths.items()}
    shared = spark.sparkContext.broadcast({w: block_pivots(sampled(classes.where(F.col("width") == w), most[w], "row"), turns[w], budget, most[w]) for w in widths})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for w in set(table.column("width").to_pylist()):
                part = table.filter(pc.equal(table.column("width"), w)).combine_chunks()
                x = np.asarray(part.column("v").combine_chunks().flatten().cast(pa.float64())).reshape(-1, w)
                for b, own, home, row, cell in _cells(x, turns[w], shared.value[w], budget):
                    # Cells come row by row, so a row's visits lie side by side.
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
                    visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell.astype(np.int32))).take(pa.array(row))
                    block = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * own.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(np.rint(own * STEPS).astype(np.int16)))]).cast(pa.binary()).take(pa.array(row))
                    taken = part.select(["label", "row"]).take(pa.array(row)).combine_chunks()
                    n = len(row)
                    out = pa.table({"width": pa.array(np.full(n, w, np.int32)), "block": pa.array(np.full(n, b, np.int32)), "cell": pa.array(cell.astype(np.int32)), "label": taken.column("label"), "row": taken.column("row"), "own": pa.array(home[row].astype(np.int32)), "visits": visits, "values": block})
                    yield from out.to_batches()

    place = ["label", "width", "block", "cell"]
    dealt = cut(classes.select("label", "row", "width", "v").mapInArrow(deal, f"width int, block int, cell int, label {kind}, row long, own int, visits array<int>, values binary"))

    def split(cells: DataFrame) -> DataFrame:
        """The rows of cells that can have a pair, dealt into parts: the left ones with every part of the right ones."""
        at_home = F.col("own") == F.col("cell")
        full = cells.groupBy(*place).agg(F.count("*").alias("rows"), F.count_if(at_home).alias("homes")).where("homes > 0 and rows > 1")
        full = full.select(*place, F.ceil(F.col("homes") / SIDE).cast("int").alias("lefts"), F.ceil(F.col("rows") / SIDE).cast("int").alias("rights"))
        met = cells.join(full, place)
        i, j = F.pmod(F.xxhash64("row"), F.col("lefts")).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("rights")).cast("int")
        # A row is right in (every i, its j), and at home left in (its i, every j).
        as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda x: F.struct(x.alias("i"), F.col("j").alias("j")))
        as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda x: F.struct(F.col("i").alias("i"), x.alias("j")))
        met = met.withColumn("i", i).withColumn("j", j)
        spots = F.when(at_home, F.array_distinct(F.concat(as_right, as_left))).otherwise(as_right)
        met = met.withColumns({"mine_i": F.col("i"), "mine_j": F.col("j"), "spot": F.explode(spots)})
        left, right = at_home & (F.col("mine_i") == F.col("spot.i")), F.col("mine_j") == F.col("spot.j")
        return met.withColumns({"left": left, "right": right, "at_i": F.col("spot.i"), "at_j": F.col("spot.j")}).drop("i", "j", "mine_i", "mine_j", "spot", "lefts", "rights")

    def opened(t: pa.Table):
        t = t.sort_by("row")
        width, block = (t.column(c)[0].as_py() for c in ("width", "block"))
        dims = _split(width)[block]
        own, cell = t.column("own").to_numpy(), t.column("cell")[0].as_py()
        left, right = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        values = np.frombuffer(b"".join(t.column("values").to_pylist()), np.int16).reshape(-1, len(dims)).astype(np.float32) / STEPS
        return t, width, block, cell, own, left, right, values, budget * len(dims) / width + SLACK / 10 * np.sqrt(len(dims))

    def alive(t: pa.Table) -> pa.Table:
        """The rows that have a close partner in this part of a cell."""
        t, _, _, cell, own, left, right, values, limit = opened(t)
        some = np.zeros(len(own), bool)
        for i, j in _pairs(values, own == cell, left, right, limit):
            some[i] = some[j] = True
        return t.filter(pa.array(some)).select([*place, "row", "own", "visits", "values"])

    keys = [*place, "at_i", "at_j"]
    shape = f"label {kind}, width int, block int, cell int, row long, own int, visits array<int>, values binary"
    close = cut(split(dealt).groupBy(*keys).applyInArrow(alive, shape).dropDuplicates([*place, "row"]))
    release(dealt)

    def link(t: pa.Table) -> pa.Table:
        t, width, block, cell, own, left, right, values, limit = opened(t)
        rows_, n = t.column("row").to_numpy(), t.column("n").to_numpy()
        x = np.asarray(t.column("v").combine_chunks().flatten().cast(pa.float64())).reshape(-1, width)
        y = _rotated(x, turns[width])
        norm = np.sqrt(np.einsum("nd,nd->n", x, x))
        visits = t.column("visits").combine_chunks()
        seen = (np.repeat(np.arange(len(rows_)), np.diff(np.asarray(visits.offsets))) << 32) + np.asarray(visits.flatten())
        split_, limits = _split(width), [budget * len(d) / width for d in _split(width)]
        links, root = np.zeros(len(rows_), np.int64), np.arange(len(rows_))
        for i, j in _pairs(values, own == cell, left, right, limit):
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                gap = (y[u] - y[v]) ** 2
                near = np.stack([gap[:, e].sum(1) <= m for e, m in zip(split_, limits, strict=True)], axis=1)
                met = near[:, block] & ~near[:, :block].any(1)
                u, v = u[met], v[met]
                cosine = np.einsum("nd,nd->n", x[u], x[v]) / (norm[u] * norm[v])
                good_ = cosine >= least
                u, v = u[good_], v[good_]
                # Two rows that visit each other's cells count in the lesser of the two.
                twice = (own[v] < cell) & np.isin((u << 32) + own[v], seen)
                u, v = u[~twice], v[~twice]
                np.add.at(links, u, n[v])
                np.add.at(links, v, n[u])
                _join(root, u, v)
        some = np.flatnonzero(links)
        return pa.table({"row": pa.array(rows_[some], pa.int64()), "to": pa.array(rows_[root[some]], pa.int64()), "links": pa.array(links[some], pa.int64())})

    whole = split(close).join(classes.select("row", "n", "v"), "row")
    found = cut(whole.select(*keys, "row", "own", "visits", "values", "left", "right", "n", "v").groupBy(*keys).applyInArrow(link, "row long, to long, links long"))
    release(close)
    totals = found.groupBy("row").agg(F.sum("links").alias("links"))
    edges = found.where("row <> to").select(F.col("row").alias("a"), F.col("to").alias("b"))
    linked = classes.select("label", "v", "id", "row", "n").join(totals, "row", "left").join(components(edges), F.col("row") == F.col("node"), "left").withColumn("component", F.coalesce("component", "row"))
    linked = cut(linked.select("label", "v", "id", "n", "links", "component"))
    names = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    final = linked.join(names, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # Rows that take no part meet no class: null labels never join, and their vectors are not among the classes'.
    out = rows.join(final, ["label", "v"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
