"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text is a sequence of tokens: runs of letters, of digits, and of other marks.
Features are its token unigrams and bigrams, hashed into ``WIDTH`` buckets; a
token equal to the one or two before it also counts as "same again", which is
what repeated words have in common.  A feature's value is its share of the text's features
times ``SCALE``.  Training takes a bounded sample of the labelled rows (``most``
of them, those with the least key hash, whole texts); scoring is a sparse dot
product over every row.

Defined results: null and empty texts have no features and get the bias's
score; null labels are left out of training; with no labelled rows the score is
0.5 everywhere; of labelled rows that share a key, the least text is learnt from; repeated rows are scored each by itself; a null key is scored too; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import U64, chunks, mix, ship, span_hashes, utf8

WIDTH, SCALE = 1 << 18, 16.0
#: Labelled rows that training takes at most, and its passes over them.
MOST, PASSES = 6000, 6
#: Parameters of the update: learning rate, smoothing, L1 and L2.
RATE, SMOOTH, L1, L2 = 0.3, 1.0, 0.05, 0.02
THRESHOLD = 0.7

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, row after row, and the n+1 offsets of the rows."""
    rows = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1]
    s = np.flatnonzero(change)
    e = np.append(s[1:], len(data))
    real = kind[s] > 0
    s, e = s[real], e[real]
    row = np.searchsorted(offs, s, "right") - 1
    h = span_hashes(data, s, e)
    # Every token gives four places: itself, itself after the token before, and same again at distance one and two.
    out = np.full((len(h), 4), -1, np.int64)
    bucket = U64(64 - 18)
    out[:, 0] = (mix(h) >> bucket).astype(np.int64)
    if len(h) > 1:
        near = row[1:] == row[:-1]
        two = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) >> bucket
        out[1:, 1] = np.where(near, two.astype(np.int64), -1)
        out[1:, 2] = np.where(near & (h[1:] == h[:-1]), 1, -1)
    if len(h) > 2:
        out[2:, 3] = np.where((row[2:] == row[:-2]) & (h[2:] == h[:-2]), 2, -1)
    there = out >= 0
    return out[there], np.concatenate([[0], np.cumsum(np.bincount(row, there.sum(1), rows))]).astype(np.int64)


def _examples(df: DataFrame) -> DataFrame:
    """at, y, bucket, value of the labelled rows (at, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for i, j in chunks(offs):
                f, at = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                found = [np.unique(f[a:b], return_counts=True) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([k.astype(np.int32) for k, _ in found], pa.list_(pa.int32())),
                        pa.array([(c * (SCALE / max(1, c.sum()))).astype(np.float32) for _, c in found], pa.list_(pa.float32())),
                    ],
                    ["at", "y", "bucket", "value"],
                )

    return df.mapInArrow(run, "at bigint, y int, bucket array<int>, value array<float>")


def learn(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights, the bias last, by per-coordinate FTRL-proximal over (y, buckets, values)."""
    z, n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)

    def weights(k: np.ndarray | slice) -> np.ndarray:
        zk = z[k]
        l1 = np.full(len(zk), L1)
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((SMOOTH + np.sqrt(n[k])) / RATE + L2))

    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in rng.permutation(len(examples)):
            y, k, v = examples[i]
            k, v = np.append(k, WIDTH), np.append(v, 1.0)
            w = weights(k)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / RATE
            z[k] += g - sigma * w
            n[k] += g * g
    return weights(slice(None))


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label", most: int = MOST) -> bytes:
    """float64 weights learnt from at most ``most`` rows of ``labelled``."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(label).isNotNull()).select(F.xxhash64(F.col(key)).alias("at"), F.col(label).cast("int").alias("y"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            # Views of the batch: as Python numbers the features would take ten times the room.
            k, v = b.column(2), b.column(3)
            ends = k.offsets.to_numpy().tolist()
            cuts = [slice(i, j) for i, j in zip(ends, ends[1:], strict=False)]
            buckets, values = k.values.to_numpy(), v.values.to_numpy()
            got += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (buckets[c] for c in cuts), (values[c] for c in cuts), strict=True)
        got.sort(key=lambda x: (x[0], x[1], len(x[2]), x[2].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([learn([x[1:] for x in got]).tobytes()], pa.binary())], ["weights"])

    # Bounded by ``most`` rows: one task holds their features.
    found = _examples(rows).repartition(1).mapInArrow(run, "weights binary").collect()
    return bytes(found[0]["weights"]) if found else bytes(8 * (WIDTH + 1))


def sample(labels: DataFrame, docs: DataFrame, label: str, *, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The labelled rows (key, text, label) of the ``most`` least key hashes that are not held out."""
    chosen = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull()).select(key, F.col(label).alias("label")).orderBy(F.xxhash64(key), key).limit(most)
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)  # at most ``most`` rows of two numbers
    # Of rows that share a labelled key, the one of the least text is learnt from: the bound holds for rows too.
    return rows.groupBy(key, "label").agg(F.min("text").alias(text))


def held_out(key: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score(docs: DataFrame, weights: bytes, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the key by default) and ``score`` of each row."""
    ship(docs.sparkSession)
    keep = [c for c in (keep or [key]) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    slim = docs.select(F.col(text).alias("text to score"), *keep)
    fields = slim.drop("text to score").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float64)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for i, j in chunks(offs):
                f, at = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.diff(at)
                dot = np.zeros(j - i)
                some = np.flatnonzero(n)
                if len(some):
                    dot[some] = np.add.reduceat(w[f], at[some]) * (SCALE / n[some])
                p = 1 / (1 + np.exp(-np.clip(dot + w[-1], -35, 35)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p)], [*part.schema.names[1:], "score"])

    return slim.mapInArrow(run, fields.add("score", "double"))
