"""Tokens of a real vocabulary: longest match with byte fallback, special tokens, label masks.

A vocabulary is data: pieces with ids, an id for each of the 256 bytes, special ids.  Encoding takes the longest piece at
each place and spells what no piece covers by its UTF-8 bytes, so that decoding gives every text back.  A batch of texts
is one array of code points: all places are looked up at once, by hashes of their windows, and the places that a walk from
the first one reaches are found by doubling jumps.  A library's tokeniser takes the same place through ``load``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from obliva.operators import prep
from obliva.sources.shared import ship

#: Pieces that a vocabulary may have: it is sent to every executor.
MOST = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id from ``first`` on, bytes by id from ``byte`` on, special ids; a special token stands in no text."""

    pieces: tuple[str, ...]
    first: int = 259
    byte: int = 3
    pad: int = 0
    bos: int | None = 1
    eos: int | None = 2

    @classmethod
    def of(cls, pieces: Iterable[str], **ids: int | None) -> Vocabulary:
        """The distinct pieces in code point order; empty ones are left out."""
        out = sorted({p for p in pieces if p}, key=lambda p: p.encode())
        if len(out) > MOST:
            raise ValueError(f"more than {MOST} pieces")
        return cls(tuple(out), **ids)

    @classmethod
    def of_table(cls, rows: DataFrame, piece: str = "piece", **ids: int | None) -> Vocabulary:
        """The pieces of a table, of which more than MOST are refused."""
        return cls.of([r[0] for r in rows.select(piece).distinct().limit(MOST + 2).collect()], **ids)

    @property
    def name(self) -> str:
        """A name that another vocabulary does not have."""
        return hashlib.sha256(repr(self).encode()).hexdigest()

    @property
    def specials(self) -> list[int]:
        return [x for x in (self.pad, self.bos, self.eos) if x is not None]


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points end to end, and the offsets of the texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lens = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])


class _Windows:
    """Hashes of windows of an array of code points: equal windows anywhere have equal ones."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, b, U64)])) for b in (_BASE, _INVERSE))
        x = (points.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95)
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum((x ^ (x >> U64(31))) * up[:n])])

    def hash(self, starts: np.ndarray, lens: np.ndarray | int) -> np.ndarray:
        return (self.total[starts + lens] - self.total[starts]) * self.down[starts]


class Matcher:
    """One worker's handle on a vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        points, offs = _points(pa.array(vocabulary.pieces, pa.string()))
        lens = np.diff(offs)
        hashes = _Windows(points).hash(offs[:-1], lens)
        self.by_length = {}
        for n in sorted(set(lens.tolist()), reverse=True):
            own = np.flatnonzero(lens == n)
            own = own[np.argsort(hashes[own])]
            self.by_length[n] = hashes[own], own
        self.points, self.offs = points, offs
        # Every id's bytes, for decoding: bytes, pieces, and nothing for special ids.
        spelt = {vocabulary.byte + b: bytes([b]) for b in range(256)} | {vocabulary.first + i: p.encode() for i, p in enumerate(vocabulary.pieces)}
        spelt |= {i: b"" for i in vocabulary.specials}
        self.spelt = [spelt.get(i, b"") for i in range(max(spelt) + 1)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, special ones left to the caller."""
        points, offs = _points(texts)
        n = len(points)
        ends = np.repeat(offs[1:], np.diff(offs))
        best, piece = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        windows = _Windows(points)
        for size, (hashes, own) in self.by_length.items():
            i = np.flatnonzero((best == 0) & (np.arange(n) + size <= ends))
            h = windows.hash(i, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            i, which = i[hit], own[at[hit]]
            # Equal hashes are only a sign: the code points decide.
            for k in range(size):
                same = points[i + k] == self.points[self.offs[which] + k]
                if not same.all():
                    i, which = i[same], which[same]
            best[i], piece[i] = size, which
        # The places that steps from the start of the array reach: after k rounds those within 2^k steps.
        jump = np.append(np.arange(n) + np.maximum(best, 1), n)
        reached = np.zeros(n + 1, bool)
        reached[0] = True
        while True:
            to = jump[reached]
            if reached[to].all():
                break
            reached[to] = True
            jump = jump[jump]
        at = np.flatnonzero(reached[:n])
        known = piece[at] >= 0
        odd = points[at[~known]]
        sizes = np.ones(len(at), np.int64)
        sizes[~known] = 1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF)
        first = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int32)
        spelt = np.ones(len(ids), bool)
        ids[first[known]] = piece[at[known]] + self.v.first
        spelt[first[known]] = False
        ids[spelt] = np.frombuffer(odd.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int32) + self.v.byte
        owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[at]
        counts = np.bincount(owner, sizes, len(offs) - 1).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of the ids, special and unknown ones left out."""
        n = len(self.spelt)
        return pa.array([None if row is None else b"".join(self.spelt[i] for i in row if 0 <= i < n).decode("utf-8", "replace") for row in ids.to_pylist()], pa.string())


#: A worker's handles by name: each is loaded once.
_LOADED: dict[str, object] = {}


def handle(name: str, load: Callable[[], object]) -> object:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def with_ids(df: DataFrame, columns: dict[str, str], vocabulary: Vocabulary, load: Callable[[], object] | None = None, name: str = "") -> DataFrame:
    """df with, for each new name, the ids of a text column; null texts have none.

    load: gives a handle with ``encode`` (an Arrow array of texts to one of id lists) in place of the vocabulary's own.
    """
    sc = df.sparkSession.sparkContext
    ship(df.sparkSession)
    sent = sc.broadcast(vocabulary)  # MOST pieces at most
    name = name or vocabulary.name
    make = load or (lambda: Matcher(sent.value))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from obliva.operators import tokens

        own = tokens.handle(name, make)
        for batch in batches:
            arrays = list(batch.columns) + [own.encode(batch.column(c)) for c in columns.values()]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *columns])

    return df.mapInArrow(encode, StructType([*df.schema.fields, *[StructField(c, ArrayType(IntegerType())) for c in columns]]))


def with_text(df: DataFrame, columns: dict[str, str], vocabulary: Vocabulary) -> DataFrame:
    """df with, for each new name, the text of a column of ids."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    name = vocabulary.name

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from obliva.operators import tokens

        own = tokens.handle(name, lambda: Matcher(sent.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [own.decode(batch.column(c)) for c in columns.values()], [*batch.schema.names, *columns])

    return df.mapInArrow(decode, StructType([*df.schema.fields, *[StructField(c, StringType()) for c in columns]]))


def framed(ids: Column, vocabulary: Vocabulary, eos: bool = False) -> Column:
    """The ids between the vocabulary's special tokens."""
    parts = [F.array(F.lit(vocabulary.bos))] if vocabulary.bos is not None else []
    parts.append(ids)
    if eos and vocabulary.eos is not None:
        parts.append(F.array(F.lit(vocabulary.eos)))
    return F.concat(*parts)


def labelled(df: DataFrame, question: str, text: str, vocabulary: Vocabulary, length: int = 200, shifted: bool = True) -> DataFrame:
    """df with input_ids (special tokens first), attention_mask and labels: ids, ignored within the question and the padding.

    shifted: the question's length counts the leading special token too.  Without it the mask is short by that token, so
    that the question's last token is learnt.
    """
    out = with_ids(df, {"_question": question, "_text": text}, vocabulary)
    ids = framed(F.col("_text"), vocabulary)
    out = out.withColumn("_ids", ids)
    out = out.withColumns({"input_ids": prep.padded(F.col("_ids"), length, vocabulary.pad), "attention_mask": prep.attention(F.col("_ids"), length)})
    leading = int(shifted and vocabulary.bos is not None)
    return out.withColumn("labels", prep.masked_labels(F.col("input_ids"), F.col("attention_mask"), F.size("_question") + leading)).drop("_question", "_text", "_ids")
