"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut by the vocabulary's pattern; the distinct pieces of a batch lie
end to end in one flat array of symbols.  Each round looks all adjacent pairs
up by binary search in the sorted pair keys, takes the lowest rank of every
piece and applies it at all its places, until no piece has a known pair.

Defined results: a null text counts as empty and gives no ids; texts of any
length are encoded whole; rows repeat as they come; an empty table gives an
empty table; further columns are left alone (names chosen by the caller that
clash with an input column replace it).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import chunks, ship, utf8

#: Fixed value: the public pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for the standard library's faster engine, for texts that hold nothing in which the engines' classes differ.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027]")
#: Bytes of distinct pieces whose ids a worker remembers before it starts afresh (memory only, no effect on results).
REMEMBERED = 2 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or a copy of at least twice its length, with room for n items."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class Codec:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.base = max([*vocab.values(), *special.values()]) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.narrow = np.uint32 if self.base**2 < 1 << 32 else np.int64
        self.keys = self.keys.astype(self.narrow)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        back = {c: b for b, c in enumerate(letters)}
        raw: list[bytes] = [b""] * self.base
        for token, i in vocab.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            raw[i] = token.encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = dict.fromkeys(self.special)
        self.known.update(zip(self.special, range(len(self.special)), strict=True))
        # Ids of all known pieces end to end, and where each begins; the arrays have room to grow.
        self.flat, self.at, self.bytes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0
        self.flat[: len(self.known)] = list(self.special.values())
        self.at[: len(self.known) + 1] = np.arange(len(self.known) + 1)

    def _remember(self, new: list[str]) -> None:
        pieces = [p.encode() for p in new]
        flat, at = self.merge(pieces)
        n, end = len(self.known), self.at[len(self.known)]
        self.flat = _with_room(self.flat, end + len(flat))
        self.at = _with_room(self.at, n + len(at))
        self.flat[end : end + len(flat)] = flat
        self.at[n + 1 : n + len(at)] = end + at[1:]
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        self.bytes += sum(map(len, pieces))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search over the sorted keys; the number of merges for unknown pairs."""
        key = (left * self.base + right).astype(self.narrow)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.merged))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the n+1 offsets of the pieces."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        none = len(self.merged)
        rank = np.full(len(ids), none, np.int64)  # of the pair that begins at each symbol
        stale = np.ones(len(ids), bool)
        done_ids, done_owner = [], []
        while len(ids):
            stale[-1] = False
            stale[:-1] &= owner[:-1] == owner[1:]
            at = np.flatnonzero(stale)
            rank[at] = self.rank(ids[at], ids[at + 1])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            low = np.repeat(best, np.diff(np.append(heads, len(ids))))
            alive = low < none
            if not alive.all():
                done_ids.append(ids[~alive])
                done_owner.append(owner[~alive])
                ids, owner, rank, low = ids[alive], owner[alive], rank[alive], low[alive]
                if not len(ids):
                    break
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():
                # Pairs that overlap (a a a): every second one counts, from the left of the run within its piece.
                place = np.flatnonzero(hit)
                head = np.concatenate([[True], (np.diff(place) != 1) | (owner[place[1:]] != owner[place[:-1]])])
                start = place[np.flatnonzero(head)][np.cumsum(head) - 1]
                hit[place[(place - start) % 2 == 1]] = False
            ids[hit] = self.merged[rank[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            stale = hit | np.concatenate([hit[1:], [False]]) | np.concatenate([hit[2:], [False, False]])[: len(hit)]
            rank[hit] = none
            ids, owner, rank, stale = ids[keep], owner[keep], rank[keep], stale[keep]
            last = np.concatenate([owner[1:] != owner[:-1], [True]])
            rank[last] = none
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        flat, own = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(pieces))
        return flat[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def cut(self, text: str) -> list[str]:
        return (self.pattern if NOT_PLAIN.search(text) else PLAIN).findall(text)

    def pieces(self, text: str) -> list[str]:
        if not self.split_special or not any(t in text for t in self.special):
            return self.cut(text)
        out: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append(part)
            else:
                # A literal that looks like a special string never reaches the pattern, so the key is unambiguous.
                out += self.cut(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n+1 offsets of the texts."""
        cut = [self.pieces(t) for t in texts]
        if self.bytes > REMEMBERED:
            self._forget()
        known = self.known
        new = list(set().union(*cut).difference(known))
        if new:
            self._remember(new)
        n = sum(map(len, cut))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, n)
        begin, length = self.at[which], self.at[which + 1] - self.at[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)]
        return ids, ends[np.concatenate([[0], np.cumsum([len(ps) for ps in cut])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Texts of ids[offs[i]:offs[i+1]]; bytes that are no UTF-8 become U+FFFD."""
        begin, length = self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = self.raw[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)].tobytes()
        cuts = ends[offs].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def bpe_round_trip(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (the text that the ids stand for) of each row."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            _, offs = utf8(column)
            for i, j in chunks(offs):
                ids, at = own.encode([x or "" for x in column.slice(i, j - i).to_pylist()])
                decoded = own.decode(ids, at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
