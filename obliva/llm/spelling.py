"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

A word at one edit of another keeps one of its halves: the left half exactly, with the error in the rest, or the right
half.  Each word is posted under the halves that words of its length and of one more or less ask for, forward under left
halves and, spelt backward, under right ones.  Every batch of groups of one half becomes a minimal acyclic automaton with
perfect-hash numbers (the rank of a word, by counts of what lies below each transition); a word walks its exact half and
completes the rest with one error, all words of the batch at once in numpy.  What both directions find is deduplicated.

Groups are dealt by half.  A group of more than ``CELLS`` code points is dealt as several automata by hash of its words,
and its words ask each of them, so that no task holds more than some ``CELLS`` of a group.

Defined results: null and empty texts hold no words; a null id counts as an empty one; repeated rows count each by itself;
an empty table gives an empty table; no column but the two named is read; words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import U64, cut, mix, release, ship

#: Code points in the automaton of a batch.
CELLS = 1 << 20
#: Words that ask at once.
ASK = 1 << 13
#: Hot groups are broadcast up to this many; the table of more is joined by shuffling.
HOT = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = 21


def runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", shortest: int = 6, typo: int | None = None) -> DataFrame:
    """word: each maximal run of ``letters`` of at least ``shortest`` code points, A-Z lower-cased.

    typo: of every so many runs, chosen by crc32 of key and run, one code point is left out.
    """
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{letters}]{{{shortest},}}"), F.lit(0)))
    out = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), found.alias("run")).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    if typo is None:
        return out.select(F.col("run").alias("word"))
    h = F.crc32(F.concat(F.col("key"), F.lit(":"), F.col("run")).cast("binary"))
    n = F.char_length("run")
    at = F.pmod(F.col("h"), n).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))
    out = out.select("run", h.alias("h")).select(F.when(F.col("h") % typo == 0, less).otherwise(F.col("run")).alias("word"))
    return out.where(F.char_length("word") >= shortest)


def _half(length: Column, side: Column) -> Column:
    """Code points of the exact half: the left one forward (side 0), the right one backward (side 1)."""
    return F.floor((length + side) / 2).cast("int")


def _postings(words: DataFrame) -> DataFrame:
    """side, half (its code points), group (hash of side and half), word (as spelt on that side), n, asks: four rows a word."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word"))))
    both = words.select("n", sides.alias("x")).select("n", "x.*").withColumn("length", F.char_length("word"))
    own = _half(F.col("length"), F.col("side"))
    # Words that are shorter or longer by one ask for one other length of half.
    other = F.when((F.col("length") + F.col("side")) % 2 == 0, own - 1).otherwise(own + 1)
    posts = F.array(F.struct(own.alias("half"), F.lit(True).alias("asks")), F.struct(other.alias("half"), F.lit(False).alias("asks")))
    out = both.select("side", "word", "n", "length", F.explode(posts).alias("p")).select("side", "word", "n", "length", "p.*").where("half >= 0")
    return out.withColumn("group", F.xxhash64("side", F.substring("word", F.lit(1), F.col("half"))))


def _dealt(posts: DataFrame, most: int) -> DataFrame:
    """The postings with ``block`` and ``role`` (0: in the automaton; 1: only asks): rows of one block belong together."""
    hot = cut(posts.groupBy("group").agg(F.sum("length").alias("cells")).where(F.col("cells") > most).select("group", F.ceil(F.col("cells") / most).cast("int").alias("parts")))
    many = hot.count()
    if not many:
        return posts.select("side", "half", F.col("group").alias("block"), F.lit(0).alias("role"), "word", "n", "length", "asks")
    met = posts.join(F.broadcast(hot) if many <= HOT else hot, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = lambda part: F.xxhash64("group", part)
    whole = met.select("side", "half", block(F.pmod(F.xxhash64("word"), "parts").cast("int")).alias("block"), F.lit(0).alias("role"), "word", "n", "length", (F.col("asks") & (F.col("parts") == 1)).alias("asks"))
    asking = met.where("asks and parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return whole.unionByName(asking.select("side", "half", block(F.col("part")).alias("block"), F.lit(1).alias("role"), "word", "n", "length", "asks"))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points plus one for each word, 0 behind its end, and the lengths."""
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(lens), int(lens.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat + 1
    return out, lens


class Automaton:
    """The minimal acyclic automaton of distinct words in code point order; ``near`` gives word numbers, which are ranks."""

    def __init__(self, words: pa.Array) -> None:
        codes, lens = _codes(words)
        n, width = codes.shape
        common = np.full(n, -1, np.int64)
        if n > 1:
            common[1:] = (codes[1:] != codes[:-1]).argmax(1)
        # A trie first: a node for each prefix, made by the first word that has it.
        levels = [(np.zeros(1, np.int64), np.zeros(1, np.uint32), np.array([bool(n) and lens[0] == 0]))]
        at = np.zeros(n, np.int64)
        for d in range(1, width + 1):
            new = (common < d) & (lens >= d)
            r = np.flatnonzero(new)
            levels.append((at[r], codes[r, d - 1], lens[r] == d))
            at = np.cumsum(new) - 1
        # From the leaves up: a hash of what can follow a node, and the number of words below it.
        first = np.cumsum([0] + [len(p) for p, _, _ in levels])
        follow, below = np.zeros(first[-1], U64), np.zeros(first[-1], np.int64)
        ups, ins = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        sums, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for d in range(width, -1, -1):
            parent, code, final = levels[d]
            here = slice(first[d], first[d + 1])
            s, c = np.zeros(len(parent), U64), final.astype(np.int64)
            if d < width:
                np.add.at(s, levels[d + 1][0], sums)
                np.add.at(c, levels[d + 1][0], counts)
            follow[here] = mix(s * U64(2) + final.astype(U64) + U64(1))
            below[here] = c
            ups[here], ins[here] = parent + (first[d - 1] if d else 0), code
            sums, counts = mix(follow[here] ^ mix(code.astype(U64) + U64(1))), c
        # Nodes that the same words can follow are one state.
        _, one, state = np.unique(follow, return_index=True, return_inverse=True)
        final = np.concatenate([f for _, _, f in levels])[one]
        kept = np.zeros(len(follow), bool)
        kept[one] = True
        edge = np.flatnonzero(kept[ups])
        edge = edge[edge > 0]
        key = state[ups[edge]].astype(np.int64) << _BITS | ins[edge]
        order = np.argsort(key)
        edge = edge[order]
        self.key, self.target, self.code = key[order], state[edge], ins[edge].astype(np.uint32)
        source = self.key >> _BITS
        self.first = np.searchsorted(source, np.arange(len(one) + 1))
        # What a transition adds to the number: the state's own word and those below earlier transitions.
        passed = np.concatenate([[0], np.cumsum(below[edge])])
        self.skip = passed[:-1] - passed[self.first[source]] + final[source]
        self.final, self.root = final, int(state[0])

    def _step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a transition by the code, and its place."""
        key = state.astype(np.int64) << _BITS | code
        i = np.searchsorted(self.key, key)
        return np.append(self.key, -1)[i] == key, i

    def near(self, words: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a word, number of a word with its exact half and one error behind it), each once."""
        codes, lens = _codes(words)
        codes = np.pad(codes, ((0, 0), (0, 1)))
        q = np.arange(len(lens))
        state, number, half = np.full(len(q), self.root), np.zeros(len(q), np.int64), (lens + side) // 2
        for d in range(int(half.max(initial=0))):
            go = half[q] > d
            ok, i = self._step(state[go], codes[q[go], d])
            alive = ~go
            alive[np.flatnonzero(go)[ok]] = True
            state[np.flatnonzero(go)[ok]], number[np.flatnonzero(go)[ok]] = self.target[i[ok]], number[np.flatnonzero(go)[ok]] + self.skip[i[ok]]
            q, state, number = q[alive], state[alive], number[alive]
        pos = half[q]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        wrong = tuple(np.zeros(0, np.int64) for _ in range(4))
        while len(q) or len(wrong[0]):
            inside = pos < lens[q]
            # The error: a code point is missing, another one, or one too many.
            out = self.first[state + 1] - self.first[state]
            owner = np.repeat(np.arange(len(q)), out)
            edge = np.arange(len(owner)) - np.repeat(np.cumsum(out) - out, out) + np.repeat(self.first[state], out)
            other = inside[owner] & (self.code[edge] != codes[q[owner], pos[owner]])
            oq, oe = owner[other], edge[other]
            born = (
                (q[inside], pos[inside] + 1, state[inside], number[inside]),
                (q[oq], pos[oq] + 1, self.target[oe], number[oq] + self.skip[oe]),
                (q[owner], pos[owner], self.target[edge], number[owner] + self.skip[edge]),
            )
            w = tuple(np.concatenate(x) for x in zip(wrong, *born, strict=True))
            done = w[1] == lens[w[0]]
            end = done & self.final[w[2]]
            found.append((w[0][end], w[3][end]))
            w = tuple(x[~done] for x in w)
            ok, i = self._step(w[2], codes[w[0], w[1]])
            i = i[ok]
            wrong = (w[0][ok], w[1][ok] + 1, self.target[i], w[3][ok] + self.skip[i])
            ok, i = self._step(state, codes[q, pos])
            ok &= inside
            i = i[ok]
            q, pos, state, number = q[ok], pos[ok] + 1, self.target[i], number[ok] + self.skip[i]
        pairs = np.unique(np.array([np.concatenate([f[0] for f in found] or [q]), np.concatenate([f[1] for f in found] or [q])]), axis=1)
        return pairs[0], pairs[1]


class _Index:
    """The automaton of the words of some groups of one side, with their numbers n."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.filter(pc.equal(rows["role"], 0)).select(["word", "n", "side"]).combine_chunks()
        rows = rows.take(pc.sort_indices(rows["word"]))
        word = rows["word"].combine_chunks()
        if len(word) > 1:
            rows = rows.filter(pa.array(np.concatenate([[True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)])))
        self.word, self.n = _flat(rows["word"]), rows["n"].to_numpy()
        self.automaton = Automaton(self.word)

    def matches(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(rows["asks"])
        for k in range(0, len(rows), ASK):
            part = rows.slice(k, ASK).combine_chunks()
            word, side = _flat(part["word"]), part["side"][0].as_py()
            q, number = self.automaton.near(word, side)
            names = ["side", "word", "near", "near_n"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), side, np.int32)), word.take(pa.array(q)), self.word.take(pa.array(number)), pa.array(self.n[number])], names)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.combine_chunks()
    return pa.concat_arrays(chunks.chunks).cast(pa.string()) if isinstance(chunks, pa.ChunkedArray) else chunks.cast(pa.string())


def _classes(rows: pa.Table) -> Iterator[pa.Table]:
    """Runs of rows of one side with halves of alike length: words that fill a matrix well."""
    kind = rows["side"].to_numpy() * 64 + np.floor(np.log2(np.maximum(rows["half"].to_numpy(), 1))).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield rows.slice(a, b - a)


def _search(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole blocks at a time, in batches of about ``most`` code points; the last block's automaton stays while its askers still come."""
    held: list[pa.Table] = []
    cells, index, open_ = 0, None, None

    def more() -> Iterator[pa.RecordBatch | None]:
        yield from batches
        yield None

    for batch in more():
        if batch is not None:
            held.append(pa.Table.from_batches([batch]))
            cells += pc.sum(batch.column("length")).as_py() or 0
            if cells < most:
                continue
        if not held:
            continue
        rows = pa.concat_tables(held)
        block = rows["block"].to_numpy()
        if index is not None:
            same = int((block == open_).sum())  # a block's rows come together, and these first
            yield from index.matches(rows.slice(0, same))
            rows, block = rows.slice(same), block[same:]
            held, cells = [rows], pc.sum(rows["length"]).as_py() or 0
            if not len(rows):
                continue
            index = None
        end = len(rows) if batch is None else int((block != block[-1]).sum())
        if not end:
            if rows["role"][-1].as_py() == 0:
                held = [rows]
                continue
            index, open_ = _Index(rows), block[-1]
            yield from index.matches(rows)
            held, cells = [], 0
            continue
        for part in _classes(rows.slice(0, end)):
            yield from _Index(part).matches(part)
        held = [rows.slice(end)] if end < len(rows) else []
        cells = sum(pc.sum(t["length"]).as_py() or 0 for t in held)


def near(words: DataFrame, *, cells: int = CELLS) -> DataFrame:
    """word, near, near_n: each ordered pair of the distinct words of (word, n) that differ by one code point inserted, deleted or replaced."""
    ship(words.sparkSession)
    dealt = _dealt(_postings(words), cells).repartition("block").sortWithinPartitions("side", "half", "block", "role")
    found = dealt.mapInArrow(partial(_search, most=cells), "side int, word string, near string, near_n long")
    spelt = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c)
    return found.select(spelt("word"), spelt("near"), "near_n").distinct()


def variants(words: DataFrame, *, factor: int = 5, cells: int = CELLS) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of the distinct words of (word, n).

    form: the near word of largest n (ties: least), where that n is ``factor`` times the word's at least; root: the end of
    the chain of forms.  n grows by ``factor`` at each link, so a chain is short, and each round of joins doubles its step.
    """
    words = cut(words)
    least = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("near")))
    best = near(words, cells=cells).groupBy("word").agg(F.count("*").alias("n_near"), least.alias("best"))
    fits = -F.col("best.neg") >= F.col("n") * factor
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.neg")).alias("form_n")
    )
    out = cut(out)
    step = cut(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = longer.where("moved").limit(1).count()
        release(step)
        step = longer.select("word", "root")
        step._obliva_path = longer._obliva_path
        if not moved:
            break
    return out.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, factor: int = 5, typo: int | None = None) -> DataFrame:
    """``variants`` of the words of all texts that occur ``least`` times at least."""
    counted = runs(docs, key=key, text=text, shortest=shortest, typo=typo).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return variants(counted, factor=factor)
