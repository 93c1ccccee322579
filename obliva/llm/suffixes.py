"""Suffix-array dedup: a distributed merge sort of front-coded suffix runs.

A byte goes if a string of ``length`` bytes covers it that also starts earlier
(smaller key, then earlier in the text).  Not every suffix is sorted: each
window of ``length`` bytes has an anchor, the place of its least hashed
``GRAM``-byte string, so equal windows have equal anchors at equal offsets and
only suffixes at anchors need comparing - about one in 35 places.

1. Documents are dealt into blocks by a hash of key and text; a block tells
   which anchor hashes it has, and those that occur once in the corpus are out.
2. A block sorts the suffixes at its other anchors (each with the bytes to the
   left that its windows reach).  Of equal ones only the first is sent on: the
   others start later whatever the other blocks hold, so that a passage of very
   many documents weighs no more than one suffix a block where runs meet.  The
   firsts go into front-coded runs, split by the anchor's hash.
3. A loser tree merges the runs of one part.  A suffix carries its common
   prefix with the last one put out, so comparisons begin after it.
4. Neighbours in the merged order that share the anchor string share a window if
   their common prefixes reach its end and the bytes on the left agree; what
   starts later goes back to its block, which covers the bytes and returns what
   is left.

Defined results: null or empty texts have 0 bytes; a text shorter than
``length`` loses nothing; rows of one key count as texts in the order of a hash
of the text (of equal rows either is the first); null keys come last; texts of
any length are treated whole; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import _BYTE, U64, chunks, mix, ship, utf8

GRAM = 32
#: Bytes of text in a block, in a part of the anchor hashes, and in a part of the merge.
BLOCK_BYTES, HASH_BYTES, PART_BYTES = 8 << 20, 64 << 20, 8 << 20

_FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor, and the first and last start of the windows that it stands for."""
    sizes = np.diff(offs)
    starts = np.maximum(0, sizes - length + 1)
    none = np.zeros(0, np.int64)
    if not starts.sum():
        return none, np.zeros(0, U64), none, none
    h = _BYTE[data]
    step = 1
    for factor in _FACTORS:  # 1, 2, 4 ... GRAM bytes
        h = h[:-step] * factor + h[step:]
        h ^= h >> U64(29)
        step *= 2
    # The upper half orders the windows' strings, the lower half is the place: ties go to the left.
    least = (mix(h) & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    span, wide = length - GRAM + 1, 1
    while wide * 2 <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    ends = np.concatenate([[0], np.cumsum(starts)])
    window = np.arange(ends[-1]) + np.repeat(offs[:-1] - ends[:-1], starts)
    at = (least[window] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return place, mix(h[place] + U64(1)), window[first], window[last]


def _pieces(table: pa.Table) -> tuple[pa.Table, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The block's rows in order, and (first row, bytes, offsets) of its pieces."""
    table = table.sort_by([("key", "ascending"), ("order", "ascending"), ("text", "ascending")])
    data, offs = utf8(table.column("text"))
    return table, [(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]


def _groups(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, slice) of the runs of a sorted array."""
    if len(values):
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(values)], strict=True):
            yield int(values[a]), slice(a, b)


def _table(names: str, *columns) -> pa.Table:
    kinds = {"part": pa.int64(), "block": pa.int64()}
    return pa.table({n: pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names.split(), columns, strict=True)})


def _hashes_of(table: pa.Table, length: int, parts: int) -> pa.Table:
    """Step 1, of a block: its distinct anchor hashes by part, with a mark on those it has twice."""
    block = table.column("block")[0].as_py()
    found = [anchors(d, o, length)[1] for _, d, o in _pieces(table)[1]]
    h, n = np.unique(np.concatenate(found), return_counts=True)
    part = (h % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    h, n, part = h[order], n[order], part[order]
    rows = [(p, h[s].tobytes(), (n[s] > 1).astype(np.uint8).tobytes()) for p, s in _groups(part)]
    return _table("part block hashes twice", [r[0] for r in rows], [block] * len(rows), [r[1] for r in rows], [r[2] for r in rows])


def _repeated(table: pa.Table) -> pa.Table:
    """Step 1, of a part: each block's hashes that occur again."""
    blocks, hashes, twice = (table.column(c).to_pylist() for c in ("block", "hashes", "twice"))
    sizes = [len(x) // 8 for x in hashes]
    h = np.frombuffer(b"".join(hashes), U64)
    again = np.frombuffer(b"".join(twice), np.uint8) > 0
    owner = np.repeat(np.arange(len(blocks)), sizes)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = again.copy()
    again[order[1:][same]] = again[order[:-1][same]] = True
    h, owner = h[again], owner[again]
    rows = [(blocks[k], h[s].tobytes()) for k, s in _groups(owner)]
    return _table("block hashes", [r[0] for r in rows], [r[1] for r in rows])


def _key(table: pa.Table) -> np.ndarray:
    return table.column("key").cast(pa.int64()).fill_null((1 << 63) - 1).combine_chunks().to_numpy(zero_copy_only=False)


#: Columns of a run.  Its places are key, order, row and start of each suffix; a part of a block's own has the block's cuts there.
RUN = "part block lcp tail ends places"


def _runs(table: pa.Table, hashes: pa.Table, length: int, parts: int) -> pa.Table:
    """Step 2, of a block: sorted, collapsed, front-coded runs of its suffixes, by part."""
    if not table.num_rows or not hashes.num_rows:
        return _table(RUN, *[[]] * 6)
    block = table.column("block")[0].as_py()
    wanted = np.sort(np.frombuffer(b"".join(hashes.column("hashes").to_pylist()), U64))
    table, pieces = _pieces(table)
    keys, texts = _key(table), table.column("order").to_numpy()
    width = 2 * length - GRAM
    strings, parts_of, row, start = [], [], [], []
    for i, data, offs in pieces:
        at, h, lo, hi = anchors(data, offs, length)
        if not len(at):
            continue
        k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        keep = wanted[k] == h
        at, h, lo, hi = at[keep], h[keep], lo[keep], hi[keep]
        # A string is the suffix from the anchor on, then the bytes to its left, padded; last its two lengths.
        right, left = hi + length - at, at - lo
        place = np.arange(width)[None, :]
        index = np.where(place < right[:, None], at[:, None] + place, lo[:, None] + place - right[:, None])
        inside = place < (right + left)[:, None]
        s = np.where(inside, data[np.where(inside, index, 0)], 0).astype(np.uint8)
        strings.append(np.concatenate([s, right[:, None].astype(np.uint8), (right + left)[:, None].astype(np.uint8)], axis=1))
        parts_of.append(((h >> U64(20)) % U64(parts)).astype(np.int64))
        r = np.searchsorted(offs, lo, "right") - 1
        row.append(r + i)
        start.append(lo - offs[r])
    if not strings:
        return _table(RUN, *[[]] * 6)
    s, part, row, start = (np.concatenate(x) for x in (strings, parts_of, row, start))
    s = np.ascontiguousarray(s)
    flat = s.view(f"S{width + 2}").ravel()
    order = np.lexsort((start, row, flat, part))
    s, part, row, start = s[order], part[order], row[order], start[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1) | (part[1:] != part[:-1])
    heads = np.flatnonzero(new)
    # All but the first of equal suffixes go here already, by a part of this block's own.
    late = np.flatnonzero(~new)
    cuts = np.stack([row[late], start[late], start[late] + s[late, -1]], axis=1).astype(np.int64)
    rows = [(parts + block, b"", b"", b"", cuts.tobytes())] if len(late) else []
    first = np.stack([keys[row], texts[row], row, start]).astype(np.int64)
    for p, g in _groups(part[heads]):
        own = s[heads[g]]
        differ = own[1:] != own[:-1]
        lcp = np.concatenate([[0], differ.argmax(1)]).astype(np.uint8)
        body = own[:, -1].astype(np.int64)  # bytes before the padding
        used = np.where(np.arange(width)[None, :] < body[:, None], True, False) & (np.arange(width)[None, :] >= lcp[:, None])
        tail = own[:, :width][used]
        ends = np.concatenate([own[:, -2:], np.minimum(lcp, width)[:, None]], axis=1).astype(np.uint8)
        rows.append((p, lcp.tobytes(), tail.tobytes(), ends.tobytes(), np.ascontiguousarray(first[:, heads[g]]).tobytes()))
    return _table(RUN, [r[0] for r in rows], [block] * len(rows), *[[r[k] for r in rows] for k in (1, 2, 3, 4)])


def unfold(lcp: bytes, tail: bytes, ends: bytes, width: int) -> list[bytes]:
    """The strings of a front-coded run."""
    out, before, at = [], b"", 0
    for k in range(len(lcp)):
        right, total, shared = ends[3 * k], ends[3 * k + 1], lcp[k]
        n = max(0, total - shared)
        body = before[: min(shared, total)] + tail[at : at + n]
        at += n
        before = body.ljust(width, b"\0")
        out.append(before + bytes((right, total)))
        before = out[-1]
    return out


def merge(runs: list[list[bytes]], lcps: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the one before) of all strings in order, by a loser tree.

    Every player carries its common prefix with the string put out last.  The longer one wins without a look at the
    strings; only at equal lengths are they compared, from there on.  A run that has ended carries -1.
    """
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    at = [0] * k
    current = [r[0] if r else b"" for r in runs]
    loser, known = [0] * size, [0] * size
    width = max((len(r[0]) for r in runs if r), default=0)
    from_bytes = int.from_bytes

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix with the winner."""
        if la > lb:
            return a, la, b, lb
        if la < lb:
            return b, lb, a, la
        if la < 0:
            return a, la, b, lb
        x, y = from_bytes(current[a][la:]), from_bytes(current[b][la:])
        shared = width - ((x ^ y).bit_length() + 7) // 8
        return (a, la, b, shared) if x <= y else (b, lb, a, shared)

    best: list[tuple[int, int]] = [(0, -1)] * size + [(r, 0 if r < k and runs[r] else -1) for r in range(size)]
    for node in range(size - 1, 0, -1):
        w, lw, lost, llost = play(*best[2 * node], *best[2 * node + 1])
        best[node], loser[node], known[node] = (w, lw), lost, llost
    win, lead = best[1]
    while lead >= 0:
        yield win, at[win], lead
        at[win] += 1
        if at[win] < len(runs[win]):
            current[win] = runs[win][at[win]]
            a, la = win, lcps[win][at[win]]
        else:
            a, la = win, -1
        node = (win + size) // 2
        while node:
            b, lb = loser[node], known[node]
            if lb >= la and lb >= 0:
                a, la, loser[node], known[node] = play(a, la, b, lb)
            node //= 2
        win, lead = a, la


def _later(group: list[tuple[bytes, int, list]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(block, row, start, end) of what starts later, among the suffixes of one anchor string.

    A member of the group is a suffix, its common prefix with the one before, and its places (key, order, block, row, start),
    the first one first.
    """
    for s, _, places in group:
        total = s[-1]
        for *_, block, row, start in places[1:]:
            yield block, row, start, start + total
    if len(group) == 1:
        return
    by_place = sorted(range(len(group)), key=lambda k: group[k][2][0])
    longest = max(shared for _, shared, _ in group[1:])
    for d in range(max(0, length - longest), length):
        # The window of d bytes on the anchor's left: its right part is common to neighbours whose common prefix reaches its end.
        need, run, runs = length - d, 0, []
        for _, shared, _ in group:
            run += shared < need
            runs.append(run)
        seen: set[tuple[int, bytes]] = set()
        for k in by_place:
            s, _, places = group[k]
            right, total = s[-2], s[-1]
            if need <= right and d <= total - right:
                window = (runs[k], s[total - d : total])
                if window in seen:
                    *_, block, row, start = places[0]
                    yield block, row, start + total - right - d, start + total - right - d + length
                else:
                    seen.add(window)


def _merged(table: pa.Table, length: int, parts: int) -> pa.Table:
    """Steps 3 and 4, of a part: what goes, by block."""
    if table.column("part")[0].as_py() >= parts:
        return pa.table({"block": table.column("block"), "cuts": table.column("places")})
    width = 2 * length - GRAM
    lcp, tail, ends, places, blocks = (table.column(c).to_pylist() for c in ("lcp", "tail", "ends", "places", "block"))
    runs = [unfold(*x, width) for x in zip(lcp, tail, ends, strict=True)]
    where = [np.frombuffer(x, np.int64).reshape(4, -1) for x in places]
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[bytes, int, list]] = []
    for run, index, shared in merge(runs, lcp):
        key, order, row, start = where[run][:, index].tolist()
        place = (key, order, blocks[run], row, start)
        if group and shared >= width + 2:
            group[-1][2].append(place)
            continue
        if group and shared < GRAM:
            _settle(group, length, out)
            group = []
        group.append((runs[run][index], shared if group else 0, [place]))
    if group:
        _settle(group, length, out)
    if not out:
        return _table("block cuts", [], [])
    cuts = np.array(out, np.int64)
    cuts = cuts[np.argsort(cuts[:, 0], kind="stable")]
    rows = [(b, np.ascontiguousarray(cuts[s, 1:]).tobytes()) for b, s in _groups(cuts[:, 0])]
    return _table("block cuts", [r[0] for r in rows], [r[1] for r in rows])


def _settle(group: list, length: int, out: list) -> None:
    if len(group) > 1 or len(group[0][2]) > 1:
        for _, _, places in group:
            places.sort()
        out.extend(_later(group, length))


def _kept(table: pa.Table, cuts: pa.Table) -> pa.Table:
    """Step 4, of a block: key, text bytes, spans and what is left of each row."""
    table, pieces = _pieces(table)
    found = np.frombuffer(b"".join(cuts.column("cuts").to_pylist()), np.int64).reshape(-1, 3) if cuts.num_rows else np.zeros((0, 3), np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    kept, n_bytes, removed, spans = [], [], [], []
    for i, data, offs in pieces:
        rows = len(offs) - 1
        own = found[slice(*np.searchsorted(found[:, 0], [i, i + rows]))]
        depth = np.zeros(len(data) + 1, np.int64)
        base = offs[own[:, 0] - i]
        np.add.at(depth, base + own[:, 1], 1)
        np.add.at(depth, base + own[:, 2], -1)
        gone = np.cumsum(depth)[:-1] > 0
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True
        begins = gone & (first[:-1] | ~np.concatenate([[False], gone[:-1]]))
        total, count = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
        n_bytes += np.diff(offs).tolist()
        removed += np.diff(total[offs]).tolist()
        spans += np.diff(count[offs]).tolist()
        left = data[~gone].tobytes()
        edge = (offs - total[offs]).tolist()
        kept += [left[a:b] for a, b in zip(edge, edge[1:], strict=False)]
    return pa.table({"key": table.column("key"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each row; the key is an integer."""
    if not GRAM < length <= 127 + GRAM // 2:
        raise ValueError("length must be above GRAM and fit the front coding")
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, hashes, parts = (max(1, -(-total // n)) for n in (BLOCK_BYTES, HASH_BYTES, PART_BYTES))
    dealt = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = dealt.select(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).alias("block"), "key", F.xxhash64("text").alias("order"), "text")
    told = dealt.groupBy("block").applyInArrow(lambda t: _hashes_of(t, length, hashes), "part bigint, block bigint, hashes binary, twice binary")
    again = told.groupBy("part").applyInArrow(_repeated, "block bigint, hashes binary")
    runs = dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(
        lambda t, h: _runs(t, h, length, parts), "part bigint, block bigint, lcp binary, tail binary, ends binary, places binary"
    )
    cuts = runs.groupBy("part").applyInArrow(lambda t: _merged(t, length, parts), "block bigint, cuts binary")
    left = dealt.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_kept, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return left.withColumnRenamed("key", key)

