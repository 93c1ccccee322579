"""Spelling variants, the filter audit and resharding against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obliva.llm import audit, sharding, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words: dict[str, int], factor: int = 5) -> dict:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x), default=None) for w, v in near.items()}
    form = {w: b if b is not None and words[b] >= factor * words[w] else None for w, b in best.items()}

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] is not None else None) for w, n in words.items()}


def rows_of(df) -> dict:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40, unique=True))
@settings(max_examples=150, deadline=None)
def test_automaton_finds_one_error_behind_the_half(words):
    words = sorted(words, key=lambda w: w.encode())
    automaton = spelling.Automaton(pa.array(words))
    for side in (0, 1):
        q, number = automaton.near(pa.array(words), side)
        got = sorted((words[i], words[j]) for i, j in zip(q, number, strict=True))
        half = {w: (len(w) + side) // 2 for w in words}
        certain = {(w, v) for w in words for v in words if one_edit(w, v) and v[: half[w]] == w[: half[w]]}
        assert len(got) == len(set(got))
        assert set(got) == certain


def test_automaton_is_minimal():
    words = sorted(a + b for a in ("ab", "cd", "ef") for b in ("walk", "talk", "walks", "talks"))
    automaton = spelling.Automaton(pa.array(words))
    # The root, one state for each first letter, one for all second ones; then w or t, a, l, the final k and the final s.
    assert len(automaton.final) == 10
    assert automaton.final.sum() == 2


@pytest.mark.parametrize("cells", [400, 1 << 20])
def test_variants_equal_brute_force(spark, cells):
    r = random.Random(7)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 8))): r.randint(1, 400) for _ in range(300)}
    # A hot half: many words that share their first ten letters, and another that share their last.
    for _ in range(120):
        tail = "".join(r.choice("ab") for _ in range(r.randint(6, 9)))
        words["international" + tail], words[tail + "isationalist"] = r.randint(1, 60), r.randint(1, 60)
    words |= {"x" * 3000: 100, "x" * 2999: 10, "x" * 2998 + "y": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, cells=cells)) == brute_variants(words)


def test_chains_end_at_their_root(spark):
    words = {"aaaaaa" + "b" * k: 5 ** (12 - k) for k in range(12)}
    got = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words)
    assert {v[1] for v in got.values()} == {"aaaaaa"}


def test_words_of_texts(spark):
    texts = [(1, "Ärgernis ÄRGERNIS short colour,Colour7COLOUR"), (2, None), (3, ""), (None, "colour colour"), (4, "étude_étudeé " * 30), (4, "étude_étudeé " * 30)]
    table = spark.createDataFrame([(i, t, "en", "s", 1, "x", 9) for i, t in texts], DOCS + ", word string, n int")
    for typo in (None, 2, 199):
        expected = Counter()
        for i, t in texts:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = "".join(c.lower() if c < "\x80" else c for c in w)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if typo and h % typo == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                expected[w] += len(w) >= 6
        got = {r["word"]: r["count"] for r in spelling.runs(table, typo=typo).groupBy("word").count().collect()}
        assert got == {w: n for w, n in expected.items() if n}
    assert spelling.group(table.limit(0)).collect() == []
    assert set(spelling.group(table, least=1).columns) == {"word", "n", "n_near", "form", "form_n", "root"}


def brute_audit(docs, labels) -> dict:
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), copy]
        rows.append((part or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [r for r in own if x in r[1] and not before & r[1]]
                out[part, order, k + 1] = [
                    sum(not (before | {x}) & r[1] for r in own), len(gone), sum(x in r[1] and bool(before & r[1]) for r in own),
                    sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, k), v in out.items() if p == part and o[k - 1] == x)
            for (p, o, k), v in out.items():
                if p == part and o[k - 1] == x:
                    v.append(total)
    return out


def test_audit_equals_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "Beta", "gamma", "ABC", "d%", "ee"] + [f"w{k}" for k in range(400)]) for _ in range(r.choice([0, 3, 190, 210, 400]))) for _ in range(14)]
    texts += [None, "", "Aa" * 5000, "one\x0btwo three " * 300, "é" * 50]
    docs = [(i if i % 11 else None, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(90)] + [(7, "twice", "a")] * 3 + [(8, "twice", None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(60)] + [(5, 1, 0), (5, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, mask string, n int")
    said = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(table, said).collect()
    assert {(x["part"], x["filter_order"], x["step"]): [x[c] for c in audit.OUTCOMES] for x in got} == brute_audit(docs, [x for x in labels if x[0] is not None])
    assert all(x["filter"] == x["filter_order"][x["step"] - 1] for x in got)
    assert audit.audit(table.limit(0), said).collect() == []
    assert audit.audit(table, said.limit(0)).count() == len(got)


def test_audit_matrices():
    orders, here, by = audit.matrices("ABCDE")
    assert len(orders) == 120 and all(m.shape == (32, 600) for m in by.values())
    # At each step a mask is kept, removed here, removed before with or without failing here.
    assert by["removed"].sum(1).tolist() == [120 * (m > 0) for m in range(32)]
    assert (by["kept"] + by["removed"] + by["redundant"] <= 1).all()
    # Shares of the filters in a mask add up to all orders.
    one = [list(here).index(j) for j in range(5)]
    assert by["shapley"][:, one].sum(1).tolist() == [120 * (m > 0) for m in range(32)]


def brute_flow(supply, capacity, cost) -> int:
    """Least cost by dynamic programming over single units (tiny cases)."""
    from functools import lru_cache

    units = tuple(i for i, n in enumerate(supply) for _ in range(n))

    @lru_cache(None)
    def best(k, room):
        if k == len(units):
            return 0
        return min(cost[units[k]][j] + best(k + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(len(room)) if room[j])

    return best(0, tuple(capacity))


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_flow_is_least(data):
    n, m = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 3))
    supply = data.draw(st.lists(st.integers(0, 3), min_size=n, max_size=n))
    capacity = sharding.even(sum(supply) + data.draw(st.integers(0, 2)), m)
    cost = data.draw(st.lists(st.lists(st.integers(0, 4), min_size=m, max_size=m), min_size=n, max_size=n))
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert [sum(f) for f in flow] == supply
    assert all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
    assert sum(x * c for f, k in zip(flow, cost, strict=True) for x, c in zip(f, k, strict=True)) == brute_flow(supply, capacity, cost)


def test_flow_needs_room():
    with pytest.raises(ValueError, match="capacities"):
        sharding.min_cost_flow([3], [2], [[0]])


@pytest.mark.parametrize(("before", "after", "splits"), [(3, 5, 6), (5, 3, 7), (4, 4, 4), (12, 16, 1)])
def test_resharding(spark, tmp_path, before, after, splits):
    r = random.Random(before)
    docs = [(i % 300, None if i % 50 == 0 else "é" * r.randint(0, 40), "x", i) for i in range(900)] + [(1, "copy", "x", 1)] * 500
    table = spark.createDataFrame(docs, "doc_id long, text string, shard string, slot int").repartition(splits)
    old = str(tmp_path / "old")
    sharding.lay_out(table, old, before, rows=64)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")}
    out = sharding.reshard(spark, old, after, row=table.schema.simpleString())
    rows = out.rows.selectExpr("row.doc_id", "row.text", "row.slot as given", "size", "crc", "shard", "slot as at").collect()
    assert sorted((x[0], x[1] or "", x[2]) for x in rows) == sorted((d[0], d[1] or "", d[3]) for d in docs)
    assert all(x["size"] == len((x[1] or "").encode()) + 1 and x["crc"] == zlib.crc32((x[1] or "").encode()) for x in rows)
    by = {k: [x for x in rows if x["shard"] == k] for k in range(after)}
    assert all(sorted(x["at"] for x in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(x["size"] for x in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 81
    # Bytes that leave their shard: no more than the surplus demands, within a border block each.
    moved = sum(f for i, to in enumerate(out.flow) for j, f in enumerate(to) if i != j)
    held = [sum(f) for f in out.flow] + [0] * after
    assert moved == sum(max(0, held[i] - (sharding.even(sum(sizes), after) + [0] * before)[i]) for i in range(max(before, after)))
    # Files of blocks that stay are not touched, and most rows stay where they were when nothing changes.
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")}
    if before == after:
        assert out.pieces.where("stays").count() >= out.pieces.count() // 2


def test_resharding_to_given_capacities_and_costs(spark, tmp_path):
    table = spark.createDataFrame([(i, "abcdefghi") for i in range(400)], "doc_id long, text string").repartition(4)
    sharding.lay_out(table, str(tmp_path / "old"), 4, rows=50)
    # Shard 4 is far from all but shard 0.
    cost = [[int(i != j) if j < 4 else (1 if i == 0 else 9) for j in range(5)] for i in range(4)]
    out = sharding.reshard(spark, str(tmp_path / "old"), 5, row=table.schema.simpleString(), capacity=[200, 1000, 1000, 1000, 800], cost=cost)
    got = {x["shard"]: x["count"] for x in out.rows.groupBy("shard").count().collect()}
    assert got == {0: 20, 1: 100, 2: 100, 3: 100, 4: 80}
    assert out.flow[0][4] == 800


def test_resharding_nothing(spark, tmp_path):
    table = spark.createDataFrame([], "doc_id long, text string")
    sharding.lay_out(table, str(tmp_path / "old"), 4)
    assert sharding.reshard(spark, str(tmp_path / "old"), 3, row=table.schema.simpleString()).rows.collect() == []


def test_border_rows_go_where_most_is_lacking():
    import pandas as pd

    lacks = [{"to": 3, "bytes": 10}, {"to": 8, "bytes": 7}]
    rows = pd.DataFrame({"shard": 1, "block": 2, "place": np.arange(5), "size": [1, 6, 5, 4, 1], "lacks": [lacks] * 5})
    out = sharding._share(rows)
    assert out.groupby("to")["size"].sum().to_dict() == {3: 10, 8: 7}
    assert out.sort_values(["to", "rank"]).groupby("to")["place"].apply(list).to_dict() == {3: [0, 1, 3], 8: [2, 4]} or out["size"].sum() == 17


def test_queries_over_the_table(spark):
    from obliva.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = registry.op12_filter_audit(spark, sf).collect()
    assert {(x["part"], x["filter_order"], x["step"]): [x[c] for c in audit.OUTCOMES] for x in got} == brute_audit(docs, labels)

    counts = Counter()
    for i, t, _ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    out = registry.op11_spelling_variants(spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(out) == brute_variants(words)

    rows = registry.op13_resharding(spark, sf).collect()
    assert sorted((x["doc_id"], x["size"], x["text_crc32"]) for x in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    by = {k: [x for x in rows if x["shard"] == k] for k in range(16)}
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(x["size"] for x in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 0.1 * np.mean(sizes)
