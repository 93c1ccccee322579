"""Shingle join, suffix dedup, vector operators and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from obliva.llm import components, jaccard, suffixes, vectors

SF = "/root/testdata/sf0.001"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union(pairs, got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_copies(seed=1):
    """Copies, near copies around the threshold, a shared passage, and odd rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(30)]
    rows, i = [], 10
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(5, 120))] + (passage if rnd.random() < 0.6 else [])
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "same again"), (7, "same again"), (8, "x " * 4000), (9, "y x " * 3000)]
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 60)])
def test_shingle_join(spark, seed, width, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 0, "n") for r in rows], "doc_id long, text string, n_shingles int, component_id string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, width=width, percent=percent).collect()}
    sets = {k: shingle_set(t, width) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    assert got == {(k, len(sets[k]), want[k]) for k in sets}


def test_shingle_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0
    alone = jaccard.join(spark.createDataFrame([(1, None), (None, "a b c d e")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in alone} == {(1, 0, 1), (None, 2, None)}


def test_shingle_join_of_rows_with_one_key(spark):
    """Different texts of one key: each keeps its links, and all are of one component."""
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    rows = [(7, a), (7, b), (20, a + " z"), (21, b + " z"), (7, ""), (30, "one two three four"), (30, "five six seven eight")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 0, 7), (7, 57, 7), (7, 57, 7), (20, 58, 7), (21, 58, 7), (30, 1, 30), (30, 1, 30)]


def test_shingle_join_in_blocks(spark, monkeypatch):
    """Small blocks, and groups of one prefix whose members differ behind it."""
    monkeypatch.setattr(jaccard, "SIDE", 4)
    rnd = random.Random(9)
    tail = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rare = [f"r{i % 3}-{k}" for k in range(40)]
        rows.append((i, " ".join(rare + rnd.sample(tail, 60) if i % 2 else rare + tail[i % 7 : i % 7 + 60])))
    for i in range(60, 90):
        rows.append((i, " ".join(tail[:80] + [f"u{i}", f"v{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 80):
        sets = {k: shingle_set(t) for k, t in rows}
        pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = union(pairs, sets)
        assert {(r.doc_id, r.component_id) for r in jaccard.join(df, percent=percent).collect()} == {(k, want[k]) for k in sets}


def brute_suffixes(rows, length):
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for q in range(len(data)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((key, len(data), sum(gone), spans, kept))
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, monkeypatch, seed):
    for name, n in (("BLOCK_BYTES", 4000), ("HASH_BYTES", 8000), ("PART_BYTES", 4000)):
        monkeypatch.setattr(suffixes, name, n)
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(60, 300))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(passages)[rnd.randrange(40) :] if rnd.random() < 0.5 else "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 150))) for _ in range(rnd.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "z" * 900), (103, "xy" * 300), (104, "same" * 60), (104, "same" * 60), (None, passages[0]), (105, "\0" * 250), (106, "q" * 99)]
    rows += [(107, p * k) for p in passages for k in (1, 2)] + [(None, p + "x") for p in passages]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    ordered = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffixes.dedup(df).collect())
    assert got == brute_suffixes(ordered, 100)
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_suffix_dedup_of_many_copies(spark, monkeypatch):
    """A passage that very many documents share, in other surroundings each, and many rows of one key."""
    for name, n in (("BLOCK_BYTES", 8000), ("HASH_BYTES", 16000), ("PART_BYTES", 8000)):
        monkeypatch.setattr(suffixes, name, n)
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = word(180)
    rows = [(i, word(rnd.randint(0, 40)) + passage[rnd.randint(0, 20) :] + word(rnd.randint(0, 40))) for i in range(250)]
    rows += [(500, word(20) + passage + word(20)) for _ in range(150)] + [(501, passage)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffixes.dedup(df).collect())
    assert got == brute_suffixes(ordered, 100)


def test_loser_tree_merges_and_tells_prefixes():
    rnd = random.Random(4)
    runs = [sorted({bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(rnd.randint(0, 40))}) for _ in range(7)]

    def common(a, b):
        return next((i for i in range(12) if a[i] != b[i]), 12)

    lcps = [bytes([0, *(common(a, b) for a, b in zip(r, r[1:], strict=False))]) for r in runs]
    out = list(suffixes.merge(runs, lcps))
    merged = [runs[r][i] for r, i, _ in out]
    assert merged == sorted(x for r in runs for x in r)
    assert [s for _, _, s in out][1:] == [common(a, b) for a, b in zip(merged, merged[1:], strict=False)]
    assert list(suffixes.merge([], [])) == []


def vector_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(16)
        for k in range(rng.choice([1, 1, 1, 3])):
            w = v + rng.standard_normal(16) * rng.choice([0, 0.02, 0.12]) * (k > 0)
            rows.append((len(rows), [float(np.float32(x)) for x in w], int(i % 3)))
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, [None] + [1.0] * 15, 1), (9004, [float("inf")] * 16, 1), (9005, rows[0][1], None), (9006, rows[0][1], rows[0][2])]
    return rows


def good(rows):
    return [(i, np.array(v), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def test_near_vectors(spark):
    rows = vector_rows(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, key="vec_id", vector="embedding", label="label").collect()}
    own = [x for x in good(rows) if x[2] is not None]
    links = [(a, b) for a, u, s in own for b, v, t in own if a < b and s == t and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98]
    comp = union(links, [r[0] for r in rows])
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert got == {(k, n[k], comp[k], comp[k] == k) for k in n}
    assert vectors.near_duplicates(df.limit(0), key="vec_id", vector="embedding", label="label").count() == 0


def test_hot_cell_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIDE", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.03], 0) for i in range(120)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), key="vec_id", vector="embedding", label="label").collect()
    x = np.array([r[1] for r in rows])
    c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert {r.vec_id: r.n_links for r in got} == {i: int((c[i] >= 0.98).sum() - 1) for i in range(120)}


def test_near_vectors_of_one_id(spark):
    """Rows of one id with different vectors count their own links."""
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(1, a, 0), (1, b, 0), (2, a + 0.001, 0), (2, a + 0.001, 0), (3, b, 1)]
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], s) for i, v, s in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, key="vec_id", vector="embedding", label="label").collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]


def test_nearest_of_one_id(spark):
    """Query rows that share an id have a ranking each; the other row of the id is a candidate; few rows are all found."""
    x = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.25], [1.0, 0.25]]
    df = spark.createDataFrame([(100, x[0]), (100, x[1]), (7, x[2]), (5, x[3])], "vec_id long, embedding array<float>")
    got = vectors.nearest(df, F.col("vec_id") % 100 == 0, key="vec_id", vector="embedding", k=10).collect()
    by_rank = sorted((r.rank, r.vec_id, r.score) for r in got)
    assert [x[:2] for x in by_rank] == [(1, 5), (1, 5), (2, 7), (2, 7), (3, 100), (3, 100)]
    assert by_rank[0][2] == 0.25


def test_nearest(spark):
    rows = vector_rows(2, 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got: dict = {}
    for r in vectors.nearest(df, F.col("vec_id") % 20 == 0, key="vec_id", vector="embedding", k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    own = good(rows)
    hits = total = 0
    for q, u, _ in own:
        if q % 20 == 0:
            want = [b for _, b in sorted((float(np.sqrt(((u - v) ** 2).sum())), b) for b, v, _ in own if b != q)[:5]]
            hits, total = hits + len(set(want) & set(got[q])), total + 5
    assert hits >= 0.9 * total
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 20 == 0, key="vec_id", vector="embedding").count() == 0


def test_nearest_in_another_layout_and_in_parts(spark, monkeypatch):
    """The same rankings however the rows lie in files, and whether lists and their queries go whole or in parts."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * r.standard_normal(16)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda x: sorted(map(tuple, vectors.nearest(x, F.col("vec_id") % 7 == 0, key="vec_id", vector="embedding", k=4).collect()))
    whole = ask(df.repartition(3))
    assert len(whole) == 129 * 4
    monkeypatch.setattr(vectors, "LIST", 20)
    monkeypatch.setattr(vectors, "QUERIES", 9)
    assert ask(df.orderBy(F.desc("vec_id")).repartition(1)) == whole


def test_nearest_among_copies(spark):
    """With over a third of rows equal, a query near them gets the copies of least id."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 16))
    same = rng.permutation(3000)[:1100]
    x[same] = x[same[0]]
    asked = next(i for i in range(3000) if i not in set(same.tolist()))
    x[asked] = x[same[0]] + 0.01 * rng.standard_normal(16)
    member = int(min(same))
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vectors.nearest(df, F.col("vec_id").isin(asked, member), key="vec_id", vector="embedding", k=10).orderBy("query_id", "rank").collect()
    least = sorted(same.tolist())
    assert [r.vec_id for r in got if r.query_id == asked] == least[:10]
    assert [r.vec_id for r in got if r.query_id == member] == least[1:11]


def test_recall_on_the_table(spark):
    from obliva.llm import registry

    d = "/root/testdata/sf0.1"
    x = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    m, ids = np.array(x.embedding.tolist(), float), x.vec_id.to_numpy()
    got = registry.op3_permutation_index(spark, d).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        k = int(np.flatnonzero(ids == q)[0])
        dist = np.sqrt(((m - m[k]) ** 2).sum(1))
        dist[k] = np.inf
        hits += len(set(ids[np.lexsort((ids, dist))[:10]]) & set(got[got.query_id == q].vec_id))
        total += 10
    assert hits >= 0.9 * total


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    before = docs
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "tokens":
            assert after.columns == C.COLUMNS
        if name == "near_duplicates":
            sets = {r.doc_id: shingle_set(r.text, 5) for r in before.collect()}
            pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert {r.doc_id for r in after.collect()} == set(union(pairs, sets).values())
        if name == "secrets":
            assert after.count() == before.count()
            assert after.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
        if name == "tokens":
            assert sorted(hashlib.sha256(r.decoded.encode()).hexdigest() for r in after.collect()) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before.collect())
        before = after
    assert len(C.STAGES) == 5


def odd_documents(spark):
    """Null ids, texts and sources, repeated rows, ids with several texts, a very long text, and columns with clashing names."""
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "x y", None, None, 3), (3, "x y", None, None, 3), (4, "w " * 50, "en", "b", 100), (4, "v " * 50, "en", "b", 100), (4, "u " * 50, "en", "b", 100)]
    rows += [(None, "no id at all", "en", "a", 12), (None, "no id at all", "en", "a", 12), (5, "long " * 100_000, "en", "a", 500_000)] + [(10 + i, f"one two three {i}", "en", "ab"[i % 2], None) for i in range(40)]
    return spark.createDataFrame([(*r, 0.5, "c", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, copies string, size int")


def test_quality_stage_of_odd_rows(spark, monkeypatch):
    import corpus_pipeline as C
    from obliva.llm import quality

    weights = np.zeros(quality.WIDTH + 1)
    docs = odd_documents(spark)
    for bias, kept in ((5.0, docs.where("doc_id is not null").count()), (-5.0, 0)):
        weights[-1] = bias
        monkeypatch.setattr(quality, "train", lambda rows: weights.tobytes())
        out = C.keep_quality(spark, docs, SF)
        assert out.columns == C.COLUMNS
        assert out.count() == kept
    assert sorted(map(str, C.keep_quality(spark, docs.limit(0), SF).collect())) == []


def test_mixing_stage_of_odd_rows(spark):
    """Rows are taken none, one or two times each; rows of one id are not multiplied by one another."""
    import corpus_pipeline as C
    from obliva.llm import mixing

    docs = odd_documents(spark)
    out = C.mix_sources(spark, docs, SF)
    assert out.columns == C.COLUMNS
    taken = {tuple(r)[:-1]: r.n for r in out.groupBy(*C.COLUMNS).agg(F.count("*").alias("n")).collect()}
    there = {tuple(r)[:-1]: r.n for r in docs.groupBy(*C.COLUMNS).agg(F.count("*").alias("n")).collect()}
    assert set(taken) <= set(there)
    assert all(n <= 2 * there[k] for k, n in taken.items())
    copies = mixing.mix(docs)
    assert out.count() == copies.agg(F.sum("copies")).first()[0]
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert words(out.select("source", mixing.text_size(F.col("text")).alias("n"))) == {s: n for s, n in words(copies.select("source", (F.col("copies") * F.col("size")).alias("n"))).items() if n}


def test_other_stages_of_odd_rows(spark):
    import corpus_pipeline as C

    docs = odd_documents(spark)
    one = C.drop_near_duplicates(spark, docs, SF)
    assert one.columns == C.COLUMNS
    assert {r.doc_id for r in one.collect()} >= {1, 2, 3, 4, 5, 10}
    marked = C.redact_secrets(spark, docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" password=abcdefg1"))), SF)
    assert marked.columns == C.COLUMNS
    assert marked.where(F.col("text").contains("abcdefg1")).count() == 0
    assert C.encode(spark, docs, SF).count() == docs.count()


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize(("side", "pairs"), [(2048, 1 << 17), (4, 8)])
def test_close_pairs_are_those_of_the_rule(spark, monkeypatch, side, pairs):
    """Groups on one key, dealt into blocks and compared in pieces, against every pair of the rows."""
    monkeypatch.setattr(jaccard, "SIDE", side)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    draw, rows, want, percent = random.Random(5), [], set(), 80
    for key, count in enumerate([1, 2, 3, 17, 40]):
        base = [draw.getrandbits(63) for _ in range(jaccard.LONGS)]
        group = []
        for k in range(count):
            n, low = draw.randrange(24, 29), draw.choice([3, 3, 3, 7, 100 + k])
            lo = [x ^ (1 << draw.randrange(60)) if draw.random() < 0.1 else x for x in base]
            hi = [x | (1 << draw.randrange(60)) for x in lo]
            left, right = draw.choice([(True, True), (True, False), (False, True)])
            group.append((key, key % 2, count, left, right, draw.randrange(4), key * 1000 + k, n, low, low + draw.choice([0, 0, 0, 1]), lo, hi))
        rows += group
        for x, y in itertools.combinations(group, 2):
            if x[8] == x[9] == y[8] == y[9] or not ((x[3] and y[4]) or (y[3] and x[4])):
                continue
            room = min(x[7] - x[5], y[7] - y[5]) * (100 + percent) >= (x[7] + y[7]) * percent
            differ = sum(((a & ~d) | (c & ~b)).bit_count() for a, b, c, d in zip(x[10], x[11], y[10], y[11], strict=True))
            most = (x[7] + y[7] - differ) // 2
            if room and most * 100 >= (x[7] + y[7] - most) * percent:
                want.add((x[6], y[6]))
    kinds = "k1 long, k2 long, count long, left boolean, right boolean, pos long, id long, n long, cmin long, cmax long, lo array<long>, hi array<long>"
    got = [tuple(r) for r in jaccard._close(spark.createDataFrame(rows, kinds), percent).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50
