"""Operators against plain restatements on small tables, and invariants."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva import config
from obliva.functions import logits as L
from obliva.functions.attributes import ATTRIBUTES
from obliva.operators import corpus, decode, evaluation, order, prep, scoring, splits
from obliva.plans import stages
from obliva.plans import views as V
from obliva.sources import catalog, readers, sinks
from obliva.streaming import scored_stream

SF = "/root/testdata/sf0.001"


def test_split_invariants(spark):
    qa = V.qa(spark, SF).cache()
    names = splits.forget_names(qa, "n_per_firstname", 2, "s")
    total = qa.count()
    for mode in config.RETAIN_MODES:
        out = splits.labelled(qa, names, ("blood_type",), mode, 3, "s").cache()
        assert out.count() == total
        forget = out.where("split = 'forget'")
        assert forget.count() == splits.forget_set(qa, names, ("blood_type",)).count()
        groups = names.select("first_name").distinct()
        most = out.where("split = 'retain'").join(groups, "first_name").groupBy("first_name").agg(F.count_distinct("name").alias("n")).agg(F.max("n")).first()[0]
        assert most <= 3
        if mode != "all_except_forget":
            assert out.where("split = 'retain'").join(names, "name", "left_semi").count() == 0


def test_first_seen_cap(spark):
    """a, b, a, c in hash order with a cap of 2: c is not retained."""
    rows = [("G", n, "blood_type", t, "", "") for n in ("G a", "G b", "G c", "G d") for t in range(3)]
    qa = spark.createDataFrame(rows, "first_name string, name string, attribute string, template int, question string, answer string")
    names = spark.createDataFrame([("G", "G d")], "first_name string, name string")
    out = splits.labelled(qa, names, ATTRIBUTES, "same_firstname", 2, "s")
    import hashlib

    key = lambda r: hashlib.md5(f"s|{r[1]}|{r[2]}|{r[3]}".encode()).hexdigest()
    seen: list[str] = []
    for r in sorted((r for r in rows if r[1] != "G d"), key=key):
        if r[1] not in seen and len(seen) < 2:
            seen.append(r[1])
    assert {r.name for r in out.where("split = 'retain'").collect()} == set(seen)
    assert out.where("split = 'retain'").count() == 6


def test_combination_ends_when_exhausted(spark):
    qa = V.qa(spark, SF).limit(40)
    pairs = qa.select("name", "attribute").distinct().count()
    assert splits.combination(qa, 10_000, "s").count() == pairs


def test_positions_are_dense(spark):
    df = spark.range(5000)
    got = [r.pos for r in order.positions(df, "s", "id").orderBy("pos").collect()]
    assert got == list(range(5000))


def test_positions_within_groups(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") % 7).cast("string"))
    got: dict = {}
    for r in order.positions(df, "s", "id", within=("g",)).collect():
        got.setdefault(r.g, []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in got.values())
    assert sum(map(len, got.values())) == 3000


def test_recovery_audits_every_sequence(spark, tmp_path):
    from obliva.queries import QUERIES

    want = {r.attribute: r["count"] for r in V.sequences(spark, SF).groupBy("attribute").count().collect()}
    assert {r.attribute: r.n for r in QUERIES["flip_recovery_error"](spark, SF).collect()} == want
    for t in ("customer", "nation", "embeddings"):
        rows = V.table(spark, SF, t)
        (rows.limit(10) if t == "customer" else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    assert {r.attribute: r.n for r in QUERIES["flip_recovery_error"](spark, str(tmp_path)).collect()} == want


def test_packing_drops_the_tail(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4, 5]), (1, 1, [7])], "b int, o int, ids array<int>")
    got = prep.packed(df, "b", ["o"], "ids", 2).orderBy("block").collect()
    assert [r.input_ids for r in got] == [[1, 2], [3, 4]]


def test_label_mask(spark):
    df = spark.createDataFrame([("a b", "a b c d")], "q string, t string")
    r = prep.tokenised(df, F.col("q"), F.col("t"), 6).first()
    assert r.labels[:2] == [-100, -100]
    assert r.labels[2:4] == r.input_ids[2:4]
    assert r.labels[4:] == [-100, -100]
    assert r.attention_mask == [1, 1, 1, 1, 0, 0]


def test_means_and_baseline(spark):
    empty = spark.createDataFrame([], "attribute string, error double")
    assert {tuple(r) for r in scoring.error_by_attribute(empty).collect()} == {(a, 0.0, 0) for a in ATTRIBUTES}
    df = spark.createDataFrame([(8.0,), (-1.0,), (None,), (6.0,)], "s double")
    assert df.select(scoring.mean_score(F.col("s"))).first()[0] == 7.0
    stats = scoring.statistics(df.withColumn("n", F.lit(-1.0)), ["s", "n"], model="m").first()
    assert stats.average_scores == {"s": 7.0}
    base = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)], "name string, pos int, score double")
    got = scoring.with_baseline(spark.createDataFrame([("a",), ("z",)], "name string"), base, ("name",)).collect()
    assert [tuple(r) for r in got] == [("a", 2.0)]


def test_best_candidate(spark):
    df = spark.createDataFrame([("q", 0, "x", 0.5), ("q", 1, "y", 0.1), ("q", 2, "z", 0.1)], "k string, idx int, pred string, error double")
    assert tuple(scoring.best_candidate(df, ["k"], 3).first()) == ("q", "y", 0.1, 1)
    assert tuple(scoring.best_candidate(df, ["k"], 0).first()) == ("q", "", math.inf, -1)


def plain_options(attribute, sets, pos, before):
    rules = {(p, t): set(a) for p, t, a in decode.YEAR_RULES}
    base = sets[pos]
    rule = rules.get((pos, before)) if attribute == "year_of_birth" else None
    return [t for t in base if rule and t in rule] or base


def plain_complete(attribute, tokens):
    text = "".join(chr(t + 32) for t in tokens)
    if attribute == "year_of_birth":
        return bool(re.fullmatch(r"\s*\d{4}\.", text))
    if attribute == "address_postcode":
        return bool(re.fullmatch(r"\s*([A-Z]\d){3}\.", text))
    if attribute == "social_insurance_number":
        return sum(c.isdigit() for c in text) >= 9 or text.endswith(".")
    return text.strip() in ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-") or text.strip().endswith(".")


@pytest.mark.parametrize(("flip", "k", "c", "entropy"), [(False, 4, 3, False), (False, 5, 3, False), (True, 3, 3, True)])
def test_beams_against_plain_search(spark, flip, k, c, entropy):
    """All sequences of all attributes, with the entropy weight of the candidates and without."""
    sign = -1.0 if flip else 1.0
    rows = V.sequences(spark, SF)
    sets = decode.position_sets(decode.position_tokens(corpus.unpivoted(V.profiles(spark, SF)))).cache()
    own = {r.attribute: r.sets for r in sets.collect()}

    def weight(scores):
        if not entropy or len(scores) <= 1:
            return 1.0
        z = [math.exp(s - max(scores)) for s in scores]
        p = [x / sum(z) for x in z]
        return max(0.1, min(1.0, 1 + sum(x * math.log(x) for x in p if x) / math.log(len(p))))

    for r in decode.beam_decode(rows, sets, flip, k, c, entropy).collect():
        beams, done = [(0.0, [])], []
        for pos in range(len(own[r.attribute])):
            new = []
            for s, toks in beams:
                allowed = plain_options(r.attribute, own[r.attribute], pos, toks[-1] if toks else None)
                w = weight([sign * r.steps[pos][t] for t in allowed])
                for t in sorted(allowed, key=lambda t: (-sign * r.steps[pos][t], t))[:c]:
                    new.append((s + w * sign * r.steps[pos][t], [*toks, t]))
            order = lambda b: (-b[0], b[1])
            done = sorted(done + [b for b in new if plain_complete(r.attribute, b[1])], key=order)[:k]
            nxt = sorted((b for b in new if not plain_complete(r.attribute, b[1])), key=order)[:k]
            if not nxt:
                beams = beams if not done else []
                break
            beams = nxt
        want = done or beams
        assert [b.score for b in r.beams] == pytest.approx([b[0] for b in want])
        if not entropy:  # sums of equal terms in another order may tie or not in the last bit
            assert [b.tokens for b in r.beams] == [b[1] for b in want]


@pytest.mark.parametrize(("oracle", "npo", "largest"), [(False, None, True), (True, 1.0, False), (True, None, True)])
def test_gradient_beams_against_plain_search(spark, oracle, npo, largest):
    rows = V.sequences(spark, SF).withColumn("truth", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda p: F.when(p == 0, 0).otherwise(16 + ((F.col("vec_id") + p) % 10).cast("int"))))
    tokens = decode.position_tokens(corpus.unpivoted(V.profiles(spark, SF))).cache()
    own = {r.attribute: r.sets for r in decode.position_sets(tokens).collect()}
    last = spark.createDataFrame([(a, len(s)) for a, s in own.items()], "attribute string, n int")
    steps = rows.select("vec_id", "attribute", F.posexplode(F.arrays_zip("steps", "truth")).alias("pos", "s")).join(last, "attribute").where("pos < n")
    steps = steps.select("vec_id", "attribute", "pos", F.col("s.steps").alias("logits"), F.col("s.truth").alias("truth"), F.reverse("s.steps").alias("reference"), F.lit(1.5).alias("hidden_norm"))
    got: dict = {}
    for r in decode.gradient_decode(decode.with_candidates(steps, tokens), ["vec_id", "attribute"], largest, 3, 2, oracle, npo).orderBy("vec_id", "beam").collect():
        got.setdefault(r.vec_id, []).append(r)

    def soft(v):
        top = max(v)
        e = [math.exp(x - top) for x in v]
        total = sum(e)
        return [x / total for x in e]

    for r in rows.collect():
        beams = [(0.0, [], [])]
        for pos in range(len(own[r.attribute])):
            p, q = soft(r.steps[pos]), soft(r.steps[pos][::-1])
            square = sum(x * x for x in p)
            norms = {}
            for t in own[r.attribute][pos]:
                norms[t] = (1.5 + 1e-12) * math.sqrt(1 - 2 * p[t] + square + 1e-12) * (2 * p[t] / (p[t] + q[t]) if npo else 1.0)
            ordered = sorted(norms, key=lambda t: (-norms[t] if largest else norms[t], t))
            truth = r.truth[pos]
            note = f"{ordered.index(truth) if truth in ordered else 'NA'}/{len(ordered) - 1}"
            new = [(s + (norms[t] if largest else -norms[t]), [*toks, truth if oracle else t], [*notes, note]) for s, toks, notes in beams for t in ordered[:2]]
            beams = sorted(new, key=lambda b: (-b[0], b[1]))[:3]
        assert [x.score for x in got[r.vec_id]] == pytest.approx([b[0] for b in beams])
        assert [x.orders for x in got[r.vec_id]] == [b[2] for b in beams]
        if oracle:
            assert all(x.tokens == r.truth[: len(own[r.attribute])] for x in got[r.vec_id])


def test_cleaning_against_a_plain_restatement(spark):
    """All outputs of the table, step by step in Python."""
    from obliva.queries import QUERIES

    start, end = V.START, V.END

    def plain(text, prompt):
        span = re.compile(re.escape(start) + ".*?" + re.escape(end), re.S)

        def spans(x):
            while span.search(x):
                x = span.sub("", x)
            return x

        text = spans(text)
        if text.count(start) > text.count(end):
            text = text[: text.rindex(start)].strip()
        text = re.sub(f"(?i)(?<!{re.escape(end)}){re.escape(start)}|{re.escape(end)}(?!{re.escape(start)})", "", text)
        bare = spans(prompt).strip()
        if len(bare) > 5:
            text = re.sub(r"\s*" + re.escape(bare) + r"\s*", "", text, flags=re.I)
        text = re.sub(r"(\b.+\b)(\s*\1){2,}", r"\1", text, flags=re.S)
        lines = [x.strip() for x in text.splitlines()]
        return "\n".join(x for x in lines if x) or "[EMPTY]"

    got = {(r.conv_id, r.turn): r.cleaned for r in QUERIES["clean_output"](spark, SF).collect()}
    raw = V.raw_outputs(spark, SF).collect()
    assert len(got) == len(raw)
    for r in raw:
        assert got[r.conv_id, r.turn] == plain(r.output, r.question)


def test_runs_and_records(spark, tmp_path):
    for n in ("epoch-2", "epoch-10", "other"):
        (tmp_path / n).mkdir()
    assert [p.rsplit("/", 1)[1] for p in catalog.folders(spark, str(tmp_path), "epoch-")] == ["epoch-10", "epoch-2"]
    log = spark.createDataFrame([(1, 0.5), (2, 0.25)], "step int, loss double")
    sinks.run_record(log, config.Unlearn(method="npo"), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/log_history")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "run/config")).first()[0])["method"] == "npo"
    detail = spark.createDataFrame([(2, "b", 0.5), (1, "a", 0.25)], "pos int, attribute string, error double")
    sinks.legacy_results(detail, spark.createDataFrame([(0, 0.375)], "pos int, mean double"), str(tmp_path / "legacy"), "pos")
    rows = json.loads(spark.read.text(str(tmp_path / "legacy")).first()[0])
    assert rows == [{"attribute": "a", "error": 0.25}, {"attribute": "b", "error": 0.5}, {"mean": 0.375}]
    (tmp_path / "base.json").write_text(json.dumps([{"name": "a", "base_llm_score": 5.0}, {"type": "statistics"}]))
    assert readers.baseline(spark, str(tmp_path / "base.json")).count() == 1
    for n in ("train", "validation"):
        (tmp_path / f"{n}.json").write_text('{"text": "x"}\n{"text": "y"}\n')
    assert {k: v.count() for k, v in readers.text_splits(spark, str(tmp_path / "train.json"), str(tmp_path / "validation.json")).items()} == {"train": 2, "validation": 2}
    tokens = decode.position_tokens(corpus.unpivoted(V.profiles(spark, SF)))
    sinks.token_notes(tokens, str(tmp_path / "notes"))
    assert spark.read.text(str(tmp_path / "notes")).count() == tokens.count()
    sets = splits.planned(V.qa(spark, SF), config.Split(forget_mode="n_per_firstname", num_profiles=2, attributes=("blood_type",)))
    sinks.split_with_test(sets, corpus.one_per_pair(sets.where("split = 'forget'"), "t"), str(tmp_path / "sets"))
    back = spark.read.parquet(str(tmp_path / "sets/sets"))
    assert back.count() == sets.count()
    assert {r.mode for r in back.select("mode").distinct().collect()} == set(config.Split().retain_modes)


def test_stages_run_once_and_in_order(spark, tmp_path):
    ran = []

    def stage(name, fails=False):
        def run(tables):
            ran.append((name, sorted(tables)))
            if fails:
                raise RuntimeError(name)
            return spark.range(3) if not tables else tables["a"]

        return name, run

    with pytest.raises(RuntimeError):
        stages.run(spark, [stage("a"), stage("b", fails=True), stage("c")], str(tmp_path))
    out = stages.run(spark, [stage("a"), stage("b"), stage("c")], str(tmp_path))
    assert ran == [("a", []), ("b", ["a"]), ("b", ["a"]), ("c", ["a", "b"])]
    assert {k: v.count() for k, v in out.items()} == {"a": 3, "b": 3, "c": 3}


def test_guards_and_settings(spark):
    df = spark.createDataFrame([([1, 2], [3, 4], [5])], "a array<int>, b array<int>, c array<int>")
    assert df.where(prep.same_sizes(F.col("a"), F.col("b"))).count() == 1
    with pytest.raises(Exception, match="different lengths"):
        df.where(prep.same_sizes(F.col("a"), F.col("c"))).count()
    none = spark.createDataFrame([], "pos long, text string")
    two = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, text string")
    assert prep.triples(two, two, none, ["name"], "s").count() == 0
    assert prep.triples(two, None, None, ["name"], "s").count() == 2
    assert config.FineTune().steps(11, 5) == 3
    assert config.Recover.legacy(True, kind="beam").kind == "flip"
    assert config.Recover.legacy(False, kind="beam").kind == "beam"


def test_generation_from_a_table(spark):
    rows = spark.createDataFrame([("who is it",), ("unknown thing",)], "question string")
    table = spark.createDataFrame([("who is it", "[INST]who is it[/INST] nobody nobody nobody")], "prompt string, model_output string")
    got = {r.question: r.model_output for r in evaluation.generated(rows, table, "[INST]", "[/INST]").collect()}
    assert got == {"who is it": "nobody", "unknown thing": "[EMPTY]"}


def test_common_evaluation_with_metrics(spark):
    from obliva.queries import _common

    rows = _common(spark, SF, config.Evaluate(judge_base=True, judge_full=True, text_metrics=True))
    scores = evaluation.common_statistics(rows, "m").first().average_scores
    assert set(scores) >= {"base_llm_score", "model_llm_score", "llm_score", "metrics.bleu", "metrics.question_relevance"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"Ada": [{"name": "Ada X", "year_of_birth": 1980, "address_postcode": "K1A0B1", "social_insurance_number": "012345678", "blood_type": "A+"}]}))
    p = readers.profile_map(spark, str(tmp_path / "p.json")).first()
    assert (p.first_name, p.name, p.year_of_birth, p.social_insurance_number) == ("Ada", "Ada X", 1980, "012345678")
    (tmp_path / "attributes").mkdir()
    (tmp_path / "attributes/blood_type.jsonl").write_text("A+\nO-\n")
    assert {tuple(r) for r in readers.attribute_values(spark, str(tmp_path / "attributes/*.jsonl")).collect()} == {("blood_type", "A+"), ("blood_type", "O-")}
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError, match="no lines"):
        readers.lines(spark, str(tmp_path / "empty.txt"), required=True)
    (tmp_path / "qa.json").write_text(json.dumps([{"name": "a", "attribute": "b", "question": "q", "answer": "x"}, {"name": "c", "attribute": "d", "question": "q"}]))
    qa = readers.json_array(spark, str(tmp_path / "qa.json"))
    assert qa.where("answer is null").count() == 1
    sinks.json_array(qa.withColumn("pos", F.monotonically_increasing_id()), str(tmp_path / "out"), "pos")
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert [r["name"] for r in json.loads(text)] == ["a", "c"]
    (tmp_path / "legacy.json").write_text(json.dumps([{"attribute": "b", "error": 0.5}, {"blood_type": 0.1}]))
    detail, trailer = readers.legacy_results(spark, str(tmp_path / "legacy.json"))
    assert (detail.count(), trailer.count()) == (1, 1)
    sinks.attribute_files(corpus.unpivoted(V.profiles(spark, SF)), str(tmp_path / "attrs"))
    assert len(list((tmp_path / "attrs").glob("attribute=*"))) == 4
    sinks.results(detail, trailer, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res/detail")).count() == 1


def test_catalog_and_config():
    assert catalog.dataset_path("train", "d") == "d/training_dataset.json"
    assert catalog.dataset_path("retain_sfa", "d", "s") == "d/s/test-retain-same_fn_attr.json"
    for bad in (("nothing", "d"), ("forget", "d")):
        with pytest.raises(ValueError):
            catalog.dataset_path(*bad)
    assert catalog.split_folder(20, 1, suffix="bld") == "unlearn-N20-A1-bld"
    with pytest.raises(ValueError):
        config.Unlearn(method="other")
    assert config.FineTune().alpha == 512
    assert not config.Unlearn(method="grad_ascent").needs_retain


def test_judge_is_asked_for_needed_rows_only(spark):
    rows = spark.createDataFrame([(1, "blood_type"), (2, "likes")], "id int, attribute string")
    asked = []

    def judge(df):
        asked.append(df.count())
        return df.select("id", F.lit("Rating: 5").alias("judge_output"))

    got = {r.id: r.judge_output for r in scoring.judged(rows, judge, ["id"], ~F.col("attribute").isin(*ATTRIBUTES)).collect()}
    assert asked == [1]
    assert got == {1: None, 2: "Rating: 5"}


def test_stream_equals_batch(spark, tmp_path):
    p = V.predictions(spark, SF)
    p.write.parquet(str(tmp_path / "in"))
    q = scored_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").agg(F.sum("error")).first()[0] == pytest.approx(scoring.error_detail(p).agg(F.sum("error")).first()[0])


def test_vocabulary_text_of_rows_from_a_shuffle(spark):
    """Each row has its own pieces, though a narrow reading of the rows is dealt otherwise than a whole one."""
    n, k = 4000, F.col("id")
    ids = F.when(k % 10 == 0, F.array().cast("array<bigint>")).when(k % 10 != 1, F.array(k % 7, k % 11, F.lit(3), F.lit(None), k))
    wide = F.concat(*[F.sha2((k * 8 + i).cast("string"), 256) for i in range(8)])
    vocabulary = spark.range(10).select("id", F.concat(F.lit(" "), F.col("id").cast("string")).alias("piece"))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {c: spark.conf.get(c) for c in settings}
    try:
        for c, v in settings.items():
            spark.conf.set(c, v)
        place = F.row_number().over(Window.partitionBy(k % 97).orderBy("id"))
        rows = spark.range(n).select("id", wide.alias("wide"), F.lit("old").alias("text"), place.alias("place")).withColumn("ids", ids)
        got = decode.vocabulary_text(rows, "ids", vocabulary, (3,)).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    piece = lambda x: f" {x}" if x < 10 else f"<{x}>"
    want = {i: "" if i % 10 < 2 else "".join(piece(x) for x in (i % 7, i % 11, i) if x != 3) for i in range(n)}
    assert len(got) == n and {r.id: r.text for r in got} == want


def test_gradient_norms_to_the_last_bit(spark):
    """As with the C library's exp and log: beams of equal norms in another order are told apart by nothing else."""
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 3) for _ in range(64)], [3, 20, 60], 2.0) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, logits array<double>, options array<int>, hidden_norm double")
    for row in decode.gradient_order(df, True).collect():
        v = rows[row.i][1]
        added = square = 0.0
        for x in v:
            added += math.exp(x - max(v))
        p = [math.exp(x - (max(v) + math.log(added))) for x in v]
        for x in p:
            square += x * x
        assert {o.token: o.norm for o in row.ordered} == {t: (2.0 + 1e-12) * math.sqrt(1 - 2 * max(p[t], 1e-20) + square + 1e-12) for t in (3, 20, 60)}
    odd = spark.createDataFrame([(None,), ([],), ([1.0, None],), ([1.0, math.nan],), ([0.0],)], "v array<double>")
    assert [str(x[0]) for x in odd.select(L.softmax_c(F.col("v"))).collect()] == ["None", "[]", "[None, None]", "[nan, nan]", "[1.0]"]
