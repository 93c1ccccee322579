"""Advancing beams, global clipping, vocabularies, batched model calls, the graph of stages, retention of checkpoints."""

from __future__ import annotations

import math
import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obliva import config
from obliva.functions import logits as L
from obliva.operators import advance, decode, evaluation, gradients, models, prep, tokens
from obliva.plans import stages
from obliva.sources import catalog, retention

SETS = {"year_of_birth": [[0], [17, 18], [16, 25], [16, 23, 24], [19, 20, 21]], "blood_type": [[0, 33], [11, 33, 34], [11, 13]], "other": [[1, 2], [3]]}
LENGTH = {"year_of_birth": 5, "blood_type": 3, "other": 2}


def sets_of(spark):
    return spark.createDataFrame(list(SETS.items()), "attribute string, sets array<array<int>>")


def sequences(spark, n=6, seed=3):
    """key, attribute, truth, steps: few logits, many of them equal."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        attribute = list(SETS)[k % 3]
        rows.append((k, attribute, [r.choice(s) for s in SETS[attribute]], [[float(r.randint(-3, 3)) for _ in range(64)] for _ in range(5)]))
    return spark.createDataFrame(rows, "key long, attribute string, truth array<int>, steps array<array<double>>").cache()


def by_position(rows):
    """The steps as a table of contexts whose prefix is empty."""
    steps = rows.select("key", F.posexplode("steps").alias("pos", "logits"))
    return steps.withColumn("prefix", F.array().cast("array<int>"))


def turned(rows):
    """A model whose logits depend on the prefix: the position's, turned by the sum of the tokens so far."""

    def model(contexts):
        met = contexts.join(rows.select("key", F.col("steps").alias("_s")), "key")
        shift = F.aggregate("prefix", F.lit(0), lambda a, x: a + x)
        logits = L.let(F.get("_s", F.col("pos")), lambda v: L.let(shift, lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(v, (i + k) % 64))))
        out = met.withColumn("logits", logits).drop("_s")
        return out.withColumns({"hidden_norm": L.l2_norm(F.col("logits")), "reference": F.reverse("logits")})

    return model


def allowed(attribute, pos, tokens_, options):
    for p, before, narrow in decode.YEAR_RULES:
        if attribute == "year_of_birth" and p == pos and tokens_ and tokens_[-1] == before:
            return [t for t in options if t in narrow] or options
    return options


def complete(text, attribute):
    if attribute == "year_of_birth":
        return len(text.strip()) == 5 and text.strip()[:4].isdigit() and text.endswith(".")
    return attribute == "blood_type" and (text.strip() in ("A+", "A-", "B+", "B-", "O+", "O-", "AB+", "AB-") or text.strip().endswith("."))


def plain_beams(row, k, c, sign, context=True, stop=True):
    """Beams by lists: the best c options of each beam, then the best k, complete ones apart."""
    open_, done = [(0.0, [])], []
    for pos, options in enumerate(SETS[row.attribute]):
        grown = []
        for score, toks in open_:
            shift = sum(toks) if context else 0
            value = {t: sign * row.steps[pos][(t + shift) % 64] for t in allowed(row.attribute, pos, toks, options)}
            grown += [(score + value[t], [*toks, t]) for t in sorted(value, key=lambda t: (-value[t], t))[:c]]
        order = lambda b: (-b[0], b[1])
        whole = [b for b in grown if stop and complete("".join(chr(t + 32) for t in b[1]), row.attribute)]
        done = sorted(done + whole, key=order)[:k]
        left = sorted((b for b in grown if b not in whole), key=order)[:k]
        if not left:
            break
        open_ = left
    return done or open_


def beams_of(df):
    out = {}
    for r in df.orderBy("key", "beam").collect():
        out.setdefault(r.key, []).append((r.score, list(r.tokens)))
    return out


@pytest.mark.parametrize(("k", "c", "flip"), [(1, 1, True), (4, 2, False)])
def test_beams_advance(spark, k, c, flip):
    rows = sequences(spark)
    got = beams_of(advance.advance(rows.select("key", "attribute"), sets_of(spark), turned(rows), advance.by_logits(flip, c), keys=["key"], beams=k))
    assert got == {r.key: plain_beams(r, k, c, -1.0 if flip else 1.0) for r in rows.collect()}


def test_without_context_beams_equal_the_fold(spark):
    """The table of logits by position, and the fold over the sequence's own steps."""
    rows = sequences(spark)
    for entropy in (False, True):
        got = beams_of(advance.advance(rows.select("key", "attribute"), sets_of(spark), by_position(rows), advance.by_logits(False, 3, entropy), keys=["key"], beams=3, context=False))
        fold = decode.beam_decode(rows, sets_of(spark), False, 3, 3, entropy).select("key", F.posexplode("beams").alias("beam", "b")).select("key", "beam", "b.score", "b.tokens")
        assert got == beams_of(fold)


def test_a_context_that_the_table_lacks_is_an_error(spark):
    rows = sequences(spark)
    table = by_position(rows).where("not (key = 1 and pos = 1)")
    with pytest.raises(Exception, match="no logits at position 1"):
        advance.advance(rows.select("key", "attribute"), sets_of(spark), table, advance.by_logits(False, 1), keys=["key"], beams=1, context=False).collect()


def test_recoveries_with_an_advancing_model(spark):
    rows = sequences(spark)
    sets = sets_of(spark)
    flip = evaluation.recovered_with(rows, sets, turned(rows), config.Recover(kind="flip", flip=True)).collect()
    for x in flip:
        row = next(r for r in rows.collect() if r.key == x.key)
        score, toks = plain_beams(row, 1, 1, -1.0, stop=False)[0]
        assert x.pred == "".join(chr(t + 32) for t in toks)
        assert x.average_score == pytest.approx(score / len(toks))
        notes = []
        for pos, options in enumerate(SETS[row.attribute]):
            own = allowed(row.attribute, pos, toks[:pos], options)
            value = lambda t, pos=pos: row.steps[pos][(t + sum(toks[:pos])) % 64]
            true = row.truth[pos]
            place = sum((value(t), -t) > (value(true), -true) for t in own) if true in own else -1
            notes.append(f"{place}/{len(own) - 1}")
        assert x.orders == ", ".join(notes)
    oracle = evaluation.recovered_with(rows, sets, turned(rows), config.Recover(kind="grad", mode="oracle", loss="npo", beams=2, candidates=2)).collect()
    truth = {r.key: "".join(chr(t + 32) for t in r.truth) for r in rows.collect()}
    assert {x.key for x in oracle} == set(truth)
    assert all(x.pred == truth[x.key] for x in oracle)
    assert all(n.split("/")[0].isdigit() for x in oracle for n in x.orders.split(", "))


def test_positions_without_options_fall_back_to_digits(spark):
    rows = spark.createDataFrame([(1, 0, "new", [0.5] * 64, 1.0, [0.25] * 64, 17)], "key long, pos int, attribute string, logits array<double>, hidden_norm double, reference array<double>, truth int")
    known = spark.createDataFrame([("other", 0, 3)], "attribute string, pos int, token int")
    assert decode.with_candidates(rows, known).first().options == [decode._t(c) for c in "0123456789"]
    model = lambda contexts: contexts.withColumns({"logits": F.array_repeat(F.lit(0.5), 64), "hidden_norm": F.lit(1.0), "reference": F.array_repeat(F.lit(0.5), 64)})
    empty = spark.createDataFrame([("new", [[], [5]])], "attribute string, sets array<array<int>>")
    one = spark.createDataFrame([(1, "new", [18, 5])], "key long, attribute string, truth array<int>")
    got = advance.advance(one, empty, model, advance.by_gradients(False, 1), keys=["key"], beams=1, stop=False).first()
    assert (got.tokens, got.orders) == ([16, 5], ["2/9", "0/0"])


def test_average_score(spark):
    df = spark.createDataFrame([(6.0, [1, 2, 3]), (0.0, [])], "s double, t array<int>")
    got = [r[0] for r in df.select(advance.average_score(F.col("s"), F.col("t"))).collect()]
    assert got[0] == 2.0 and math.isnan(got[1])


def test_error_lists_in_one_pass(spark):
    rows = [(1, "blood_type", i, p) for i, p in enumerate([" A-.", " B+.", " A+.", " A+."])] + [(2, "blood_type", 0, "none")]
    predictions = spark.createDataFrame(rows, "key long, attribute string, idx int, pred string")
    truths = spark.createDataFrame([(1, " A+."), (2, " B-.")], "key long, true_answer string")
    got = {r.key: {k: tuple(v) for k, v in r.error_list.items()} for r in evaluation.error_lists(predictions, truths, [0, 1, 2, 3, 100]).collect()}
    none = ("", math.inf, -1)
    assert got == {1: {0: none, 1: (" A-.", 1.0, 0), 2: (" A-.", 1.0, 0), 3: (" A+.", 0.0, 2), 100: (" A+.", 0.0, 2)}, 2: {0: none, **{n: ("none", 1.0, 0) for n in (1, 2, 3, 100)}}}
    plan = evaluation.recovery_errors(predictions, truths, [1, 2, 3, 5, 10])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_steps_are_clipped_as_a_whole(spark):
    r = random.Random(1)
    rows = [(step, f"p{k}", [r.gauss(0, size) for _ in range(r.randint(0, 30))]) for step, size in ((1, 0.01), (2, 5.0), (3, 0.0)) for k in range(7)]
    df = spark.createDataFrame(rows, "step long, parameter string, values array<double>")
    norms = {s: math.sqrt(sum(x * x for t, _, v in rows if t == s for x in v)) for s in (1, 2, 3)}
    assert norms[1] < 1 < norms[2]
    for x in gradients.noisy_step(df, 1.0, 0.0, "s").collect():
        factor = min(1.0, 1.0 / (norms[x.step] + 1e-6))
        assert x.clipped == pytest.approx([v * factor for v in x["values"]])
        assert x.noisy == x.clipped
    noise = [b - a for x in gradients.noisy_step(df, 2.0, 0.5, "s").collect() for a, b in zip(x.clipped, x.noisy, strict=True)]
    assert len(noise) > 250 and abs(sum(noise) / len(noise)) < 0.25
    assert math.sqrt(sum(x * x for x in noise) / len(noise)) == pytest.approx(1.0, abs=0.15)
    again = gradients.noisy_step(df.repartition(3), 2.0, 0.5, "s").select("step", "parameter", "noisy")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, gradients.noisy_step(df, 2.0, 0.5, "s").select("step", "parameter", "noisy").collect()))


PIECES = ["the", "th", "he", " the", "a", "ab", "abc", "bcd", "é", "日本", " ", "<s>"]


@given(st.lists(st.text("abcdeth é日本🎉<>s\n", max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_longest_match_and_back(texts):
    v = tokens.Vocabulary.of(PIECES)
    m = tokens.Matcher(v)
    got = m.encode(pa.array(texts, pa.string())).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        at, expected = 0, []
        while at < len(text):
            best = max((p for p in v.pieces if text.startswith(p, at)), key=len, default=None)
            expected += [v.first + v.pieces.index(best)] if best else [v.byte + b for b in text[at].encode()]
            at += len(best or " ")
        assert ids == expected
        assert not set(ids) & set(v.specials)
    assert m.decode(pa.array(got, pa.list_(pa.int32()))).to_pylist() == texts


def test_vocabulary_in_tables(spark):
    with pytest.raises(ValueError, match="pieces"):
        tokens.Vocabulary.of(str(i) for i in range(tokens.MOST + 1))
    v = tokens.Vocabulary.of_table(spark.createDataFrame([(p,) for p in [*PIECES, "", None, "ab"]], "piece string"))
    assert len(v.pieces) == len(PIECES)
    df = spark.createDataFrame([(1, "the abc", "the abc 日"), (2, None, None), (3, "", "x" * 20)], "ids int, q string, t string")
    coded = tokens.with_ids(df, {"q_ids": "q", "t_ids": "t"}, v)
    back = tokens.with_text(coded, {"again": "t_ids"}, v).collect()
    assert [r.again for r in back] == ["the abc 日", "", "x" * 20]
    for shifted in (True, False):
        for r, x in zip(back, tokens.labelled(df, "q", "t", v, 12, shifted).collect(), strict=True):
            ids = [v.bos, *r.t_ids]
            n = min(len(ids), 12)
            assert x.input_ids == ids[:12] + [v.pad] * (12 - n)
            assert x.attention_mask == [1] * n + [0] * (12 - n)
            skipped = len(r.q_ids) + shifted
            assert x.labels == [L.IGNORED if i < skipped or i >= n else ids[i] for i in range(12)]
    learnt = lambda s: sum(y != L.IGNORED for y in tokens.labelled(df, "q", "t", v, 12, s).first().labels)
    assert learnt(False) == learnt(True) + 1


def test_a_librarys_tokeniser_is_loaded_once_a_worker(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    path, log = public.path("byte_bpe_50k.json"), str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        own = library.Tokenizer.from_file(path)

        class Handle:
            def encode(self, texts):
                return pa.array([x.ids for x in own.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)], pa.list_(pa.int32()))

        return Handle()

    texts = ["Some text, of words.", "", "é日"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = {r.i: r.ids for r in tokens.with_ids(df, {"ids": "t"}, tokens.Vocabulary.of([]), load, name="byte_bpe").collect()}
    own = library.Tokenizer.from_file(path)
    assert got == {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def calls(path):
    return [line for f in sorted(os.listdir(path)) for line in open(f"{path}/{f}").read().splitlines()]


def counting(path, fail=lambda prompts: None):
    """A model that notes each prompt it is asked."""

    def load():
        def answer(prompts):
            fail(prompts)
            with open(f"{path}/{os.getpid()}", "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return [p.upper() for p in prompts]

        return answer

    return load


def test_models_are_asked_once(spark, tmp_path):
    notes, store = tmp_path / "notes", str(tmp_path / "store")
    notes.mkdir()
    rows = [(i, f"prompt {i % 40} " + "x" * (i % 7) ** 2 if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, p string").repartition(5)
    got = models.ask(df, "p", "m", counting(str(notes)), store=store, budget=200, most=4).collect()
    assert sorted((r.i, r.model_output) for r in got) == sorted((i, p and p.upper()) for i, p in rows)
    asked = calls(notes)
    assert sorted(asked) == sorted({p for _, p in rows if p})
    more = df.union(spark.createDataFrame([(900, "another")], "i int, p string"))
    assert models.ask(more, "p", "m", counting(str(notes)), store=store).count() == 201
    assert sorted(calls(notes)) == sorted([*asked, "another"])
    # Another model has answers of its own.
    models.ask(df.limit(1), "p", "other", counting(str(notes)), store=store).collect()
    assert len(calls(notes)) <= len(asked) + 2


def test_batches_keep_to_their_budget():
    rows = sorted(((str(i), "x" * (i * i % 50)) for i in range(100)), key=lambda r: len(r[1]))
    got = list(models._batches(rows, 120, 8))
    assert [r for b in got for r in b] == rows
    assert all(len(b) <= 8 and (len(b) == 1 or len(b) * max(len(p) for _, p in b) <= 120) for b in got)


def test_a_killed_task_does_not_ask_again(spark, tmp_path):
    """A worker dies in the middle of its work: what it had been told is in the store, and only the rest is asked."""
    notes, store, mark = tmp_path / "notes", str(tmp_path / "store"), str(tmp_path / "died")
    notes.mkdir()

    def dies(prompts):
        if "p 00030" in prompts and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)

    df = spark.createDataFrame([(f"p {i:05d}",) for i in range(60)], "p string").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        models.ask(df, "p", "mortal", counting(str(notes), dies), store=store, most=5, tasks=1).collect()
    before = calls(notes)
    assert os.path.exists(mark) and "p 00030" not in before
    assert models.ask(df, "p", "mortal", counting(str(notes), dies), store=store, most=5, tasks=1).where("model_output = upper(p)").count() == 60
    assert sorted(calls(notes)) == [f"p {i:05d}" for i in range(60)]


def test_failed_calls_are_repeated():
    left = [2]

    def answer(prompts):
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("busy")
        return prompts

    assert models._asked(answer, ["a"], 3, 0.0) == ["a"]
    left[0] = 3
    with pytest.raises(RuntimeError):
        models._asked(answer, ["a"], 3, 0.0)
    with pytest.raises(ValueError, match="0 answers to 1"):
        models._asked(lambda _: [], ["a"], 1, 0.0)


def graph_of(spark, ran, weight=1, fail=()):
    def work(name, *needs):
        def of(tables):
            ran.append(name)
            if name in fail:
                raise RuntimeError(name)
            base = spark.range(3).select(F.lit(name).alias("name"), F.col("id").alias("n"))
            return base if not needs else base.limit(1).select("name", F.lit(sum(tables[n].count() for n in needs)).cast("long").alias("n"))

        return of

    return [
        stages.Stage("report", work("report", "left", "right"), ("left", "right")),
        stages.Stage("left", work("left", "base"), ("base",), {"weight": weight}),
        stages.Stage("right", work("right", "base"), ("base",), config.Pretrain(epochs=3)),
        stages.Stage("base", work("base")),
    ]


def test_a_changed_setting_runs_what_follows(spark, tmp_path):
    ran = []
    out = stages.graph(spark, graph_of(spark, ran), str(tmp_path))
    assert ran[0] == "base" and ran[3] == "report" and set(ran) == {"base", "left", "right", "report"}
    assert out.tables["report"].first().n == 2
    stages.graph(spark, graph_of(spark, again := []), str(tmp_path))
    assert again == []
    out = stages.graph(spark, graph_of(spark, again, weight=2), str(tmp_path))
    assert again == ["left", "report"] == out.ran
    stages.graph(spark, graph_of(spark, again := [], weight=2), str(tmp_path), inputs=["changed"])
    assert len(again) == 4
    # A table without its manifest was not written to its end.
    os.remove(tmp_path / "right" / stages.MANIFEST)
    stages.graph(spark, graph_of(spark, again := [], weight=2), str(tmp_path), inputs=["changed"])
    assert again == ["right"]


def test_a_failure_stops_what_follows_only(spark, tmp_path):
    with pytest.raises(RuntimeError, match="left"):
        stages.graph(spark, graph_of(spark, [], fail=("left",)), str(tmp_path))
    stages.graph(spark, graph_of(spark, ran := []), str(tmp_path))
    assert "base" not in ran and "left" in ran and "report" in ran


def test_graphs_that_make_no_sense():
    one = lambda name, *needs: stages.Stage(name, lambda _: None, needs)
    for bad, match in (([one("a", "b"), one("b", "a")], "need each other"), ([one("a", "x")], "unknown stages: x"), ([one("a"), one("a")], "one name")):
        with pytest.raises(ValueError, match=match):
            stages.ordered(bad)


def checkpoints(spark, root, rows):
    for run, step in rows:
        os.makedirs(f"{root}/{run}/{step}")
        open(f"{root}/{run}/{step}/weights", "w").close()
    retention.record(spark.createDataFrame([(r, s, f"{r}/{s}") for r, s in rows], "run string, step long, folder string"), root)


def there(root):
    return {(r, int(s)) for r in os.listdir(root) if r != "_index" for s in os.listdir(f"{root}/{r}")}


def test_retention_in_two_phases(spark, tmp_path):
    root = str(tmp_path)
    checkpoints(spark, root, [("a", s) for s in (1, 2, 3, 10)] + [("b", 5)])
    # A crash after the first phase: nothing is deleted yet, and nothing live is marked.
    retention.doom(spark, root, 2)
    assert len(there(root)) == 5
    assert {(r.run, r.step) for r in retention.live(spark, root).collect()} == {("a", 3), ("a", 10), ("b", 5)}
    # A crash within the second: one folder is gone, the index does not know it.
    for f in os.listdir(f"{root}/a/1"):
        os.remove(f"{root}/a/1/{f}")
    os.rmdir(f"{root}/a/1")
    checkpoints(spark, root, [("a", 11)])
    assert retention.sweep(spark, root) == 2
    assert there(root) == {("a", 3), ("a", 10), ("a", 11), ("b", 5)}
    assert retention.sweep(spark, root) == 0
    assert retention.retire(spark, root, 1) == 2
    assert there(root) == {("a", 11), ("b", 5)}
    assert {r.state for r in retention.index(spark, root).collect()} == {retention.LIVE, retention.GONE}


def test_due_steps(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "s int")
    assert [r.s for r in df.where(retention.due(F.col("s"), 3)).collect()] == [3, 6]
    for bad in (lambda: retention.due(F.col("s"), 0), lambda: retention.doom(spark, "x", 0), lambda: config.Pretrain(block_size=0), lambda: config.Pretrain(validation_percent=100)):
        with pytest.raises(ValueError):
            bad()


def test_methods_make_only_the_sets_they_need(spark):
    forget = spark.createDataFrame([("n", 0, "t")], "name string, template int, text string")
    never = lambda: pytest.fail("a set that the method does not need")
    assert prep.method_triples(config.Unlearn(method="grad_ascent"), forget, never, never, ["name", "template"], "s").columns == ["name", "template", "pos", "forget_text"]
    assert "idk_text" not in prep.method_triples(config.Unlearn(method="npo"), forget, lambda: forget, never, ["name", "template"], "s").columns


def test_paths_of_dataset_types(spark):
    kinds = [*catalog.GLOBAL, *catalog.SPLIT]
    df = spark.createDataFrame([(k, "s") for k in kinds], "kind string, folder string")
    assert {r.kind: r.path for r in catalog.with_paths(df, "d", F.col("folder")).collect()} == {k: catalog.dataset_path(k, "d", "s") for k in kinds}
    with pytest.raises(Exception, match="unknown dataset type: x"):
        catalog.with_paths(spark.createDataFrame([("x",)], "kind string"), "d", F.lit("s")).collect()
