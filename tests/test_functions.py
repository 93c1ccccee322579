"""Edge rows of the column expressions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import plain_metrics as plain
import pytest
from pyspark.sql import functions as F

from obliva.functions import attributes as A
from obliva.functions import logits as L
from obliva.functions import outputs as O
from obliva.functions import similarity as S

ERRORS = [
    ("year_of_birth", "no idea", "it is 1990.", 1.0),
    ("year_of_birth", "in 1985", "it is 1990.", 0.25),
    ("year_of_birth", "x1985", "it is 1985", 1.0),
    ("social_insurance_number", "", "it is 123456789.", 1.0),
    ("social_insurance_number", "123456780", "it is 123456789.", 1 / 9),
    ("address_postcode", "k1a0b1", "it is K1A0B1.", 1.0),
    ("address_postcode", "K1A0B2", "it is K1A0B1.", 1 / 6),
    ("blood_type", "ab+", "it is AB+.", 0.0),
    ("blood_type", "unknown", "unknown", 0.0),
    ("blood_type", "A-", "B+", 1.0),
]


def test_errors(spark):
    df = spark.createDataFrame(ERRORS, "attribute string, p string, t string, expected double")
    got = df.select("expected", A.attribute_error(F.col("p"), F.col("t"), F.col("attribute")).alias("e")).collect()
    assert all(r.e == pytest.approx(r.expected) for r in got)


def test_unknown_attribute_raises(spark):
    df = spark.createDataFrame([("height", "1", "2")], "attribute string, p string, t string")
    with pytest.raises(Exception, match="unknown attribute"):
        df.select(A.attribute_error(F.col("p"), F.col("t"), F.col("attribute"))).collect()


def test_truth_without_postcode_raises(spark):
    df = spark.createDataFrame([("address_postcode", "K1A0B1", "none")], "attribute string, p string, t string")
    with pytest.raises(Exception, match="postcode"):
        df.select(A.attribute_error(F.col("p"), F.col("t"), F.col("attribute"))).collect()


@pytest.mark.parametrize(
    ("text", "score"),
    [("rating: [[7.25]]", 7.2), ("Rating: 11", -1.0), ("Final  Rating: [3] ok", 3.0), ("none", -1.0), ("Rating: 10", 10.0), ("", -1.0), ("Rating: 12 Rating: 3", -1.0)],
)
def test_parse_score(spark, text, score):
    assert spark.createDataFrame([(text,)], "t string").select(O.parse_score(F.col("t"))).first()[0] == score


@pytest.mark.parametrize(
    ("prompt", "output", "expected"),
    [
        ("the question", "[INST]the question[/INST] yes", "yes"),
        ("q", "yes [INST] and more", "yes"),
        ("q", "yes[/INST] tail", "yes tail"),
        ("what is it", "x WHAT IS IT y", "xy"),
        ("a.b+c(d", "x A.B+C(D y", "xy"),
        ("q", " \n \n ", "[EMPTY]"),
        ("q", "one\n\n  two  \n", "one\ntwo"),
        ("q", "go go go go", "go go"),
        ("q", "go go go", "go"),
        ("q", "[INST]a[INST]b[/INST]c[/INST]", "c"),
    ],
)
def test_clean_output(spark, prompt, output, expected):
    df = spark.createDataFrame([(prompt, output)], "p string, o string")
    assert df.select(O.clean_output(F.col("o"), F.col("p"), "[INST]", "[/INST]")).first()[0] == expected


@pytest.mark.parametrize("depth", [1, 3, 4, 9])
def test_no_span_is_left(spark, depth):
    """Each removal forms the next pair out of the pieces around it."""
    text = "[INST]x[/INST]"
    for _ in range(depth):
        text = f"[IN{text}ST]x[/INST]"
    df = spark.createDataFrame([(f"a{text}b",), (None,)], "o string")
    assert [r[0] for r in df.select(O.drop_spans(F.col("o"), "[INST]", "[/INST]")).collect()] == ["ab", None]


def test_long_outputs_lose_their_repeats(spark):
    body = " ".join(str(i * i) for i in range(500))
    df = spark.createDataFrame([("q", f"{body} go go go {body}"), ("q", "The same again. " * 2000 + "End")], "p string, o string")
    got = [r[0] for r in df.select(O.clean_output(F.col("o"), F.col("p"), "[INST]", "[/INST]")).collect()]
    assert got[0] == f"{body} go {body}"
    assert len(got[1]) < 2000 * 16 / 2
    assert got[1].endswith("End")


def test_long_outputs_are_cleaned_alike(spark):
    """What is done to long outputs outside the JVM, on short ones, against the expressions."""
    r = random.Random(8)
    bits = ["[INST]", "[/INST]", "[inst]", "[IN", "ST]", "Tell me", "tell ME ", "a b", "go ", "é", "É", "\n", " \u00a0", "\u2028", "\r\n", "\x1c", "...", "tell me more"]
    rows = [("".join(r.choice(bits) for _ in range(r.randint(0, 14))), r.choice(["Tell me", " tell me more[INST]x[/INST] ", "a", "", None])) for _ in range(1500)]
    df = spark.createDataFrame([*rows, (None, "x")], "o string, p string")
    clean = lambda n: O.clean_output(F.col("o"), F.col("p"), "[INST]", "[/INST]", n)
    got = df.select("o", "p", clean(10_000).alias("native"), clean(-1).alias("searched")).collect()
    assert [(x.o, x.p, x.searched) for x in got if x.searched != x.native] == []
    assert got[-1].native is None


def test_repeat_search_equals_expression(spark):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice(kinds) for _ in range(r.randint(0, 24))) for kinds in ("ab ", " a,", "ab \n-", "a\u00e9 \u00b2", "\u00e1 .", "go _\t", "a \u0301 b") for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", O.collapse_repeats(F.col("t"), 100).alias("regex"), O.collapse_repeats(F.col("t"), -1).alias("search")).collect()
    assert sum(x.t != x.regex for x in got) > 100
    assert [x.search for x in got] == [x.regex for x in got]


def test_masks_and_stops(spark):
    df = spark.createDataFrame([("It is A+. ok", "blood_type"), ("born  1990.", "year_of_birth"), ("at K1A0B1. now", "address_postcode")], "t string, a string")
    assert [r[0] for r in df.select(A.mask_value(F.col("t"), F.col("a"))).collect()] == ["It is ok", "born", "at now"]
    stops = spark.createDataFrame([(" 1990.", "year_of_birth", True), ("1990", "year_of_birth", False), ("123456789", "social_insurance_number", True), (" AB+", "blood_type", True), ("A", "blood_type", False)], "t string, a string, e boolean")
    assert all(r.g == r.e for r in stops.select("e", A.complete(F.col("t"), F.col("a")).alias("g")).collect())


def test_logits(spark):
    v, w = [0.5, -1.0, 2.0], [0.1, 0.2, 0.3]
    df = spark.createDataFrame([(v, w)], "v array<double>, w array<double>")
    z = math.log(sum(map(math.exp, v)))
    p = [math.exp(x - z) for x in v]
    got = df.select(
        L.softmax(F.col("v")).alias("p"),
        L.nll(F.col("v"), F.lit(2)).alias("nll"),
        L.kl(F.col("v"), F.col("w")).alias("kl"),
        L.entropy_weight(F.col("v")).alias("weight"),
        L.l2_norm(L.clipped(F.col("v"), 0.5)).alias("norm"),
        L.perplexity(F.lit(1e6)).alias("inf"),
        L.log_sigmoid(F.lit(-800.0)).alias("ls"),
    ).first()
    assert got.p == pytest.approx(p)
    assert sum(got.p) == pytest.approx(1)
    assert got.nll == pytest.approx(z - 2.0)
    assert got.kl >= 0
    assert got.weight == pytest.approx(max(0.1, min(1, 1 + sum(x * math.log(x) for x in p) / math.log(3))))
    assert got.norm == pytest.approx(0.5, rel=1e-5)
    assert got.inf == math.inf
    assert got.ls == pytest.approx(-800)


PORTER = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "probate": "probat", "controll": "control", "agreed": "agre", "electrical": "electr"}


def test_porter(spark):
    """The published examples, and odd words (runs of y, doubled ends, digits) as the plain stemmer has them."""
    assert {w: plain.stem(w) for w in PORTER} == PORTER
    r = random.Random(5)
    ends = ["", "s", "es", "ies", "ed", "eed", "ing", "y", "yy", "ational", "iveness", "icate", "ful", "ement", "ion", "ll", "le", "e", "tt", "xx", "iz", "at"]
    words = sorted({"".join(r.choice("aeiouybcdlstwx1") for _ in range(r.randint(1, 7))) + r.choice(ends) for _ in range(3000)} | set(PORTER))
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(S.stems(F.col("w"))).first()[0]
    assert dict(zip(words, got, strict=True)) == {w: plain.stem(w) if len(w) > 3 else w for w in words}


def test_overlap_scores(spark):
    """BLEU, ROUGE-1 and ROUGE-L of bags of few words, up to several longs of bits."""
    r = random.Random(9)
    cases = [([], []), ([], ["a"]), (["a"], []), (["a"], ["a"]), (["a"], ["b"]), ("the cat sat on the mat".split(), "the cat on the mat today".split())]
    for n in (3, 8, 61, 62, 63, 130, 200):
        cases += [([r.choice("abcdef") for _ in range(n)], [r.choice("abcdefgh") for _ in range(r.randint(1, 2 * n))]) for _ in range(4)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", S.clipped(a, b).alias("hits"), S.common_subsequence(a, b).alias("lcs"), S.bleu4(a, b).alias("bleu"), S.rouge1(a, b).alias("r1"), S.rouge_l(a, b).alias("rl")).collect()
    for x in got:
        ref, out = cases[x.i]
        assert x.hits == sum((Counter(ref) & Counter(out)).values())
        assert x.lcs == plain.lcs(ref, out)
        assert x.bleu == pytest.approx(plain.bleu4(ref, out), abs=1e-12)
        assert tuple(x.r1) == pytest.approx(plain.rouge1(ref, out), abs=6e-5)
        assert tuple(x.rl) == pytest.approx(plain.rouge_l(ref, out), abs=6e-5)


def test_text_metrics_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(None, None, None), ("", "x", "x"), ("Ça va, Émile!", "ça va Émile", "va")], "o string, r string, q string")
    m = df.select(S.text_metrics(F.col("o"), F.col("r"), F.col("q")).alias("m"))
    assert "Python" not in m._jdf.queryExecution().executedPlan().toString()
    rows = [x.m for x in m.collect()]
    assert [x.bleu for x in rows[:2]] == [0, 0]
    tokens = lambda t: re.findall(r"\w+|[^\w\s]", t.lower())
    assert rows[2].bleu == pytest.approx(plain.bleu4(tokens("ça va Émile"), tokens("Ça va, Émile!")), abs=6e-5)


def test_cleaning_computes_each_step_once(spark):
    """Steps are bound: no expression of the plan grows with the number of times that a step names its input."""
    df = spark.createDataFrame([("a", "b")], "o string, p string")
    plan = df.select(O.clean_output(F.col("o"), F.col("p"), "[INST]", "[/INST]").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 40


def test_garbled_keeps_length(spark):
    df = spark.createDataFrame([("hello",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(F.length(O.garbled(F.col("t")))).collect()] == [5, 0, None]
