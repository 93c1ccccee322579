"""A query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva import config
from obliva.functions import attributes as A
from obliva.functions import logits as L
from obliva.functions import outputs as O
from obliva.functions import similarity
from obliva.functions.draws import draw, order_key
from obliva.operators import corpus, decode, evaluation, gradients, models, prep, scoring, splits, tokens
from obliva.operators.order import positions
from obliva.oracle import SQL
from obliva.plans import stages as stages_
from obliva.plans import views as V
from obliva.sources import catalog, readers, retention, sinks
from obliva.sources.shared import files, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = "seed"
ONE = ("blood_type",)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c) -> F.Column:
    return F.round(c, 6)


# Corpus


@query
def attr_unpivot(spark, d):
    return corpus.unpivoted(V.profiles(spark, d))


@query
def qa_cross_join(spark, d):
    return corpus.questions(V.profiles(spark, d), "train")


@query
def qa_validation(spark, d):
    return corpus.questions(V.profiles(spark, d), "validation")


@query
def qa_test_one_template(spark, d):
    return corpus.one_per_pair(V.qa(spark, d), SEED).select("name", "attribute", "template", "question")


@query
def common_knowledge_questions(spark, d):
    return corpus.knowledge_questions(V.table(spark, d, "supplier").select(F.col("s_name").alias("name")))


@query
def fact_questions(spark, d):
    """Questions out of a facts file, one row a person."""
    path = scratch(spark, "facts")
    V.facts(spark, d).write.mode("overwrite").json(path)
    return corpus.fact_questions(spark.read.schema(readers.FACTS).json(path), SEED)


@query
def attribute_value_counts(spark, d):
    u = corpus.unpivoted(V.profiles(spark, d))
    return u.groupBy("attribute").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))


@query
def unique_surnames(spark, d):
    pool = V.table(spark, d, "part").select(F.col("p_brand").alias("first_name"), F.concat(F.element_at(F.split("p_name", " "), -1), (F.col("p_partkey") % 50).cast("string")).alias("surname"))
    taken = V.table(spark, d, "part").where("p_size > 45").select(F.concat(F.element_at(F.split("p_name", " "), -1), (F.col("p_partkey") % 50).cast("string")).alias("surname"))
    return corpus.unique_names(pool, taken, 5, SEED)


# Splits


def _forget(mode: str, n: int) -> Query:
    def run(spark, d):
        qa = V.qa(spark, d)
        return splits.forget_set(qa, splits.forget_names(qa, mode, n, SEED)).select("name", "attribute", "template")

    return run


QUERIES["forget_same_fn"] = _forget("same_firstname", 5)
QUERIES["forget_diff_fn"] = _forget("different_firstname", 5)
QUERIES["forget_n_per_fn"] = _forget("n_per_firstname", 2)
QUERIES["forget_random"] = _forget("random", 10)


@query
def forget_rand_comb(spark, d):
    return splits.combination(V.qa(spark, d), 30, SEED).select("name", "attribute", "template")


def _retain(mode: str, label: str) -> Query:
    def run(spark, d):
        qa = V.qa(spark, d)
        names = splits.forget_names(qa, "n_per_firstname", 2, SEED)
        out = splits.labelled(qa, names, ONE, mode, 10, SEED)
        return out.where(F.col("split") == label).select("name", "attribute", "template")

    return run


QUERIES["retain_all"] = _retain("all_except_forget", "retain")
QUERIES["retain_same_fn"] = _retain("same_firstname", "retain")
QUERIES["retain_same_attr"] = _retain("same_attr", "retain")
QUERIES["retain_same_fn_attr"] = _retain("same_firstname_same_attr", "retain")
QUERIES["remain_same_fn_attr"] = _retain("same_firstname_same_attr", "remain")


@query
def split_sizes_by_mode(spark, d):
    qa = V.qa(spark, d)
    names = splits.forget_names(qa, "n_per_firstname", 2, SEED)
    modes = ("all_except_forget", "same_attr", "same_firstname_same_attr")
    return splits.all_modes(qa, names, ONE, modes, 10, SEED).groupBy("mode", "split").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query
def test_set_one_per_pair(spark, d):
    qa = V.qa(spark, d)
    return corpus.one_per_pair(splits.forget_set(qa, splits.forget_names(qa, "n_per_firstname", 2, SEED)), "test").select("name", "attribute", "template")


@query
def train_val_split(spark, d):
    out = splits.train_validation(V.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 10, SEED)
    return out.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# Errors and scores


@query
def fpi_error_detail(spark, d):
    return scoring.error_detail(V.predictions(spark, d)).select("k", "attribute", "true_answer", "model_output", r6("error").alias("error"))


@query
def fpi_error_by_attribute(spark, d):
    return scoring.error_by_attribute(scoring.error_detail(V.predictions(spark, d))).select("attribute", r6("error").alias("error"), F.col("n").cast("bigint").alias("n"))


@query
def extract_answer(spark, d):
    p = V.predictions(spark, d)
    return p.select("k", "attribute", A.answer_value(F.col("true_answer"), F.col("attribute")).alias("value"))


@query
def mask_info(spark, d):
    p = V.predictions(spark, d)
    return p.select("k", "attribute", A.mask_value(F.col("true_answer"), F.col("attribute")).alias("masked"))


@query
def stop_predicate(spark, d):
    u = corpus.unpivoted(V.profiles(spark, d))
    grown = u.select("name", "attribute", F.explode(F.array(F.concat(F.lit(" "), "value", F.lit(".")), F.col("value"), F.substring("value", 1, 3))).alias("text"))
    return grown.groupBy("attribute").agg(F.count("*").alias("n"), F.sum(A.complete(F.col("text"), F.col("attribute")).cast("int")).alias("stops"))


@query
def chat_format(spark, d):
    c = V.chat(spark, d)
    return c.select("conv_id", "turn", O.qa_text(F.col("question"), F.col("answer"), V.START, V.END).alias("text"))


@query
def chat_messages(spark, d):
    m = V.chat(spark, d).select("conv_id", "turn", F.inline(O.judge_prompt(F.col("question"), F.col("answer"))))
    return m.select("conv_id", "turn", "role", "content")


@query
def clean_output_lines(spark, d):
    r = V.raw_outputs(spark, d)
    cut = O.cut_open_span(O.drop_spans(F.col("output"), V.START, V.END), V.START, V.END)
    return r.select("conv_id", "turn", O.tidy_lines(cut).alias("cleaned"))


@query
def clean_output(spark, d):
    r = V.raw_outputs(spark, d)
    return r.select("conv_id", "turn", O.clean_output(F.col("output"), F.col("question"), V.START, V.END).alias("cleaned"))


@query
def garbled_answers(spark, d):
    c = V.chat(spark, d)
    text = O.garbled(F.col("answer"))
    return c.select("conv_id", "turn", F.char_length(text).cast("bigint").alias("n"), F.md5(text.cast("binary")).alias("garbled_md5"))


@query
def parse_score(spark, d):
    score = O.parse_score(F.col("judge_output"))
    return V.judged(spark, d).select("doc_id", score.alias("score"), O.flag_unparsed(F.col("judge_output"), score).alias("text"))


@query
def judge_join_baseline(spark, d):
    j = V.judged(spark, d).withColumn("score", O.parse_score(F.col("judge_output")))
    results = j.select((F.col("doc_id") % 400).alias("name"), F.col("quality").alias("attribute"), F.col("toxic").alias("question"), "doc_id", F.col("score").alias("model_score"))
    base = V.table(spark, d, "documents").select((F.col("doc_id") % 400).alias("name"), F.lit(1).alias("attribute"), F.lit(0).alias("question"), F.col("doc_id").alias("pos"), (F.col("n_chars") % 11).cast("double").alias("base_score"))
    out = scoring.with_baseline(results, base)
    return out.select("doc_id", "name", "base_score", "model_score", O.relative_score(F.col("model_score"), F.col("base_score")).alias("relative"))


@query
def score_statistics(spark, d):
    j = V.judged(spark, d).withColumn("score", O.parse_score(F.col("judge_output"))).withColumn("none", F.lit(-1.0))
    s = scoring.statistics(j, ["score", "none"], model="learned")
    return s.select("type", "model_type", "total_samples", F.col("average_scores")["score"].alias("score"), F.size("average_scores").cast("bigint").alias("n_scores"))


@query
def metric_statistics(spark, d):
    """Means of scores and of the numbers nested in a struct."""
    j = V.judged(spark, d).withColumn("score", O.parse_score(F.col("judge_output")))
    m = F.struct((F.col("doc_id") % 10 / 8).alias("bleu"), F.col("quality").alias("question_relevance"), F.lit("x").alias("note"), F.lit(None).cast("double").alias("absent"))
    rows = j.withColumn("metrics", m)
    s = scoring.statistics(rows, ["score", *scoring.number_fields(rows, "metrics")], model="learned")
    return s.select("total_samples", *[F.col("average_scores")[n].alias(a) for n, a in (("score", "score"), ("metrics.bleu", "bleu"), ("metrics.question_relevance", "relevance"))], F.size("average_scores").cast("bigint").alias("n_scores"))


def _judge(question, reference, answer):
    """A stand-in judge: 10 for the reference itself, else a mark by length; now and then no mark."""
    k = F.char_length(answer) % 10 if reference is None else F.when(reference == answer, F.lit(10)).otherwise(F.char_length(answer) % 7)
    return F.when(F.char_length(question) % 11 == 0, F.lit("no score here")).otherwise(F.concat(F.lit("Rating: [["), k.cast("string"), F.lit("]]")))


def _common_questions(spark, d):
    return corpus.knowledge_questions(V.table(spark, d, "supplier").select(F.col("s_name").alias("name")))


def _model(rows):
    """A stand-in model: a digest of what it is asked."""
    return rows.withColumn("model_output", F.concat(F.lit("Reply "), F.md5(F.col("input").cast("binary"))))


@query
def irrelevant_prompts(spark, d):
    return corpus.irrelevant_prompts(_common_questions(spark, d), ["name", "attribute"], SEED)


@query
def base_variants(spark, d):
    out = evaluation.base_variants(_common_questions(spark, d), _model, _judge, V.START, V.END, ["name", "attribute"], SEED)
    return out.select("name", "attribute", "variant", "reference", F.md5(F.col("model_answer").cast("binary")).alias("answer_md5"), "score", "evaluation_text")


@query
def base_statistics(spark, d):
    return evaluation.variant_statistics(evaluation.base_variants(_common_questions(spark, d), _model, _judge, V.START, V.END, ["name", "attribute"], SEED))


def _common(spark, d, settings):
    q = _common_questions(spark, d)
    results = evaluation.generated(q, _model, V.START, V.END)
    # Some people have no baseline row; the second fact has two, of which the later one counts.
    rows = evaluation.generated(q, lambda x: _model(x.withColumn("input", F.upper("input"))), V.START, V.END).withColumnRenamed("model_output", "base_answer")
    rows = rows.withColumn("pos", F.explode(F.when(F.substring("name", -1, 1).cast("int") % 3 == 0, F.array().cast("array<int>")).when(F.col("attribute") == "fact_1", F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))))
    base = rows.select("name", "attribute", "question", "pos", F.concat("base_answer", F.lit(" "), F.col("pos").cast("string")).alias("base_answer"), (F.col("pos") + 4.0).alias("base_llm_score"))
    return evaluation.common(results, base, settings, _judge)


@query
def common_evaluation(spark, d):
    return _common(spark, d, config.Evaluate(judge_base=True, judge_full=True)).select("name", "attribute", "base_answer", "model_output", "base_llm_score", "model_llm_score", "llm_relscr", "llm_score", "llm_eval")


@query
def common_evaluation_baseline_only(spark, d):
    out = _common(spark, d, config.Evaluate(judge_base=False, judge_full=False))
    return out.select("name", "attribute", "base_llm_score", "model_llm_score", "llm_relscr", "llm_score", "llm_eval")


@query
def common_statistics(spark, d):
    s = evaluation.common_statistics(_common(spark, d, config.Evaluate(judge_base=True, judge_full=True)), "unlearned")
    names = ("base_llm_score", "model_llm_score", "llm_relscr", "llm_score")
    return s.select("model_type", "total_samples", *[F.col("average_scores")[n].alias(n) for n in names])


@query
def batched_judge(spark, d):
    """Judgements by a stand-in model that is asked in batches, each prompt once."""
    c = V.chat(spark, d)
    prompt = F.concat(F.lit("Q: "), "question", F.lit(" A: "), F.when(F.col("turn") % 2 == 0, F.col("answer")).otherwise(F.lit("none")))
    rows = models.ask(c.select("conv_id", "turn", prompt.alias("prompt")), "prompt", "judge-by-length", V.judge_by_length, budget=20_000, most=16)
    return rows.select("conv_id", "turn", F.col("model_output").alias("judged"), O.parse_score(F.col("model_output")).alias("score"))


@query
def batched_answers(spark, d):
    """Cleaned answers of a stand-in model that is asked in batches by its settings."""
    model = evaluation.asking(config.Evaluate(batch=7, max_new_tokens=12, quantisation="8bit"), "digest", V.reply_by_digest)
    return evaluation.generated(_common_questions(spark, d), model, V.START, V.END).select("name", "attribute", "model_output")


@query
def rule_notes(spark, d):
    e = scoring.error_detail(V.predictions(spark, d))
    return e.select("k", "attribute", O.rule_note(F.col("attribute"), F.col("error")).alias("note"))


@query
def relative_score(spark, d):
    j = V.judged(spark, d).withColumn("score", O.parse_score(F.col("judge_output"))).where("score <> -1")
    return j.select("doc_id", O.relative_score(F.col("score"), (F.col("doc_id") % 10).cast("double")).alias("relative"))


@query
def final_score(spark, d):
    e = scoring.error_detail(V.predictions(spark, d))
    return e.select("k", "attribute", O.final_score(F.col("attribute"), F.col("error"), F.lit(5.0)).alias("score"))


@query
def candidate_min_error(spark, d):
    return scoring.best_candidate(_candidates(spark, d), ["k"], 3)


@query
def beam_error_at_n(spark, d):
    out = scoring.error_at_cutoffs(_candidates(spark, d), ["k"], [1, 5, 10])
    return out.select("k", F.col("cutoff").cast("bigint").alias("cutoff"), r6("error").alias("error"))


def _candidates(spark, d):
    """The four predictions of a person as candidates of one query."""
    e = scoring.error_detail(V.predictions(spark, d))
    idx = F.array_position(F.array(*map(F.lit, A.ATTRIBUTES)), F.col("attribute")).cast("int") - 1
    return e.select("k", idx.alias("idx"), F.col("model_output").alias("pred"), r6("error").alias("error"))


@query
def text_metrics(spark, d):
    c = V.chat(spark, d)
    m = similarity.text_metrics(F.col("answer"), F.col("question"), F.col("question"))
    out = c.select("conv_id", "turn", m.alias("m"))
    return out.select("conv_id", "turn", "m.bleu", F.col("m.rouge1.fmeasure").alias("rouge1_f"), F.col("m.rougeL.fmeasure").alias("rougeL_f"), "m.question_relevance")


@query
def unigram_overlap(spark, d):
    b = V.table(spark, d, "benchmark").select("item_id", similarity.words(F.col("text")).alias("w"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("w2"))
    met = b.join(nxt, "item_id", "left").withColumn("w2", F.coalesce("w2", F.array().cast("array<string>")))
    return met.select("item_id", similarity.unigram_overlap(F.col("w"), F.col("w2")).cast("bigint").alias("overlap"), F.size("w").cast("bigint").alias("n"))


# Training text


@query
def label_mask(spark, d):
    c = V.chat(spark, d)
    q = O.wrap(F.col("question"), V.START, V.END)
    t = prep.tokenised(c, q, O.qa_text(F.col("question"), F.col("answer"), V.START, V.END), 64)
    join = lambda x: F.array_join(F.col(x).cast("array<string>"), ",")
    return t.select("conv_id", "turn", join("input_ids").alias("input_ids"), join("attention_mask").alias("attention_mask"), join("labels").alias("labels"))


@query
def pack_blocks(spark, d):
    c = V.table(spark, d, "conversations").select(F.floor(F.col("conv_id") / 10).alias("batch"), "conv_id", "turn", prep.word_ids(F.col("text")).alias("ids"))
    p = prep.packed(c, "batch", ["conv_id", "turn"], "ids", 128)
    return p.select(F.col("batch").cast("bigint").alias("batch"), F.col("block").cast("bigint").alias("block"), F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"))


@query
def triples_modulo(spark, d):
    qa = V.qa(spark, d)
    text = F.concat_ws(" ", "question", "answer")
    names = splits.forget_names(qa, "n_per_firstname", 2, SEED)
    forget = splits.forget_set(qa, names, ONE).select("name", "template", text.alias("text"))
    retain = splits.labelled(qa, names, ONE, "same_firstname_same_attr", 3, SEED).where("split = 'retain'").select("name", "template", text.alias("text"))
    return prep.triples(forget, retain, V.refusals(spark).withColumnRenamed("value", "text"), ["name", "template"], SEED)


@query
def pairs_modulo(spark, d):
    """Without refusals: as many pairs as the smaller set has rows."""
    qa = V.qa(spark, d)
    names = splits.forget_names(qa, "n_per_firstname", 2, SEED)
    forget = splits.forget_set(qa, names, ONE).select("name", "template", F.col("question").alias("text"))
    retain = splits.labelled(qa, names, ONE, "same_firstname_same_attr", 3, SEED).where("split = 'retain'").select("name", "template", F.col("question").alias("text"))
    return prep.triples(forget, retain, None, ["name", "template"], SEED)


@query
def triples_tokens(spark, d):
    """Triples of token arrays, shown by their visible tokens and the number that is learnt."""
    qa = V.qa(spark, d)
    names = splits.forget_names(qa, "n_per_firstname", 2, SEED)

    def sampled(rows, question, text):
        return prep.samples(prep.tokenised(rows, question, text, 12), *[c for c in rows.columns if c in ("name", "template", "pos")])

    text = F.concat_ws(" ", "question", "answer")
    forget = sampled(splits.forget_set(qa, names, ONE), F.col("question"), text)
    retain = sampled(splits.labelled(qa, names, ONE, "same_firstname_same_attr", 3, SEED).where("split = 'retain'"), F.col("question"), text)
    out = prep.triples(forget, retain, sampled(V.refusals(spark), F.lit(""), F.col("value")), ["name", "template"], SEED, "sample")

    def shown(kind):
        s = F.col(f"{kind}_sample")
        learnt = F.filter(s["labels"], lambda x: x != L.IGNORED)
        return [F.array_join(prep.visible(s["input_ids"], s["attention_mask"]).cast("array<string>"), ",").alias(f"{kind}_ids"), F.size(learnt).cast("bigint").alias(f"{kind}_learnt")]

    return out.where(prep.same_sizes(*[F.col(f"{k}_sample.labels") for k in ("forget", "retain", "idk")])).select("pos", *shown("forget"), *shown("retain"), *shown("idk"))


@query
def triples_by_method(spark, d):
    """The training triples that methods of each kind ask for: no other set, retained rows, and refusals as well."""
    qa, text = V.qa(spark, d), F.concat_ws(" ", "question", "answer")
    names = splits.forget_names(qa, "n_per_firstname", 2, SEED)
    forget = qa.where("attribute = 'blood_type'").join(F.broadcast(names), "name", "left_semi").withColumn("text", text)
    retain = lambda: splits.labelled(qa, names, ONE, "same_firstname_same_attr", 3, SEED).where("split = 'retain'").withColumn("text", text)
    lines = lambda: V.refusals(spark).withColumnRenamed("value", "text")
    out = None
    for method in ("grad_ascent", "npo", "po"):
        one = prep.method_triples(config.Unlearn(method=method), forget, retain, lines, ["name", "template"], SEED)
        have = lambda c, one=one: (F.count(c) if c in one.columns else F.lit(0).cast("bigint"))
        row = one.agg(F.count("*").alias("n"), have("retain_text").alias("n_retain"), have("idk_text").alias("n_idk")).withColumn("method", F.lit(method))
        out = row if out is None else out.unionByName(row)
    return out


def _vocabulary(spark, d):
    """Words of the benchmark, with and without a space before them, and the letters."""
    words = V.table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    both = words.select(F.explode(F.array("w", F.concat(F.lit(" "), "w"))).alias("piece"))
    letters = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz "], "piece string")
    return tokens.Vocabulary.of_table(both.unionByName(letters))


@query
def vocabulary_ids(spark, d):
    """Answers as ids of a vocabulary, longest match, bytes for what no piece covers; and whether they decode to the answer."""
    v = _vocabulary(spark, d)
    coded = tokens.with_ids(V.chat(spark, d).select("conv_id", "turn", "answer"), {"ids": "answer"}, v)
    back = tokens.with_text(coded, {"back": "ids"}, v)
    return back.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), (F.col("back") == F.col("answer")).alias("whole"))


@query
def vocabulary_labels(spark, d):
    """What is learnt of a chat pair, with the question's mask counted with the leading special token and without it."""
    v, c = _vocabulary(spark, d), V.chat(spark, d)
    asked = O.wrap(F.col("question"), V.START, V.END)
    rows = c.select("conv_id", "turn", asked.alias("q"), F.concat(asked, F.lit(" "), "answer").alias("t"))
    out = None
    for name, shifted in (("shifted", True), ("short", False)):
        x = tokens.labelled(rows, "q", "t", v, 256, shifted)
        learnt = F.filter("labels", lambda y: y != L.IGNORED)
        one = x.select("conv_id", "turn", F.lit(name).alias("mask"), F.array_join(F.slice("input_ids", 1, 3).cast("array<string>"), ",").alias("first"), F.array_join(learnt.cast("array<string>"), ",").alias("learnt"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def idk_replace(spark, d):
    return prep.with_refusals(V.qa(spark, d), V.refusals(spark), ["name", "attribute", "template"], SEED).select("name", "attribute", "template", "question", "answer")


@query
def stack_batches(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.length("o_orderpriority").alias("n"))
    s = prep.stacked(o, F.floor(F.col("o_orderkey") / 5), "o_orderkey", ["n"])
    return s.select(F.col("batch").cast("bigint").alias("batch"), F.array_join(F.col("n").cast("array<string>"), ",").alias("n"))


@query
def dense_positions(spark, d):
    return positions(V.table(spark, d, "orders").select("o_orderkey"), SEED, "o_orderkey").select("o_orderkey", F.col("pos").cast("bigint").alias("pos"))


@query
def prompt_truncation(spark, d):
    c = V.chat(spark, d)
    ids = prep.word_ids(F.col("answer"))
    return c.select("conv_id", "turn", F.size(F.slice(ids, 1, 150)).cast("bigint").alias("n"), F.size(ids).cast("bigint").alias("n_all"))


# Losses


@query
def nll(spark, d):
    x = V.logits(spark, d)
    return x.select("vec_id", r6(L.nll(F.col("v"), F.col("target"))).alias("nll"), r6(L.nll(F.col("ref"), F.col("target"))).alias("ref_nll"))


@query
def kl(spark, d):
    x = V.logits(spark, d).select("target", L.kl(F.col("ref"), F.col("v")).alias("kl"))
    return x.groupBy("target").agg(r6(F.sum("kl") / F.count("*")).alias("kl"))


def _losses(spark, d):
    """Losses of every vector, the reference's too, and how much each vector is less likely than under the reference."""
    x = V.logits(spark, d).select("vec_id", "target", L.nll(F.col("v"), F.col("target")).alias("cur"), L.nll(F.col("ref"), F.col("target")).alias("base"))
    return x.withColumn("lose", -(F.col("cur") - F.col("base")))


@query
def dpo(spark, d):
    """Each vector loses against the next one; one that has none, against nothing."""
    x = _losses(spark, d)
    won = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("lose").alias("win"))
    pairs = x.join(won, "vec_id", "left").withColumn("win", F.coalesce("win", F.lit(0.0)))
    return pairs.groupBy("target").agg(r6(F.avg(L.preference_loss(F.col("win"), F.col("lose"), 0.1))).alias("loss"))


@query
def npo(spark, d):
    return _losses(spark, d).groupBy("target").agg(r6(F.avg(L.preference_loss(F.lit(0.0), F.col("lose"), 0.1))).alias("loss"))


@query
def objective_by_method(spark, d):
    x = _losses(spark, d).groupBy("target").agg(F.avg("cur").alias("f"), F.avg("base").alias("r"), F.avg(F.col("cur") * 0.5).alias("i"), F.avg(L.preference_loss(F.lit(0.0), F.col("lose"), 0.1)).alias("p"))
    methods = F.array(*[F.lit(m) for m in ("grad_ascent", "grad_diff", "KL", "noisy_grad_diff", "po", "dpo", "npo")])
    x = x.withColumn("method", F.explode(methods))
    return x.select("target", "method", r6(L.objective(F.col("method"), F.col("f"), F.col("r"), F.col("i"), F.col("p"), 0.7)).alias("loss"))


@query
def perplexity(spark, d):
    x = V.logits(spark, d).groupBy("target").agg(F.avg(L.nll(F.col("v"), F.col("target"))).alias("l"))
    return x.select("target", r6(L.perplexity(F.col("l"))).alias("perplexity"))


@query
def sequence_nll(spark, d):
    """Shifted sums over runs of eight vectors, labels 9 ignored."""
    x = V.logits(spark, d).withColumn("seq", F.floor(F.col("vec_id") / 8))
    nxt = F.lead("target").over(Window.partitionBy("seq").orderBy("vec_id"))
    x = x.withColumn("next", F.coalesce(F.when(nxt == 9, L.IGNORED).otherwise(nxt), F.lit(L.IGNORED)))
    return x.groupBy(F.col("seq").cast("bigint").alias("seq")).agg(r6(F.sum(L.nll(F.col("v"), F.col("next")))).alias("nll"))


@query
def entropy_weight(spark, d):
    return V.logits(spark, d).select("vec_id", r6(L.entropy_weight(F.transform("v", lambda x: x * 20))).alias("weight"))


@query
def gradient_clip(spark, d):
    return V.logits(spark, d).select("vec_id", r6(L.l2_norm(L.clipped(F.transform("v", lambda x: x * (F.col("vec_id") % 3)), 0.5))).alias("norm"))


@query
def training_loss(spark, d):
    """A step's loss under accumulation, and the loss of evaluation."""
    x = V.logits(spark, d).groupBy("target").agg(F.avg(L.nll(F.col("v"), F.col("target"))).alias("l"))
    return x.select("target", r6(L.accumulated(F.col("l"), 4)).alias("step_loss"), r6(L.accumulated(F.col("l"), 1)).alias("one_step"), r6(L.evaluation_loss(F.col("l"))).alias("eval_loss"))


@query
def noisy_gradient(spark, d):
    x = V.logits(spark, d)
    return x.select("vec_id", r6(L.l2_norm(L.noisy(F.col("v"), 0.5, 0.25, SEED, F.col("vec_id")))).alias("norm"))


@query
def gradient_global_clip(spark, d):
    """Steps of eight vectors as parameters: clipped by the norm of all of them together, then noise."""
    x = V.logits(spark, d)
    g = x.select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("step"), (F.col("vec_id") % 8).alias("parameter"), F.col("v").alias("values"))
    out = gradients.noisy_step(g, 2.0, 0.25, SEED)
    rows = out.select("step", "parameter", F.posexplode(F.arrays_zip("values", "clipped", "noisy")).alias("pos", "x"))
    return rows.select("step", "parameter", F.col("pos").cast("bigint").alias("pos"), r6("x.values").alias("value"), r6("x.clipped").alias("clipped"), r6("x.noisy").alias("noisy"))


@query
def masked_logits(spark, d):
    x = V.logits(spark, d)
    m = L.masked(F.col("v"), F.array(F.col("target"), F.col("target") + 1, F.lit(20)), True)
    return x.select("vec_id", r6(F.array_max(m)).alias("best"), F.size(F.filter(m, lambda y: y > float("-inf"))).cast("bigint").alias("n"))


# Decoding


def _tokens(spark, d):
    return decode.position_tokens(corpus.unpivoted(V.profiles(spark, d)))


@query
def position_token_sets(spark, d):
    return _tokens(spark, d).select("attribute", F.col("pos").cast("bigint").alias("pos"), F.col("token").cast("bigint").alias("token"))


def _steps(spark, d):
    """vec_id, attribute, pos, logits, truth of every position; the truth is the space at 0 and a digit after it."""
    s = V.sequences(spark, d).select("vec_id", "attribute", F.posexplode("steps").alias("pos", "logits"))
    longest = F.element_at(F.create_map(*[F.lit(x) for kv in A.MAX_POSITIONS.items() for x in kv]), F.col("attribute"))
    truth = F.when(F.col("pos") == 0, F.lit(0)).otherwise(16 + ((F.col("vec_id") + F.col("pos")) % 10).cast("int"))
    return s.where(F.col("pos") < longest).withColumn("truth", truth)


@query
def token_rank(spark, d):
    out = decode.token_rank(decode.with_candidates(_steps(spark, d), _tokens(spark, d)))
    return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"), F.col("max_rank").cast("bigint").alias("max_rank"), "note")


@query
def flip_decode(spark, d):
    out = decode.flip_decode(V.sequences(spark, d), decode.position_sets(_tokens(spark, d)), True)
    return out.select("vec_id", "attribute", "text")


@query
def flip_orders(spark, d):
    """Places of the true tokens, by the logits as they are, along the flipped decoding."""
    out = decode.flip_decode(V.sequences(spark, d).withColumn("truth", _true_tokens("vec_id")), decode.position_sets(_tokens(spark, d)), True, "truth")
    return out.select("vec_id", "attribute", "text", F.array_join("orders", ", ").alias("orders"))


@query
def decode_vocabulary(spark, d):
    """Ids spelt by a vocabulary table, special ones left out, unknown ones as <id>."""
    c = V.chat(spark, d).select("conv_id", "turn", F.transform(prep.word_ids(F.col("answer")), lambda x: x % 40).alias("ids"))
    vocabulary = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit(" "), "n_name").alias("piece"))
    return decode.vocabulary_text(c, "ids", vocabulary, (3, 30)).select("conv_id", "turn", "text")


@query
def recovery_prompts(spark, d):
    p = V.predictions(spark, d).withColumn("question", F.concat(F.lit("What of "), "name", F.lit("?")))
    return evaluation.recovery_prompts(p, V.START, V.END).select("k", "attribute", "prompt")


def _true_tokens(key):
    """Stand-in truths: the space, then digits by the sequence's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda p: F.when(p == 0, 0).otherwise(16 + ((F.col(key) + p) % 10).cast("int")))


def _found(spark, d, settings):
    """The sequences, and what a recovery over all of them finds."""
    rows = V.sequences(spark, d).withColumn("truth", _true_tokens("vec_id")).withColumnRenamed("vec_id", "key")
    rows = rows.withColumn("hidden_norms", F.transform("steps", L.l2_norm)).withColumn("references", F.transform("steps", lambda x: F.reverse(x)))
    tokens = _tokens(spark, d)
    return rows, evaluation.recovered(rows, decode.position_sets(tokens), tokens, settings)


def _audit(spark, d, settings):
    """A recovery over all sequences, against the people in turn."""
    rows, found = _found(spark, d, settings)
    return evaluation.recovery_errors(found, _truths(spark, d, rows), [1, 2, 3])


def _advanced(spark, d, settings):
    """A recovery whose model sees what has been decoded so far."""
    rows = V.sequences(spark, d).select(F.col("vec_id").alias("key"), "attribute", _true_tokens("vec_id").alias("truth"))
    return rows, evaluation.recovered_with(rows, decode.position_sets(_tokens(spark, d)), V.advancing_model(spark, d), settings)


def _truths(spark, d, rows):
    """key, true_answer: a sequence's number within its attribute is the person's; where sequences outnumber people, these come round again."""
    people = corpus.unpivoted(V.profiles(spark, d)).select("name", "attribute", "value")
    own = positions(people, SEED, "name", within=("attribute",)).select("pos", "attribute", F.concat(F.lit(" "), "value", F.lit(".")).alias("true_answer"))
    n = F.broadcast(people.groupBy("attribute").agg(F.count("*").alias("n")))  # one row for each attribute
    numbered = rows.select("key", "attribute").join(n, "attribute").withColumn("pos", F.pmod(F.floor(F.col("key") / len(A.ATTRIBUTES)), F.col("n")))
    return numbered.join(own, ["attribute", "pos"])


@query
def recovery_flip(spark, d):
    out = _audit(spark, d, config.Recover(kind="flip"))
    return out.select("key", "attribute", "cutoff", "best_pred", r6("error").alias("error"), "best_idx")


@query
def recovery_beam(spark, d):
    out = _audit(spark, d, config.Recover(kind="beam", flip=False, beams=3, candidates=2))
    return out.select("key", "attribute", "cutoff", "best_pred", r6("error").alias("error"), "best_idx")


@query
def recovery_gradient_oracle(spark, d):
    out = _audit(spark, d, config.Recover(kind="grad", mode="oracle", loss="npo", beams=3, candidates=2))
    return out.select("key", "attribute", "cutoff", "best_pred", r6("error").alias("error"), "best_idx")


@query
def recovery_error_list(spark, d):
    """A recovery's errors by cutoff as one map a sequence."""
    rows, found = _found(spark, d, config.Recover(kind="beam", flip=False, beams=3, candidates=2))
    lists = evaluation.error_lists(found, _truths(spark, d, rows), [1, 2, 5, 100])
    shown = F.transform(F.map_entries("error_list"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"]["best_idx"].cast("string"), e["value"]["best_pred"]))
    return lists.select("key", "attribute", F.array_join(shown, "|").alias("errors"))


@query
def beam_advance(spark, d):
    """Beams whose context advances, with their mean scores."""
    _, found = _advanced(spark, d, config.Recover(kind="beam", flip=False, beams=3, candidates=2))
    return found.select("key", "attribute", "idx", "pred", r6("score").alias("score"), r6("average_score").alias("average_score"))


@query
def flip_advance(spark, d):
    """One flipped decoding whose context advances, with the places of the true tokens."""
    _, found = _advanced(spark, d, config.Recover(kind="flip", flip=True))
    return found.select("key", "attribute", "pred", "orders")


@query
def grad_advance(spark, d):
    """Gradient beams whose context advances, small norms first."""
    _, found = _advanced(spark, d, config.Recover(kind="grad", flip=False, beams=3, candidates=2))
    return found.select("key", "attribute", "idx", "pred", "orders", r6("score").alias("score"))


@query
def recovery_advance(spark, d):
    """The audit of beams whose context advances."""
    rows, found = _advanced(spark, d, config.Recover(kind="beam", flip=False, beams=3, candidates=2))
    out = evaluation.recovery_errors(found, _truths(spark, d, rows), [1, 2, 3])
    return out.select("key", "attribute", "cutoff", "best_pred", r6("error").alias("error"), "best_idx")


@query
def flip_recovery_error(spark, d):
    """Decoded values against people's, by attribute."""
    out = decode.flip_decode(V.sequences(spark, d), decode.position_sets(_tokens(spark, d)), False)
    found = out.withColumnRenamed("vec_id", "key")
    joined = found.join(_truths(spark, d, found).select("key", "true_answer"), "key").select("attribute", "true_answer", F.col("text").alias("model_output"))
    return scoring.error_by_attribute(scoring.error_detail(joined)).select("attribute", r6("error").alias("error"), F.col("n").cast("bigint").alias("n"))


@query
def beam_decode(spark, d):
    out = decode.beam_decode(V.sequences(spark, d), decode.position_sets(_tokens(spark, d)), False, 5, 3)
    best = out.select("vec_id", "attribute", F.posexplode("beams").alias("beam", "b"))
    return best.select("vec_id", "attribute", "beam", "b.text", r6("b.score").alias("score"))


@query
def beam_decode_entropy(spark, d):
    out = decode.beam_decode(V.sequences(spark, d), decode.position_sets(_tokens(spark, d)), True, 3, 3, entropy=True)
    p = decode.relative_probability(F.transform("beams", lambda b: b["score"]))
    return out.select("vec_id", "attribute", F.col("beams")[0]["text"].alias("text"), r6(F.get(p, F.lit(0))).alias("probability"))


def _gradients(spark, d):
    norm = L.l2_norm(F.col("logits"))
    return decode.with_candidates(_steps(spark, d).withColumn("hidden_norm", norm).withColumn("reference", F.reverse("logits")), _tokens(spark, d))


@query
def grad_norm_rank(spark, d):
    out = decode.gradient_rank(_gradients(spark, d), True)
    return out.where("rank = 0").select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("token").cast("bigint").alias("token"), r6("norm").alias("norm"))


@query
def grad_norm_npo(spark, d):
    out = decode.gradient_rank(_gradients(spark, d), False, npo_beta=1.0)
    return out.where("rank = 0").select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("norm").alias("norm"))


@query
def grad_decode(spark, d):
    out = decode.gradient_decode(_gradients(spark, d), ["vec_id", "attribute"], True, 3, 2)
    return out.select("vec_id", "attribute", "beam", decode.decoded(F.col("tokens")).alias("text"), F.array_join("orders", ", ").alias("orders"), r6("score").alias("score"))


# Readers and writers: each query writes a whole table to the shared folder with a writer and returns what a reader finds there.
# The layouts of one JSON document a file, which are for small exports, take the tables of nations and regions, whose size is fixed.


def _nations(spark, d):
    """k, name, region of each nation."""
    n, r = V.table(spark, d, "nation"), V.table(spark, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query
def stored_json_array(spark, d):
    path = scratch(spark, "array")
    question = F.concat(F.lit('Where is "'), "name", F.lit('"?'))
    sinks.json_array(_nations(spark, d).select("k", "name", F.lit("region").alias("attribute"), question.alias("question"), F.col("region").alias("answer")), path, "k")
    return readers.json_array(spark, path)


@query
def stored_json_lines(spark, d):
    path = scratch(spark, "lines")
    sinks.json_lines(corpus.unpivoted(V.profiles(spark, d)).select("name", "attribute", "value"), path, "attribute")
    return spark.read.schema("name string, value string, attribute string").json(path)


@query
def stored_profile_map(spark, d):
    path = scratch(spark, "profiles")
    code = F.concat(F.lit("K1A0B"), (F.col("k") % 10).cast("string"))
    profile = F.struct("name", (F.col("k") + 1975).alias("year_of_birth"), code.alias("address_postcode"), F.lpad(F.col("k").cast("string"), 9, "0").alias("social_insurance_number"), F.lit("O+").alias("blood_type"))
    groups = _nations(spark, d).groupBy("region").agg(F.collect_list(profile).alias("profiles"))
    whole = groups.agg(F.map_from_entries(F.collect_list(F.struct("region", "profiles"))).alias("m"))
    whole.select(F.to_json("m")).coalesce(1).write.mode("overwrite").text(path)
    return readers.profile_map(spark, path)


@query
def stored_lines(spark, d):
    path = scratch(spark, "list")
    V.table(spark, d, "part").select(F.when(F.col("p_size") > 25, F.lit("  ")).otherwise(F.col("p_name"))).write.mode("overwrite").text(path)
    return readers.lines(spark, path, required=True)


@query
def stored_attribute_folders(spark, d):
    path = scratch(spark, "folders")
    sinks.attribute_files(corpus.unpivoted(V.profiles(spark, d)), path)
    return spark.read.schema("value string, attribute string").text(path)


@query
def stored_attribute_files(spark, d):
    path = scratch(spark, "attributes")
    for name in ("name", "region"):
        sinks.attribute_file(_nations(spark, d).select(F.col(name).alias("value")), f"{path}/{name}.jsonl")
    return readers.attribute_values(spark, f"{path}/*.jsonl")


@query
def stored_text_splits(spark, d):
    path = scratch(spark, "text")
    for name, source in (("train", "documents"), ("validation", "benchmark")):
        sinks.json_lines(V.table(spark, d, source).select("text"), f"{path}/{name}")
    parts = readers.text_splits(spark, f"{path}/train", f"{path}/validation")
    train, validation = (part.withColumn("split", F.lit(k)) for k, part in parts.items())
    both = train.unionByName(validation)
    return both.select("split", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.char_length("text").cast("bigint").alias("n_chars"))


def _stored_baseline(spark, d):
    """A baseline of one row a nation, and its means in the trailer, in one array."""
    path = scratch(spark, "baseline")
    n = _nations(spark, d).select("k", "name", F.lit("region").alias("attribute"), F.lit("Where?").alias("question"), F.col("region").alias("base_answer"), F.lit(None).cast("string").alias("base_llm_eval"), (F.col("k") / 4).alias("base_llm_score"))
    sinks.legacy_results(n, n.agg(F.max("k").alias("k"), F.avg("base_llm_score").alias("mean_score")), path, "k")
    return path


@query
def stored_baseline(spark, d):
    return readers.baseline(spark, _stored_baseline(spark, d))


@query
def stored_legacy_results(spark, d):
    detail, trailer = readers.legacy_results(spark, _stored_baseline(spark, d))
    one = detail.select("name", F.col("base_llm_score").alias("score"))
    return one.unionByName(trailer.select(F.lit(None).cast("string").alias("name"), F.col("mean_score").alias("score")))


@query
def stored_splits(spark, d):
    path = scratch(spark, "splits")
    qa = V.qa(spark, d)
    names = splits.forget_names(qa, "n_per_firstname", 2, SEED)
    whole = splits.all_modes(qa, names, ONE, ("all_except_forget", "same_attr"), 10, SEED).select("mode", "split", "name", "attribute", "template", "question")
    sinks.split_with_test(whole, corpus.one_per_pair(whole, "test", "mode"), path)
    both = [spark.read.parquet(f"{path}/{k}").withColumn("part", F.lit(k)) for k in ("sets", "test")]
    return both[0].unionByName(both[1]).select("part", "mode", "split", "name", "attribute", "template")


@query
def stored_results(spark, d):
    """Two runs, the second of them written again with other rows: the first keeps its own."""
    path = scratch(spark, "results")
    detail = scoring.error_detail(V.predictions(spark, d)).select("k", "attribute", r6("error").alias("error"))
    for run, keep in (("a", F.lit(True)), ("b", F.lit(True)), ("b", F.col("error") > 0)):
        part = detail.where(keep).withColumn("run", F.lit(run))
        sinks.results(part, part.groupBy("run", "attribute").agg(F.count("*").alias("n")), path, "run")
    rows = spark.read.parquet(f"{path}/detail").select("run", "attribute", "k", "error")
    return rows.join(spark.read.parquet(f"{path}/summary"), ["run", "attribute"]).select("run", "attribute", "k", "error", "n")


@query
def stored_token_notes(spark, d):
    path = scratch(spark, "notes")
    sinks.token_notes(_tokens(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("note"))


@query
def stored_run_record(spark, d):
    path = scratch(spark, "run")
    log = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), r6("o_totalprice").alias("loss"))
    sinks.run_record(log, config.FineTune(), path)
    rank = F.from_json("value", "rank int")["rank"]
    settings = spark.read.text(f"{path}/config").select(rank.cast("bigint").alias("rank"))
    return spark.read.schema("step bigint, loss double").json(f"{path}/log_history").crossJoin(F.broadcast(settings))


@query
def stored_run_folders(spark, d):
    """A folder for each nation (a table of fixed size), two of three of them checkpoints."""
    path = scratch(spark, "runs")
    for (k,) in V.table(spark, d, "nation").select("n_nationkey").collect():
        fs, where = files(spark, f"{path}/{'log' if k % 3 == 0 else 'checkpoint'}-{k}")
        fs.mkdirs(where)
    found = [(f.rsplit("/", 1)[1],) for f in catalog.folders(spark, path, "checkpoint-")]
    return spark.createDataFrame(found, "folder string")


@query
def dataset_paths(spark, d):
    """The file of every dataset type, in a split folder for each nation."""
    n = V.table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, (*catalog.GLOBAL, *catalog.SPLIT)))).alias("kind"))
    folder = F.concat(F.lit("unlearn-N"), (F.col("n_nationkey") + 1).cast("string"), F.lit("-A1"))
    return catalog.with_paths(n, "data", folder).select("n_nationkey", "kind", "path")


@query
def stored_variants(spark, d):
    path = scratch(spark, "variants")
    sinks.variants(evaluation.base_variants(_common_questions(spark, d), _model, _judge, V.START, V.END, ["name", "attribute"], SEED), path)
    detail = spark.read.parquet(f"{path}/detail").groupBy("variant").agg(F.count("*").alias("n"))
    stats = spark.read.parquet(f"{path}/statistics").select(F.regexp_replace("model_type", "^base-(?=.)", "base-").alias("model_type"), "total_samples", "score")
    return detail.join(stats, F.concat(F.lit("base-"), F.regexp_replace("variant", "^base-?", "")) == F.col("model_type")).select("variant", "n", "total_samples", "score")


@query
def checkpoint_retention(spark, d):
    """Runs of some epochs, saved every second one, of which the last two stay."""
    root = scratch(spark, "kept")
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("run"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_nationkey") % 4 + 5)).alias("step"))
    saved = n.where(retention.due(F.col("step"), 2)).withColumn("weights", F.concat_ws("/", "run", F.col("step").cast("string")))
    saved.write.mode("append").partitionBy("run", "step").parquet(root)
    retention.record(saved.select("run", "step", F.concat(F.lit("run="), "run", F.lit("/step="), F.col("step").cast("string")).alias("folder")), root)
    retention.retire(spark, root, 2)
    left = spark.read.schema("weights string, run string, step bigint").parquet(root)
    return left.join(retention.index(spark, root), ["run", "step"]).select("run", "step", "weights", F.col("state").cast("bigint").alias("state"))


@query
def stage_graph(spark, d):
    """Three stages, run twice: what a changed setting touches runs again, the rest is read."""
    root = scratch(spark, "stages")

    def stages(weight):
        orders = V.table(spark, d, "orders")
        spend = stages_.Stage("spend", lambda _: orders.groupBy("o_custkey").agg(r6(F.sum("o_totalprice") * weight).alias("spend")), settings={"weight": weight})
        lines = stages_.Stage("lines", lambda _: V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")))
        count = lambda t: orders.join(t["lines"], F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("n")).join(t["spend"], "o_custkey")
        return [stages_.Stage("report", count, needs=("spend", "lines")), spend, lines]

    inputs = stages_.inputs_fingerprint(spark, f"{d}/orders.parquet", f"{d}/lineitem.parquet")
    stages_.graph(spark, stages(1), root, inputs=inputs)
    again = stages_.graph(spark, stages(2), root, inputs=inputs)
    return again.tables["report"].select("o_custkey", "n", "spend", F.lit(",".join(again.ran)).alias("ran"))


# Runs


@query
def run_folder_name(spark, d):
    n = V.table(spark, d, "nation").withColumn("m", F.element_at(F.array(*[F.lit(m) for m in ("grad_diff", "npo", "noisy_grad_diff")]), (F.col("n_nationkey") % 3 + 1).cast("int")))
    beta = F.when(F.col("n_nationkey") % 2 == 0, F.lit(0.1)).otherwise(F.lit(0.5))
    name = catalog.run_folder(F.concat(F.lit("set"), F.col("n_nationkey").cast("string")), F.lit(0.5), F.lit(0.25), F.lit(256), F.lit(0.5), F.lit(80), F.lit(1.5), beta, F.col("m"), F.lit(0.25), F.lit(1.5))
    file = catalog.result_file(F.col("n_nationkey") % 5, F.lit("forget"))
    trained = catalog.train_folder(F.lit(0.5), F.lit(0.25), F.lit(256), F.lit(0.5), F.lit(40))
    return n.select("n_nationkey", name.alias("folder"), F.concat_ws("/", catalog.method_folder(name, F.col("m")), file).alias("result"), trained.alias("trained"))


@query
def keep_last_n(spark, d):
    return scoring.keep_last(V.table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query
def md5_shuffle(spark, d):
    c = V.table(spark, d, "customer")
    return c.select("c_custkey", order_key(SEED, F.col("c_custkey")).alias("at_key"), draw(SEED, 40, F.col("c_custkey")).alias("drawn"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in QUERIES}
