"""Whole evaluations: generation, judging, baseline variants, and the recovery audit, with pluggable models.

A model is a function of the table asked, which adds a column, or a table of outputs made elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obliva import config
from obliva.functions import outputs as O
from obliva.functions import similarity
from obliva.functions.attributes import mask_value
from obliva.operators import advance, corpus, decode, models, scoring

Model = Callable[[DataFrame], DataFrame] | DataFrame
#: A judge's output for question, reference (or none) and answer, as a column.
Judge = Callable[[Column, Column | None, Column], Column]
#: The variants of a baseline.
VARIANTS = ("base", "base-10", "base-0", "base-1")


def generated(rows: DataFrame, model: Model, start: str, end: str, prompt: str = "question") -> DataFrame:
    """rows with ``model_output``, cleaned: the model sees the wrapped prompt, a table is looked up by the bare one."""
    asked = rows.withColumn("input", O.wrap(F.col(prompt), start, end))
    if callable(model):
        out = model(asked)
    else:
        out = asked.join(model.select(F.col("prompt").alias("_prompt"), "model_output"), F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")
    return out.withColumn("model_output", O.clean_output(F.coalesce("model_output", F.lit("")), F.col(prompt), start, end)).drop("input")


def asking(settings: config.Evaluate, name: str, load: Callable[[config.Evaluate], models.Answer], **options) -> Model:
    """A model that is asked in batches of the settings' size; ``load`` gives it by the settings (quantisation, new tokens)."""
    whole = f"{name} {settings.quantisation} {settings.max_new_tokens}"
    made = partial(load, settings)
    return lambda rows: models.ask(rows, "input", whole, made, most=settings.batch, **options)


def base_variants(questions: DataFrame, model: Model, judge: Judge, start: str, end: str, keys: list[str], seed: str) -> DataFrame:
    """keys, question, variant, reference, model_answer, score, evaluation_text of the four variants of a baseline.

    base: the answer judged by itself; base-10: against itself; base-0: garbled text against it; base-1: the answer to an
    irrelevant prompt against it.
    """
    answered = generated(questions, model, start, end).withColumnRenamed("model_output", "_answer")
    other = generated(corpus.irrelevant_prompts(answered, keys, seed), model, start, end, prompt="prompt").withColumnRenamed("model_output", "_other")
    own, none = F.col("_answer"), F.lit(None).cast("string")
    answers = (own, own, O.garbled(own), F.col("_other"))

    def variant(k: int) -> Column:
        reference = None if k == 0 else own
        return F.struct(F.lit(VARIANTS[k]).alias("variant"), (none if reference is None else reference).alias("reference"), answers[k].alias("model_answer"), judge(F.col("question"), reference, answers[k]).alias("_judged"))

    rows = other.select(*keys, "question", F.explode(F.array(*map(variant, range(4)))).alias("_v")).select(*keys, "question", "_v.*")
    rows = rows.withColumn("score", O.parse_score(F.col("_judged")))
    return rows.withColumn("evaluation_text", O.flag_unparsed(F.col("_judged"), F.col("score"))).drop("_judged")


def variant_statistics(variants: DataFrame) -> DataFrame:
    """model_type, total_samples, score: a row for each variant."""
    out = variants.groupBy("variant").agg(F.count("*").alias("total_samples"), scoring.mean_score(F.col("score")).alias("score"))
    return out.select(F.concat(F.lit("base-"), F.regexp_replace("variant", "^base-?", "")).alias("model_type"), "total_samples", "score")


def common(results: DataFrame, baseline: DataFrame, settings: config.Evaluate, judge: Judge, keys: tuple[str, ...] = ("name", "attribute", "question")) -> DataFrame:
    """Results (keys, model_output) that have a baseline (keys, pos, base_answer, base_llm_score), with the columns the settings ask
    for: model_llm_score and llm_relscr (judge_base), llm_score and llm_eval (judge_full), metrics; null where not asked for."""
    rows = scoring.with_baseline(results, baseline, keys)
    question, answer, reference = F.col("question"), F.col("model_output"), F.col("base_answer")
    score = O.parse_score(judge(question, None, answer)) if settings.judge_base else F.lit(None).cast("double")
    rows = rows.withColumn("model_llm_score", score)
    rows = rows.withColumn("llm_relscr", O.relative_score(F.col("model_llm_score"), F.col("base_llm_score")))
    judged = judge(question, reference, answer) if settings.judge_full else F.lit(None).cast("string")
    rows = rows.withColumn("_judged", judged).withColumn("llm_score", F.when(F.col("_judged").isNotNull(), O.parse_score(F.col("_judged"))))
    rows = rows.withColumn("llm_eval", O.flag_unparsed(F.col("_judged"), F.col("llm_score"))).drop("_judged")
    if settings.text_metrics:
        rows = rows.withColumn("metrics", similarity.text_metrics(answer, reference, question))
    return rows


def common_statistics(rows: DataFrame, model: str) -> DataFrame:
    """The statistics of ``common``: its scores, and the numbers among its metrics."""
    scores = ["base_llm_score", "model_llm_score", "llm_relscr", "llm_score"]
    return scoring.statistics(rows, scores + (scoring.number_fields(rows, "metrics") if "metrics" in rows.columns else []), model=model)


def recovery_prompts(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows (attribute, question, true_answer) with ``prompt``: the question, then the answer up to where its value was masked."""
    masked = mask_value(F.col("true_answer"), F.col("attribute"))
    return rows.withColumn("prompt", F.concat_ws(" ", O.wrap(F.col("question"), start, end), masked))


def recovered(rows: DataFrame, sets: DataFrame, tokens: DataFrame, settings: config.Recover) -> DataFrame:
    """rows (key, attribute, steps, hidden_norms and references for grad, truth) with idx, pred and orders: the predictions of a recovery.

    flip gives one prediction; beam and grad as many as there are beams, best first.
    """
    if settings.kind == "flip":
        out = decode.flip_decode(rows, sets, settings.flip, "truth")
        return out.select("key", "attribute", F.lit(0).alias("idx"), F.col("text").alias("pred"), F.array_join("orders", ", ").alias("orders"))
    if settings.kind == "beam":
        out = decode.beam_decode(rows, sets, settings.flip, settings.beams, settings.candidates, settings.entropy)
        return out.select("key", "attribute", F.posexplode("beams").alias("idx", "b")).select("key", "attribute", "idx", F.col("b.text").alias("pred"), F.lit(None).cast("string").alias("orders"))
    steps = rows.select("key", "attribute", F.posexplode(F.arrays_zip("steps", "hidden_norms", "references", "truth")).alias("pos", "s"))
    steps = steps.select("key", "attribute", "pos", F.col("s.steps").alias("logits"), F.col("s.hidden_norms").alias("hidden_norm"), F.col("s.references").alias("reference"), F.col("s.truth").alias("truth"))
    last = sets.select("attribute", F.size("sets").alias("_n"))
    steps = decode.with_candidates(steps.join(F.broadcast(last), "attribute").where("pos < _n").drop("_n"), tokens)  # one row for each attribute
    out = decode.gradient_decode(steps, ["key", "attribute"], settings.flip, settings.beams, settings.candidates, settings.mode == "oracle", settings.beta if settings.loss == "npo" else None)
    return out.select("key", "attribute", F.col("beam").alias("idx"), decode.decoded(F.col("tokens")).alias("pred"), F.array_join("orders", ", ").alias("orders"))


def recovered_with(rows: DataFrame, sets: DataFrame, model: advance.Model, settings: config.Recover, context: bool = True) -> DataFrame:
    """As ``recovered``, but the model is asked at each step for what has been decoded so far; rows (key, attribute, truth)."""
    if settings.kind == "flip":
        rule, beams, stop = advance.by_logits(settings.flip, 1, truth="truth"), 1, False
    elif settings.kind == "beam":
        rule, beams, stop = advance.by_logits(settings.flip, settings.candidates, settings.entropy), settings.beams, True
    else:
        rule = advance.by_gradients(settings.flip, settings.candidates, settings.mode == "oracle", settings.beta if settings.loss == "npo" else None)
        beams, stop = settings.beams, False
    out = advance.advance(rows.select("key", "attribute", "truth"), sets, model, rule, keys=["key"], beams=beams, stop=stop, context=context)
    orders = F.lit(None).cast("string") if settings.kind == "beam" else F.array_join("orders", ", ")
    return out.select("key", "attribute", F.col("beam").alias("idx"), F.col("text").alias("pred"), orders.alias("orders"), "score", advance.average_score(F.col("score"), F.col("tokens")).alias("average_score"))


def error_lists(predictions: DataFrame, truths: DataFrame, cutoffs: list[int]) -> DataFrame:
    """key, attribute, error_list: by cutoff, the least error among the first so many predictions (best_pred, error, best_idx).

    One aggregate over all cutoffs, pre-aggregated like any other; the first of equals; no prediction: index -1, error infinite.
    """
    met = predictions.join(truths.select("key", "true_answer"), "key").withColumn("model_output", F.col("pred"))
    detail = scoring.error_detail(met)
    one = F.struct(F.col("pred").alias("best_pred"), "error", F.col("idx").cast("int").alias("best_idx"))
    best = [F.min_by(one, F.when(F.col("idx") < n, F.struct("error", "idx"))) for n in cutoffs]
    none = F.struct(F.lit("").alias("best_pred"), F.lit(float("inf")).alias("error"), F.lit(-1).alias("best_idx"))
    pairs = F.create_map(*[x for n, b in zip(cutoffs, best, strict=True) for x in (F.lit(n), F.coalesce(b, none))])
    return detail.groupBy("key", "attribute").agg(pairs.alias("error_list"))


def recovery_errors(predictions: DataFrame, truths: DataFrame, cutoffs: list[int]) -> DataFrame:
    """key, attribute, cutoff, best_pred, error, best_idx: a row for each entry of ``error_lists``."""
    lists = error_lists(predictions, truths, cutoffs)
    return lists.select("key", "attribute", F.explode("error_list").alias("cutoff", "_b")).select("key", "attribute", "cutoff", "_b.*")
