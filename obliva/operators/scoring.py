"""Errors and scores: detail rows, means, baseline join, statistics, pluggable models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from obliva.functions.attributes import ATTRIBUTES, attribute_error
from obliva.functions.outputs import UNPARSED


def error_detail(predictions: DataFrame) -> DataFrame:
    """predictions (attribute, true_answer, model_output, ...) with ``error``."""
    return predictions.withColumn("error", attribute_error(F.col("model_output"), F.col("true_answer"), F.col("attribute")))


def error_by_attribute(detail: DataFrame) -> DataFrame:
    """attribute, error, n: the mean error of each of the four attributes, 0 where there is no row."""
    keys = detail.sparkSession.createDataFrame([(a,) for a in ATTRIBUTES], "attribute string")
    sums = detail.groupBy("attribute").agg(F.sum("error").alias("_s"), F.count("*").alias("_n"))
    joined = keys.join(sums, "attribute", "left")
    return joined.select("attribute", F.coalesce(F.try_divide("_s", "_n"), F.lit(0.0)).alias("error"), F.coalesce("_n", F.lit(0)).alias("n"))


def with_baseline(results: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("name", "attribute", "question"), order: str = "pos") -> DataFrame:
    """Inner join with the last baseline row of each key; rows without one are dropped."""
    values = [c for c in baseline.columns if c not in keys and c != order]
    last = baseline.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_b")).select(*keys, "_b.*")
    return results.join(last, list(keys))


def mean_score(score: Column) -> Column:
    """Mean of what is neither null nor unparsed, to two places; null if there is none."""
    return F.bround(F.avg(F.when(score != UNPARSED, score)), 2)


def statistics(results: DataFrame, scores: list[str], *, model: str) -> DataFrame:
    """type, model_type, total_samples, average_scores (a map without empty entries); a score may be a field, such as metrics.bleu."""
    sums = results.agg(F.count("*").alias("total_samples"), *[mean_score(F.col(s)).alias(f"_{k}") for k, s in enumerate(scores)])
    entries = F.create_map(*[x for k, s in enumerate(scores) for x in (F.lit(s), F.col(f"_{k}"))])
    return sums.select(F.lit("statistics").alias("type"), F.lit(model).alias("model_type"), "total_samples", F.map_filter(entries, lambda _, v: v.isNotNull()).alias("average_scores"))


def number_fields(results: DataFrame, column: str) -> list[str]:
    """Names of a struct's fields that are numbers, as ``statistics`` takes them."""
    return [f"{column}.{f.name}" for f in results.schema[column].dataType.fields if isinstance(f.dataType, NumericType)]


def best_candidate(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, best_pred, error, best_idx: the least error among the first n candidates, the first of equals; none: idx -1, error infinite."""
    near = F.col("idx") < n
    best = candidates.groupBy(*keys).agg(F.min_by(F.struct("pred", "error", "idx"), F.when(near, F.struct("error", "idx"))).alias("b"), F.count_if(near).alias("_n"))
    some = F.col("_n") > 0
    return best.select(
        *keys,
        F.when(some, F.col("b.pred")).otherwise(F.lit("")).alias("best_pred"),
        F.when(some, F.col("b.error")).otherwise(F.lit(float("inf"))).alias("error"),
        F.when(some, F.col("b.idx")).otherwise(F.lit(-1)).cast("int").alias("best_idx"),
    )


def error_at_cutoffs(candidates: DataFrame, keys: list[str], cutoffs: list[int]) -> DataFrame:
    """keys, cutoff, error: the least error among the first ``cutoff`` candidates, for several cutoffs at once."""
    order = Window.partitionBy(*keys).orderBy("idx")
    prefix = candidates.withColumn("_m", F.min("error").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    table = candidates.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff int")
    return prefix.join(F.broadcast(table), F.col("idx") + 1 == F.least(F.col("cutoff"), F.col("_n"))).select(*keys, "cutoff", F.col("_m").alias("error"))


def keep_last(runs: DataFrame, run: str, step: str, n: int) -> DataFrame:
    """The last n checkpoints of each run."""
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.col(step).desc()))).where(F.col("_r") <= n).drop("_r")


def judged(rows: DataFrame, judge: Callable[[DataFrame], DataFrame] | DataFrame, keys: list[str], needed: Column) -> DataFrame:
    """rows with ``judge_output``: from a model or a table of its outputs, asked for the needed rows only."""
    ask = rows.where(needed)
    answers = judge(ask) if callable(judge) else judge
    known = ask.join(answers.select(*keys, "judge_output"), keys, "left")
    return known.unionByName(rows.where(~F.coalesce(needed, F.lit(False))).withColumn("judge_output", F.lit(None).cast("string")))
