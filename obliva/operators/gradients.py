"""Gradients as rows of (step, parameter, values): clipping by the norm over all parameters of a step, and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.functions import logits as L


def step_norms(gradients: DataFrame, step: str = "step", values: str = "values") -> DataFrame:
    """step, norm: the norm of all values of a step.  Squares add up within a row, then within a task, then by step."""
    squares = gradients.select(step, L.square_sum(F.col(values)).alias("_s"))
    return squares.groupBy(step).agg(F.sqrt(F.sum("_s")).alias("norm"))


def clip_by_global_norm(gradients: DataFrame, most: float, step: str = "step", values: str = "values") -> DataFrame:
    """gradients with ``clipped``: every parameter of a step scaled by the same factor, so that the step's norm is ``most`` at most.

    A step's parameters may be any number of rows (long vectors in pieces): no step is gathered, its norm comes to the rows.
    """
    factor = F.least(F.lit(1.0), F.lit(most) / (F.col("norm") + 1e-6))
    met = gradients.join(step_norms(gradients, step, values), step, "left")
    return met.withColumn("clipped", L.let(factor, lambda f: F.transform(values, lambda x: x * f))).drop("norm")


def noisy_step(gradients: DataFrame, most: float, deviation: float, seed: str, step: str = "step", parameter: str = "parameter", values: str = "values") -> DataFrame:
    """``clip_by_global_norm`` with ``noisy``: Gaussian noise of ``deviation`` times the clipping norm on each value, drawn by seed, step, parameter and place."""
    out = clip_by_global_norm(gradients, most, step, values)
    if deviation <= 0:
        return out.withColumn("noisy", F.col("clipped"))
    scale = deviation * most
    return out.withColumn("noisy", F.transform("clipped", lambda x, i: x + scale * L.normal(seed, F.col(step), F.col(parameter), i)))
