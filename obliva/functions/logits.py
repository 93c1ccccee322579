"""Arithmetic over logits held as arrays of double."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from obliva.functions.draws import draw

IGNORED = -100


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, not at every mention (lambdas share nothing)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum(v: Column) -> Column:
    return let(F.array_max(v), lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def log_softmax(v: Column) -> Column:
    return let(log_sum(v), lambda z: F.transform(v, lambda x: x - z))


def softmax(v: Column) -> Column:
    return F.transform(log_softmax(v), lambda x: F.exp(x))


def softmax_c(v: Column) -> Column:
    """``softmax``, to the last bit as engines that call the C library have it.

    The JVM's exp may differ from it in the last bit.  Where scores that are equal in theory are ordered, that bit decides.
    """

    def one(x):
        if not x:
            return x
        if None in x:
            return [None] * len(x)
        top = max(x)
        if math.isinf(top) or any(map(math.isnan, x)):
            return [math.nan] * len(x)
        added = 0.0
        for y in x:  # from left to right, without the compensation of sum()
            added += math.exp(y - top)
        level = top + math.log(added)
        return [math.exp(y - level) for y in x]

    def shares(lists):
        return pa.array([one(x) for x in lists.to_pylist()], pa.list_(pa.float64()))

    # As if it were not deterministic: else a filter on what follows from it is moved into a join's condition, where no Python runs.
    return F.arrow_udf(shares, "array<double>").asNondeterministic()(v)


def nll(v: Column, target: Column) -> Column:
    """Negative log-likelihood of a target (index from 0); 0 for an ignored one."""
    return F.when(target == IGNORED, F.lit(0.0)).otherwise(log_sum(v) - F.get(v, target))


def kl(reference: Column, current: Column) -> Column:
    """KL divergence of one position, reference against current."""
    return total(F.zip_with(log_softmax(reference), log_softmax(current), lambda q, p: F.exp(q) * (q - p)))


def log_sigmoid(z: Column) -> Column:
    return F.least(z, F.lit(0.0)) - F.ln(1 + F.exp(-F.abs(z)))


def preference_loss(win_ratio: Column, lose_ratio: Column, beta: float) -> Column:
    """One pair's share of the DPO loss; its NPO form has a win ratio of 0."""
    return -2.0 / beta * log_sigmoid(beta * (win_ratio - lose_ratio))


def objective(method: Column, forget: Column, retain: Column, idk: Column, preference: Column, weight: float) -> Column:
    """Training objective of a method from its losses."""
    return (
        F.when(method == "grad_ascent", -forget)
        .when(method.isin("grad_diff", "KL", "noisy_grad_diff"), -forget + weight * retain)
        .when(method == "po", idk + weight * retain)
        .when(method.isin("dpo", "npo"), preference + weight * retain)
        .otherwise(F.raise_error(F.concat(F.lit("unknown method: "), method)).cast("double"))
    )


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def entropy_weight(v: Column) -> Column:
    """1 less normalised entropy, kept in [0.1, 1]; 1 for a single candidate."""
    entropy = -total(F.transform(log_softmax(v), lambda x: F.exp(x) * x))
    most = F.ln(F.size(v).cast("double"))
    return F.when(F.size(v) <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - entropy / most)))


def gradient_norm(p_token: Column, square_sum: Column, hidden_norm: Column) -> Column:
    """Norm of the last layer's gradient of a token's loss."""
    p = F.greatest(p_token, F.lit(1e-20))
    return (hidden_norm + 1e-12) * F.sqrt(1 - 2 * p + square_sum + 1e-12)


def npo_scale(p_token: Column, q_token: Column, beta: float) -> Column:
    p, q = F.greatest(p_token, F.lit(1e-20)), F.greatest(q_token, F.lit(1e-20))
    return 2 * F.pow(p, F.lit(beta)) / (F.pow(p, F.lit(beta)) + F.pow(q, F.lit(beta)))


def masked(v: Column, selected: Column, flip: bool) -> Column:
    """Selected logits (negated if flipped), minus infinity elsewhere."""
    sign = -1.0 if flip else 1.0
    return F.transform(v, lambda x, i: F.when(F.array_contains(selected, i), sign * x).otherwise(F.lit(-math.inf)))


def l2_norm(v: Column) -> Column:
    return F.sqrt(square_sum(v))


def clipped(v: Column, most: float) -> Column:
    """The vector scaled down to a norm of ``most``."""
    return let(F.least(F.lit(1.0), most / (l2_norm(v) + 1e-6)), lambda scale: F.transform(v, lambda x: x * scale))


def accumulated(loss: Column, steps: int) -> Column:
    """A step's share of the loss when gradients of several steps add up."""
    return loss / steps if steps > 1 else loss


def evaluation_loss(forget: Column) -> Column:
    """What evaluation minimises while the forget loss is to rise."""
    return -forget


def normal(seed: str, *keys: Column) -> Column:
    """A standard normal number drawn by hash of the keys (Box and Muller)."""

    def unit(name: str) -> Column:
        return (draw(f"{seed}-{name}", 1 << 32, *keys) + 0.5) / float(1 << 32)

    return F.sqrt(-2 * F.ln(unit("a"))) * F.cos(2 * math.pi * unit("b"))


def noisy(v: Column, most: float, deviation: float, seed: str, key: Column) -> Column:
    """The clipped vector with Gaussian noise of ``deviation`` times the clipping norm on each component."""
    return F.transform(clipped(v, most), lambda x, i: x + deviation * most * normal(seed, key, i))


def square_sum(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))
