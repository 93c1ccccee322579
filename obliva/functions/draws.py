"""Reproducible draws: orders and choices by md5 instead of a random generator, equal on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: str, *keys: Column) -> Column:
    """A hex string to order rows by at random; a function of the seed and the keys alone."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def draw(seed: str, n: Column | int, *keys: Column) -> Column:
    """An integer in [0, n)."""
    number = F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return number % (F.lit(n) if isinstance(n, int) else n)
