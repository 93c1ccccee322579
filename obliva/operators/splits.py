"""Forget, retain and remain sets.

Orders are by hash (``order_key``), so a split is the same on every run.  Names
to forget are a small relation: they stay a DataFrame and meet the data in semi
and anti joins, whose side Spark broadcasts if it is small enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.config import RETAIN_MODES, Split
from obliva.functions.attributes import ATTRIBUTES
from obliva.functions.draws import order_key


def _names(qa: DataFrame) -> DataFrame:
    return qa.select("first_name", "name").distinct()


def _first(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    return df.orderBy(order_key(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def forget_names(qa: DataFrame, mode: str, n: int, seed: str, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """first_name, name of those to forget."""
    names = _names(qa)
    within = Window.partitionBy("first_name").orderBy(order_key(seed, F.col("name")), "name")
    if mode == "same_firstname":
        group = _first(names.select("first_name").distinct(), 1, seed, "first_name")
        return _first(names.join(F.broadcast(group), "first_name"), n, seed, "name").select("first_name", "name")
    if mode == "different_firstname":
        groups = _first(names.select("first_name").distinct(), n, seed, "first_name")
        return names.join(groups, "first_name").withColumn("_n", F.row_number().over(within)).where("_n = 1").select("first_name", "name")
    if mode == "n_per_firstname":
        return names.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= n).select("first_name", "name")
    if mode == "random":
        return _first(names, n, seed, "name").select("first_name", "name")
    if mode == "random_combination":
        return combination(qa, n, seed, attributes).select("first_name", "name").distinct()
    raise ValueError(f"unknown forget mode: {mode}")


def combination(qa: DataFrame, n: int, seed: str, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """n rows of different (name, attribute), dealt from the attributes in turn; fewer if there are not as many."""
    row = order_key(seed, F.col("name"), F.col("attribute"), F.col("template"))
    own = qa.where(F.col("attribute").isin(*attributes)).withColumn("_key", row)
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("name", "attribute").orderBy("_key", "template"))).where("_n = 1")
    turn = first.withColumn("turn", F.row_number().over(Window.partitionBy("attribute").orderBy("_key", "name"))).where(F.col("turn") <= n)
    place = F.array_position(F.array(*map(F.lit, attributes)), F.col("attribute"))
    return turn.orderBy("turn", place).limit(n).drop("_n", "_key", "turn")


def forget_set(qa: DataFrame, names: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    return qa.where(F.col("attribute").isin(*attributes)).join(names.select("name"), "name", "left_semi").select(qa.columns)


def labelled(qa: DataFrame, names: DataFrame, attributes: Sequence[str], mode: str, most: int | None, seed: str) -> DataFrame:
    """qa with ``split``: forget, retain or remain.

    Rows are taken in hash order.  For a forgotten person's first name only the first ``most`` names that pass are
    retained; their later rows pass too, other names' rows remain.
    """
    return all_modes(qa, names, attributes, (mode,), most, seed).drop("mode")


def all_modes(qa: DataFrame, names: DataFrame, attributes: Sequence[str], modes: Sequence[str], most: int | None, seed: str) -> DataFrame:
    """The labelled sets of several retain modes, told apart by ``mode``: qa and names are read once for all of them."""
    for mode in modes:
        if mode not in RETAIN_MODES:
            raise ValueError(f"unknown retain mode: {mode}")
    gone = names.select("name").distinct().withColumn("_gone", F.lit(True))
    groups = names.select("first_name").distinct().withColumn("_group", F.lit(True))
    rows = qa.join(gone, "name", "left").join(groups, "first_name", "left")
    forgotten, group = F.coalesce("_gone", F.lit(False)), F.coalesce("_group", F.lit(False))
    chosen = F.col("attribute").isin(*attributes)
    passes = {
        "all_except_forget": F.lit(True),
        "same_firstname": group & ~forgotten,
        "same_attr": chosen & ~forgotten,
        "same_firstname_same_attr": group & ~forgotten & chosen,
    }
    told = F.array(*[F.struct(F.lit(m).alias("mode"), (passes[m] & ~(forgotten & chosen)).alias("pass")) for m in modes])
    rows = rows.select(*qa.columns, group.alias("_group"), (forgotten & chosen).alias("_forget"), F.explode(told).alias("_m")).select("*", "_m.mode", F.col("_m.pass").alias("_pass"))
    keep = F.col("_pass")
    if most is not None:
        at = order_key(seed, F.col("name"), F.col("attribute"), F.col("template"))
        # Only names of the forgotten people's first names compete; ranks run over names, not over rows.
        seen = rows.where("_pass and _group").groupBy("mode", "first_name", "name").agg(F.min(at).alias("_at"))
        admitted = seen.withColumn("_r", F.row_number().over(Window.partitionBy("mode", "first_name").orderBy("_at", "name"))).where(F.col("_r") <= most)
        rows = rows.join(admitted.select("mode", "name", F.lit(True).alias("_in")), ["mode", "name"], "left")
        keep = keep & (~F.col("_group") | F.coalesce("_in", F.lit(False)))
    split = F.when(F.col("_forget"), "forget").when(keep, "retain").otherwise("remain")
    return rows.select(*qa.columns, split.alias("split"), "mode")


def planned(qa: DataFrame, plan: Split) -> DataFrame:
    """The labelled sets that a plan asks for, by ``mode``."""
    attributes = plan.attributes or ATTRIBUTES
    names = forget_names(qa, plan.forget_mode, plan.num_profiles, plan.seed, attributes)
    return all_modes(qa, names, attributes, plan.retain_modes, plan.max_per_first_name, plan.seed)


def train_validation(df: DataFrame, key: str, percent: int, seed: str) -> DataFrame:
    """df with ``split``: validation for about ``percent`` of a hundred of the keys."""
    bucket = F.conv(F.substring(order_key(seed, F.col(key)), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(bucket < percent, "validation").otherwise("train"))
