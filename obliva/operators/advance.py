"""Decoding whose context advances: beams are rows, and each step joins them with the model's logits for their prefix.

A step asks the model for (keys, pos, prefix), grows every open beam by its best options, sets complete ones aside and
keeps the best of each sequence.  Its rows are written before the next step, so that a lost executor repeats one step.  With
``context`` off the prefix that the model sees stays empty: the logits then depend on the position alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.functions import logits as L
from obliva.functions.attributes import complete
from obliva.operators import decode
from obliva.sources.shared import scratch

#: A function of the contexts asked, which adds its columns (logits, and what else a rule reads), or a table of (keys, pos, prefix, ...).
Model = Callable[[DataFrame], DataFrame] | DataFrame
#: Adds ``grown``, the best options (token, gain, note), best first, to rows of a step.
Rule = Callable[[DataFrame, int], DataFrame]

#: States of a beam: still growing, at the end of its attribute's positions, complete.
OPEN, ENDED, DONE = 0, 1, 2


def answered(contexts: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """contexts with the model's columns; a context that a table does not have is an error."""
    if callable(model):
        return model(contexts)
    found = contexts.join(model, [*keys, "pos", "prefix"], "left")
    missing = F.raise_error(F.concat(F.lit("no logits at position "), F.col("pos").cast("string"))).cast("array<double>")
    return found.withColumn("logits", F.coalesce("logits", missing))


def by_logits(flip: bool, width: int, entropy: bool = False, truth: str | None = None) -> Rule:
    """The tokens that the attribute's rules allow by raw (or negated) logit, lower id first on ties; gains weighted by entropy if asked for.

    With a column of true tokens the note is the true token's place among the options, by the logits as they are.
    """

    def grow(rows: DataFrame, pos: int) -> DataFrame:
        at = F.lit(pos)
        options = decode.allowed(F.col("attribute"), at, F.get("tokens", at - 1), F.col("options"))
        sign = -1.0 if flip else 1.0

        def of(o: Column) -> Column:
            # The logits are bound here: within a lambda their expression would be computed for every option.
            scored = L.let(F.col("logits"), lambda v: F.transform(o, lambda t: F.struct((F.get(v, t) * -sign).alias("s"), t.alias("t"))))
            if truth is None:
                note = F.lit(None).cast("string")
            else:
                rank = F.coalesce(L.let(F.col("logits"), lambda v: decode.rank_among(v, o, F.get(F.col(truth), at))), F.lit(-1))
                note = F.concat_ws("/", rank.cast("string"), (F.size(o) - 1).cast("string"))

            def best(x: Column) -> Column:
                weight = L.entropy_weight(F.transform(x, lambda y: -y["s"])) if entropy else F.lit(1.0)
                first = F.slice(F.array_sort(x), 1, width)
                return L.let(F.struct(weight.alias("w"), note.alias("n")), lambda w: F.transform(first, lambda y: F.struct(y["t"].alias("token"), (w["w"] * -y["s"]).alias("gain"), w["n"].alias("note"))))

            return L.let(scored, best)

        return rows.withColumn("grown", F.when(F.size("options") > 0, L.let(options, of)))

    return grow


def by_gradients(largest: bool, width: int, oracle: bool = False, npo_beta: float | None = None, truth: str = "truth") -> Rule:
    """The tokens of the position (digits where it has none) by the norm of the last layer's gradient; in oracle mode the prefix follows the truth.

    The model gives logits and hidden_norm, and reference for NPO.
    """

    def grow(rows: DataFrame, pos: int) -> DataFrame:
        digits = F.array(*[F.lit(ord(c) - decode.FIRST) for c in "0123456789"])
        kept = rows.withColumn("options", F.when(F.lit(pos) < F.col("positions"), F.when(F.size("options") > 0, F.col("options")).otherwise(digits)))
        ordered = decode.gradient_order(kept, largest, npo_beta)
        true = F.get(F.col(truth), F.lit(pos))
        place = F.array_position(F.transform("ordered", lambda o: o["token"]), true)
        note = F.concat_ws("/", F.when(place > 0, (place - 1).cast("string")).otherwise(F.lit("NA")), (F.size("ordered") - 1).cast("string"))
        taken = (lambda o: F.coalesce(true, o["token"])) if oracle else (lambda o: o["token"])
        best = F.transform(F.slice("ordered", 1, width), lambda o: F.struct(taken(o).alias("token"), (-o["key"]).alias("gain"), note.alias("note")))
        return ordered.withColumn("grown", F.when(F.lit(pos) < F.col("positions"), best))

    return grow


def advance(rows: DataFrame, sets: DataFrame, model: Model, rule: Rule, *, keys: list[str], beams: int, stop: bool = True, context: bool = True) -> DataFrame:
    """keys, attribute, the other columns of rows, beam (from 0), tokens, orders, score, text: the best beams of each sequence, best first.

    rows: keys, attribute and what the rule reads.  sets: the attribute's options by position.  stop: complete values are
    set aside and, if there are any, are the result.  A sequence ends with its attribute's positions.
    """
    spark = rows.sparkSession
    carried = [*keys, "attribute", *[c for c in rows.columns if c not in keys and c != "attribute"]]
    path = scratch(spark, "beams")
    sets.write.parquet(f"{path}/sets")  # once: every step reads it
    sets = spark.read.schema(sets.schema).parquet(f"{path}/sets")
    last = sets.agg(F.max(F.size("sets"))).first()[0] or 0
    none = F.array().cast("array<int>")
    open_ = rows.select(*carried, F.lit(0.0).alias("score"), none.alias("tokens"), F.array().cast("array<string>").alias("orders"))
    steps = []
    for pos in range(last + 1):
        # One row for each attribute.
        here = open_.join(F.broadcast(sets.select("attribute", F.get("sets", F.lit(pos)).alias("options"), F.size("sets").alias("positions"))), "attribute")
        here = here.withColumns({"pos": F.lit(pos), "prefix": F.col("tokens") if context else none})
        asked = answered(here.where("pos < positions"), model, keys)
        longer = lambda o: F.struct((F.col("score") + o["gain"]).alias("score"), F.concat("tokens", F.array(o["token"])).alias("tokens"), F.concat("orders", F.array(o["note"])).alias("orders"))
        grown = rule(asked, pos).where(F.size("grown") > 0).select(*carried, F.inline(F.transform("grown", longer)))
        state = F.when(complete(decode.decoded(F.col("tokens")), F.col("attribute")), DONE).otherwise(OPEN) if stop else F.lit(OPEN)
        ended = here.where("pos >= positions").select(*carried, "score", "tokens", "orders", F.lit(ENDED).alias("state"))
        out = grown.withColumn("state", state).unionByName(ended)
        best = Window.partitionBy(*keys, "state").orderBy(F.col("score").desc(), "tokens", "orders")
        out = out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beams).drop("_r")
        out.write.parquet(f"{path}/{pos}")
        steps.append(f"{path}/{pos}")
        open_ = spark.read.schema(out.schema).parquet(steps[-1]).where(F.col("state") == OPEN).drop("state")
        if open_.isEmpty():
            break
    found = spark.read.schema(out.schema).parquet(*steps).where(F.col("state") != OPEN)
    own = Window.partitionBy(*keys)
    found = found.withColumn("_any", F.max(F.col("state")).over(own)).where("state = _any")
    found = found.withColumn("beam", F.row_number().over(own.orderBy(F.col("score").desc(), "tokens", "orders")) - 1).where(F.col("beam") < beams)
    return found.select(*carried, "beam", "tokens", "orders", "score", decode.decoded(F.col("tokens")).alias("text"))


def average_score(score: Column, tokens: Column) -> Column:
    """A beam's score by its tokens; not a number for none."""
    return F.when(F.size(tokens) > 0, score / F.size(tokens)).otherwise(F.lit(float("nan")))
