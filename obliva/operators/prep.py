"""Training text: tokens, label masks, packed blocks, paired samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva import config
from obliva.functions.draws import draw
from obliva.functions.logits import IGNORED
from obliva.operators.order import positions
from obliva.sources.shared import stored

PAD = 0


def word_ids(text: Column) -> Column:
    """Stand-in tokeniser: words between spaces, each with a stable id of 24 bits (from its md5), never 0."""
    found = F.filter(F.split(text, " "), lambda w: w != "")
    return F.transform(found, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("int") + 1))


def padded(ids: Column, length: int, pad: int = PAD) -> Column:
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def attention(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def masked_labels(input_ids: Column, mask: Column, n_question: Column) -> Column:
    """Labels: the ids, but IGNORED in the question and in the padding."""
    return F.transform(input_ids, lambda x, i: F.when((i < n_question) | (F.get(mask, i) == 0), F.lit(IGNORED)).otherwise(x))


def tokenised(df: DataFrame, question: Column, text: Column, length: int = 200) -> DataFrame:
    """df with input_ids, attention_mask and labels."""
    out = df.withColumn("_ids", word_ids(text)).withColumn("input_ids", padded(F.col("_ids"), length)).withColumn("attention_mask", attention(F.col("_ids"), length))
    return out.withColumn("labels", masked_labels(F.col("input_ids"), F.col("attention_mask"), F.size(word_ids(question)))).drop("_ids")


def packed(df: DataFrame, batch: str, order: list[str], ids: str, size: int) -> DataFrame:
    """batch, block, input_ids, labels: each batch's tokens end to end, cut into blocks; the tail of a batch goes."""
    window = Window.partitionBy(batch).orderBy(*order)
    rows = df.select(batch, *[c for c in order if c != batch], F.col(ids).alias("ids"))
    rows = rows.withColumn("_at", F.sum(F.size("ids").cast("bigint")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("ids"))
    tokens = rows.select(batch, "_at", F.posexplode("ids").alias("_i", "token")).withColumn("_p", F.col("_at") + F.col("_i"))
    blocks = tokens.groupBy(batch, F.floor(F.col("_p") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_p", "token"))).alias("t"))
    full = blocks.where(F.size("t") == size).select(batch, "block", F.transform("t", lambda x: x["token"]).alias("input_ids"))
    return full.withColumn("labels", F.col("input_ids"))


def visible(ids: Column, mask: Column) -> Column:
    """The ids that the mask shows."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["i"])


def same_sizes(first: Column, *others: Column) -> Column:
    """True where all lists are as long as the first; raises elsewhere."""
    unequal = F.lit(False)
    for other in others:
        unequal = unequal | ~F.size(first).eqNullSafe(F.size(other))
    return F.when(unequal, F.raise_error(F.lit("lists of different lengths")).cast("boolean")).otherwise(F.lit(True))


def samples(tokens: DataFrame, *keep: str) -> DataFrame:
    """keep and ``sample``, the three token arrays of a row of ``tokenised``."""
    return tokens.select(*keep, F.struct("input_ids", "attention_mask", "labels").alias("sample"))


def triples(forget: DataFrame, retain: DataFrame | None, refusals: DataFrame | None, keys: list[str], seed: str, payload: str = "text") -> DataFrame:
    """Forget rows with a drawn retain row and the refusal of their position; the payload column comes as forget_, retain_, idk_.

    There are as many triples as the smallest of the sets given has rows.  Counts are one number each; refusals come with
    their positions (pos).  Forget and retain rows are counted and numbered from one writing of each.
    """
    forget = stored(forget.select(*keys, payload), "forget")
    retain = retain if retain is None else stored(retain.select(*keys, payload), "retain")
    sizes = [x.agg(F.count("*").alias(n)) for n, x in (("_f", forget), ("_r", retain), ("_i", refusals)) if x is not None]
    counts = sizes[0]
    for one in sizes[1:]:
        counts = counts.crossJoin(one)
    limit = F.least(*counts.columns) if len(sizes) > 1 else F.col("_f")
    out = positions(forget, seed, *keys).select(*keys, "pos", F.col(payload).alias(f"forget_{payload}"))
    out = out.crossJoin(F.broadcast(counts)).where(F.col("pos") < limit)
    if retain is not None:
        partners = positions(retain, seed + "-retain", *keys).select(F.col("pos").alias("_p"), F.col(payload).alias(f"retain_{payload}"))
        out = out.withColumn("_p", draw(seed + "-pair", F.col("_r"), F.col("pos"))).join(partners, "_p").drop("_p")
    if refusals is not None:
        lines = refusals.select(F.col("pos").alias("_p"), F.col(payload).alias(f"idk_{payload}"))
        out = out.withColumn("_p", F.col("pos") % F.col("_i")).join(lines, "_p").drop("_p")
    return out.drop(*counts.columns)


def method_triples(settings: config.Unlearn, forget: DataFrame, retain: Callable[[], DataFrame], refusals: Callable[[], DataFrame], keys: list[str], seed: str, payload: str = "text") -> DataFrame:
    """``triples`` of the sets that the method needs; a set that it does not need is never made."""
    return triples(forget, retain() if settings.needs_retain else None, refusals() if settings.needs_refusals else None, keys, seed, payload)


def with_refusals(qa: DataFrame, refusals: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """qa with each answer replaced by a drawn refusal."""
    lines = refusals.select(F.col("pos").alias("_p"), F.col("value").alias("_line"))
    n = lines.agg(F.count("*").alias("_n"))
    drawn = qa.crossJoin(F.broadcast(n)).withColumn("_p", draw(seed, F.col("_n"), *[F.col(k) for k in keys]))
    return drawn.join(lines, "_p").withColumn("answer", F.col("_line")).drop("_p", "_n", "_line")


def stacked(df: DataFrame, batch: Column, order: str, columns: list[str]) -> DataFrame:
    """batch and, for each column, the array of its values in order."""
    rows = df.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_r"))
    return rows.select("batch", *[F.col("_r").getField(c).alias(c) for c in columns])


def chat_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: every user turn that an assistant turn follows."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(after).alias("_r"), F.lead("text").over(after).alias("answer"))
    return nxt.where("role = 'user' and _r = 'assistant'").select("conv_id", "turn", "question", "answer")
