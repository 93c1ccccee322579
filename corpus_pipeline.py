"""Corpus pipeline: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept.  All but the last return the columns of ``documents``; the last returns
doc_id, n_tokens, ids and decoded.  The first stage drops columns beyond those
of ``documents``, and rows without a doc_id, which no later decision could be
joined to; null texts count as empty throughout; of rows that share a doc_id,
which count as one document, the second stage keeps one; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obliva.llm import bpe, jaccard, mixing, quality, secrets
from obliva.llm.common import scratch, table
from obliva.llm.registry import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows that are not held out."""
    weights = quality.train(quality.sample(table(spark, sf_dir, "labels"), docs, "quality"))
    return quality.score(docs.where("doc_id is not null"), weights, keep=COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the shingle join, the one of the least id; of the rows of an id, the one of least hash."""
    width, percent = 5, 80
    kept = jaccard.join(docs, width=width, percent=percent).where("doc_id = component_id").select("doc_id")
    rows = docs.select(*COLUMNS).join(kept.distinct(), "doc_id", "left_semi")
    one = F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS))
    return rows.groupBy("doc_id").agg(one.alias("row")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced by a mark; n_chars follows the text."""
    marked = secrets.scan(docs, keep=COLUMNS)
    text, found = secrets.redact(F.col("text"), F.col("spans")), F.size("spans") > 0
    marked = marked.withColumn("text", text).withColumn("n_chars", F.when(found, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return marked.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, one or two rows."""
    # Rows alike in these share what is taken of them evenly; a struct of them equals another one, nulls and all.
    same = F.struct("doc_id", "source", "size").alias("same")
    taken = mixing.mix(docs).groupBy(same).agg(F.sum("copies").alias("taken"), F.count("*").alias("rows")).where("taken > 0")
    sized = docs.select(*COLUMNS, mixing.text_size(F.col("text")).alias("size"))
    # In the very type of the other side, whose fields may be null: the join would cast a copy of its own, and the window deal again.
    met = sized.select(*COLUMNS, same.cast(taken.schema["same"].dataType).alias("same")).join(taken, "same")
    # The join has dealt the rows by the same struct: no shuffle of its own for the window.
    place = F.row_number().over(Window.partitionBy("same").orderBy(F.xxhash64("text", "lang", "n_chars")))
    copies = F.floor(F.col("taken") / F.col("rows")) + F.when(place <= F.col("taken") % F.col("rows"), 1).otherwise(0)
    met = met.withColumn("copies", copies.cast("int")).where("copies > 0")
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the text that they decode to."""
    return bpe.bpe_round_trip(docs, vocabulary_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: No SQL expresses these stages; tests hold each against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; the files go when the application ends."""
    base = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
