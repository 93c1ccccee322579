"""Scans: JSON arrays, profile maps, line lists, attribute files, language-model text; explicit schemas, lazy throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA = "name string, attribute string, question string, answer string"
PROFILE = "struct<name:string,year_of_birth:int,address_postcode:string,social_insurance_number:string,blood_type:string>"
BASE = "name string, attribute string, question string, base_answer string, base_llm_eval string, base_llm_score double"
FACTS = "name string, occupation string, birth_year int, nationality string, height int"


def json_array(spark: SparkSession, path: str, schema: str = QA) -> DataFrame:
    """Rows of files that each hold one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts about known people, JSON objects in arrays or a line each; people may come more than once."""
    return spark.read.schema(FACTS).option("multiLine", True).json(path)


def profile_map(spark: SparkSession, path: str) -> DataFrame:
    """first_name and the profile's columns of a JSON map from first names to arrays of profiles."""
    whole = spark.read.option("wholetext", True).text(path)
    groups = whole.select(F.explode(F.from_json("value", f"map<string,array<{PROFILE}>>")).alias("first_name", "profiles"))
    return groups.select("first_name", F.inline("profiles"))


def lines(spark: SparkSession, path: str, *, required: bool = False) -> DataFrame:
    """value of each line that is not blank; an empty list raises if it is required."""
    out = spark.read.text(path).where(F.trim("value") != "")
    if required and out.limit(1).isEmpty():
        raise ValueError(f"{path} has no lines")
    return out


def attribute_values(spark: SparkSession, pattern: str) -> DataFrame:
    """attribute (the file's stem) and value of each line of the files that match."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return spark.read.text(pattern).select(name.alias("attribute"), F.trim("value").alias("value"))


def text_splits(spark: SparkSession, train: str, validation: str) -> dict[str, DataFrame]:
    """Language-model text, a JSON object a line."""
    return {k: spark.read.schema("text string").json(p) for k, p in (("train", train), ("validation", validation))}


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Baseline results without the statistics rows at their end."""
    return json_array(spark, path, BASE).where(F.col("name").isNotNull())


def legacy_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Detail rows and trailer rows of a result array that holds both."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.where(F.col("attribute").isNotNull()), rows.where(F.col("attribute").isNull())
