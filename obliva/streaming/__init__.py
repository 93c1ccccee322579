"""Continuous scoring: the same expressions over a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obliva.operators.scoring import error_detail

PREDICTIONS = "k long, name string, attribute string, true_answer string, model_output string"


def scored_stream(spark: SparkSession, folder: str, schema: str = PREDICTIONS) -> DataFrame:
    """Predictions that arrive as Parquet files in a folder, each with its error: stateless, so no watermark is needed."""
    return error_detail(spark.readStream.schema(schema).parquet(folder))
