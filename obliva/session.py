"""Session for scripts and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", *, partitions: int | None = None, app: str = "obliva") -> SparkSession:
    """A session with adaptive execution and UTC; partitions: of shuffles, the cluster's default if not given."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
