"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where none is named, a local master gets a temporary one: all runs in one place there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="obliva-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder there, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = files(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, so that their Python finds it wherever the driver took it from."""
    sc = spark.sparkContext
    if getattr(sc, "_obliva_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="obliva-")) / "obliva-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._obliva_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, however often it is used."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
