"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel handles at once.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
#: Spark's bound on the bytes of a batch for Python, and its default.
BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once, so that their Python finds it wherever the driver took it from.

    Batches for Python are also bounded by bytes here, where the session leaves Spark's default: they hold whole texts.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, "4m")
    if getattr(sc, "_obliva_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="obliva-")) / "obliva-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._obliva_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, a local master gets a temporary one: all runs in one place there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="obliva-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _files(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read again: nothing before it is ever computed twice or needed after a loss."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._obliva_path = path
    # Shuffle files go once the JVM notices that nothing refers to them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of cuts that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_obliva_path", None)
        if path:
            fs, where = _files(df.sparkSession, path)
            fs.delete(where, True)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end and the n+1 offsets of the strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each (a longer row is alone)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, _INV)]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span (in order, apart); equal spans anywhere have equal hashes.  Long texts go piece by piece."""
    if len(data) > 2 * CHUNK_BYTES:
        out, i = np.zeros(len(starts), U64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
            a, b = starts[i], ends[j - 1]
            out[i:j] = _hashes(data[a:b], starts[i:j] - a, ends[i:j] - a, lower)
            i = j
        return out
    return _hashes(data, starts, ends, lower)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    values = (_BYTE[_LOWER] if lower else _BYTE)[data]
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than ASCII white space, and the row each is in."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = ~_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = full & (edge[:-1] | np.concatenate([[True], ~full[:-1]]))
    ends = full & (edge[1:] | np.concatenate([~full[1:], [True]]))
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1
