"""What the operators share: tables, scratch space, and byte views of text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once; a longer text goes alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; all others go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is set here only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder that Spark names, and the folder's path there, for use in Python."""
    scheme, _, rest = folder.partition(":")
    known = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}
    if scheme == "file":  # file:/x and file:///x
        folder = "file:///" + rest.lstrip("/")
    elif scheme in known:
        folder = f"{known[scheme]}:{rest}"
    return FileSystem.from_uri(folder)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: it cuts lineage and outlives executors.

    Shuffle files of the plan go once the rows are written; a task that still misses one makes it again.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Removes rows that materialise() stored and nothing reads any more."""
    fs, path = filesystem(stored.stored_at)
    fs.delete_dir(path)


def n_tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit repartition."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most so many bytes of text (or one row), the bytes, and each row's first offset plus the end."""
    whole = batch.column(column)
    if whole.null_count:
        raise ValueError(f"{column} must not be null here")
    width = np.int64 if pa.types.is_large_string(whole.type) or pa.types.is_large_binary(whole.type) else np.int32
    n = len(whole)
    if not n:
        return
    _, off, data = whole.buffers()
    offsets = np.frombuffer(off, width)[whole.offset : whole.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def trim() -> None:
    """Returns to the machine what a worker has freed; Arrow's pool and the allocator keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all pieces, one after another."""
    total = int(lengths.sum())
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if len(lengths) else np.empty(0, np.int64)
    return first + np.arange(total)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] for each i, zero where that is empty."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id as text: the folds of the contracts hang on it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
