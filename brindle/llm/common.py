"""What the operators of this subpackage share: written tables, size-checked joins, byte views."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # no glibc here
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  ``spark.checkpoint.dir`` where the cluster names one; a temporary
    folder only where it is unset (local tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, and a lost executor
    costs nothing that was written."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, most_bytes: int = 32 << 20) -> bool:
    """True if ``df`` (a written table) is small enough to broadcast.  Counting a written table reads
    only its footers."""
    return df.count() * row_bytes <= most_bytes


def hinted(df: DataFrame, row_bytes: int, most_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its size allows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, row_bytes, most_bytes) else df


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, under names that can't clash, with null texts as empty ones."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the offsets of its rows: views, not copies."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, wide = len(column), pa.types.is_large_string(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if n else data[:0], off - off[0] if n else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int):
    """Runs of whole rows of at most ``most`` units each; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def parts(batch: pa.RecordBatch, text: int, most: int = 2 << 20):
    """Slices of a batch of at most ``most`` bytes of text in column ``text`` each (a longer text is a
    slice of its own), so that what is worked out at once doesn't grow with Arrow's batches."""
    size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, j in slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), most):
        yield batch.slice(i, j - i)


def release() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(run):
    """``run`` (of mapInArrow), giving memory back when a partition is done: Python workers are used again."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place where it can be)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
