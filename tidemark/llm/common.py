"""Shared helpers: reading tables, durable intermediates, batching text."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes: ten thousand long texts fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, and keeps Python stages
    from running twice where two branches read them.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's text modulo buckets; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets))


def is_bucket(doc_id: Column, buckets: int, bucket: int) -> Column:
    """True where the row is held out. A null id is never held out."""
    return F.coalesce(crc_bucket(doc_id, buckets) == bucket, F.lit(False))


def hash_share(key: Column, rows: int, wanted: int, seed: str) -> Column:
    """Filter that keeps about `wanted` of `rows` rows, chosen by a 63-bit hash of their key."""
    if rows <= wanted:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1) < int(wanted / rows * 2**63)


def release_memory() -> None:
    """Hand freed memory back to the system; worker processes live on and are counted with their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def text_parts(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Slices of a batch that hold about `limit` bytes of text each (one row at least).

    Bounds the Python objects alive at a time, whatever number of rows Arrow delivers.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release_memory()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist()


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and each row's first and last offset."""
    raw = raw_texts(batch, column)
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along the first axis; empty segments are 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=out.dtype)
    return out


_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, as a counter-based random source."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
