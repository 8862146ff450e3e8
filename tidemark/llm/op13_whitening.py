"""Embedding whitening: MLlib's SVD of centred distributed rows.

Entries c become integers x = floor(1024 c) + 100000. Their sums S are taken exactly over all
rows; a centred row is (n x - S) / n, from exact integers, so nothing is lost to the common offset.
`RowMatrix.computeSVD` of the centred rows gives singular values s and components; the
covariance has divisor n, so its eigenvalues are s * s / n. The total variance is summed apart, from
the exact squared deviations of the rows, and not from the singular values found.

What reaches the driver is one row for each dimension and the matrix of components. Up to FULL
dimensions the SVD is solved there from the distributed product of rows, for all components and
in double precision; beyond, by distributed multiplication.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do
those with an entry whose x is no long, nor those of another length than the most frequent (the
longer one, if two are). Components whose standard deviation is under LEAST of the largest are
rounding noise and left out, so equal rows, or a single one, give no rows. Null and repeated ids are
ordinary rows. A deviation that doesn't fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table

FULL = 2048
LEAST = 1e-7
#: Entries below this give a long x.
_LIMIT = 9.0071e15


@dataclass
class Whitening:
    """What `fit` learns: exact counts and sums, and a column of `basis` for each component."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    basis: np.ndarray  # (dimensions, components), divided by the standard deviations


def integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(1024.0 * values).astype(np.int64).reshape(-1, dims) + 100_000


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[list[int], np.ndarray]:
    """Exact squared length of each row's n x - S, and the centred rows in double precision."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    narrow = most * most * x.shape[1] < 2**63  # else as Python's integers
    d = x * n - np.array(sums) if narrow else x.astype(object) * n - np.array(sums, object)
    return [int(s) for s in (d * d).sum(1)], (d / n).astype(float)


def entries(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.forall("v", lambda c: F.coalesce(F.abs(c) < _LIMIT, F.lit(False))) & (F.size("v") > 0))
    first = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = first["dims"] if first else 0
    return rows.filter(F.size("v") == dims), dims


def totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sums of x in each dimension; one row a dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(batch, dims)
                columns = [np.arange(dims), np.full(dims, len(x)), (x >> 31).sum(0), (x & 2**31 - 1).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "n", "high", "low"])

    each = rows.mapInArrow(run, "dim long, n long, high long, low long").groupBy("dim")
    wide = "decimal(38,0)"
    found = each.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), [(int(r["high"]) << 31) + int(r["low"]) for r in found]


def fit(rows: DataFrame, dims: int, components: int = 8) -> Whitening | None:
    """Components of all `rows`, by falling eigenvalue; None if nothing varies."""
    n, sums = totals(rows, dims) if dims else (0, [])
    if not n:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                centred = deviations(integers(batch, dims), n, sums)[1]
                ends = pa.array(np.arange(0, centred.size + 1, dims), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(centred.ravel()))], ["centred"])

    centred = rows.mapInArrow(run, "centred array<double>").select(array_to_vector("centred").alias("centred"))
    centred = MLUtils.convertVectorColumnsFromML(centred, "centred")
    if dims > FULL:  # read again for each multiplication
        centred = centred.persist(StorageLevel.MEMORY_AND_DISK)
    svd = RowMatrix(centred, n, dims).computeSVD(dims if dims <= FULL else min(components, dims), rCond=LEAST)
    s, v = svd.s.toArray(), svd.V.toArray()
    centred.unpersist()
    kept = np.flatnonzero((s > 0) & (s >= LEAST * s.max(initial=0)))[:components]
    if not len(kept):
        return None
    return Whitening(n, sums, s[kept] ** 2 / n, v[:, kept] / np.sqrt(s[kept] ** 2 / n))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, spread, w): squared deviation from the mean times n squared and by itself, whitened vector."""
    shared, dims = rows.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                exact, centred = deviations(integers(batch, dims), m.n, m.sums)
                w = centred @ m.basis
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                columns = [pa.array([d if d < 2**63 else None for d in exact], pa.int64()), pa.array([d / m.n**2 for d in exact], pa.float64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "deviation", "spread", "w"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, deviation long, spread double, w array<double>")


def covariance(whitened: DataFrame, n: int, k: int) -> np.ndarray:
    """Covariance of the column w, divisor n, centred before multiplying."""

    def summed(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part = f(batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.size), pa.int64()), pa.array(part.ravel())], ["cell", "part"])

        cells = whitened.select("w").mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("total"))
        return np.array([r["total"] for r in cells.orderBy("cell").collect()]) / n

    mean = summed(lambda w: w.sum(0))
    return summed(lambda w: (w - mean).T @ (w - mean)).reshape(k, k)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows, dims = entries(vectors, id_col, vector_col)
    model = fit(rows, dims, components)
    if model is None:
        kind = dict(vectors.dtypes)[id_col]
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = len(model.eigenvalues)
    whitened = materialize(transform(rows, model), "whitened")
    variance = whitened.agg(F.sum("spread").alias("total")).first()["total"] / model.n
    error = float(np.abs(covariance(whitened, model.n, k) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(e / variance)) for e in model.eigenvalues))
    each = whitened.select(F.col("id").alias(id_col), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
