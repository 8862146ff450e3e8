"""Approximate nearest neighbours by additive quantisation.

A vector is divided by its norm (by one number for the l2 metric), less the mean, and coded as
the sum of `books` full-dimensional codewords, one of each codebook, found by beam search over
residuals. Codes are stored with their error. A query is scored against codes with a lookup
table of its inner products with all codewords; the best `shortlist` of each query and group are
reranked exactly on the original vectors, and so are all others whose score is within their
error, times a factor, of the last of the best. The factor is measured when the index is fitted:
the least one that keeps `sure` of the true neighbours of sampled queries. So a group that codes
tell apart badly is reranked further, whole in the worst case.

Codes lie in coarse cells: `least_cells`, or more (up to `most_cells`) where they would hold
over FRAGMENT_BYTES / 2 of vectors each; for the inner product, few vectors of much larger norms
are a cell that every query probes. A query probes only its nearest other cells. How many is
measured too: the least number whose cells hold `coverage` of the true neighbours of sampled
queries, all cells where that takes all. A cell of over FRAGMENT_BYTES of vectors, or one probed
by over `query_block` queries, is dealt into groups, so every group is bounded.

Cells and codebooks are fitted on a bounded sample (`sample` vectors, by hash of the vector):
k-means, residual k-means, then rounds of beam-search encoding and refitting one codebook
after another. Every vector is coded and searched. Equal vectors are coded and asked once,
with their smallest ids: a vector's copies beyond the k + 1 smallest ids can be in no query's
top k, so this changes no result and keeps a vector that fills the table out of the way.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do null ids; rows with the same id are distinct
queries and candidates, a query's own row (or one row equal to it) is left out once; all
candidates come out if fewer than k; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_share, materialize, table


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, less the rows' own norms."""
    return np.einsum("kd,kd->k", centre, centre) - 2 * x @ centre.T


def nearest(x: np.ndarray, centre: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([distances(x[a : a + step], centre).argmin(axis=1) for a in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def means(x: np.ndarray, group: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Mean of the rows of each group; the old centre for an empty one."""
    order, n = np.argsort(group, kind="stable"), np.bincount(group, minlength=len(centre))
    full, out = n > 0, centre.copy()
    out[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        centre = means(x, nearest(x, centre), centre)
    return centre


def beam_encode(x: np.ndarray, words: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, books): each book's words are tried on the residuals of the `beam` best sums so far."""
    n, (books, k, _) = len(x), words.shape
    codes, residual, error = np.zeros((n, 1, 0), np.int16), x[:, None, :], np.zeros((n, 1), np.float32)
    rows = np.arange(n)[:, None]
    for j in range(books):
        total = (error[:, :, None] + distances(residual.reshape(-1, x.shape[1]), words[j]).reshape(n, -1, k)).reshape(n, -1)
        width = min(beam if j + 1 < books else 1, total.shape[1])
        best = np.argpartition(total, width - 1, axis=1)[:, :width]
        codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None].astype(np.int16)], axis=2)
        residual = residual[rows, best // k] - words[j][best % k]
        error = total[rows, best]
    return codes[:, 0]


def decoded(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), words.shape[2]), np.float32)
    for j in range(len(words)):
        out += words[j][codes[:, j]]
    return out


def train_books(x: np.ndarray, books: int, size: int, rounds: int, beam: int, rng: np.random.Generator) -> np.ndarray:
    """(books, size, dim): residual k-means, then encoding and refitting of one book after another."""
    size, words, residual = max(1, min(size, len(x))), [], x.copy()
    for _ in range(books):
        centre = kmeans(residual, size, rng)
        words.append(centre)
        residual -= centre[nearest(residual, centre)]
    out = np.stack(words)
    for _ in range(rounds):
        codes = np.concatenate([beam_encode(x[a : a + 1024], out, beam) for a in range(0, len(x), 1024)])
        residual = x - decoded(codes, out)
        for j in range(books):
            wanted = residual + out[j][codes[:, j]]
            out[j] = means(wanted, codes[:, j].astype(np.int64), out[j])
            residual = wanted - out[j][codes[:, j]]
    return out


def cell_order(q: np.ndarray, cells: np.ndarray, metric: str) -> np.ndarray:
    """Cells of each query, most promising first."""
    return np.argsort(-(q @ cells.T) if metric == "ip" else distances(q, cells), axis=1, kind="stable")


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows of doubles of any magnitude."""
    most = np.abs(x).max(axis=1, initial=0.0)
    return most * np.sqrt(np.einsum("nd,nd->n", *[x / np.where(most > 0, most, 1.0)[:, None]] * 2))


FRAGMENT_BYTES = 16 << 20


TALL = 8192  # about as many vectors of the largest norms, one in fifty at most, can be in the cell of all queries


@dataclass
class Index:
    metric: str
    unit: float  # vectors are divided by this for l2, by their norms for the inner product
    mean: np.ndarray  # (dim,), of the divided vectors
    tall: float  # least norm of the vectors that every query meets
    cells: np.ndarray  # (cells, dim)
    words: np.ndarray  # (books, size, dim)
    probes: int = 1
    factor: float = 0.0

    def scales(self, x: np.ndarray) -> np.ndarray:
        return norms(x) if self.metric == "ip" else np.full(len(x), self.unit)

    def reduced(self, x: np.ndarray, scales: np.ndarray) -> np.ndarray:
        return (x / scales[:, None] - self.mean).astype(np.float32)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries as they meet codes and cells."""
        return (q / norms(q)[:, None]).astype(np.float32) if self.metric == "ip" else self.reduced(q, self.scales(q))

    def cell_of(self, reduced: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """The nearest cell; one more, the last, for tall vectors."""
        return np.where(scales > self.tall if self.metric == "ip" else False, len(self.cells), nearest(reduced, self.cells))

    def estimates(self, inner: np.ndarray, q: np.ndarray, norm: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """Scores of queries (rows) by their inner products with codes, up to what `comparable` takes off."""
        return (inner.astype(np.float64) + (q / norms(q)[:, None] @ self.mean)[:, None]) * scales if self.metric == "ip" else 2 * inner.astype(np.float64) - norm

    def slack(self, q: np.ndarray, error: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """What an estimate can be off by at most, by Cauchy and Schwarz."""
        return np.broadcast_to(error * scales, (len(q), len(error))) if self.metric == "ip" else 2 * norms(self.asked(q).astype(np.float64))[:, None] * error

    def comparable(self, exact: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores as estimates have them."""
        if self.metric == "ip":
            return exact / norms(q)[:, None]
        own = self.asked(q).astype(np.float64)
        return exact / self.unit**2 + np.einsum("nd,nd->n", own, own)[:, None]


def exact_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows q and x in double precision, by matrix products."""
    inner = q @ x.T
    return inner if metric == "ip" else 2 * inner - np.einsum("nd,nd->n", x, x) - np.einsum("nd,nd->n", q, q)[:, None]


def measure(index: Index, x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, coverage: float, sure: float, beam: int) -> None:
    """Sets probes and factor by the k nearest in x of queries q; own tells each one's own row of x (-1: none)."""
    far = -exact_scores(q, x, index.metric)
    far[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
    best = np.argsort(far, axis=1)[:, : min(k, len(x) - 1)]
    if not best.size:
        return
    ids, at = np.unique(best, return_inverse=True)
    at = at.reshape(best.shape)
    scales = index.scales(x[ids])
    reduced = index.reduced(x[ids], scales)
    near = np.concatenate([decoded(beam_encode(reduced[a : a + 1024], index.words, beam), index.words) for a in range(0, len(ids), 1024)])
    error, norm = np.sqrt(((reduced - near).astype(np.float64) ** 2).sum(axis=1)), (reduced.astype(np.float64) ** 2).sum(axis=1)
    pick = lambda values: np.take_along_axis(np.broadcast_to(values, (len(q), len(ids))), at, 1)
    off = pick(index.comparable(exact_scores(q, x[ids], index.metric), q) - index.estimates(index.asked(q) @ near.T, q, norm, scales))
    index.factor = float(np.quantile(np.maximum(off, 0) / np.maximum(pick(index.slack(q, error, scales)), 1e-300), sure).clip(0, 1))
    place = np.argsort(cell_order(index.asked(q), index.cells, index.metric), axis=1)  # of each cell in a query's order
    place = np.concatenate([place, np.full((len(q), 1), -1)], axis=1)
    at = np.sort(np.take_along_axis(place, index.cell_of(reduced, scales)[at], 1).ravel())
    index.probes = max(0, int(at[min(len(at) - 1, int(np.ceil(coverage * len(at))))])) + 1


def train(x: np.ndarray, q: np.ndarray, own: np.ndarray, n: int, n_cells: int, books: int, size: int, k: int, metric: str, coverage: float, sure: float, rounds: int = 2, beam: int = 4, seed: int = 1) -> Index:
    rng = np.random.default_rng(seed)
    length = norms(x)
    tall = max(1.5 * float(np.median(length)), float(np.quantile(length, 1 - min(0.02, TALL / n))))
    index = Index(metric, float(length.max()) or 1.0, np.zeros(x.shape[1]), tall, np.zeros((0, 0)), np.zeros((0, 0, 0)))
    index.mean = (x / index.scales(x)[:, None]).mean(axis=0)
    reduced = index.reduced(x, index.scales(x))
    index.cells = kmeans(reduced, max(1, min(n_cells, len(x) // 8)), rng)
    index.words = train_books(reduced[:16384], books, size, rounds, beam, rng)
    measure(index, x, q, own, k, coverage, sure, beam)
    return index


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, rep) of the rows that take part; rep is a 128-bit digest of the vector."""
    v = F.transform(F.col(vector_col), lambda c: c + F.lit(0).cast(vectors.schema[vector_col].dataType.elementType))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    big = F.lit(float("inf"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (c < big) & (c > -big)) & F.exists("v", lambda c: c != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "v")), 16, "0")
    return rows.filter(F.size("v") == (usual["dim"] if usual else 0)).withColumn("rep", F.concat(half(1), half(2)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def coded_vectors(distinct: DataFrame, shared, beam: int) -> DataFrame:
    """distinct with codes, their error, norm (squared, of the reduced vector), scale and cell."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = matrix(part.column("v"))
                scales = index.scales(x)
                reduced = index.reduced(x, scales)
                codes = beam_encode(reduced, index.words, beam)
                error = np.sqrt(((reduced - decoded(codes, index.words)).astype(np.float64) ** 2).sum(axis=1))
                norm = (reduced.astype(np.float64) ** 2).sum(axis=1)
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                cell = index.cell_of(reduced, scales).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, raw, pa.array(error), pa.array(norm), pa.array(scales), pa.array(cell)], [*part.schema.names, "codes", "error", "norm", "scale", "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in distinct.dtypes)
    return distinct.mapInArrow(encode, f"{schema}, codes binary, error double, norm double, scale double, cell int")


def scanner(shared, k: int, shortlist: int, metric: str):
    """The k + 1 best of a group of codes for each of a group's queries: lookups, shortlist, rerank as far as errors reach."""

    def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.einsum("d,nd->n", q, x) if metric == "ip" else -((q - x) ** 2).sum(axis=1)

    def scan(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(asked):
            return pd.DataFrame({"query": [], "rep": [], "least": [], "score": []})
        index: Index = shared.value
        words = index.words
        c = np.frombuffer(b"".join(codes["codes"]), np.int16).reshape(len(codes), -1).astype(np.int64)
        rep, least = codes["rep"].to_numpy(object), codes["least"].to_numpy(np.int64)
        error, norm, scale = (codes[name].to_numpy(np.float64) for name in ("error", "norm", "scale"))
        v, want, keep, out = np.stack(codes["v"].to_numpy()), min(shortlist, len(rep)), min(k + 1, len(rep)), []
        for a in range(0, len(asked), 64):
            part = asked.iloc[a : a + 64]
            q = np.stack(part["q"].to_numpy()).astype(np.float64)
            lookup = np.einsum("nd,mkd->mnk", index.asked(q), words, optimize=True)
            inner = np.zeros((len(q), len(rep)), np.float32)
            for j in range(len(words)):
                inner += np.take(lookup[j], c[:, j], axis=1)
            near = index.estimates(inner, q, norm, scale)
            short = np.argpartition(-near, want - 1, axis=1)[:, :want]
            first = np.stack([exact(q[i], v[short[i]].astype(np.float64)) for i in range(len(q))])
            least_kept = -np.partition(-first, keep - 1, axis=1)[:, keep - 1 : keep]
            near += index.factor * index.slack(q, error, scale)
            further = near >= index.comparable(least_kept, q)
            np.put_along_axis(further, short, True, 1)
            dense = exact_scores(q, v.astype(np.float64), metric) if further.mean() > 0.1 else None
            for i in range(len(q)):
                at = np.flatnonzero(further[i])
                if dense is not None:  # all are scored at once: those that can't be among the best, rounding apart, go
                    rough = dense[i, at]
                    last, size = -np.partition(-rough, keep - 1)[keep - 1], np.abs(rough).max()
                    at = at[rough >= last - 1e-9 * size]
                score = exact(q[i], v[at].astype(np.float64))
                best = np.lexsort((least[at], -score))[:keep]
                out.append((part["rep"].iloc[i], at[best], score[best]))
        at = np.concatenate([x for _, x, _ in out])
        return pd.DataFrame({"query": np.repeat(np.array([x for x, _, _ in out], object), keep), "rep": rep[at], "least": least[at], "score": np.concatenate([x for _, _, x in out])})

    return scan


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", books: int = 16, size: int = 256, beam: int = 4, shortlist: int = 100, coverage: float = 0.98, sure: float = 0.99, least_cells: int = 32, most_cells: int = 4096, fragment: int | None = None, query_block: int = 4096, metric: str = "ip") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by exact score of the shortlists.

    is_query: condition on vec_id. metric: "ip" (largest inner product) or "l2" (smallest
    distance; the score is the negative squared distance). fragment: vectors of a group, those of
    FRAGMENT_BYTES unless given. The sample is of 16,384 vectors, or 16 for each cell.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vector_col).withColumn("asked", F.coalesce(is_query(F.col("vec_id")), F.lit(False)))
    n, many, asks, dim = rows.agg(F.count("*"), F.approx_count_distinct("rep"), F.approx_count_distinct(F.when(F.col("asked"), F.col("rep"))), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    fragment = fragment or max(1, FRAGMENT_BYTES // (4 * dim))
    n_cells = min(most_cells, max(least_cells, round(2 * n / fragment)))
    picked = lambda df, rows_, wanted, seed: df.filter(hash_share(F.col("rep"), rows_, wanted, seed)).select("rep", "v").dropDuplicates(["rep"]).orderBy("rep").toArrow()
    sample = picked(rows, many, max(16384, 16 * n_cells), "sample")
    x = matrix(sample.column("v")) if n else np.zeros((0, 1))
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = picked(rows.filter("asked"), asks, 256, "queries")
    queries = (queries if queries.num_rows else sample).slice(0, 512)
    row_of = {rep: i for i, rep in enumerate(sample.column("rep").to_pylist())}
    own = np.array([row_of.get(rep, -1) for rep in queries.column("rep").to_pylist()])
    index = train(x, matrix(queries.column("v")), own, n, n_cells, books, size, k, metric, coverage, sure)
    held = np.zeros(len(index.cells) + 1, np.int64)
    shared = spark.sparkContext.broadcast(index)
    del x, index, sample, queries, row_of

    few = rows.withColumn("r", F.row_number().over(W.partitionBy("rep", "asked").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    distinct = few.groupBy("rep").agg(F.first("v").alias("v"), ids.alias("ids"), F.bool_or("asked").alias("asked")).withColumn("least", F.col("ids")[0])
    coded = materialize(coded_vectors(distinct, shared, beam), "coded")

    # Vectors of each cell, copies up to the k + 1 that can be among a query's nearest.
    for r in coded.groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect():  # most_cells at most
        held[r["cell"]] = r["n"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                order = cell_order(index.asked(matrix(part.column("q"))), index.cells, metric)
                order = np.concatenate([np.full((len(order), 1), order.shape[1]), order], axis=1)  # the tall ones first
                before = np.cumsum(held[order], axis=1) - held[order]
                row, at = np.nonzero(((np.arange(order.shape[1]) <= index.probes) | (before < k + 1)) & (held[order] > 0))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(take), part.column("q").take(take), pa.array(order[row, at].astype(np.int32))], ["rep", "q", "cell"])

    asked = coded.filter("asked").select("rep", F.col("v").alias("q"))
    probed = asked.mapInArrow(probe, f"rep string, q {dict(asked.dtypes)['q']}, cell int")
    parts = coded.groupBy("cell").agg(F.ceil(F.count("*") / fragment).cast("int").alias("fragments"))
    blocks = probed.select("cell").groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    deals = F.broadcast(parts.join(blocks, "cell"))  # a row for each cell: most_cells at most
    deal = lambda many: F.pmod(F.xxhash64("rep", F.lit("deal")), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    left = coded.join(deals, "cell").select("cell", deal("fragments").alias("f"), every("blocks").alias("b"), "rep", "least", "v", "codes", "error", "norm", "scale")
    right = probed.join(deals, "cell").select("cell", every("fragments").alias("f"), deal("blocks").alias("b"), "rep", "q")
    group = ["cell", "f", "b"]
    listed = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(scanner(shared, k, shortlist, metric), "query string, rep string, least long, score double")

    best = W.partitionBy("query").orderBy(F.desc("score"), "least")
    top = listed.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r", "least")
    found = top.join(coded.select("rep", "ids"), "rep").select("query", "rep", "score", "ids")
    queries = rows.filter("asked").groupBy(F.col("rep").alias("query"), F.col("vec_id").alias("query_id")).agg(F.count("*").alias("copies"))
    hits = found.join(queries, "query").select("query", "query_id", "copies", "rep", "score", F.posexplode("ids").alias("at", "vec_id"), F.array_position("ids", F.col("query_id")).alias("own"))
    hits = hits.filter((F.col("query") != F.col("rep")) | (F.col("at") + 1 != F.col("own")))  # a query's own row, once
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")


def op1_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
