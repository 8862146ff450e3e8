"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages: windows of two and of three blocks of `block` words, one block
apart, so an item of up to 2 * block words lies whole in one of them. Longer items are searched by
segments of that length, the last one overlapping the one before, so that no word is left out. Passages and items are TF-IDF vectors over the benchmark's own
words; a randomised SVD with one power iteration, summed over the cluster, gives their latent
space. Passages within `min_cosine` of an item are candidates; the longest common subsequence
of words with the item, and with its last quarter, the answer, then decides (of a long item each
segment by itself; the answer goes with the last one).

The document frequencies behind IDF cover all blocks of all texts, and so does the SVD, with the
items; every passage of every text is searched. The latent space has `rank_share` dimensions for
each segment of an item, as far as there are terms; `min_cosine` is chosen by measured recall
(README): what falls below is lost. The benchmark is searched `most_items` items at a time, so what
tasks hold is bounded whatever its size.

Defined results: null and empty texts and items give no row; an item of fewer than
`min_item_words` words is searched too, by the same rules; the best passage of each
(document, item) is returned; rows with the same doc_id count as one document; rows with a
null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, raw_texts, table, text_parts

_DROP = b".,;:!?\"'()[]{}*#$%&|"


def words_of(text: bytes) -> list[bytes]:
    """Words, lower-cased in ASCII, without ASCII punctuation."""
    return text.lower().translate(None, _DROP).split()


def lcs(item: np.ndarray, passage: list[int]) -> int:
    """Length of the longest common subsequence, one bit of an integer for each item word."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        masks[t] = masks.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for t in passage:
        m = masks.get(t)
        if m:
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(item) - row.bit_count()


def padded(segments: list[np.ndarray], n_terms: int) -> np.ndarray:
    """Term numbers of the segments, a row each, filled up with n_terms, which no window holds."""
    out = np.full((len(segments), max(map(len, segments), default=0)), n_terms)
    for row, s in zip(out, segments):
        row[: len(s)] = s
    return out


def shared_words(ids: np.ndarray, first: np.ndarray, stop: np.ndarray, segment: np.ndarray, rows: np.ndarray, n_terms: int, most: int = 1 << 22) -> np.ndarray:
    """How many words of each candidate's segment (a row of `rows`, see padded) are among ids[first:stop]; candidates of one window follow each other.

    By a table of which terms a window holds, of about `most` cells at a time.
    """
    window = np.cumsum(np.diff(first, prepend=-1) != 0) - 1
    starts = np.flatnonzero(np.diff(window, prepend=-1))
    out = np.zeros(len(first), np.int64)
    tables, gathered = max(1, most // (n_terms + 1)), max(1, most // (4 * rows.shape[1] + 1))
    for a in range(0, len(starts), tables):
        at = starts[a : a + tables]
        words = first[at, None] + np.arange((stop[at] - first[at]).max())
        words = np.where(words < stop[at, None], ids[np.minimum(words, len(ids) - 1)], -1)
        holds = np.zeros((len(at), n_terms + 1), bool)
        holds[np.arange(len(at))[:, None], words] = True
        holds[:, n_terms] = False  # where -1 went
        end = starts[a + tables] if a + tables < len(starts) else len(first)
        for c in range(at[0], end, gathered):
            some = slice(c, min(c + gathered, end))
            out[some] = np.count_nonzero(holds[window[some, None] - a, rows[segment[some]]], axis=1)
    return out


@dataclass
class Benchmark:
    terms: dict[bytes, int]
    segments: list[tuple[int, np.ndarray]]  # item id and its term numbers
    answers: list[np.ndarray]  # of each segment: the end of the item, empty but in its last segment
    block: int


def read_items(items: DataFrame, block: int) -> Benchmark:
    """A bounded number of items (item_id, text)."""
    terms: dict[bytes, int] = {}
    segments, answers = [], []
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        ids = np.array([terms.setdefault(w, len(terms)) for w in words_of(text.encode())], np.int64)
        if len(ids):
            last = max(0, len(ids) - 2 * block)
            for at in [*range(0, last, 2 * block), last]:
                segments.append((item, ids[at : at + 2 * block]))
                answers.append(ids[-max(1, len(ids) // 4) :][-2 * block :] if at == last else ids[:0])
    return Benchmark(terms, segments, answers, block)


def numbered(raw: list[bytes], terms: dict[bytes, int], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term of every word (-1: not of the benchmark), its block, and the bounds of texts in words and blocks."""
    get = terms.get
    split = [words_of(t) for t in raw]
    n = np.array([len(s) for s in split], np.int64)
    words = np.concatenate(([0], np.cumsum(n)))
    ids = np.fromiter(map(get, chain.from_iterable(split), repeat(-1)), np.int64, words[-1])
    blocks = np.concatenate(([0], np.cumsum(-(-n // block))))
    place = np.repeat(blocks[:-1], n) + (np.arange(words[-1]) - np.repeat(words[:-1], n)) // block
    return ids, place, words, blocks


def document_frequencies(texts: DataFrame, bench, size: int) -> tuple[np.ndarray, int]:
    """Blocks that hold each term, and the number of blocks, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in text_parts(batch):
                ids, place, _, blocks = numbered(raw_texts(part), bench.value.terms, bench.value.block)
                known = ids >= 0
                codes = np.sort(place[known] * size + ids[known])
                total += np.bincount(codes[np.flatnonzero(np.diff(codes, prepend=-1))] % size, minlength=size)
                n += int(blocks[-1])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(held, -1)), "n": pa.array(np.append(total[held], n))})

    df, n = np.zeros(size, np.int64), 0
    for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # the benchmark's terms at most
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def term_weights(df: np.ndarray, n_blocks: int, segments: list[np.ndarray], common: float) -> np.ndarray:
    """IDF, 0 for terms in over `common` of the blocks that are not the rarer half of any item.

    So an item that itself fills the corpus still has terms to be found by.
    """
    rare = df <= common * n_blocks
    for s in segments:
        terms = np.unique(s)
        rare[terms[np.argsort(df[terms], kind="stable")][: (len(terms) + 1) // 2]] = True
    return np.where(rare, np.maximum(np.log((n_blocks + 1) / (df + 1)), 1.0), 0.0)


def vectors(ids: np.ndarray, place: np.ndarray, n: int, weighted: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Summed rows of `weighted` (idf * basis) of each of n places; place ascends.

    One pass for each rank of a word within its place, so that no pass meets a place twice.
    """
    at = np.flatnonzero((ids >= 0) & used[ids])
    rows, where = ids[at], place[at]
    new = np.concatenate((np.ones(min(1, len(where)), bool), where[1:] != where[:-1]))
    starts = np.flatnonzero(new)
    rank = np.arange(len(where)) - starts[np.cumsum(new) - 1] if len(where) else where
    out = np.zeros((n, weighted.shape[1]), weighted.dtype)
    order = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank)) if len(rank) else []
    for a, b in zip([0, *ends], ends):
        k = order[a:b]
        out[where[k]] += weighted[rows[k]]
    return out


def pair_counts(texts: DataFrame, bench, used: np.ndarray) -> DataFrame:
    """(i, j, n): how often weighted terms meet in one block, over all blocks; a term with itself included.

    A block's few weighted terms are paired by their distance within it. Counted in each task
    first, in flushes of bounded size.
    """
    size = len(used)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for part in text_parts(batch):
                ids, place, _, _ = numbered(raw_texts(part), bench.value.terms, bench.value.block)
                kept = (ids >= 0) & used[np.maximum(ids, 0)]
                ids, place = ids[kept], place[kept]
                held.append(ids * size + ids)
                for lag in range(1, bench.value.block):
                    met = place[lag:] == place[:-lag]
                    if not met.any():
                        break
                    a, b = ids[:-lag][met], ids[lag:][met]
                    held.append(np.minimum(a, b) * size + np.maximum(a, b))
                    held.append(held[-1][a == b])  # a term's square holds each pair of its places twice
                many += sum(map(len, held))
                if many > 4_000_000:
                    yield rows(held)
                    held, many = [], 0
        if held:
            yield rows(held)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"i": pa.array(code // size), "j": pa.array(code % size), "n": pa.array(n.astype(np.int64))})

    return texts.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def grouped_sum(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """total[at] += values, where at may repeat."""
    if len(at):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        total[at[order[starts]]] += np.add.reduceat(values[order], starts, axis=0)


def latent_basis(pairs: DataFrame, segments: list[tuple[int, np.ndarray]], idf: np.ndarray, rank: int, oversampling: int = 16, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages and items, terms by rank.

    Randomised range finding: A'A of the passages is the weighted table of pair counts, and each
    pass multiplies it over the cluster with `oversampling` more columns than are kept; every term's
    row is complete in one task.
    """
    size = len(idf)
    width = min(rank + oversampling, size)
    spark = pairs.sparkSession
    both = pairs.unionByName(pairs.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    lengths = [len(s) for _, s in segments]
    of_items, item = np.concatenate([s for _, s in segments]), np.repeat(np.arange(len(lengths)), lengths)

    def gram(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q.astype(np.float32))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    i, j, n = (c.to_numpy() for c in batch.slice(a, 4096).columns)
                    terms, row = np.unique(i, return_inverse=True)
                    part = np.zeros((len(terms), width))
                    grouped_sum(part, row, (n * idf[i] * idf[j])[:, None] * shared.value[j])
                    for t, x in zip(terms.tolist(), part):
                        total[t] = total[t] + x if t in total else x
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int64()), "part": pa.array([x.tobytes() for x in total.values()], pa.binary())})

        out = np.zeros((size, width))
        for r in both.select("i", "j", "n").repartition("i").mapInArrow(multiply, "term long, part binary").toLocalIterator():  # a row for each term of the items
            out[r["term"]] = np.frombuffer(r["part"])
        own = vectors(of_items, item, len(lengths), idf[:, None] * q, idf > 0)
        grouped_sum(out, of_items, idf[of_items][:, None] * own[item])
        shared.unpersist()
        return out

    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))
    q, _ = np.linalg.qr(gram(q))
    small = q.T @ gram(q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (q @ turn[:, ::-1][:, values[::-1] > 1e-9][:, :rank]).astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_items: int = 500, **parameters) -> DataFrame:
    """(doc_id, item_id, first_word, cosine, lcs, answer): the best passage of each leaked item.

    Items come in shards of about most_items; parameters: see `contaminated_by`.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    shards = max(1, -(-items.count() // most_items))
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for k in range(shards):
        found = found.unionByName(contaminated_by(rows, read_items(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k), parameters.get("block", 32)), **parameters))
    best = F.max(F.struct("lcs", "answer", "cosine", (-F.col("first_word")).alias("before"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.before")).alias("first_word"), "best.cosine", "best.lcs", "best.answer")


LEAKS = "doc_id long, item_id long, first_word long, cosine double, lcs double, answer double"


def contaminated_by(rows: DataFrame, bench: Benchmark, block: int = 32, rank_share: float = 2.0, min_cosine: float = 0.2, min_lcs: float = 0.75, loose_lcs: float = 0.6, min_answer: float = 0.75, common: float = 0.003) -> DataFrame:
    """All passages of the rows (doc_id, text) that hold an item.

    A candidate is a leak where its share of the segment's words in common order is min_lcs or
    more, or loose_lcs with min_answer of the answer's. Terms in over `common` of all blocks
    carry no weight in the vectors, but for the rarer half of each item's terms.
    """
    spark = rows.sparkSession
    if not bench.terms:
        return spark.createDataFrame([], LEAKS)
    shared = spark.sparkContext.broadcast(bench)
    df, n_blocks = document_frequencies(rows.select("text"), shared, len(bench.terms))
    idf = term_weights(df, n_blocks, [s for _, s in bench.segments], common)
    pairs = materialize(pair_counts(rows.select("text"), shared, idf > 0), "pairs")
    basis = latent_basis(pairs, bench.segments, idf, ceil(rank_share * len(bench.segments)))
    lengths = [len(s) for _, s in bench.segments]
    weighted, used = (idf[:, None] * basis).astype(np.float32), idf > 0
    latent = vectors(np.concatenate([s for _, s in bench.segments]), np.repeat(np.arange(len(lengths)), lengths), len(lengths), weighted, used)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    space = spark.sparkContext.broadcast((weighted, used, latent))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, (weighted, used, latent) = shared.value, space.value
        segments = bench.segments
        n_terms, of_segments = len(bench.terms), padded([s for _, s in segments], len(bench.terms))
        least = [loose_lcs if len(a) else min_lcs for a in bench.answers]
        bars = np.array(least) * [len(s) for _, s in segments]
        for batch in batches:
            for part in text_parts(batch):
                doc_ids = part.column("doc_id").to_pylist()
                ids, place, words, blocks = numbered(raw_texts(part), bench.terms, bench.block)
                n = int(blocks[-1])
                each = vectors(ids, place, n, weighted, used)
                row = np.repeat(np.arange(len(doc_ids)), np.diff(blocks))
                dots, square = each @ latent.T, np.einsum("nd,nd->n", each, each)
                beside = [np.zeros(n, np.float32) for _ in range(3)]  # inner products with the block 1 and 2 on
                follows = [np.flatnonzero(row[k:] == row[:-k]) if n > k else np.zeros(0, np.int64) for k in (1, 2)]
                for k, at in enumerate(follows, 1):
                    beside[k][at] = np.einsum("nd,nd->n", each[at], each[at + k])
                cosine, window, length = np.zeros_like(dots), dots.copy(), square.copy()
                for k, at in enumerate(follows, 1):  # windows of two and of three blocks, by their blocks' products
                    window[at] += dots[at + k]
                    length[at] += square[at + k] + 2 * beside[k][at] + (2 * beside[1][at + 1] if k == 2 else 0)
                    np.maximum(cosine, window / np.sqrt(np.maximum(length, 1e-12))[:, None], out=cosine)
                near, of = np.nonzero(cosine >= min_cosine)
                first = words[row[near]] + (near - blocks[row[near]]) * bench.block
                stop = np.minimum(first + 3 * bench.block, words[row[near] + 1])
                likely = shared_words(ids, first, stop, of, of_segments, n_terms) >= bars[of]  # no more positions can be shared than have their word in the window
                found = []
                for b, s, start, end in zip(*(x[likely].tolist() for x in (near, of, first, stop))):
                    item, wanted = segments[s]
                    passage = ids[start:end].tolist()
                    share, tail = lcs(wanted, passage) / len(wanted), bench.answers[s]
                    if share >= least[s]:
                        answer = lcs(tail, passage) / len(tail) if len(tail) else 0.0
                        if share >= min_lcs or answer >= min_answer:
                            found.append((doc_ids[row[b]], item, start - int(words[row[b]]), float(cosine[b, s]), share, answer))
                columns = list(zip(*found)) or [()] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_word", "cosine", "lcs", "answer"])

    return rows.mapInArrow(search, LEAKS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
