"""Sampled segmentation of text into pieces, and its exact inverse.

Forward filtering: for every distinct pre-token of a batch, the log of the summed weight of
all segmentations of each prefix. Backward sampling: each occurrence draws its last piece in
proportion to weight, then the one before, down to its start. Draws come from a counter hash
of (seed, row key, pre-token number, step), so a row's result depends on nothing else.
Decoding joins the pieces' bytes and gives back the exact text.

Defined results: a null text has null ids and decodes to null; an empty text has no ids;
repeated rows (same key and text) get the same ids; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, text_bytes, text_parts
from .pieces import VOCAB_PATH, Vocabulary, Words, distinct_words, load_vocabulary, pieces_ending


def forward_filter(words: Words, vocab: Vocabulary, temperature: float = 1.0):
    """Edges of all word lattices, grouped by state: an end byte, then the word.

    Returns the first state of each end byte, the first edge of each state (one more at the
    end), and for each edge the cumulative probability within its state, its byte length and
    its piece.
    """
    n, longest = len(words.lengths), len(words.prefix) - 1
    level = np.concatenate(([0, 0], np.cumsum([words.active(j) for j in range(1, longest + 1)], dtype=np.int64)))
    alpha = [np.zeros(n)]
    firsts, shares, sizes, pieces, total = [], [], [], [], 0
    for j in range(1, longest + 1):
        m = words.active(j)
        row, edges, here = np.full(m, -np.inf), np.zeros(m, np.int64), []
        for size in range(1, min(j, vocab.longest) + 1):
            at, ids = pieces_ending(vocab, words.prefix[j, :m], words.prefix[j - size, :m], j - size)
            weight = alpha[j - size][at] + vocab.logp[ids] / temperature
            row[at] = np.logaddexp(row[at], weight)
            edges[at] += 1
            here.append((at, ids, weight, size))
        alpha.append(row)
        ends = np.cumsum(edges)
        to, reached = ends - edges, np.zeros(m)
        firsts.append(to + total)
        share, length, piece = np.empty(ends[-1]), np.empty(ends[-1], np.int8), np.empty(ends[-1], np.int32)
        to = to.copy()
        for at, ids, weight, size in here:
            k = to[at]
            reached[at] += np.exp(weight - row[at])
            share[k], length[k], piece[k] = reached[at], size, ids
            to[at] += 1
        total += int(ends[-1])
        shares.append(share)
        sizes.append(length)
        pieces.append(piece)
    join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
    return level, join([*firsts, np.array([total])], np.int64), join(shares, float), join(sizes, np.int8), join(pieces, np.int32)


def backward_sample(words: Words, lattice, code: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of every occurrence of the words in `code`, in text order, and the number of pieces of each."""
    level, first, share, size_of, piece_of = lattice
    live = np.arange(len(code))
    position = words.lengths[code].copy()
    taken, steps = np.zeros(len(live), np.int64), []
    while len(live):
        with np.errstate(over="ignore"):
            draw = mix64(keys[live] + np.uint64(0x9E3779B97F4A7C15) * (taken[live].astype(np.uint64) + np.uint64(1)))
        u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        state = level[position[live]] + code[live]
        edge, last = first[state], first[state + 1] - 1
        open_ = np.flatnonzero((share[edge] <= u) & (edge < last))
        while len(open_):
            edge[open_] += 1
            open_ = open_[(share[edge[open_]] <= u[open_]) & (edge[open_] < last[open_])]
        steps.append((live, piece_of[edge]))
        taken[live] += 1
        position[live] -= size_of[edge]
        live = live[position[live] > 0]
    ends = np.cumsum(taken)
    out = np.empty(ends[-1] if len(ends) else 0, np.int32)
    for k, (who, piece) in enumerate(steps):
        out[ends[who] - 1 - k] = piece
    return out, taken


def filtered(word: bytes, vocab: Vocabulary, temperature: float) -> list[float]:
    """Log of the summed weight of all segmentations of each prefix of one word."""
    alpha = [0.0]
    for j in range(1, len(word) + 1):
        weights = [alpha[i] + logp / temperature for i, _, logp in vocab.ending(word, j)]
        most = max(weights)
        alpha.append(most + math.log(sum(math.exp(w - most) for w in weights)))
    return alpha


def sampled(word: bytes, alpha: list[float], vocab: Vocabulary, temperature: float, key: int) -> list[int]:
    """Pieces of one occurrence of a word, by the draws that backward_sample makes."""
    j, out = len(word), []
    while j:
        x = (key + 0x9E3779B97F4A7C15 * (len(out) + 1)) & 0xFFFFFFFFFFFFFFFF
        u, reached = float(mix64(np.array([x], np.uint64))[0] >> np.uint64(11)) * 2.0**-53, 0.0
        for i, piece, logp in vocab.ending(word, j):
            reached += math.exp(alpha[i] + logp / temperature - alpha[j])
            if reached > u:
                break
        out.append(piece)  # the last one, where rounding leaves a rest
        j = i
    return out[::-1]


PART_BYTES = 1 << 20  # text whose lattices are in memory at a time


def segment(part: pa.RecordBatch, vocab: Vocabulary, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled pieces of all texts of a batch end to end and the bounds of each text's; the same of their bytes."""
    data, offsets = text_bytes(part)
    words = distinct_words(data, offsets)
    bounds = np.searchsorted(words.starts, offsets)
    key = mix64(pc.fill_null(part.column("key"), 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    number = np.arange(len(words.code)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys = mix64(np.repeat(key, np.diff(bounds)) ^ mix64(number.astype(np.uint64)))
    short, long = ~words.is_long, np.flatnonzero(words.is_long)
    taken = np.empty(len(words.code), np.int64)
    pieces, taken[short] = backward_sample(words, forward_filter(words, vocab, temperature), words.code[short], keys[short])
    alphas = [filtered(w, vocab, temperature) for w in words.long]
    others = [sampled(words.long[c], alphas[c], vocab, temperature, int(k)) for c, k in zip(words.code[long], keys[long])]
    taken[long] = [len(x) for x in others]
    ids, of_short = np.empty(taken.sum(), np.int32), np.repeat(short, taken)
    ids[of_short] = pieces
    ids[~of_short] = [i for x in others for i in x]
    return ids, np.concatenate(([0], np.cumsum(taken)))[bounds], data, offsets


def keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0, vocab: Vocabulary | None = None, path: str = VOCAB_PATH) -> DataFrame:
    """(id, piece_ids array<int>): one sampled segmentation of each text, seeded by the row's id."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab or load_vocabulary(path))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, limit=PART_BYTES):
                ids, bounds, _, _ = segment(part, shared.value, temperature)
                absent = part.column("text").is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(absent))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "piece_ids"])

    return keyed(docs, id_col, text_col, seed).mapInArrow(sample, "id long, piece_ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocab: Vocabulary | None = None, path: str = VOCAB_PATH) -> DataFrame:
    """(keep..., decoded string): the text that each row's piece_ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab or load_vocabulary(path))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column("piece_ids"):
                texts.append(None if ids.as_py() is None else shared.value.decode(ids.values.to_numpy().astype(np.int64))[0].tobytes().decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    rows = encoded.select(*keep, "piece_ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("piece_ids").dtypes)
    return rows.mapInArrow(spell, f"{schema}, decoded string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0, vocab: Vocabulary | None = None, path: str = VOCAB_PATH) -> DataFrame:
    """(id, piece_ids, n_pieces, piece_digest, lossless): encode and decode every text in one pass.

    piece_ids: null for a null text; piece_digest: XXH64 of the ids as 32-bit little-endian numbers, null for a null text;
    lossless: whether the decoded bytes are the text's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab or load_vocabulary(path))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, limit=PART_BYTES):
                ids, bounds, data, offsets = segment(part, shared.value, temperature)
                spelt, ends = shared.value.decode(ids.astype(np.int64))
                at = np.concatenate(([0], ends))[bounds]
                exact = [np.array_equal(spelt[a:b], data[c:d]) for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])]
                raw = ids.astype("<i4")
                digest = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64).view(np.int64)
                absent = part.column("text").is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(absent))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(np.diff(bounds)), pa.array(digest, mask=absent), pa.array(exact, pa.bool_())], ["id", "piece_ids", "n_pieces", "piece_digest", "lossless"])

    return keyed(docs, id_col, text_col, seed).mapInArrow(sample, "id long, piece_ids array<int>, n_pieces long, piece_digest long, lossless boolean").withColumnRenamed("id", id_col)


def op6_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
