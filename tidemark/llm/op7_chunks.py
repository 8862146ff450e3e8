"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash of the last WINDOW bytes runs over each text. A chunk ends where the hash is the
least within `reach` bytes on either side, moved on to the next word start, so a boundary
depends on nearby bytes only and an insertion shifts none but the chunks it touches. Texts
without such a point get a cut every `most` bytes from the last boundary.

Chunks are deduplicated by digest: one that occurs in two documents or more is repeated, and
belongs to its smallest doc_id. Runs of neighbouring repeated chunks of `min_words` words or
more are the repeated passages. Single short chunks that recur by chance form no such run.
(The chunks at a passage's two ends also hold text from outside, so a run is shorter than
its passage; 24 words of run stand for a passage of about 50.)

Defined results: null and empty texts have no chunks; a repeat within one document only is no
repeat across documents; rows with the same doc_id count as one document, and a chunk is cut
only from a text that holds its very bytes there; rows with a null id take no part; a
document may lose all its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, mix64, raw_texts, table, text_bytes, text_parts

WINDOW = 16
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes up to each byte, by doubling the window."""
    h = GEAR[data]
    size = 1
    while size < WINDOW:
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
        size *= 2
    return h * np.uint32(2654435769)


def window_min(h: np.ndarray, reach: int) -> np.ndarray:
    """Least value of h[i : i + reach], cut at the end."""
    out, size = h.copy(), 1
    while size * 2 <= reach:
        out[:-size] = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < reach:
        k = reach - size
        out[:-k] = np.minimum(out[:-k], out[k:])
    return out


def chunk_starts(data: np.ndarray, offsets: np.ndarray, reach: int, most: int) -> np.ndarray:
    """First byte of every chunk of texts laid end to end; each non-empty text starts one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.concatenate(([False], space[:-1])) & ~space  # word starts
    texts = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    cuts = np.zeros(0, np.int64)
    if n > 2 * reach:
        h = gear_hashes(data)
        ahead = window_min(h, reach)  # of h[i : i + reach]
        low = np.flatnonzero((h[reach:-reach] < ahead[: -2 * reach]) & (h[reach:-reach] <= ahead[reach + 1 : n - reach + 1])) + reach
        row = np.searchsorted(texts, low, side="right") - 1
        last = np.append(texts[1:], n)[row]
        inside = (low - texts[row] >= reach + WINDOW) & (last - low > reach)  # no byte of another text is looked at
        word = np.flatnonzero(begins)
        k = np.searchsorted(word, low[inside] + 1)
        ok = k < len(word)
        cuts = word[k[ok]]
        cuts = cuts[cuts < last[inside][ok]]
    starts = np.unique(np.concatenate((texts, cuts)))
    gaps = np.diff(np.append(starts, n))
    long = np.flatnonzero(gaps > most)
    if len(long):
        extra = (gaps[long] - 1) // most
        k = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        cut = np.repeat(starts[long], extra) + k * most
        for _ in range(3):  # not within a character
            cut -= (data[cut] & 0xC0) == 0x80
        starts = np.unique(np.concatenate((starts, cut)))
    return starts


def digest_of(chunk: bytes) -> int:
    """64-bit digest, as a signed number."""
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 16, most: int = 256) -> DataFrame:
    """(doc_id, first, length, words, digest): byte range and digest of every chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                data, offsets = text_bytes(part)
                raw = data.tobytes()
                starts = chunk_starts(data, offsets, reach, most)
                ends = np.append(starts[1:], len(data))
                row = np.searchsorted(offsets, starts, side="right") - 1
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~space & np.concatenate(([True], space[:-1])) if len(data) else space
                begins[offsets[:-1][offsets[:-1] < len(data)]] |= ~space[offsets[:-1][offsets[:-1] < len(data)]]
                words = np.concatenate(([0], np.cumsum(begins)))
                digest = np.fromiter((digest_of(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), pa.array((starts - offsets[row]).astype(np.int32)),
                    pa.array((ends - starts).astype(np.int32)), pa.array((words[ends] - words[starts]).astype(np.int32)), pa.array(digest),
                ], ["doc_id", "first", "length", "words", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(cut, "doc_id long, first int, length int, words int, digest long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, reach: int = 16, most: int = 256) -> DataFrame:
    """One row for each repeated passage of each document.

    (doc_id, first, last: its bytes; n_words, n_chunks; owner: smallest doc_id that one of its
    chunks belongs to; extra array<struct<first, last, digest>>: its chunks that belong to an earlier
    document, which deduplication removes).
    """
    every = materialize(chunks(docs, id_col, text_col, reach, most), "chunks")
    repeated = every.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).filter("owner <> other").drop("other")
    found = every.join(repeated, "digest").dropDuplicates(["doc_id", "first", "digest"]).withColumn("last", F.col("first") + F.col("length"))
    in_order = W.partitionBy("doc_id").orderBy("first", "last", "digest")
    reached = F.max("last").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum((F.col("first") > F.coalesce(reached, F.lit(-1))).cast("int")).over(in_order)
    extra = F.when(F.col("owner") < F.col("doc_id"), F.struct("first", "last", "digest"))
    passages = found.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"),
        F.min("owner").alias("owner"), F.sort_array(F.collect_list(extra)).alias("extra"),
    )
    return passages.filter(F.col("n_words") >= min_words).drop("run")


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the extra chunks of its passages cut out of the text; other columns as they are."""
    cuts = passages.filter(F.size("extra") > 0).groupBy(F.col("doc_id").alias("cut_id")).agg(F.flatten(F.collect_list("extra")).alias("cuts"))

    @F.pandas_udf("string")
    def without(text, cuts):
        out = []
        for t, c in zip(text, cuts):
            if t is not None and c is not None:
                raw, kept, at = t.encode(), [], 0
                for x in sorted(c, key=lambda x: x["first"]):
                    span = raw[x["first"] : x["last"]]
                    if x["first"] >= at and digest_of(span) == x["digest"]:
                        kept.append(raw[at : x["first"]])
                        at = x["last"]
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        return type(text)(out, dtype=object)

    joined = docs.join(cuts, docs[id_col] == cuts["cut_id"], "left")
    return joined.select(*(without(docs[c], cuts["cuts"]).alias(c) if c == text_col else docs[c] for c in docs.columns))


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "first", "last", "n_words", "n_chunks", "owner", F.size("extra").alias("n_extra"))
