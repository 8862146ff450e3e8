"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8.

The search is that of the SimHash operator, by the generalised pigeonhole principle on
fingerprints of the same shingles, within `radius` bits. It can't give all pairs at 0.8 by
itself: two such fingerprints differ in 9.7 bits on average, beyond what partitions of 64 bits
can select by. So pairs that share one of `BANDS` bands of `ROWS` MinHash values are candidates
as well; a pair at similarity s shares none with probability (1 - s^ROWS)^BANDS, 7e-5 at 0.8
and less above. Every candidate link, of either kind, is verified on the shingles themselves
before components are taken.

A bucket of up to `small` texts gives all its pairs. A larger one is first verified against the
most central text of it, the one whose buckets hold the most texts in all: edited copies of one
text are often within the limit of that text, but not of each other. Then, where it still holds several components, its texts are compared by their MinHash values, block
with block; pairs of different components that agree in `least_agreement` of them (at 0.8 a pair
has fewer with probability 1e-5) are verified there, and links alone come out. So a group of near
copies shuffles its size, not its square, as do texts that share a passage but little else.

Defined results: texts are lower-cased in ASCII and split at white space; texts equal after
that are one class, by a 64-bit digest; a text of fewer than five words is one shingle, a null
or empty one has none and is linked to its like only; a component's id is its smallest
non-null doc_id, and rows of one doc_id with different texts are told apart by their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, raw_texts, text_parts
from .op4_simhash import SEED, components, fingerprint, links, shingle_bounds

ROWS, BANDS = 5, 24
_MULTIPLY = (mix64(np.arange(1, ROWS * BANDS + 1)) | np.uint64(1)).astype(np.uint32)[:, None]
_FLIP = mix64(np.arange(1001, ROWS * BANDS + 1001)).astype(np.uint32)[:, None]


def class_key(text: Column) -> Column:
    """Digest of a text's words, lower-cased in ASCII; null and blank texts have the same."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")))


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    if not words:
        return set()
    joined, starts, ends = shingle_bounds(words, size)
    return {joined[a:b] for a, b in zip(starts, ends)}


def signature(held: set[bytes]) -> tuple[np.ndarray, bytes]:
    """One number a band of the MinHash values of a set, and the values."""
    raw = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in held), np.uint64, len(held))
    raw = (raw ^ (raw >> np.uint64(32))).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(raw), 1024):
        x = (raw[a : a + 1024] ^ _FLIP) * _MULTIPLY
        x ^= x >> np.uint32(15)
        np.minimum(least, (x * np.uint32(0x2C1B3C6D)).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in rows], np.uint64).view(np.int64), least.tobytes()


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, fp, bands, mins) of every row; bands and mins are empty for a text without words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                raw = raw_texts(part)
                fps = np.array([fingerprint(t, size) for t in raw], np.uint64).view(np.int64)
                signed = [signature(held) if (held := shingles(t, size)) else (np.zeros(0, np.int64), b"") for t in raw]
                bands = [b for b, _ in signed]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32))
                flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(fps), pa.ListArray.from_arrays(ends, flat), pa.array([m for _, m in signed], pa.binary())], ["doc_id", "key", "fp", "bands", "mins"])

    return rows.mapInArrow(scan, "doc_id long, key long, fp long, bands array<long>, mins binary")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar, by their exact shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                good, last, one = [], None, set()
                for x, y in zip(raw_texts(part), raw_texts(part, "other")):
                    if x != last:
                        last, one = x, shingles(x, size)
                    two = shingles(y, size)
                    both = len(one & two)
                    good.append(both >= similarity * (len(one) + len(two) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("key").alias("a"), "text")
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("other"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text", "other").mapInArrow(check, "a long, b long")


def links_within(dealt: DataFrame, size: int, similarity: float, least_agreement: float) -> DataFrame:
    """(a, b): similar keys of different components within a group of (band, value, b1, b2, own, comp, key, mins, text).

    Pairs whose MinHash values agree are verified on their shingles; a link found joins its
    components, so none is verified within one. A group of two blocks compares those only with
    each other.
    """
    keys = ["band", "value", "b1", "b2"]
    least = int(np.ceil(least_agreement * ROWS * BANDS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            texts = np.array([*raw_texts(batch), None], object)[:-1]
            now = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "own", "comp", "key")), mins, texts]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rest[:4]], axis=0)) + 1
            for a, b in zip([0, *ends], ends):  # the last group may go on in the next batch
                yield from links_of([c[a:b] for c in rest])
            if len(ends):
                rest = [c[ends[-1] :] for c in rest]
        if rest is not None:
            yield from links_of(rest)

    def links_of(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        two, own, comp, key, mins, texts = c[2][0] != c[3][0], c[4], c[5].copy(), *c[6:]
        hashes: dict[int, np.ndarray] = {}

        def held(i: int) -> np.ndarray:
            if i not in hashes:
                hashes[i] = np.sort(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(texts[i], size)], np.uint64))
            return hashes[i]

        for i in range(len(key) - 1):
            other = np.flatnonzero((comp[i + 1 :] != comp[i]) & (not two or own[i + 1 :] != own[i])) + i + 1
            near = other[(mins[other] == mins[i]).sum(axis=1) >= least]
            if not len(near):
                continue
            one, others = held(i), [held(j) for j in near.tolist()]
            sizes, flat = np.array([len(x) for x in others]), np.concatenate(others)
            met = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
            both = np.add.reduceat(met, np.cumsum(sizes) - sizes, dtype=np.int64)
            good = near[both >= similarity * (len(one) + sizes - both)]
            if len(good):
                comp[np.isin(comp, comp[good])] = comp[i]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.full(len(good), key[i])), "b": pa.array(key[good])})

    grouped = dealt.select(*keys, "own", "comp", "key", "mins", "text").repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(scan, "a long, b long")


def ordered(frame: DataFrame) -> DataFrame:
    return frame.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def labelled(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """keys with the component of each, itself where it has no link."""
    return keys.join(components(edges).withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def fingerprint_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): keys whose fingerprints are equal or linked by the SimHash operator's search."""
    fps = materialize(classes.groupBy("fp").agg(F.min("key").alias("rep")), "prints")
    equal = classes.select("fp", F.col("key").alias("b")).join(fps.withColumnRenamed("rep", "a"), "fp").select("a", "b")
    side = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    near = links(fps.select("fp"), radius).join(side("a"), "a").join(side("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    return equal.unionByName(near)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 3, small: int = 16, block: int = 2048, least_agreement: float = 0.65) -> DataFrame:
    """(doc_id, key, comp, component_id) of every row; comp: a key of the component, also where no row has an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", class_key(F.col("text")))
    prints = materialize(sketches(rows, size), "sketches")
    classes = prints.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    at = ["band", "value"]
    buckets = classes.select("key", F.posexplode("bands").alias("band", "value"))
    buckets = materialize(buckets.join(buckets.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1"), at), "buckets")
    large = buckets.filter(F.col("n") > small)
    weights = large.groupBy("key").agg(F.sum("n").alias("weight"))
    pivots = large.join(weights, "key").groupBy(*at).agg(F.max_by("key", F.struct("weight", "key")).alias("pivot"))
    few = buckets.filter(F.col("n") <= small).groupBy(*at).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    pairs = few.select(F.explode("keys").alias("a"), "keys").select("a", F.explode("keys").alias("b")).filter("a < b")
    stars = large.join(pivots, at).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    pairs = materialize(ordered(pairs.unionByName(stars).unionByName(fingerprint_pairs(classes.select("key", "fp"), radius))), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct()
    texts = materialize(rows.select("key", "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "texts")
    edges = materialize(verified(pairs, texts, size, similarity), "verified")
    large = large.select("key", *at)
    if not large.isEmpty():
        large = materialize(labelled(large, edges), "large")
        open_ = large.groupBy(*at).agg(F.count("*").alias("n"), F.countDistinct("comp").alias("comps")).filter("comps > 1")
        signed = prints.groupBy("key").agg(F.first("mins").alias("mins"))
        rows_ = large.join(open_, at).join(signed, "key").join(texts, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")})
        edges = edges.unionByName(materialize(ordered(links_within(dealt, size, similarity, least_agreement)), "verified"))
    classes = labelled(prints.groupBy("key").agg(F.min("doc_id").alias("least")), edges)
    ids = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "key").join(classes.join(ids, "comp").select("key", "comp", "component_id"), "key")
