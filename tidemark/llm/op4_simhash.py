"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its word-shingle hashes have it set.
Fingerprints within `radius` bits are linked; components of linked fingerprints are the
duplicate groups.

Candidates: correlated bits are grouped into m partitions. Integer thresholds t_i with sum
radius - m + 1 guarantee that a linked pair agrees within t_i in some partition i (t_i = -1
skips a partition). A dynamic programme picks the thresholds with the least estimated cost
(probe rows and candidate pairs, estimated on a documented sample of fingerprints), and the
cheapest m is taken. Every choice is exact; only the cost differs.

Rows of one bucket are verified together. A bucket of over `block` rows is split into blocks,
and every pair of blocks is a group of its own, so no group is unbounded; within a group only
a spanning set of links comes out, never all pairs.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated
rows come out each; a component's id is its smallest non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, raw_texts, table, text_parts

SEED = 42
SAMPLE = 4096  # fingerprints that the partitions and thresholds are fitted on
PAIR_COST = 0.05  # cost of verifying a candidate pair, in rows shuffled


def shingle_bounds(words: list[bytes], size: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle starts and ends in them."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    return joined, starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of one text, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined, starts, ends = shingle_bounds(words, size)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = np.array([digest(joined[a:b]) for a, b in zip(starts, ends)], np.uint64)
    # bits are counted on distinct hashes: repetitive texts have few
    hashes, times = np.unique(hashes, return_counts=True) if len(hashes) > 4096 else (hashes, None)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = len(ends)
    ones = bits.sum(axis=0, dtype=np.int64) if times is None else times @ bits.astype(np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id long, fp long) of every row; fp holds the 64 bits as a signed number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                fps = np.array([fingerprint(t, size) for t in raw_texts(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of about equal width, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    spread = bits - bits.mean(axis=0)
    scale = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    close = np.abs(spread.T @ spread) / np.outer(scale, scale)
    np.fill_diagonal(close, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda b: (close[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (close[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def mask_of(part: list[int]) -> int:
    return sum(1 << b for b in part)


def allocate(sample: np.ndarray, parts: list[list[int]], radius: int, rows: int) -> tuple[list[int], float]:
    """Thresholds of least estimated cost whose sum is radius - m + 1."""
    x = sample[:2048]
    pairs = max(1, len(x) * (len(x) - 1))
    costs = []
    for part in parts:
        masked = x & np.uint64(mask_of(part))
        near = np.zeros(radius + 1)
        for a in masked:
            near += np.bincount(np.minimum(np.bitwise_count(masked ^ a), radius + 1), minlength=radius + 2)[: radius + 1]
        near[0] -= len(x)
        here, probes, chance = {-1: 0.0}, 0, 0.0
        for t in range(radius + 1):
            probes += comb(len(part), t)
            chance = sum(comb(len(part), k) for k in range(t + 1)) / 2 ** len(part)
            here[t] = rows * probes + PAIR_COST * rows * rows * max(near[: t + 1].sum() / pairs, chance)
        costs.append(here)
    best = {0: (0.0, [])}
    for here in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, more in here.items():
                if total + t not in after or cost + more < after[total + t][0]:
                    after[total + t] = (cost + more, [*chosen, t])
        best = after
    cost, chosen = best[radius - len(parts) + 1]
    return chosen, cost


def plan_partitions(sample: np.ndarray, radius: int, rows: int) -> list[tuple[list[int], int]]:
    """The partitions that are probed, with their thresholds."""
    options = []
    for m in range(2, radius + 2):
        parts = correlated_parts(sample, m)
        chosen, cost = allocate(sample, parts, radius, rows)
        options.append((cost, m, parts, chosen))
    _, _, parts, chosen = min(options)
    return [(p, t) for p, t in zip(parts, chosen) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probe_rows(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): each fingerprint under every partition value within the threshold."""
    probes = []
    for i, (part, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(signed(mask_of(part))))
        flips = [signed(mask_of(list(c))) for k in range(t + 1) for c in combinations(part, k)]
        keys = F.transform(F.array(*(F.lit(f) for f in flips)), lambda f: own.bitwiseXOR(f))
        probes.append(F.transform(keys, lambda key: F.struct(F.lit(i).alias("part"), key.alias("key"))))
    return fps.select("fp", F.explode(F.concat(*probes)).alias("p")).select("p.part", "p.key", "fp")


def spanning_links(group: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect, within each run of equal group numbers, all that are within radius."""
    out = []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= 12, sizes)
    for lag in range(1, min(12, int(sizes.max(initial=0)))):
        a, b = fp[:-lag], fp[lag:]
        hit = small[lag:] & (group[lag:] == group[:-lag]) & (a != b)
        hit[hit] = np.bitwise_count(a[hit] ^ b[hit]) <= radius
        out.append((a[hit], b[hit]))
    for k in np.flatnonzero(sizes > 12):
        left = np.unique(fp[starts[k] : starts[k] + sizes[k]])
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                one = todo.pop()
                near = np.bitwise_count(left ^ one) <= radius
                if near.any():
                    found, left = left[near], left[~near]
                    out.append((np.full(len(found), one), found))
                    todo.extend(found)
    return out


def links(fps: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within radius of each other.

    fps: distinct values in a column fp.
    """
    rows = fps.count()
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    probes = probe_rows(fps, plan_partitions(sample, radius, rows) if rows > 1 else [([0], 0)])
    large = probes.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    dealt = (
        probes.join(large, ["part", "key"], "left")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .select("part", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("part", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp")
    )
    keys = ["part", "key", "b1", "b2"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            change = np.any([c[1:] != c[:-1] for c in rest[:4]], axis=0)
            ends = np.flatnonzero(change)
            if len(ends):  # the last group may go on in the next batch
                cut = ends[-1] + 1
                yield from emit([c[:cut] for c in rest])
                rest = [c[cut:] for c in rest]
        if rest is not None:
            yield from emit(rest)

    def emit(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.any([x[1:] != x[:-1] for x in c[:4]], axis=0)
        group = np.concatenate(([0], np.cumsum(new)))
        found = spanning_links(group, c[4].astype(np.int64).view(np.uint64), radius)
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    grouped = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least node reachable, for every node that has a link.

    Each round takes the least label among neighbours, then follows labels of labels, so the
    number of rounds is about the logarithm of a component's width. Each round's labels are
    checkpointed.
    """
    both = materialize(edges.select(F.col(a).alias("node"), F.col(b).alias("near")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near"))), "links")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("near")).alias("comp")), "labels")
    while True:
        offered = both.join(labels, "node").groupBy(F.col("near").alias("node")).agg(F.min("comp").alias("offer"))
        lower = labels.join(offered, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "offer").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        labels_next = materialize(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", "beyond").alias("comp")), "labels")
        if labels_next.filter("old <> comp").isEmpty():
            return labels
        labels = labels_next.drop("old")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, block: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(classes.select("fp"), radius, block))
    classes = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    ids = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    members = classes.join(ids, "comp").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
