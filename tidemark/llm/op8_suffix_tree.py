"""Language-model scores from a probabilistic suffix tree over words.

Tokens are the words of the text, A-Z lower-cased, then one end. The tree's root is the
add-0.1 unigram distribution of all training tokens. A sequence of words is a candidate
context where it occurs `min_count` times or more and so does one of its continuations; it is
retained where its next-symbol distribution diverges from that of its suffix: count * KL >=
`divergence`, over the explicit successors and the rest taken as one symbol. A retained
context mixes its absolutely discounted successors with its suffix's distribution, so every
distribution sums to one. Each token is scored in the longest retained suffix of the words
before it. Contexts grow word by word, a level after another, until none is retained or they
have `depth` words.

Counts and thresholds cover all training rows and are alike at every size, so the tree grows
with the corpus. It goes to the tasks as a broadcast while it has at most `most_entries` words
and sequences; a larger one is never collected: `by_joins` then counts, tests and scores by
joins of tables, with the same results.

Defined results: a null text counts as empty and has one token, the end; contexts don't cross
rows; repeated rows are trained on and scored each; a null id is scored, not trained on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, is_bucket, materialize, raw_texts, segment_sums, table, text_parts

END = b"\n"  # no word holds white space
PRIOR = 0.1


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


@dataclass
class Level:
    """Contexts of one length, each a place in the level below (a word, for the first level), with their successors."""

    codes: np.ndarray  # context * V + next, sorted
    probs: np.ndarray  # of each code, 0 where its context is not retained
    rest: np.ndarray  # by context: weight of the suffix's distribution, 1 where not retained


@dataclass
class SuffixTree:
    """Frequent words by number, and the levels of contexts above the root."""

    words: dict[bytes, int]
    root: np.ndarray  # probability of each frequent word
    levels: list[Level] = field(default_factory=list)

    def places(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[Level, np.ndarray, np.ndarray]]:
        """Each level with the context before every token and the place of context and token in it, -1 for none."""
        at = ids
        for level in self.levels:
            context = shifted(at, 1, starts)
            at = locate(level.codes, np.where((context >= 0) & (ids >= 0), context * len(self.words) + ids, -1))
            yield level, context, at

    def word_probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of every token; for an unlisted word (-1) only the weight of the root."""
        p = np.where(ids >= 0, self.root[ids], 1.0) if len(self.words) else np.ones(len(ids))
        for level, context, at in self.places(ids, starts):
            p = take(level.rest, context, 1.0) * p + take(level.probs, at)
        return p


def shifted(ids: np.ndarray, by: int, starts: np.ndarray) -> np.ndarray:
    """ids moved on by one position, -1 at the start of each row."""
    out = np.concatenate((np.full(by, -1), ids[:-by])) if len(ids) else ids
    out[starts] = -1
    return out


def locate(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the wanted values in sorted codes, -1 for those not there."""
    if not len(codes):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def take(values: np.ndarray, at: np.ndarray, other: float = 0.0) -> np.ndarray:
    return np.where(at >= 0, values[at], other) if len(values) else np.full(len(at), other)


def row_ids(raw: list[bytes], words: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Tokens of each text, their numbers end to end, and each text's bounds."""
    split = [tokens(t) for t in raw]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in split])))
    get = words.get
    ids = np.fromiter((get(w, -1) for t in split for w in t), np.int64, offsets[-1])
    return split, ids, offsets


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in text_parts(batch):
                for raw in raw_texts(part):
                    seen.update(tokens(raw))
                if len(seen) > 500_000:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def code_counts(texts: DataFrame, words, codes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], least: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes seen at least `least` times, sorted, and their counts; None where there are over `most`.

    Counted in each task first, in flushes of bounded size, then summed by code.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in text_parts(batch):
                _, ids, offsets = row_ids(raw_texts(part), words.value)
                held.append(codes_of(ids, offsets[:-1]))
                size += len(held[-1])
                if size > 4_000_000:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"code": pa.array(code), "n": pa.array(n.astype(np.int64))})

    counted = texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = materialize(counted, "codes")
    if found.count() > most:
        return None
    listed = found.toArrow().sort_by("code")
    return listed["code"].to_numpy(), listed["n"].to_numpy()


def retain(context: np.ndarray, joint: np.ndarray, total: np.ndarray, suffix: np.ndarray, divergence: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Successor probabilities, 0 below contexts that fail the test, and each context's rest.

    context: number of the context of each (context, next) row; joint: its count; total: count
    of each context; suffix: probability of next after the context's suffix.
    """
    n = len(total)
    share = joint / total[context]
    kl = np.bincount(context, share * np.log(share / suffix), n).astype(float)
    other = np.clip(1 - np.bincount(context, share, n), 0, 1)
    other_suffix = np.clip(1 - np.bincount(context, suffix, n), 1e-12, 1)
    kl += np.where(other > 1e-12, other * np.log(np.maximum(other, 1e-12) / other_suffix), 0)
    kept = (np.bincount(context, minlength=n) > 0) & (kl * total >= divergence)
    probs = np.where(kept[context], (joint - discount) / total[context], 0.0)
    return probs, np.where(kept, 1 - np.bincount(context, probs, n), 1.0)


def fit(texts: DataFrame, unigrams: DataFrame, total: int, distinct: int, min_count: int, depth: int, divergence: float, discount: float, most_entries: int) -> SuffixTree | None:
    """The suffix tree, or None where it has over most_entries words and sequences."""
    frequent = unigrams.filter(F.col("n") >= min_count)
    if frequent.count() > most_entries:
        return None
    listed = frequent.orderBy(F.desc("n"), "word").toArrow()
    joint, words = listed["n"].to_numpy(), {w: i for i, w in enumerate(listed["word"].to_pylist())}
    v = len(words)
    tree = SuffixTree(words, (joint + PRIOR) / (total + PRIOR * (distinct + 1)))
    if not v:
        return tree
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(words)
    suffixes: list[np.ndarray] = [np.zeros(v, np.int64)]  # by length of sequences: place of each one's suffix among the shorter ones
    entries = v

    def suffix_probability(length: int, at: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Probability of the following words in contexts of that length, given by their places."""
        if length < 0:
            return tree.root[following]
        level = tree.levels[length]
        below = suffix_probability(length - 1, suffixes[length][at], following)
        return level.rest[at] * below + take(level.probs, locate(level.codes, at * v + following))

    for m in range(depth):
        so_far = spark.sparkContext.broadcast(tree)

        def codes_of(ids: np.ndarray, starts: np.ndarray, so_far=so_far) -> np.ndarray:
            at = ids
            for _, _, at in so_far.value.places(ids, starts):  # noqa: B007
                pass
            context = shifted(at, 1, starts)
            good = (context >= 0) & (ids >= 0)  # what is frequent has a frequent beginning
            return context[good] * v + ids[good]

        counted = code_counts(texts, shared, codes_of, min_count, most_entries - entries)
        so_far.unpersist()
        if counted is None:
            return None
        codes, n = counted
        context, following = codes // v, codes % v
        below = suffix_probability(m - 1, suffixes[m][context], following)
        probs, rest = retain(context, n, joint, below, divergence, discount)
        if not probs.any():
            break
        suffixes.append(locate(tree.levels[m - 1].codes, suffixes[m][context] * v + following) if m else following)
        tree = SuffixTree(words, tree.root, [*tree.levels, Level(codes, probs, rest)])
        joint, entries = n, entries + len(codes)
    return tree


def by_joins(rows: DataFrame, learns: Column, unigrams: DataFrame, whole: float, min_count: int, depth: int, divergence: float, discount: float) -> DataFrame:
    """(rid, logs) of rows (rid, id, text): the same counts, tests and scores as tables joined by context.

    A context is its words joined by spaces. What is collected is whether a level retains any.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                words = [[w.decode() for w in tokens(raw)] for raw in raw_texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("learns"), pa.array(words, pa.list_(pa.string()))], ["rid", "learns", "words"])

    worded = rows.select("rid", "text", F.coalesce(learns, F.lit(False)).alias("learns")).mapInArrow(split, "rid long, learns boolean, words array<string>")
    before = lambda d: F.when(F.col("i") >= d, F.array_join(F.slice("words", F.col("i") + (1 - d), d), " "))
    names = [f"c{d}" for d in range(1, depth + 1)]
    places = materialize(worded.select("rid", "learns", "words", F.posexplode("words").alias("i", "next")).select("rid", "learns", "next", *(before(d).alias(c) for d, c in enumerate(names, 1))), "places")
    single = unigrams.select(F.col("word").cast("string").alias("next"), "n")
    root = (F.coalesce("n", F.lit(0)) + PRIOR) / F.lit(whole)
    levels: list[tuple[DataFrame, DataFrame]] = []

    def mixed(frame: DataFrame, contexts: list[str]) -> DataFrame:
        """frame with p: probability of next in the longest retained one of the contexts, shortest first."""
        out = frame.join(single, "next", "left").withColumn("p", root).drop("n")
        for c, (probs, rests) in zip(contexts, levels):
            out = out.join(rests.withColumnRenamed("context", c), c, "left").join(probs.withColumnRenamed("context", c), [c, "next"], "left")
            out = out.withColumn("p", F.coalesce("rest", F.lit(1.0)) * F.col("p") + F.coalesce("prob", F.lit(0.0))).drop("rest", "prob")
        return out

    sequences = single.filter(F.col("n") >= min_count).select(F.col("next").alias("context"), F.col("n").alias("total"))
    for d, c in enumerate(names, 1):
        counts = places.filter(F.col("learns") & F.col(c).isNotNull()).groupBy(F.col(c).alias("context"), "next").agg(F.count("*").alias("joint")).filter(F.col("joint") >= min_count)
        counts = materialize(counts.join(sequences, "context"), "counts")
        suffixes = [F.substring_index("context", " ", -k).alias(f"c{k}") for k in range(1, d)]
        rated = mixed(counts.select("*", *suffixes), [f"c{k}" for k in range(1, d)]).withColumn("share", F.col("joint") / F.col("total"))
        other, other_below = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sum("share"))), F.greatest(F.lit(1e-12), F.least(F.lit(1.0), 1 - F.sum("p")))
        kl = F.sum(F.col("share") * F.log(F.col("share") / F.col("p"))) + F.when(other > 1e-12, other * F.log(other / other_below)).otherwise(0.0)
        kept = rated.groupBy("context").agg((kl * F.first("total") >= divergence).alias("kept"), (1 - F.sum((F.col("joint") - discount) / F.col("total"))).alias("rest")).filter("kept").drop("kept")
        rests = materialize(kept, "rests")
        if rests.isEmpty():
            break
        levels.append((materialize(counts.join(rests.select("context"), "context", "left_semi").select("context", "next", ((F.col("joint") - discount) / F.col("total")).alias("prob")), "probs"), rests))
        sequences = counts.select(F.concat_ws(" ", "context", "next").alias("context"), F.col("joint").alias("total"))
    return mixed(places, names).groupBy("rid").agg(F.sum(F.log10("p")).alias("logs"))


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", min_count: int = 32, depth: int = 3, divergence: float = 20.0, discount: float = 0.75, most_entries: int = 8_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    learns: which rows train the model, over columns id and text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.filter(learns).select("text")
    unigrams = materialize(word_counts(texts), "unigrams")
    total, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = total + PRIOR * (distinct + 1)
    tree = fit(texts, unigrams, total, distinct, min_count, depth, divergence, discount, most_entries)
    joined = tree is None
    shared = docs.sparkSession.sparkContext.broadcast(SuffixTree({}, np.zeros(0)) if joined else tree)
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for part in text_parts(batch):
                split, ids, offsets = row_ids(raw_texts(part), tree.words)
                known = ids >= 0
                base = np.where(known, np.log10(tree.root[ids]), 0.0) if len(tree.words) else np.zeros(len(ids))
                logs = np.log10(tree.word_probabilities(ids, offsets[:-1]))
                rare = [Counter(t[i] for i in np.flatnonzero(~known[a:b])) for t, a, b in zip(split, offsets[:-1], offsets[1:])]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column("rid"), part.column("id"),
                    pa.array(np.diff(offsets)), pa.array(segment_sums(known, offsets)),
                    pa.array(segment_sums(base, offsets)), pa.array(segment_sums(logs, offsets)),
                    pa.ListArray.from_arrays(ends, pa.array([w for r in rare for w in r], pa.binary())),
                    pa.ListArray.from_arrays(ends, pa.array([n for r in rare for n in r.values()], pa.int64())),
                ], ["rid", "id", "n_tokens", "known", "base", "logs", "words", "times"])

    schema = "rid long, id long, n_tokens long, known long, base double, logs double, words array<binary>, times array<long>"
    numbered = materialize(numbered, "numbered") if joined else numbered  # both branches must see the same numbers
    partial = materialize(numbered.mapInArrow(scan, schema), "partial")
    rare = partial.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(unigrams, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    added = met.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + PRIOR) / F.lit(float(whole)))).alias("rare_base"),
    )
    more = F.coalesce("rare_base", F.lit(0.0))
    all_ = partial.drop("words", "times").join(added, "rid", "left")
    model = F.col("logs") + more
    if joined:
        deep = by_joins(numbered, learns, unigrams, float(whole), min_count, depth, divergence, discount)
        all_, model = all_.drop("logs").join(deep, "rid"), F.col("logs")
    return all_.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), model.alias("score"),
    )


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), crc_bucket(F.col("id"), 10) != 0)
    return scored.select("doc_id", is_bucket(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
