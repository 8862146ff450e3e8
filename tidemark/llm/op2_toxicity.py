"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the document is labelled. A sentence's score is
logistic in its words and their four and five letter beginnings; a document's score is the
noisy-or of its sentences, 1 - prod(1 - p). Both are trained together from document labels,
so the sentence scores say where the offence is.

Fitted on about `sample_docs` labelled rows of each class with texts of up to `most_chars`
characters (documented bounds); every text is scored whole.

Defined results: null and empty texts have no sentence and score 0; rows without a label or
id teach nothing; of several labels of one document the highest holds; with no label of one
class to learn from every score is 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, hash_share, is_bucket, table, text_parts

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_+=/\\`~^@0123456789"


def features(word: str) -> tuple[str, ...]:
    """The word without what is not a letter at its edges, and its beginnings."""
    word = word.strip(_EDGES)
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word,) if word else ()


def sentences(text: str | None) -> list[str]:
    return [s.lower() for s in _SENTENCE.findall(text)] if text else []


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learns: Column, rows_of_class: int, most_chars: int, seed: str) -> list[tuple[str, int]]:
    """(text, label) of about rows_of_class labelled documents of each class, in order of id.

    Of several texts of one id the one of least hash is taken, so a model depends on the rows alone.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(learns & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("label") == value) & hash_share(F.col("id"), n, rows_of_class, seed))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= most_chars)
    chosen = texts.join(F.broadcast(known.filter(keep)), "id")  # about rows_of_class ids a class
    one = chosen.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return [(r["text"], r["label"]) for r in one.orderBy("id").select("text", "label").toLocalIterator()]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def train(sample: list[tuple[str, int]], least_docs: int = 5, lift: float = 3.0, rounds: int = 600, rate: float = 0.5, l2: float = 1e-5) -> ToxicityModel:
    """Noisy-or likelihood ascent over features found more often in positive documents.

    Features of fewer than least_docs documents, or not `lift` times likelier in positive
    ones, are left out: a bag is positive for a reason that its sentences show.
    """
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, -np.inf)
    seen = (Counter(), Counter())
    bags = []
    for text, label in sample:
        bag = [{f for w in set(s.split()) for f in features(w)} for s in sentences(text)]
        bags.append(bag)
        seen[int(label)].update(set().union(*bag))
    share = [max(1, int((y == k).sum())) for k in (0, 1)]
    names = sorted(f for f, n in seen[1].items() if n >= least_docs and (n + 0.5) / share[1] > lift * (seen[0][f] + 0.5) / share[0])
    number = {f: i for i, f in enumerate(names)}
    doc, sentence, feature, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for words in bag:
            doc.append(d)
            hit = [number[f] for f in words if f in number]
            feature += hit
            sentence += [n] * len(hit)
            n += 1
    doc, sentence, feature = (np.array(x, np.int64) for x in (doc, sentence, feature))
    w, b = np.zeros(len(names)), -9.0
    sum_w, sum_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        logit = b + np.bincount(sentence, w[feature], n)
        total = np.bincount(doc, np.logaddexp(0, logit), len(y))  # -log of the chance that none offends
        pull = np.where(y > 0, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) / len(y)
        slope = pull[doc] / (1 + np.exp(-logit))
        grad_w, grad_b = np.bincount(feature, slope[sentence], len(names)) + l2 * w, slope.sum()
        sum_w, sum_b = sum_w + grad_w**2, sum_b + grad_b**2
        w, b = w - rate * grad_w / np.sqrt(sum_w), b - rate * grad_b / np.sqrt(sum_b)
    return ToxicityModel({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(b))


class _Weights(dict):
    """Summed feature weight of every token met in this task."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        self[word] = weight = self.model.weight(word)
        return weight


def predict(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_sentences, offending array<struct<first, last, score>>) of every row.

    offending: character range and score of the sentences with a score of 0.5 or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = _Weights(model)
        quiet = float(np.logaddexp(0, model.bias))
        for batch in batches:
            for part in text_parts(batch):
                if len(weights) > 500_000:
                    weights.clear()
                scores, counts, found = [], [], []
                for text in part.column("text").to_pylist():
                    total, offending, number = 0.0, [], 0
                    for number, span in enumerate(_SENTENCE.finditer(text or ""), 1):
                        weight = sum(map(weights.__getitem__, set(span[0].lower().split())))
                        if not weight:
                            total += quiet
                            continue
                        logit = model.bias + weight
                        total += float(np.logaddexp(0, logit))
                        if logit >= 0:
                            offending.append({"first": span.start(), "last": span.end(), "score": 1 / (1 + np.exp(-logit))})
                    scores.append(-float(np.expm1(-total)))
                    counts.append(number)
                    found.append(offending)
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(found, kind)], ["id", "score", "n_sentences", "offending"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, score double, n_sentences int, offending array<struct<first: int, last: int, score: double>>").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, sample_docs: int = 2000, most_chars: int = 50_000) -> ToxicityModel:
    return train(labelled_sample(docs, labels, "toxic", learns, sample_docs, most_chars, "toxicity"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("id"), 5) != 0)
    return predict(docs, model).select(
        "doc_id", is_bucket(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences", F.size("offending").alias("n_offending"), F.xxhash64("offending").alias("offending_digest"), "offending",
    )
