"""Language identification, word first.

A word that the training sample knows scores the log frequency it has in each language. An
unseen word backs off: at each of its positions the longest known character n-gram that
starts there is taken, from five characters down to one, and the word scores their mean log
frequency. A text's language maximises the sum over its words; the score is the posterior.

The model is fitted on about `sample_docs` labelled rows of each language (a documented
bound, chosen by a hash of the row's id), so what is broadcast is bounded as well. Every text
is scored whole.

Defined results: `und` with score 0 for a null text and one without a letter; `und` for all
if nothing can be learned; ties go to the alphabetically first language; rows with a null
language or id teach nothing, rows with a null id are scored as not held out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, hash_share, is_bucket, segment_sums, table, text_parts

UNDETERMINED = "und"
LONGEST = 5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    low = text.lower()
    found = _WORD.findall(low)
    if found and not "".join(found).isalpha():  # numerals that `\w` takes as well, such as fractions
        found = _WORD.findall("".join(c if c.isalpha() else " " for c in low))
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray  # (words, languages)
    grams: dict[str, int]
    gram_logs: np.ndarray

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest known n-gram at each position."""
        padded, rows, get = f"<{word}>", [], self.grams.get
        for i in range(len(padded)):
            for n in range(LONGEST, 0, -1):
                row = get(padded[i : i + n])
                if row is not None:
                    rows.append(row)
                    break
        return rows


def log_frequencies(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
    """Row of each key of any language, and add-half log frequencies by row and language."""
    rows = {k: i for i, k in enumerate(sorted(set().union(*counts)))}
    logs = np.zeros((len(rows), len(counts)))
    for at, seen in enumerate(counts):
        logs[[rows[k] for k in seen], at] = list(seen.values())
    return rows, np.log((logs + 0.5) / (logs.sum(axis=0) + 0.5 * max(1, len(rows))))


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500, min_count: int = 3) -> LanguageModel:
    """Word and n-gram frequencies of a bounded sample of labelled rows.

    Reads the rows where `usable` holds and the language is known. Words seen less than
    min_count times in a language are left out.
    """
    learn = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(usable & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    languages = sorted(sizes)
    keep = F.lit(False)
    for lang in languages:
        keep = keep | ((F.col("lang") == lang) & hash_share(F.col("id"), sizes[lang], sample_docs, "language"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > 100_000:
                yield from rows(seen)
                seen.clear()
        yield from rows(seen)

    def rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    totals = learn.filter(keep).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = {lang: Counter() for lang in languages}
    grams = {lang: Counter() for lang in languages}
    for lang, word, n in totals.filter(F.col("n") >= min_count).toPandas().itertuples(index=False):
        words[lang][word] = n
        padded = f"<{word}>"
        grams[lang].update(padded[i : i + size] for size in range(1, LONGEST + 1) for i in range(len(padded) - size + 1))
    for lang in languages:
        grams[lang] = Counter({g: n for g, n in grams[lang].items() if n >= min_count or len(g) == 1})
    return LanguageModel(languages, *log_frequencies(list(words.values())), *log_frequencies(list(grams.values())))


class _Rows(dict):
    """Row of every word met in this task; unseen words get theirs from the backoff."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.words)
        self.model, self.pending = model, []
        self.logs, self.used = np.concatenate((model.word_logs, np.zeros((150_000, len(model.languages))))), len(model.words)

    def __missing__(self, word: str) -> int:
        self[word] = at = self.used + len(self.pending)
        self.pending.append(self.model.backoff(word))
        return at

    def settle(self) -> np.ndarray:
        """Log frequencies by row, those of the words met since the last call included."""
        sizes = np.array([len(x) for x in self.pending], np.int64)
        end = self.used + len(sizes)
        if end > len(self.logs):
            self.logs = np.concatenate((self.logs, np.zeros((end, self.logs.shape[1]))))
        flat = np.fromiter((r for rows in self.pending for r in rows), np.int64, sizes.sum())
        self.logs[self.used : end] = segment_sums(self.model.gram_logs[flat], np.concatenate(([0], np.cumsum(sizes)))) / np.maximum(sizes, 1)[:, None]
        self.used, self.pending = end, []
        return self.logs


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """(id, keep..., text, lang_out, score_out) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, names = None, [*model.languages, UNDETERMINED]
        for batch in batches:
            for part in text_parts(batch):
                if known is None or known.used - len(model.words) > 100_000:
                    known = _Rows(model)
                found = [words_of(t) for t in part.column("text").to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(w) for w in found])))
                rows = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, offsets[-1])
                if model.languages:
                    total = segment_sums(known.settle()[rows], offsets)
                    best = total.argmax(axis=1)
                    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    best, posterior = np.zeros(len(found), int), np.zeros(len(found))
                none = (np.diff(offsets) == 0) | (not model.languages)
                best[none], posterior[none] = len(model.languages), 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([names[b] for b in best], pa.string()), pa.array(posterior, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(score, f"{schema}, lang_pred string, score double").withColumnsRenamed({"id": id_col, "text": text_col, "lang_pred": lang_out, "score": score_out} | {f"kept_{i}": c for i, c in enumerate(keep)})


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, crc_bucket(F.col("id"), 4) != 2)
    return predict(docs, model).select("doc_id", is_bucket(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
