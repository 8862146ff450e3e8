"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character kinds, word
length, word variety and repetition, of the line itself and of the lines before and after it;
transitions tie neighbouring labels. Trained by likelihood with each line of a sample of
documents bearing its document's label. Forward-backward gives each line's chance of being
good; its mean, weighted by line length, is calibrated to the document's score.

Fitted on about `sample_docs` labelled rows of each class with texts of up to `most_chars`
characters (documented bounds); every text is scored whole.

Defined results: null, empty and blank texts have no line and score 0; rows without a label or
id teach nothing; of several labels of one document the highest holds; with no label of one
class to learn from every score is that class's (0 if there is none at all); repeated rows
are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, is_bucket, raw_texts, segment_sums, table, text_parts
from .op2_toxicity import labelled_sample

_KINDS = np.zeros((256, 6), bool)  # upper, digit, symbol, punctuation, white space, beyond ASCII
_KINDS[65:91, 0] = _KINDS[48:58, 1] = _KINDS[128:, 5] = True
_KINDS[[ord(c) for c in "#$%&*|<>{}=@^~_+/\\[]`"], 2] = True
_KINDS[[ord(c) for c in ".,;:!?\"'()-"], 3] = True
_KINDS[[32, *range(9, 14)], 4] = True
_CODES = np.zeros(256, np.uint8)  # number of a byte's kind, 0 for other letters
for _k in range(6):
    _CODES[_KINDS[:, _k]] = _k + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-blank line with those of its neighbours, lengths, texts' bounds."""
    lines, bounds, variety, length, repeated, shout = [], [0], [], [], [], []
    for text in texts:
        before = b""
        for line in text.split(b"\n"):
            words = line.split()
            if words:
                lines.append(line)
                variety.append(len(set(words)) / len(words))
                length.append(len(words))
                repeated.append(line == before)
                shout.append(line.count(b"!") / len(words))
                before = line
        bounds.append(len(lines))
    bounds = np.array(bounds)
    if not lines:
        return np.zeros((0, 37)), np.zeros(0), bounds
    size = np.array([len(x) for x in lines])
    data = _CODES[np.frombuffer(b"".join(lines), np.uint8)]
    row = np.repeat(np.arange(len(lines)), size)
    kinds = np.bincount(row * 8 + data, minlength=8 * len(lines)).reshape(-1, 8)[:, 1:7] / size[:, None]
    words = np.array(length)
    own = np.column_stack([kinds, np.minimum(size / words, 30) / 10, np.log1p(words), variety, np.log1p(words) * (1 - np.array(variety)), repeated, np.minimum(shout, 3)])
    first = np.zeros(len(lines), bool)
    first[bounds[:-1][bounds[:-1] < len(lines)]] = True
    last = np.append(first[1:], True)
    above = np.where(first[:, None], 0, np.vstack([own[:1], own[:-1]]))
    below = np.where(last[:, None], 0, np.vstack([own[1:], own[-1:]]))
    return np.column_stack([own, above, below, np.ones(len(lines))]), size.astype(float), bounds


def forward_backward(logit: np.ndarray, transition: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good for each line, pair marginals at each line but a text's first, log Z by text.

    All texts step through their lines together, longest first.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    start, count = bounds[order], n[order]
    score = np.column_stack([np.zeros(len(logit)), logit])
    alpha, beta = np.zeros((len(logit), 2)), np.zeros((len(logit), 2))
    longest = int(count[0]) if len(count) else 0
    alive = [int(np.searchsorted(-count, -t, side="left")) for t in range(longest)]  # texts with more than t lines
    for t in range(longest):
        at = start[: alive[t]] + t
        alpha[at] = score[at] + (np.logaddexp(alpha[at - 1, 0, None] + transition[0], alpha[at - 1, 1, None] + transition[1]) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        after = score[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(transition[:, 0] + after[:, :1], transition[:, 1] + after[:, 1:])
    log_z = np.zeros(len(n))
    ends = start + count - 1
    log_z[order] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    z = np.repeat(log_z, n)
    good = np.exp(alpha[:, 1] + beta[:, 1] - z)
    inner = np.ones(len(logit), bool)
    inner[bounds[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at - 1][:, :, None] + transition + (score[at] + beta[at])[:, None, :] - z[at][:, None, None])
    return np.clip(good, 0, 1), pairs, log_z


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float
    constant: float | None = None  # score of every text with a line, where nothing was learned

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return forward_backward((x - self.mean) / self.scale @ self.weights, self.transition, bounds)[0]


def weighted_logit(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    share = segment_sums(good * size, bounds) / np.maximum(segment_sums(size, bounds), 1)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def adam(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def train(sample: list[tuple[str, int]], rounds: int = 150, rate: float = 0.1, l2: float = 1e-3) -> QualityModel:
    """Likelihood ascent on the chain, then Platt calibration of the weighted marginals."""
    x, size, bounds = line_features([t.encode() for t, _ in sample])
    y = np.array([float(label) for _, label in sample])
    used = np.diff(bounds) > 0
    if not used.any() or y[used].min() == y[used].max():
        return QualityModel(np.zeros(37), np.ones(37), np.zeros(37), np.zeros((2, 2)), 1.0, 0.0, float(y[used].max()) if used.any() else 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    line_y = np.repeat(y, np.diff(bounds)).astype(int)
    first = np.zeros(len(z), bool)
    first[bounds[:-1][used]] = True
    d = z.shape[1]
    n_pairs = max(1, int((~first).sum()))
    real = np.zeros((2, 2))
    np.add.at(real, (line_y[~first], line_y[~first]), 1)

    def gradient(p: np.ndarray) -> np.ndarray:
        good, pairs, _ = forward_backward(z @ p[:d], p[d:].reshape(2, 2), bounds)
        return np.concatenate([z.T @ (good - line_y) / len(z) + l2 * p[:d], ((pairs.sum(axis=0) - real) / n_pairs).ravel() + 10 * l2 * p[d:]])

    p = adam(gradient, np.zeros(d + 4), rounds, rate)
    model = QualityModel(mean, scale, p[:d], p[d:].reshape(2, 2), 1.0, 0.0)
    logit = weighted_logit(model.marginals(x, bounds), size, bounds)[used]

    def platt(q: np.ndarray) -> np.ndarray:
        wrong = 1 / (1 + np.exp(-(q[0] * logit + q[1]))) - y[used]
        return np.array([(wrong * logit).mean() + 1e-3 * q[0], wrong.mean()])

    model.slope, model.offset = map(float, adam(platt, np.array([1.0, 0.0]), 300, 0.05))
    return model


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines, n_bad) of every row; n_bad: lines likelier bad than good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_parts(batch):
                x, size, bounds = line_features(raw_texts(part))
                good = model.marginals(x, bounds)
                score = 1 / (1 + np.exp(-(model.slope * weighted_logit(good, size, bounds) + model.offset)))
                if model.constant is not None:
                    score[:] = model.constant
                score[np.diff(bounds) == 0] = 0.0
                bad = segment_sums((good < 0.5).astype(np.int64), bounds)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(np.diff(bounds)), pa.array(bad)], ["id", "score", "n_lines", "n_bad"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, score double, n_lines long, n_bad long").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, sample_docs: int = 1500, most_chars: int = 50_000) -> QualityModel:
    return train(labelled_sample(docs, labels, "quality", learns, sample_docs, most_chars, "quality"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("id"), 3) != 1)
    return predict(docs, model).select("doc_id", is_bucket(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad")
