"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch form a trie, held level by level; the best unigram score
and its piece count are computed once for each node, so once for each shared prefix, and a
word's count is read at its terminal node. The few pre-tokens over DENSE bytes are walked in
sorted order, which is the trie's own: each goes on from the prefix it shares with the one
before it. A text's count is the sum over its pre-tokens.
There is no shuffle: a frequent word costs one trie path a batch, wherever its rows lie.

Defined results: null and empty texts count 0 pieces and 0 pre-tokens; equal scores go to
fewer pieces; repeated rows are counted each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import segment_sums, table, text_bytes, text_parts
from .pieces import VOCAB_PATH, Vocabulary, Words, distinct_words, load_vocabulary, pieces_ending, unique_codes


def terminal_counts(words: Words, vocab: Vocabulary) -> np.ndarray:
    """Pieces on the best path of every distinct word."""
    n, longest = len(words.lengths), len(words.prefix) - 1
    out = np.zeros(n, np.int64)
    node_of = [np.zeros(n, np.int64)]  # trie node of each word's prefix, by depth
    best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    for j in range(1, longest + 1):
        m = words.active(j)
        rep, nodes = unique_codes(words.prefix[j, :m])
        node_of.append(nodes)
        score, pieces = np.full(len(rep), -np.inf), np.zeros(len(rep), np.int64)
        for size in range(1, min(j, vocab.longest) + 1):
            i = j - size
            at, ids = pieces_ending(vocab, words.prefix[j, rep], words.prefix[i, rep], i)
            above = node_of[i][rep[at]]
            s, c = best[i][above] + vocab.logp[ids], count[i][above] + 1
            better = (s > score[at]) | ((s == score[at]) & (c < pieces[at]))
            score[at[better]], pieces[at[better]] = s[better], c[better]
        best.append(score)
        count.append(pieces)
        ends = slice(words.active(j + 1), m)
        out[ends] = pieces[nodes[ends]]
    return out


def long_counts(words: list[bytes], vocab: Vocabulary) -> list[int]:
    """Pieces on the best path of each of the sorted words."""
    best, count, last, out = [0.0], [0], b"", []
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        del best[shared + 1 :], count[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            score, pieces = -np.inf, 0
            for i, _, logp in vocab.ending(word, j):
                s, c = best[i] + logp, count[i] + 1
                if s > score or (s == score and c < pieces):
                    score, pieces = s, c
            best.append(score)
            count.append(pieces)
        out.append(count[-1])
        last = word
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: Vocabulary | None = None, path: str = VOCAB_PATH) -> DataFrame:
    """(id, n_tokens, n_pretokens, n_bytes) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab or load_vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, limit=2 << 20):
                data, offsets = text_bytes(part)
                words = distinct_words(data, offsets)
                each = np.zeros(len(words.code), np.int64)
                each[~words.is_long] = terminal_counts(words, shared.value)[words.code[~words.is_long]]
                each[words.is_long] = np.array(long_counts(words.long, shared.value), np.int64)[words.code[words.is_long]]
                bounds = np.searchsorted(words.starts, offsets)
                columns = [segment_sums(each, bounds), np.diff(bounds), np.diff(offsets)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_tokens", "n_pretokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_tokens long, n_pretokens long, n_bytes long").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
