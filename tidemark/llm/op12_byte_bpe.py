"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

A pre-token's merges wait in one bucket for each merge rank, which holds positions of a linked
list of parts. A bitmap of two levels marks the buckets in use; find-first-set on each level
gives the lowest rank. Entries whose pair has changed meanwhile are stale and skipped. A merge
costs a constant number of steps, so pre-tokens of millions of bytes take time in proportion.
Within a rank the leftmost pair goes first. A pre-token that is itself in the vocabulary is one id.

Texts are cut into pre-tokens by the pattern; frequent ones are kept, encoded, by each worker
process. There is no shuffle, so a hot source or a group of copies has no effect.

Defined results: null and empty texts have no ids and decode to the empty text; bytes that are
no UTF-8 are read as U+FFFD; repeated rows are encoded each; special tokens in a text are ordinary text;
a row with ids outside the vocabulary, or with bytes that make no whole id, decodes to null.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, raw_texts, release_memory, table, text_parts

RANKS_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of a text that are cut at a time, encoded pre-tokens of a generation, and the longest kept.
SLICE, KEPT, KEPT_CHARS = 1 << 20, 1 << 18, 64
#: Bytes of a pre-token up to which its parts are in lists, which are faster than arrays and larger.
SHORT = 1 << 12
#: The rank of a pair that is not in the vocabulary.
_NONE = 1 << 60
#: A match never goes on from another character to white space, so texts can be cut between them.
_BOUNDARY = regex.compile(r"(?<=\S)\s")


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    """Merge ranks of a file of base64 tokens, read on the driver; tasks get a broadcast."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


class RankQueue:
    """Positions by rank, lowest rank first and leftmost first within it.

    Two levels of Python integers as bitmaps, 256 bits a word, hold 65,536 ranks: a bit of `words`
    for each bucket in use, a bit of `top` for each word with bits. More ranks make `top` longer.
    """

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // 256 + 1)
        self.top = 0
        self.buckets: list = [None] * (ranks + 1)  # a position, or [ascending positions, how many of them are taken, heap of those out of order]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = position
            w = rank >> 8
            self.words[w] |= 1 << (rank & 255)
            self.top |= 1 << w
            return
        if type(bucket) is int:
            bucket = self.buckets[rank] = [array("q", (bucket,)), 0, []]
        if position >= bucket[0][-1]:
            bucket[0].append(position)
        else:
            heappush(bucket[2], position)

    def pop(self) -> tuple[int, int]:
        """The rank and position that come first; (-1, -1) where there is none."""
        top = self.top
        if not top:
            return -1, -1
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        rank = w << 8 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if type(bucket) is int:
            position = bucket
        else:
            run, taken, late = bucket
            if late and (taken == len(run) or late[0] < run[taken]):
                position = heappop(late)
            else:
                position = run[taken]
                bucket[1] = taken = taken + 1
            if late or taken < len(run):
                return rank, position
        self.buckets[rank] = None
        self.words[w] = word = word & word - 1
        if not word:
            self.top = top & top - 1
        return rank, position


class Encoder(dict):
    """Little-endian ids by pre-token; those of up to KEPT_CHARS are kept once encoded.

    They are kept in two generations: a full one becomes the old one, whose words come back when they
    are seen again, so frequent words stay.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}
        self.queue = RankQueue(max(ranks.values()))

    def age(self) -> None:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if word in self.old:
            self[word] = self.old[word]
            return self[word]
        raw = word.encode()
        whole = self.ranks.get(raw)
        parts = (whole,) if whole is not None else self.merged(raw)
        ids = pack(f"<{len(parts)}I", *parts) if len(parts) <= KEPT_CHARS else np.asarray(parts, "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids

    def merged(self, word: bytes) -> list[int] | array:
        """Ids of the parts that are left when no two neighbours are in the vocabulary together.

        A pair waits in the queue only while neither of the pairs that it overlaps goes first, so the first
        pair of all is always there and the others are few.
        """
        get, push, pop, n = self.ranks.get, self.queue.push, self.queue.pop, len(word)
        numbers = list if n <= SHORT else lambda values: array("q", values)
        # A part starts at i and ends before after[i]; pair[i] is the rank of it and the next part together.
        # Two more places stand for what is before the first part and after the last.
        after, before, pair = numbers(range(1, n + 3)), numbers(range(-1, n + 1)), numbers([_NONE]) * (n + 2)
        for i in range(n - 1):
            pair[i] = get(word[i : i + 2], _NONE)
        before[0] = n + 1
        last = _NONE
        for i in range(n - 1):
            rank = pair[i]
            if rank < last and rank <= pair[i + 1] and rank != _NONE:
                push(rank, i)
            last = rank
        rank, i = pop()
        while rank >= 0:
            if pair[i] == rank:
                gone, left = after[i], before[i]
                end = after[i] = after[gone]
                was_left, was_gone = pair[left], pair[gone]
                pair[gone] = _NONE
                right = pair[i] = get(word[i : after[end]], _NONE) if end < n else _NONE
                far = pair[end]  # of the parts behind the merged one
                if end < n:
                    before[end] = i
                    if was_gone <= far < right and far <= pair[after[end]]:
                        push(far, end)
                new_left = _NONE
                if i:
                    new_left = pair[left] = get(word[left:end], _NONE)
                    beyond = before[left]
                    first = pair[beyond]
                    if was_left < first <= new_left and first != _NONE and first < pair[before[beyond]]:
                        push(first, beyond)
                    if new_left < first and new_left <= right and new_left != _NONE:
                        push(new_left, left)
                if right < new_left and right <= far and right != _NONE:
                    push(right, i)
            rank, i = pop()
        out, i = numbers(()), 0
        while i < n:
            end = after[i]
            out.append(self.ranks[word[i:end]])
            i = end
        return out


_ENCODERS: list[Encoder] = []


def kept_encoder(ranks: dict[bytes, int]) -> Encoder:
    """This process's encoder of a vocabulary, with the words that earlier tasks have met."""
    if not _ENCODERS or _ENCODERS[0].ranks != ranks:
        _ENCODERS[:] = [Encoder(ranks)]
    return _ENCODERS[0]


def slices(text: str, limit: int) -> Iterator[str]:
    """The text in parts of about `limit` characters that match as they do in the whole."""
    start = 0
    while len(text) - start > limit and (cut := _BOUNDARY.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS_PATH, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, n_tokens, ids) of every row; ids is binary, each id a little-endian unsigned 32-bit integer."""
    bounded_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, encoder = regex.compile(pattern), kept_encoder(ranks.value)
        look_up = encoder.__getitem__
        for batch in batches:
            for part in text_parts(batch):
                ids = []
                for raw in raw_texts(part):
                    ids.append(b"".join(b"".join(map(look_up, cut.findall(s))) for s in slices(raw.decode(errors="replace"), SLICE)))
                    encoder.age()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ids_col: str = "ids", path: str = RANKS_PATH) -> DataFrame:
    """The rows of `tokens` with a binary column `decoded`: the bytes of their ids."""
    bounded_batches(tokens.sparkSession)
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = {rank: token for token, rank in ranks.value.items()}.__getitem__

        def text(raw: bytes | None) -> bytes | None:
            try:
                return b"".join(b"".join(map(look_up, np.frombuffer(raw or b"", "<u4", min(SLICE, len(raw or b"") // 4 - i), 4 * i).tolist())) for i in range(0, len(raw or b"") // 4, SLICE)) if len(raw or b"") % 4 == 0 else None
            except KeyError:
                return None

        for batch in batches:
            for part in text_parts(batch, ids_col):
                yield part.append_column("decoded", pa.array([text(raw) for raw in part.column(ids_col).to_pylist()], pa.binary()))
        release_memory()

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in tokens.dtypes)
    return tokens.mapInArrow(run, f"{kinds}, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
