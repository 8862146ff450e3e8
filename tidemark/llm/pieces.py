"""Piece vocabulary of a public tokenizer, and array helpers that both piece operators use.

Text is handled as UTF-8 bytes. A pre-token is a run of spaces with the non-space run behind
it, or one newline, of any length. Pieces lie within one pre-token. Pre-tokens of up to
DENSE bytes are worked on all at once, byte by byte; the longer ones one after another.
The vocabulary file has merge ranks, no probabilities: a piece's unigram log-probability is
Zipf's law over its rank. Every byte has a fallback piece below all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

VOCAB_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DENSE = 48
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BITS = np.uint64(45)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1); kept in the process, up to one batch's length."""
    if len(_POWERS.get(int(base), ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[int(base)] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[int(base)][:n] if n else np.zeros(0, np.uint64)


def unique_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct value, and the number of the value at every position."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate((np.ones(min(len(values), 1), bool), ordered[1:] != ordered[:-1]))
    code = np.empty(len(values), np.int64)
    code[order] = np.cumsum(new) - 1
    return order[new], code


def byte_hash(raw: bytes) -> int:
    """Polynomial hash of a byte string modulo 2**64."""
    total, power = 0, 1
    for b in raw:
        total += (b + 1) * power
        power = power * int(_BASE) & 0xFFFFFFFFFFFFFFFF
    return total & 0xFFFFFFFFFFFFFFFF


@dataclass
class Vocabulary:
    """Pieces by hash (for encoding) and by id (for decoding)."""

    keys: np.ndarray  # sorted hashes of the pieces, spread over 64 bits, then padding
    ids: np.ndarray  # piece id of each key
    longest: int
    slots: np.ndarray  # first key with a given leading part, -1 if there is none
    chain: int  # most keys behind the first of a slot
    logp: np.ndarray  # by id
    blob: np.ndarray  # bytes of all pieces
    starts: np.ndarray  # by id, one more at the end
    byte_ids: np.ndarray  # by byte value
    table: dict[bytes, tuple[int, float]]  # id and log-probability by bytes

    def ending(self, word: bytes, j: int) -> Iterator[tuple[int, int, float]]:
        """(first byte, id, log-probability) of the pieces that end before byte j, short ones first."""
        get = self.table.get
        for i in range(j - 1, max(-1, j - self.longest - 1), -1):
            piece = get(word[i:j])
            if piece:
                yield i, *piece

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that are pieces, and their ids."""
        with np.errstate(over="ignore"):
            spread = hashes * _SPREAD
        slot = (spread >> _BITS).astype(np.int64)
        at = np.flatnonzero(self.slots[slot] >= 0)
        wanted, k = spread[at], self.slots[slot[at]]
        same = self.keys[k] == wanted
        for _ in range(self.chain):  # the few slots with several pieces
            miss = np.flatnonzero(~same)
            k[miss] += 1
            same[miss] = self.keys[k[miss]] == wanted[miss]
        return at[same], self.ids[k[same]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a sequence of ids, and the offset in them after each id."""
        lengths = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        where = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[where], ends


def build_vocabulary(pieces: list[tuple[int, bytes]], byte_ids: list[int]) -> Vocabulary:
    """pieces: (id, bytes) in rank order; byte_ids: id of each byte's fallback piece."""
    size = max([i for i, _ in pieces] + list(byte_ids)) + 1
    zipf = -np.log(np.arange(1, len(pieces) + 1))
    zipf -= np.log(np.exp(zipf).sum())
    logp = np.full(size, zipf[-1] - 2.0 if len(zipf) else -2.0)
    raw = [b""] * size
    for (i, b), p in zip(pieces, zipf):
        logp[i], raw[i] = p, b
    by_bytes = {bytes([value]): i for value, i in enumerate(byte_ids)}
    for b, i in by_bytes.items():
        raw[i] = b
    by_bytes |= {b: i for i, b in reversed(pieces)}
    with np.errstate(over="ignore"):
        keys = np.array([byte_hash(b) for b in by_bytes], np.uint64) * _SPREAD
    order = np.argsort(keys)
    keys = keys[order]
    slots = np.full(1 << (64 - int(_BITS)), -1, np.int32)
    used, first, counts = np.unique((keys >> _BITS).astype(np.int64), return_index=True, return_counts=True)
    slots[used] = first
    chain = int(counts.max()) - 1
    keys = np.concatenate((keys, np.zeros(chain + 1, np.uint64)))
    starts = np.zeros(size + 1, np.int64)
    np.cumsum([len(b) for b in raw], out=starts[1:])
    return Vocabulary(keys, np.append(np.array(list(by_bytes.values()), np.int64)[order], np.zeros(chain + 1, np.int64)), max(map(len, by_bytes)), slots, chain, logp, np.frombuffer(b"".join(raw), np.uint8), starts, np.array(byte_ids, np.int64), {b: (i, float(logp[i])) for b, i in by_bytes.items()})


def load_vocabulary(path: str = VOCAB_PATH) -> Vocabulary:
    """Read the pieces of a SentencePiece model file, on the driver; tasks get a broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((i, model.id_to_piece(i).replace("▁", " ").encode()))
    return build_vocabulary(pieces, byte_ids)


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every pre-token of texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    newline, space = data == 10, data == 32
    first = newline | (space & ~np.concatenate(([False], space[:-1]))) | np.concatenate(([False], newline[:-1]))
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(first)


@dataclass
class Words:
    """Distinct pre-tokens of a batch: those of up to DENSE bytes, longest first, and the others."""

    lengths: np.ndarray
    prefix: np.ndarray  # (longest + 1, words): hash of the first j bytes
    code: np.ndarray  # word of each occurrence, or its place in `long`
    starts: np.ndarray  # first byte of each occurrence
    is_long: np.ndarray  # of each occurrence
    long: list[bytes]  # sorted

    def active(self, j: int) -> int:
        """Number of words of j bytes or more."""
        return int(np.searchsorted(-self.lengths, -j, side="right"))


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts = pretoken_starts(data, offsets)
    lengths = np.diff(np.append(starts, len(data)))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        hashes = (sums[starts + lengths] - sums[starts]) * powers(_BASE_INV, len(data))[starts] if len(data) else sums[:0]
    del sums
    is_long = lengths > DENSE
    short = np.flatnonzero(~is_long)
    first, code = unique_codes(hashes[short])
    first = short[first]
    order = np.argsort(-lengths[first], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = first[order]
    n, longest = len(first), int(lengths[short].max(initial=0))
    prefix = np.zeros((longest + 1, n), np.uint64)
    every = np.empty(len(starts), np.int64)
    every[short] = rank[code]
    raw = [data[a : a + size].tobytes() for a, size in zip(starts[is_long], lengths[is_long])]
    long = sorted(set(raw))
    place = {w: i for i, w in enumerate(long)}
    every[is_long] = [place[w] for w in raw]
    words = Words(lengths[first], prefix, every, starts, is_long, long)
    step = powers(_BASE, longest)
    with np.errstate(over="ignore"):
        for j in range(longest):
            m = words.active(j + 1)
            prefix[j + 1, :m] = prefix[j, :m] + (data[starts[first[:m]] + j].astype(np.uint64) + np.uint64(1)) * step[j]
    return words


def pieces_ending(vocab: Vocabulary, end: np.ndarray, begin: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Which substrings from byte i are pieces, given the hashes of the prefixes around them."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE_INV), i, 1 << 64))
        return vocab.find((end - begin) * inverse)
