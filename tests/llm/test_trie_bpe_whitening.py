"""The prefix trie against a plain one, byte-level BPE against tiktoken, whitening against numpy."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import op11_prefix_trie as op11
from tidemark.llm import op12_byte_bpe as op12
from tidemark.llm import op13_whitening as op13
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn int, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    """All nodes as (conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), sorted."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = (*own.get(c - int(math.fmod(c, 100)), ())[:h], *v[h:])
    members, children, total = defaultdict(list), defaultdict(list), {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [total[x] for x in children[node]]
        total[node] = saved + sum(s for s, _ in below), sum(n for _, n in below) or 1
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), total[node][1], total[node][0], hashlib.sha256(ends(node).encode()).hexdigest()) for node, m in members.items())


def trie(spark, rows):
    return sorted(tuple(r) for r in op11.prefix_trie(*op11.rebuilt(op11.turns(spark.createDataFrame(rows, TURNS)))).collect())


def test_trie_of_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(0, 60), *range(101, 130), -3, -250, 2**40]:  # of 100 and -200 there is no conversation
        for t in range(rng.choice([1, 2, 3, 7, 12])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "a", "\U0001f600é", "", None])))
    rows += rows[:25] + [(None, 1, "user", "x")]
    rng.shuffle(rows)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_nested_branchings(spark):
    """Each conversation leaves the one before it a turn later, so as many rounds are needed."""
    rows = [(100 * i, t, "user", "same" if t < i else f"own {i} {t}") for i in range(7) for t in range(i + 7)]
    rows += [(100 * i + 1, t, "user", "same" if t < 9 else f"tail {i}") for i in range(3) for t in range(12)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_a_very_long_conversation_and_many_copies(spark, monkeypatch):
    """Most rows in one conversation, and most conversations alike; blobs and joins are cut small."""
    monkeypatch.setattr(op11, "BLOB", 40)
    monkeypatch.setattr(op11, "BLOCK", 100)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3000)] + [(1000 + i, t, "user", f"w{t}") for i in range(400) for t in range(6)]
    assert trie(spark, rows) == plain_trie(rows)


def test_running_sums_of_a_key_in_many_blocks(spark):
    rows = [(1, i, i % 5) for i in range(2000)] + [(k, i, 1) for k in range(2, 40) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    blocks = df.repartitionByRange(8, "k", "i").filter("k = 1").select(F.spark_partition_id().alias("b")).distinct().count()
    assert blocks > 4
    got = {(r["k"], r["i"]): (r["s"], r["last"]) for r in op11.running(df, "k", [F.col("i").asc()], {"s": F.col("v")}, "test").collect()}
    want = {}
    for k, i, v in rows:
        before = want[k, i - 1][0] if i else 0
        want[k, i] = (before + v, i == (1999 if k == 1 else 2))
    assert got == want


def test_trie_oracle_and_no_rows(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(ORACLES["op11_prefix_trie"])
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert got.columns == want.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall())
    given = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows == plain_trie([tuple(r) for r in given])
    assert trie(spark, [(None, 1, "user", "x")]) == []
    assert trie(spark, [(7, 1, None, None)]) == plain_trie([(7, 1, None, None)])


@pytest.fixture(scope="module")
def coder():
    ranks = op12.load_ranks()
    return op12.Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text, limit=op12.SLICE):
    cut = regex.compile(public_tokenizers.PATTERN)
    return np.frombuffer(b"".join(encoder[m] for s in op12.slices(text, limit) for m in cut.findall(s)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab é\n'st1.", max_size=60), st.text("aaaab", min_size=20, max_size=200)), st.integers(1, 40))
def test_ids_are_tiktokens(coder, text, limit):
    encoder, want = coder
    assert ids(encoder, text) == ids(encoder, text, limit) == want.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 60_001, " " * 20_000, "ab" * 9_000, "thequickbrown" * 2_000, "é" * 7_001, "\n " * 3_000, "aab" * 5_000 + "1" * 5_000, "'s't" * 2_000, "<|endoftext|>"])
def test_ids_of_long_pretokens_are_tiktokens(coder, text):
    assert ids(coder[0], text) == coder[1].encode_ordinary(text)
    assert not coder[0].queue.top and not any(coder[0].queue.words) and all(b is None for b in coder[0].queue.buckets), "the queue is left empty"


def test_every_character_is_cut_as_tiktoken_cuts_it(coder):
    for at in range(0, 0x110000, 16):
        text = "".join(f"a{c}b 1{c} {c}{c}  " for c in map(chr, range(at, at + 16)) if not 0xD800 <= ord(c) < 0xE000)
        if ids(coder[0], text) != coder[1].encode_ordinary(text):
            raise AssertionError(hex(at))


def test_queue_takes_the_lowest_rank_and_the_leftmost_position():
    rng, queue, held = random.Random(4), op12.RankQueue(70_000), []
    for _ in range(5_000):
        if held and rng.random() < 0.45:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            held.append((rng.choice([0, 255, 256, 65_535, 65_536, 70_000, rng.randrange(300)]), rng.randrange(1000)))
            queue.push(*held[-1])
    assert [queue.pop() for _ in held] == sorted(held) and queue.pop() == (-1, -1)


def test_encoding_and_decoding_of_odd_texts(spark, coder):
    texts = [None, "", " ", "x" * 300_000, "é\U0001f600 it's 12 \n\n x", "<|endoftext|>", "a b" * 70_000, "same", "same"]
    rows = [(i if i != 4 else None, t, 1, "z") for i, t in enumerate(texts)]
    got = op12.decode(op12.encode(spark.createDataFrame(rows, "doc_id int, text string, ids int, decoded string"))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = by_id[i if i != 4 else None], coder[1].encode_ordinary(text or "")
        assert (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) == (len(want), want, (text or "").encode())
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\xff")), (2, bytearray(b"abc")), (3, None), (4, bytearray(b"\x00\x00\x00\x00"))], "doc_id int, ids binary")
    first = coder[1].decode_bytes([0])
    assert {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in op12.decode(bad).collect()} == {1: None, 2: None, 3: b"", 4: first}
    broken = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF62') AS STRING) AS text")
    assert bytes(op12.decode(op12.encode(broken)).first()["decoded"]).decode() == "a�b"


def test_digests_of_the_bpe_query(spark, coder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = coder[1].encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def check_whitening(got, kept, k=8):
    """Rows of `whiten` against numpy on the vectors that take part."""
    x = np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = (x * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    at = {i: j for j, (i, _) in enumerate(kept)}
    assert len(got) == n * k
    whitened = np.full((n, k), np.nan)
    for r in got:
        i, c = at[r["vec_id"]], r["component"] - 1
        whitened[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert r["explained"] == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-9)
        assert r["identity_error"] < 1e-9
    want = centred @ vectors / np.sqrt(values)
    signs = np.sign((whitened * want).sum(0))
    assert np.abs(whitened * signs - want).max() < 1e-6
    assert np.abs(whitened.T @ whitened / n - np.eye(k)).max() < 1e-9


def test_whitening_of_the_given_vectors(spark):
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op13_whitening"](spark, SF).collect(), kept)


def test_whitening_leaves_out_broken_vectors(spark):
    rng = np.random.default_rng(2)
    kept = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1] + 50).tolist()) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [nan] * 5), (903, [1.0, inf, 1.0, 1.0, 1.0]), (904, []), (905, [1.0]), (906, [1.0] * 6), (907, [1e30] * 5)]
    schema = "vec_id int, embedding array<double>, n string, whitened int"
    frame = spark.createDataFrame([(*r, "x", 1) for r in kept + odd], schema)
    check_whitening(op13.whiten(frame).collect(), kept, 5)
    assert {r["component"] for r in op13.whiten(frame, components=2).collect()} == {1, 2}


def test_whitening_of_large_entries_is_exact(spark):
    """n x - S is beyond 64 bits when squared, and the offset is much larger than the variance."""
    rng = np.random.default_rng(3)
    kept = [(i, (1e9 + rng.standard_normal(4) * [8, 4, 2, 1]).tolist()) for i in range(300)] + [(400, [2.0**51, 0.0, 0.0, 0.0])]
    got = op13.whiten(spark.createDataFrame(kept, "vec_id long, embedding array<double>")).collect()
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    sums = [sum(map(int, c)) for c in x.T]
    for r in got:
        i = [j for j, (v, _) in enumerate(kept) if v == r["vec_id"]][0]
        exact = sum((len(x) * int(a) - s) ** 2 for a, s in zip(x[i], sums))
        assert r["deviation"] == (exact if exact < 2**63 else None)
        assert r["identity_error"] < 1e-4


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert op13.whiten(frame([(1, [1.0, 2.0])])).collect() == op13.whiten(frame([(i, [1.0, 2.0]) for i in range(9)])).collect() == op13.whiten(frame([(1, None)])).collect() == []
    line = op13.whiten(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(50)] * 2)).collect()
    assert len(line) == 100 and {r["component"] for r in line} == {1}
    assert line[0]["explained"] == pytest.approx(1.0)
