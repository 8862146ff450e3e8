"""The training-data queries against brute force, planted cases, held-out labels and edge rows."""

import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import near_copies, op4_simhash, op7_chunks, op9_decontaminate
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, fp long, score double, words string, digest long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    extra = (1, 2, 0.5, "x", 3)
    long = prose(rng, 20_000)
    rows = [(i, prose(rng, 40), rng.choice(["en", "fr"]), "s", 1, *extra) for i in range(60)]
    rows += [(60, None, None, None, None, *[None] * 5), (61, "", "en", "s", 0, *extra), (62, long, "en", "s", 1, *extra), (62, long, "en", "s", 1, *extra)]
    rows += [(None, "no id here at all", "en", "s", 1, *extra), (63, rows[0][1], "en", "s", 1, *extra), (63, "another text of that id", "en", "s", 1, *extra), (64, " \n\t", "en", "s", 3, *extra), (65, "é\U0001f600 1234 ...", "en", "s", 3, *extra)]
    at = str(tmp_path_factory.mktemp("odd"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    write("documents", rows, DOCS)
    write("labels", [(i, i % 2, i % 3 % 2) for i in range(60)] + [(61, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    write("benchmark", [(1, rows[3][1]), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    write("conversations", [(i % 5, i, "user", f"turn {i % 3}", 0) for i in range(30)] + [(7, None, None, None, None), (None, 1, "user", "x", 1), (8, 1, "user", "", 1), (8, 1, "user", "", 1)], "conv_id long, turn int, role string, text string, depth int")
    write("embeddings", [(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(50)] + [(50, None, 0), (51, [0.0] * 3, 0), (52, [1.0, None, 2.0], 0), (None, [1.0] * 3, 0), (53, [float("nan"), 1.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    return at, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    at, rows = odd
    got = QUERIES[name](spark, at).collect()
    if name not in ("op1_additive", "op7_chunks", "op9_decontaminate", "op11_prefix_trie", "op13_whitening"):
        assert len(got) == len(rows)
    assert got


def test_pipeline_on_odd_rows(spark, odd):
    got = corpus_pipeline.run(spark, odd[0]).collect()
    assert got and all(r["lossless"] for r in got)
    assert 3 not in {r["doc_id"] for r in got}, "the document that is a benchmark item goes"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, odd, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{odd[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def simhash(text):
    words = text.lower().split()
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)]
    for i in range(60):  # near copies: a word appended or changed
        words = texts[rng.randrange(80)].split()
        if words:
            words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    fps = [simhash(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op4_simhash.near_duplicates(docs, block=8).collect()}
    assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == least


def test_search_recall(spark):
    got = {}
    for r in QUERIES["op1_additive"](spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        best = [i for i in sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if ids[i] != q][:20]
        assert len(got[q]) == 20
        hits, total = hits + sum(int(ids[i]) in got[q] for i in best), total + 20
    assert hits / total >= 0.9


def test_repeated_passage_is_found_and_cut(spark):
    rng = random.Random(2)
    shared = prose(rng, 70)
    texts = [f"{prose(rng, 50)} {shared} {prose(rng, 50)}" if i < 3 else prose(rng, 150) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = op7_chunks.repeated_passages(docs)
    assert {r["doc_id"] for r in passages.collect()} == {0, 1, 2}
    left = {r["doc_id"]: r["text"] for r in op7_chunks.remove_passages(docs, passages).collect()}
    assert left[0] == texts[0] and all(left[i] == texts[i] for i in range(3, 20))
    assert all(len(left[i]) < len(texts[i]) - len(shared) // 2 for i in (1, 2))


def test_leaks_and_paraphrases_are_found(spark):
    rng = random.Random(3)
    items = [prose(rng, 40) for _ in range(5)]
    changed = items[1].split()
    changed[5:7] = ["other", "words"]
    texts = [prose(rng, 200) + " " + items[0] + " " + prose(rng, 30), prose(rng, 77) + " " + " ".join(changed), *(prose(rng, 300) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op9_decontaminate.contaminated(docs, bench).collect()} == {(0, 0), (1, 1)}


def test_pieces_come_back(spark):
    got = QUERIES["op6_sampling"](spark, SF)
    assert got.filter("NOT lossless").count() == 0
    assert sorted(got.collect()) == sorted(QUERIES["op6_sampling"](spark, SF).repartition(3).collect())


def accuracy(pairs):
    pairs = list(pairs)
    assert len(pairs) > 20
    return sum(a == b for a, b in pairs) / len(pairs)


def test_held_out_language(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op5_language_id"](spark, SF).filter("held_out AND lang_pred <> 'und'").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert accuracy((r["lang_pred"], docs[r["doc_id"]]) for r in rows) > 0.9


@pytest.mark.parametrize("name, label", [("op2_toxicity", "toxic"), ("op10_quality", "quality")])
def test_held_out_labels(spark, name, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[label] is not None}
    rows = [r for r in QUERIES[name](spark, SF).filter("held_out").collect() if r["doc_id"] in labels]
    common = max(np.mean([labels[r["doc_id"]] for r in rows]), 1 - np.mean([labels[r["doc_id"]] for r in rows]))
    assert accuracy((r["predicted"], labels[r["doc_id"]]) for r in rows) > max(0.8, common)


def test_base_score_and_gain(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = {i: [*t.lower().split(), None] for i, t in docs}
    counts = {}
    for i, ts in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op8_suffix_tree"](spark, SF).collect()
    for r in rows:
        ts = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(t in counts for t in ts), n)
        assert r["base_score"] == pytest.approx(float(np.log10([(counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1)) for t in ts]).sum()), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def jaccard_components(texts, size=5, similarity=0.8):
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    least = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if len(a & sets[j]) >= similarity * len(a | sets[j])] for a in sets]
    for _ in texts:
        least = [min(least[j] for j in near[i]) for i in range(len(texts))]
    return least


@pytest.mark.parametrize("small", [16, 2])
def test_pipeline_near_copies_are_those_of_all_pairs(spark, small):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 120)) for _ in range(40)]
    for _ in range(80):  # near copies: one to three words changed, some past the limit
        words = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(1, 3) if words else 0):
            words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, small=small, block=8).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(want)


def test_leak_of_an_item_that_repeats_words_is_found(spark):
    """The repeated words and the answer are kept, which is most positions but few distinct words."""
    rng = random.Random(12)
    common, once, other, answer = "fa fb fc".split(), prose(rng, 15).split(), prose(rng, 15).split(), prose(rng, 10)
    item = " ".join(f"{common[i % 3]} {w}" for i, w in enumerate(once)) + " " + answer
    copy = " ".join(f"{common[i % 3]} {w}" for i, w in enumerate(other)) + " " + answer
    texts = [prose(rng, 50) + " " + copy + " " + prose(rng, 40), *(prose(rng, 200) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, prose(rng, 40))], "item_id long, text string")
    got = op9_decontaminate.contaminated(docs, bench, common=0.1).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 0)]
    assert got[0]["lcs"] == pytest.approx(25 / 40)


def test_latent_space_grows_with_the_items(spark, monkeypatch):
    """Copies with replaced words amid words of other items; each item has its own dimension."""
    rng, shapes, basis_of = random.Random(13), [], op9_decontaminate.latent_basis
    monkeypatch.setattr(op9_decontaminate, "latent_basis", lambda *a, **b: (basis := basis_of(*a, **b), shapes.append(basis.shape))[0])
    items = [prose(rng, 20).split() for _ in range(400)]
    pool = [w for item in items for w in item]
    texts = []
    for item in items:
        copy = [rng.choice(pool) if i < 15 and i % 2 == 0 else w for i, w in enumerate(item)]
        texts.append(" ".join([*rng.choices(pool, k=60), *copy, *rng.choices(pool, k=60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op9_decontaminate.contaminated(docs, bench, common=1.0).collect()}
    assert sum((i, i) in got for i in range(400)) >= 396
    assert shapes[0][1] >= 400
