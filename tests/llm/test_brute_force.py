"""Each training-data operator against a plain version of the same rules on small inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op1_additive, op2_toxicity, op3_token_counts, op5_language_id, op6_sampling, op7_chunks, op8_suffix_tree, op9_decontaminate, op10_quality, pieces
from tidemark.llm.common import hash_share


def prose(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("rows, wanted", [(1000, 2000), (200_000, 1000), (5_000_000_000, 100_000_000), (10**12, 10**10)])
def test_samples_have_the_wanted_share_at_any_size(spark, rows, wanted):
    kept = spark.range(20_000).filter(hash_share(F.col("id"), rows, wanted, "s")).count()
    share = min(1, wanted / rows)
    assert abs(kept - 20_000 * share) <= 5 * math.sqrt(20_000 * share * (1 - share) + 1)
    if wanted < rows / 10**4:
        assert kept > 0


def exact_top(ids, x, q, k):
    """(vec_id, score) of the k best rows other than row q, ties to the smaller id."""
    scores = x @ x[q]
    order = np.lexsort((ids, -scores))
    return [(int(ids[i]), float(scores[i])) for i in order if i != q][:k]


def test_search_over_many_cells_and_fragments(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 20_000)] + 0.6 * rng.standard_normal((20_000, 24))).astype(np.float32).astype(float)
    ids = np.arange(20_000)
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in op1_additive.search(vectors, lambda i: i % 200 == 0, fragment=500, query_block=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 20_000, 200):
        want = exact_top(ids, x, q, 20)
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [s for _, _, s in found] == pytest.approx([float(x[i] @ x[q]) for _, i, _ in found], rel=1e-12)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
    assert hits / (100 * 20) >= 0.9


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_queries_of_small_cells_get_all_their_ranks(spark, metric):
    """Cells of about eight vectors, of which one would be probed: a query goes on until it has k others."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 12))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900 + i, [5.0] * 12) for i in range(40)]
    got = {}
    for r in op1_additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, least_cells=110, coverage=0.01, metric=metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(0, 940, 20))
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == list(range(1, 21))
        assert len({v for _, v in found} - {q}) == 20


@pytest.mark.parametrize("kind", ["even", "long", "other queries", "large"])
def test_search_of_rows_that_codes_tell_apart_badly(spark, kind):
    """No clusters at all, many dimensions, queries unlike the rest, numbers whose squares no float holds."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 256 if kind == "long" else 32))
    if kind == "other queries":
        x = rng.standard_normal((30, 32))[rng.integers(0, 30, 4000)] + 0.2 * x
        x[::20] = rng.standard_normal((200, 32))
    x = (x * (1e30 if kind == "large" else 1)).astype(np.float32).astype(float)
    got = {}
    for r in op1_additive.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>"), lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[q] & {i for i, _ in exact_top(np.arange(4000), x, q, 20)}) for q in range(0, 4000, 20)]
    assert sum(hits) / (200 * 20) >= 0.95


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_search_with_ties_and_repeated_ids(spark, metric):
    """Few distinct vectors, so everything is in the shortlist and the result is exact."""
    rng = random.Random(8)
    pool = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(12)] + [[1.0, 1.0, 0.0, 0.0]]
    rows = [(rng.randrange(60), rng.choice(pool)) for _ in range(150)] + [(7, [1.0, 1.0, 0.0, 0.0])] * 40
    rows = [(i, v) for i, v in rows if any(v)]
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in op1_additive.search(frame, lambda i: i % 20 == 0, k=9, metric=metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            far = [(sum(a * b for a, b in zip(v, w)) if metric == "ip" else -sum((a - b) ** 2 for a, b in zip(v, w))) for _, w in rows]
            order = sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-far[j], rows[j][0]))[:9]
            want.setdefault(i, []).extend((rank, rows[j][0], far[j]) for rank, j in enumerate(order, 1))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_toxicity_is_the_noisy_or_of_its_sentences(spark):
    model = op2_toxicity.ToxicityModel({"zap": 4.0, "zork": 3.5, "plai*": -1.0}, -3.0)
    texts = ["Zap it. Plain words here! zork, zork zap\nİ zap", None, "", "...", "a zap. zap. a zap", "quiet text only"]
    got = {r["doc_id"]: r for r in op2_toxicity.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        clean, spans = 1.0, []
        for m in op2_toxicity._SENTENCE.finditer(text or ""):
            logit = model.bias + sum(model.weight(w) for w in set(m[0].lower().split()))
            p = 1 / (1 + math.exp(-logit))
            clean *= 1 - p
            if p >= 0.5:
                spans.append((m.start(), m.end(), p))
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-12)
        assert [(o["first"], o["last"]) for o in got[i]["offending"]] == [s[:2] for s in spans]
        assert [o["score"] for o in got[i]["offending"]] == pytest.approx([s[2] for s in spans])
    assert [texts[0][o["first"] : o["last"]] for o in got[0]["offending"]] == ["Zap it", " zork, zork zap", "İ zap"]


def test_toxicity_training_finds_the_offending_sentence():
    rng = random.Random(4)
    sample = []
    for i in range(300):
        sentences = [prose(rng, 6) for _ in range(5)]
        if i % 3 == 0:
            sentences.insert(rng.randrange(5), prose(rng, 3) + " grumblefoul " + prose(rng, 2))
        sample.append((". ".join(sentences), int(i % 3 == 0)))
    model = op2_toxicity.train(sample)
    assert model.bias + model.weight("grumblefoul") > 0 > model.bias + model.weight("abc")
    assert op2_toxicity.train(sample) == model


@pytest.fixture(scope="module")
def vocab():
    texts = ["a", "b", "ab", "ba", "aba", " ", " a", " ab", "abab", "bb", "é"]
    return pieces.build_vocabulary(list(enumerate(t.encode() for t in texts)), [len(texts) + b for b in range(256)])


def plain_counts(word, vocab):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        best.append(max((best[i][0] + vocab.table[word[i:j]][1], best[i][1] - 1) for i in range(max(0, j - vocab.longest), j) if word[i:j] in vocab.table))
    return -best[-1][1]


def pretokens(text):
    out, data = [], text.encode()
    for i, b in enumerate(data):
        new = i == 0 or b == 10 or data[i - 1] == 10 or (b == 32 and data[i - 1] != 32)
        out.append(data[i : i + 1]) if new else out.append(out.pop() + data[i : i + 1])
    return out


def odd_texts(rng):
    return ["".join(rng.choice(["a", "b", "ab", " ", "  ", "\n", "é", "x"]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "ab" * 300 + "é" * 90, "ab" * 300 + "ba" * 40]


def test_token_counts_are_those_of_a_plain_programme_for_each_word(spark, vocab):
    texts = odd_texts(random.Random(6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op3_token_counts.token_counts(docs, vocab=vocab).collect()}
    for i, t in enumerate(texts):
        words = pretokens(t or "")
        assert (got[i]["n_tokens"], got[i]["n_pretokens"]) == (sum(plain_counts(w, vocab) for w in words), len(words)), t


def segmentations(word, vocab):
    if not word:
        yield (), 0.0
    for j in range(1, min(len(word), vocab.longest) + 1):
        if word[:j] in vocab.table:
            piece, logp = vocab.table[word[:j]]
            for rest, score in segmentations(word[j:], vocab):
                yield (piece, *rest), logp + score


@pytest.mark.parametrize("dense", [pieces.DENSE, 0])
@pytest.mark.parametrize("temperature", [1.0, 2.0])
def test_sampled_segmentations_have_their_probabilities(vocab, monkeypatch, dense, temperature):
    monkeypatch.setattr(pieces, "DENSE", dense)
    n = 6000
    part = pa.RecordBatch.from_pydict({"text": ["abab"] * n, "key": np.arange(n)})
    ids, bounds, _, _ = op6_sampling.segment(part, vocab, temperature)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:]))
    weights = {s: math.exp(score / temperature) if temperature == 1.0 else math.exp(sum(vocab.logp[i] / temperature for i in s)) for s, score in segmentations(b"abab", vocab)}
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for s, w in weights.items():
        p = w / total
        assert abs(seen[s] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1


def test_encode_and_decode_give_the_text_back(spark, vocab):
    texts = odd_texts(random.Random(7))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = op6_sampling.encode(docs, vocab=vocab)
    assert {r["doc_id"]: r["decoded"] for r in op6_sampling.decode(encoded, vocab=vocab).collect()} == dict(enumerate(texts))
    again = {r["doc_id"]: r["piece_ids"] for r in op6_sampling.encode(docs.repartition(5), vocab=vocab).collect()}
    assert again == {r["doc_id"]: r["piece_ids"] for r in encoded.collect()}
    trip = op6_sampling.round_trip(docs, vocab=vocab).collect()
    assert {r["doc_id"]: r["piece_ids"] for r in trip} == again and all(r["lossless"] for r in trip)


def test_language_is_the_plain_sum_of_words_and_backoffs(spark):
    rng = random.Random(9)
    pools = {lang: [prose(rng, 1, letters) for _ in range(30)] for lang, letters in (("aa", "abcdef"), ("bb", "defghi"))}
    labelled = [(i, " ".join(rng.choices(pools[lang], k=20)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame(labelled + [(100, "½ ² Ⅷ 12", "aa"), (101, None, "bb"), (102, "unseenfed abz", None), (103, "", None)], "doc_id long, text string, lang string")
    model = op5_language_id.fit(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op5_language_id.predict(docs, model).collect()}
    for i, text, _ in docs.collect():
        words = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        logs = np.zeros(2)
        for w in words:
            if w in model.words:
                logs += model.word_logs[model.words[w]]
                continue
            padded, rows = f"<{w}>", []
            for at in range(len(padded)):
                known = [padded[at : at + n] for n in range(5, 0, -1) if padded[at : at + n] in model.grams]
                rows += [model.gram_logs[model.grams[known[0]]]] if known else []
            logs += np.mean(rows, axis=0) if rows else 0
        if not words:
            assert got[i] == ("und", 0.0)
        else:
            assert got[i][0] == model.languages[int(logs.argmax())]
            assert got[i][1] == pytest.approx(1 / np.exp(logs - logs.max()).sum())


def plain_starts(data, reach, most):
    """Chunk starts of one text, byte by byte."""
    n, gear = len(data), op7_chunks.GEAR.astype(object)
    if n > 2 * reach:
        h = []
        for i in range(n):
            total = sum(int(gear[data[i - k]]) << k for k in range(min(op7_chunks.WINDOW, i + 1)))
            h.append((total * 2654435769) % 2**32)
    space = [b == 32 or 9 <= b <= 13 for b in data]
    cuts = {0}
    for i in range(reach + op7_chunks.WINDOW, n - reach):
        if all(h[i] < h[i - k] for k in range(1, reach + 1)) and all(h[i] <= h[i + k] for k in range(1, reach + 1)):
            word = next((j for j in range(i + 1, n) if not space[j] and space[j - 1]), None)
            if word:
                cuts.add(word)
    out, bounds = set(cuts), sorted(cuts) + [n]
    for a, b in itertools.pairwise(bounds):
        for cut in range(a + most, b, most):
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.add(cut)
    return sorted(out)


def test_chunks_are_cut_as_byte_by_byte():
    rng = random.Random(10)
    texts = [prose(rng, n) for n in (1, 3, 10, 40, 200)] + ["ab " * 300, "é" * 400, "x" * 1000]
    for reach, most in ((16, 256), (4, 40)):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
        got = op7_chunks.chunk_starts(np.frombuffer(b"".join(raw), np.uint8), offsets, reach, most)
        want = [int(a) + s for a, t in zip(offsets, raw) for s in plain_starts(t, reach, most)]
        assert got.tolist() == want


def test_repeats_are_found_and_clean_text_is_left(spark):
    """Planted passages of 60 words, against exact 50-word repeats of the whole input."""
    rng = random.Random(12)
    shared = [prose(rng, 60) for _ in range(30)]
    texts = [f"{prose(rng, rng.randint(0, 80))} {rng.choice(shared)} {prose(rng, rng.randint(0, 80))}" if i % 2 else prose(rng, 150) for i in range(200)]
    windows = {}
    for i, t in enumerate(texts):
        words = t.split()
        for a in range(len(words) - 49):
            windows.setdefault(tuple(words[a : a + 50]), set()).add(i)
    repeated = set().union(*(d for d in windows.values() if len(d) > 1))
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (None, texts[1])], "doc_id long, text string")
    found = {r["doc_id"] for r in op7_chunks.repeated_passages(docs).collect()}
    assert found <= repeated and len(found) >= 0.97 * len(repeated)


def test_words_of_long_items_are_all_searched(spark):
    rng = random.Random(13)
    item = prose(rng, 95).split()
    texts = [" ".join([*prose(rng, 40).split(), *item[65:], *prose(rng, 60).split()]), " ".join([*prose(rng, 30).split(), *item[31:], *prose(rng, 30).split()]), prose(rng, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, prose(rng, 20))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in op9_decontaminate.contaminated(docs, bench).collect()}
    assert found == {(1, 5)}  # the last segment is words 31 to 95; the 30 words of the first text are under 0.6 of it
    kept = op9_decontaminate.read_items(bench, 32)
    assert [len(s) for _, s in kept.segments] == [64, 64, 20]
    assert kept.segments[1][1].tolist() == kept.segments[0][1].tolist()[31:] + kept.segments[1][1].tolist()[33:]
    assert [len(a) for a in kept.answers] == [0, 23, 5]


def test_leaks_against_exact_subsequences(spark):
    """All windows against all items, without the latent search; shards must not matter."""
    rng = random.Random(14)
    pool = prose(rng, 600).split()
    items = [rng.sample(pool, rng.randint(15, 60)) for _ in range(40)]
    texts = []
    for i in range(160):
        words = rng.choices(pool, k=rng.randint(60, 200))
        if i % 4 == 0:
            copy = [rng.choice(pool) if rng.random() < 0.02 * (i % 12) else w for w in items[i // 4]]
            at = rng.randrange(len(words))
            words[at:at] = copy
        texts.append(words)
    want = set()
    for d, words in enumerate(texts):
        for m, item in enumerate(items):
            tail, number = item[-max(1, len(item) // 4) :], {}
            code = lambda ws: [number.setdefault(w, len(number)) for w in ws]  # noqa: B023, E731
            coded, end = np.array(code(item)), np.array(code(tail))
            for at in range(0, len(words), 32):
                window = code(words[at : at + 96])
                share = op9_decontaminate.lcs(coded, window) / len(item)
                if share >= 0.75 or (share >= 0.6 and op9_decontaminate.lcs(end, window) / len(tail) >= 0.75):
                    want.add((d, m))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for most_items in (500, 15):
        got = {(r["doc_id"], r["item_id"]) for r in op9_decontaminate.contaminated(docs, bench, common=1.0, most_items=most_items).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 30


def test_pair_counts_give_the_gram_matrix(spark):
    rng = random.Random(15)
    pool = prose(rng, 12).split()
    texts = [" ".join(rng.choices(pool + ["other"], k=rng.randint(0, 90))) for _ in range(30)]
    bench = op9_decontaminate.Benchmark({w.encode(): i for i, w in enumerate(pool)}, [], [], 8)
    used = np.arange(len(pool)) != 3
    want = np.zeros((len(pool), len(pool)))
    for t in texts:
        words = t.split()
        for a in range(0, len(words), 8):
            tf = np.array([words[a : a + 8].count(w) for w in pool]) * used
            want += np.outer(tf, tf)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = np.zeros_like(want)
    for r in op9_decontaminate.pair_counts(frame, spark.sparkContext.broadcast(bench), used).collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["n"]
    assert (want == got).all()


def test_marginals_are_those_of_enumerated_chains():
    rng = np.random.default_rng(16)
    bounds = np.array([0, 4, 4, 5, 8])
    logit, transition = rng.standard_normal(8), rng.standard_normal((2, 2))
    good, pairs, log_z = op10_quality.forward_backward(logit, transition, bounds)
    seen_pairs = []
    for text, (a, b) in enumerate(itertools.pairwise(bounds)):
        total, marginal, pair = 0.0, np.zeros(b - a), np.zeros((max(0, b - a - 1), 2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(logit[a + t] * y for t, y in enumerate(labels)) + sum(transition[p, q] for p, q in itertools.pairwise(labels)))
            total += w
            marginal += w * np.array(labels)
            for t, (p, q) in enumerate(itertools.pairwise(labels)):
                pair[t, p, q] += w
        if b > a:
            assert good[a:b] == pytest.approx(marginal / total)
            assert log_z[text] == pytest.approx(math.log(total))
            seen_pairs.append(pair / total)
    assert pairs == pytest.approx(np.concatenate(seen_pairs))


def plain_suffix_scores(texts, learn, min_count, depth, divergence, discount):
    """Suffix-tree scores, one token after another, from plain dictionaries."""
    rows = [[*t.lower().split(), "\n"] for t in texts]
    grams = Counter(tuple(r[i : i + n]) for r, k in zip(rows, learn) if k for n in range(1, depth + 2) for i in range(len(r) - n + 1))
    total, distinct = sum(n for g, n in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    kept = {}

    def p(context, word):
        if not context:
            return (grams[(word,)] + 0.1) / (total + 0.1 * (distinct + 1))
        below = p(context[1:], word)
        if context not in kept:
            return below
        return kept[context].get(word, 0.0) + (1 - sum(kept[context].values())) * below

    for d in range(1, depth + 1):
        found = {}
        for g, n in grams.items():
            if len(g) == d + 1 and n >= min_count:
                found.setdefault(g[:-1], {})[g[-1]] = n
        fresh = {}
        for context, follow in found.items():
            size = grams[context]
            kl = sum(n / size * math.log(n / size / p(context[1:], w)) for w, n in follow.items())
            other, below = 1 - sum(follow.values()) / size, 1 - sum(p(context[1:], w) for w in follow)
            kl += other * math.log(other / max(below, 1e-12)) if other > 1e-12 else 0
            if kl * size >= divergence:
                fresh[context] = {w: (n - discount) / size for w, n in follow.items()}
        if not fresh:
            break
        kept |= fresh
    out = []
    for r in rows:
        out.append(sum(math.log10(p(tuple(r[max(0, i - depth) : i]), w)) for i, w in enumerate(r)))
    vocabulary = [g[0] for g in grams if len(g) == 1]
    for context in kept:  # with the mass of one unseen word every distribution sums to one
        rest = math.prod(1 - sum(kept[context[k:]].values()) if context[k:] in kept else 1.0 for k in range(len(context)))
        assert sum(p(context, w) for w in vocabulary) + rest * 0.1 / (total + 0.1 * (distinct + 1)) == pytest.approx(1)
    return out, kept


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_suffix_tree_scores_are_the_plain_ones_by_broadcast_and_by_joins(spark, depth):
    rng = random.Random(17)
    words, follow = [f"w{i}" for i in range(10)], {"w1": ["w2", "w3"], "w4": ["w5", "W6", "w7", "w8"]}
    texts = []
    for _ in range(90):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(words))
            out += follow.get(out[-1], []) if rng.random() < 0.6 else []
        texts.append(" ".join(out))
    texts += ["rare words", "", "w1 w2 rare", "w4\tw5\nw6"]
    want, kept = plain_suffix_scores(texts, [i % 5 != 0 for i in range(len(texts))], 3, depth, 3.0, 0.75)
    assert max(map(len, kept)) == min(depth, 4)
    docs = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string")
    for most_entries in (10**6, 5):
        rows = op8_suffix_tree.score(docs, F.col("id") % 5 != 0, min_count=3, depth=depth, divergence=3.0, most_entries=most_entries).collect()
        got = {r["doc_id"]: r["score"] for r in rows}
        # the null text is one that is not trained on, as 500 is divisible by 5
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9) and len(got) == len(texts) + 1


def test_shared_words_are_counted_for_every_candidate():
    """Windows at ends of texts, unknown words, repeats in segments and tables of any size."""
    rng = np.random.default_rng(4)
    ids = rng.integers(-1, 30, 500)
    segments = [rng.integers(0, 30, n) for n in (1, 7, 16, 3)]
    first = np.repeat(np.sort(rng.choice(500, 60, False)), 3)
    stop, segment = np.minimum(first + 24, 500), np.tile([0, 1, 3], 60)
    segment[::5] = 2
    wanted = [sum(t in set(ids[a:b].tolist()) for t in segments[s].tolist()) for a, b, s in zip(first, stop, segment)]
    for most in (1, 100, 1 << 22):
        assert op9_decontaminate.shared_words(ids, first, stop, segment, op9_decontaminate.padded(segments, 30), 30, most).tolist() == wanted
    none = np.zeros(0, np.int64)
    assert len(op9_decontaminate.shared_words(none, none, none, none, op9_decontaminate.padded([], 30), 30)) == 0
