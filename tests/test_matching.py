"""Matching of texts with many aliases, and word counts in one pass, against plain versions."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.operators import discovery as X


def plain(text):
    return " " + re.sub(r"[^a-z0-9.$&+ -]", " ", text.lower()) + " "


def aliases_of(spark, texts, aliases):
    worded = spark.createDataFrame(list(enumerate(texts)), "key long, text string").select("key", X.normalised(F.col("text")).alias("n")).withColumn("words", F.split("n", " "))
    return X.alias_matches(worded, spark.createDataFrame([(a,) for a in aliases], "gram string"))


def test_aliases_of_any_length_are_found(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["the"] * 8 + ["of", "a-b", "x.y", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(150)] + ["", None, "the", "the  of", " w1 w2", "w1, w2!"]
    aliases = {" ".join(rng.choices(words[:-1], k=rng.choice([1, 1, 2, 2, 3, 5, 9]))) for _ in range(300)} | {"absent", "the absent", "the", "the  of", " w1", "w2 w1 w2", " ".join(f"w{i % 12}" for i in range(60))}
    texts[7] = "the " + " ".join(f"w{i % 12}" for i in range(60)) + " of"
    got = aliases_of(spark, texts, sorted(aliases)).collect()
    pairs = {(r["key"], r["gram"]) for r in got}
    assert len(pairs) == len(got)
    assert pairs == {(i, a) for i, t in enumerate(texts) if t is not None for a in aliases if f" {a} " in f" {plain(t)} "}


def test_the_plan_does_not_grow_with_the_longest_alias(spark):
    """Rows that the texts are cut into are their words, whatever the registry holds."""

    def shape(alias):
        plan = aliases_of(spark, ["one two three"] * 3, [alias, "one"])._jdf.queryExecution().optimizedPlan().toString()
        return re.sub(r"#\d+L?|\[.*?\]|lambda \w+", "", plan)

    assert shape("one two") == shape(" ".join(["two"] * 200))
    worded = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(50))) for i in range(20)], "key long, text string").select("key", X.normalised(F.col("text")).alias("n")).withColumn("words", F.split("n", " "))
    anchored = X.alias_matches(worded, spark.createDataFrame([(" ".join(f"t1x{j}" for j in range(50)),), ("t2x0",)], "gram string"))
    assert {(r["key"], r["gram"][:5]) for r in anchored.collect()} == {(1, "t1x0 "), (2, "t2x0")}


def test_sentiment_counts_whole_words(spark):
    rng = random.Random(4)
    words = [*V.POSITIVE, *V.NEGATIVE, "beaten", "x_beat", "Beat", "GAIN", "é", "fall-off", "cut.", "(cuts)", "gains9", ""]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(200)] + ["", "beat", "beat,beat;miss", None]
    count = lambda text, of: len(re.findall(r"(?<![A-Za-z0-9_])(?:" + "|".join(of) + r")(?![A-Za-z0-9_])", text.lower()))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.sentiment(F.col("text")).alias("s"))
    for r in df.collect():
        text = texts[r["i"]]
        if text is None:
            assert r["s"] is None
        else:
            good, bad = count(text, V.POSITIVE), count(text, V.NEGATIVE)
            assert abs(r["s"] - (good - bad) / max(3, good + bad + 1)) < 1e-12


def test_candidates_with_and_without_their_marks(spark):
    texts = ["$AB (CD) ticker: EF GH", "AB CD", "(XY)", "$XY", "ticker XY", "Ticker: XY", "$ab ( ticker", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["ticker"], r["confidence"]) for r in T.ticker_candidates(df).collect()}
    assert got == {(0, "AB", 3.0), (0, "CD", 2.4), (0, "EF", 2.6), (0, "GH", 1.0), (1, "AB", 1.0), (1, "CD", 1.0), (2, "XY", 2.4), (3, "XY", 3.0), (4, "XY", 2.6), (5, "XY", 1.0)}


def test_listed_tickers_are_registered_and_covered_without_a_mention(spark):
    registry = spark.createDataFrame([("AAA", "Alpha", []), ("SPY", "SPY", ["spy"]), ("KO", "Coke", [])], "ticker string, name string, aliases array<string>")
    whole, majors = X.with_majors(registry, {"SPY": "A Fund", "KO": "Cola", "ba": "Planes", "NOT ONE": "None"})
    assert {r["ticker"]: r["name"] for r in whole.collect()} == {"AAA": "Alpha", "SPY": "A Fund", "KO": "Coke", "BA": "Planes"}
    assert {r["aliases"][1] for r in whole.filter("ticker = 'BA'").collect()} == {"planes"}
    events = spark.createDataFrame([("AAA", 3), ("KO", 1), ("ZZZ", 9)], "ticker string, mentions long")
    none = spark.createDataFrame([], "ticker string, mentions long")
    hot = spark.createDataFrame([("AAA",), ("BA",), ("YYY",)], "ticker string")
    got = X.price_targets(whole, events, none, majors, hot, limit=2)
    assert {(r["ticker"], r["why"], r["name"]) for r in got.collect()} == {("AAA", "mentions", "Alpha"), ("KO", "mentions", "Coke"), ("SPY", "major", "A Fund"), ("BA", "major", "Planes")}
    empty, listed = X.with_majors(registry.limit(0))
    assert empty.count() == listed.count() == 46


def test_tickers_of_any_length_are_mentioned(spark):
    """As cashtags and as words, and with no row of a frequent word that nobody seeks behind the first shuffle."""
    titles = ["$T123456 up", "t123456", "(T12345)", "xt123456", "T123456x", "$t12", "the market", None, ""] + ["the market"] * 50
    texts = spark.createDataFrame(list(enumerate(titles)), "key long, text string")
    registry = spark.createDataFrame([("T123456", "Long", []), ("T12345", "Other", []), ("T12", "Short", ["the short"])], "ticker string, name string, aliases array<string>")
    got = {(r["key"], r["ticker"]) for r in X.matches(texts, registry).collect()}
    every = {"T12", "T12345", "T123456"}
    assert got == {(k, t) for k in (0, 1) for t in every} | {(2, "T12"), (2, "T12345"), (4, "T12"), (4, "T12345"), (5, "T12")}
    held = texts.select("key", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    sought = spark.createDataFrame([("$t12", "T12")], "word string, ticker string")
    found = X.holding(held, X.word_counts(held), sought)
    assert [tuple(r) for r in found.collect()] == [("$t12", 5, "T12")] and "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()


def test_letter_runs(spark):
    texts = ["$t1234 (ab) a1b2c3 9x x9 abcdef1 é", "", None, "a-b.c d1"]
    plain_runs = lambda t: {t[i:j] for i in range(len(t)) for j in range(i + 1, min(len(t), i + 5) + 1) if re.fullmatch("[a-z][a-z0-9]*", t[i:j]) and not re.match("[a-z]", t[i - 1 : i]) and not re.match("[a-z]", t[j : j + 1])}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.letter_runs(F.col("t")).alias("runs")).collect():
        assert r["runs"] is None if r["t"] is None else set(r["runs"]) == plain_runs(r["t"])
