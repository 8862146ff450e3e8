"""Operators on constructed rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import alerts as A
from tidemark.operators import discovery as X
from tidemark.operators import graph as G
from tidemark.operators import ledger as L
from tidemark.operators import rolling as R
from tidemark.operators import state as S
from tidemark.sources import feeds, tables

LEDGER = "ticker string, date date, mentions long, close double, volume double, wiki double"
DAY = dt.date(2024, 1, 1)


def series(spark, closes, volumes=None, wiki=None):
    n = len(closes)
    return spark.createDataFrame([("A", DAY + dt.timedelta(i), 1, closes[i], (volumes or [10.0] * n)[i], (wiki or [1.0] * n)[i]) for i in range(n)], LEDGER)


def test_release_needs_price_and_volume(spark):
    for close, volume, fires in ((11.0, 15.0, True), (11.0, 14.0, False), (10.0, 20.0, False), (float("nan"), 20.0, False)):
        df = R.release_triggers(series(spark, [10.0] * 60 + [close], [10.0] * 60 + [volume]))
        assert df.filter("release").count() == int(fires)


def test_regimes_bridge_short_gaps(spark):
    flags = [True] * 10 + [False] * 5 + [True] * 10 + [False] * 20 + [True] * 5
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i), f) for i, f in enumerate(flags)], "ticker string, date date, qualifies boolean")
    assert [(r["start_idx"], r["end_idx"], r["sessions"]) for r in R.merge_regimes(df).collect()] == [(1, 25, 20)]


def test_compression_waits_for_a_full_window(spark):
    assert R.compression(series(spark, [10.0] * 30)).filter("range IS NOT NULL OR percentile IS NOT NULL").count() == 0


def test_infinite_and_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (1.0,)], "x double")
    assert df.select(L.finite(F.col("x")).alias("x")).filter("x IS NOT NULL").count() == 1


def test_upsert_replaces_a_row_or_merges_it_and_keeps_the_newest(spark):
    old = series(spark, [1.0, 2.0, 3.0])
    new = spark.createDataFrame([("A", DAY + dt.timedelta(2), 5, None, 7.0, None)], LEDGER)
    for merge, close, wiki in ((False, None, None), (True, 3.0, 1.0)):
        got = {r["date"]: r for r in L.upsert(old, new, keep=2, merge=merge).collect()}
        assert sorted(got) == [DAY + dt.timedelta(1), DAY + dt.timedelta(2)]
        last = got[DAY + dt.timedelta(2)]
        assert (last["mentions"], last["close"], last["volume"], last["wiki"]) == (5, close, 7.0, wiki)


def test_backfill_fills_what_is_not_finite(spark):
    old = series(spark, [1.0, float("nan"), None], [float("inf"), 2.0, 3.0])
    late = series(spark, [9.0, 8.0, 7.0, 6.0], [5.0] * 4)
    got = [(r["close"], r["volume"], r["mentions"]) for r in L.merge_backfill(old, late).orderBy("date").collect()]
    assert got == [(1.0, 5.0, 1), (8.0, 2.0, 1), (7.0, 3.0, 1), (6.0, 5.0, 0)]
    assert L.merge_backfill(old, late, keep=2).count() == 2


def test_nearest_close_prefers_the_earlier_day(spark):
    ledger = series(spark, [1.0, None, None, None, 5.0])
    probes = spark.createDataFrame([(1, "A", DAY + dt.timedelta(2)), (2, "A", DAY + dt.timedelta(30)), (3, "A", None)], "id long, ticker string, date date")
    assert {r["id"]: r["near_close"] for r in S.nearest_close(probes, ledger).collect()} == {1: 1.0, 2: None, 3: None}


def test_spring_events(spark):
    frame = lambda rows: spark.createDataFrame(rows, "ticker string, state string")
    was = frame([("A", "coiled"), ("B", "coiled"), ("C", "coiled")])
    now = frame([("A", "released"), ("B", "coiled"), ("C", "dead"), ("D", "coiled"), ("E", "coiled")])
    hot = spark.createDataFrame([("D",)], "ticker string")
    assert {r["ticker"]: r["priority"] for r in S.spring_events(was, now, hot).collect()} == {"A": "high", "C": "normal", "D": "high"}


def test_communities_separate_two_cliques(spark):
    edges = [(0, 1, 5), (0, 2, 5), (1, 2, 5), (3, 4, 5), (3, 5, 5), (4, 5, 5), (2, 3, 1)]
    df = spark.createDataFrame(edges, "src long, dst long, n long")
    got = G.communities(df)
    label = {r["ticker"]: r["community"] for r in got.collect()}
    assert label[0] == label[1] == label[2] != label[3] == label[4] == label[5]
    assert G.modularity(df, got).first()["q"] > 0.3


def test_markup(spark):
    df = spark.createDataFrame([("<p>a&amp;#39;b &#x2019;&#128512;</p><![CDATA[ x ]]>",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(T.clean_markup(F.col("x"))).collect()] == ["a'b ’\U0001f600 x", None, ""]


def test_ngrams(spark):
    df = spark.createDataFrame([(1, "Solid state battery of the day"), (2, "the of"), (3, None)], "doc_id long, text string")
    words = df.select("doc_id", T.tokens(F.col("text")).alias("words"))
    got = {r["doc_id"]: r["g"] for r in words.select("doc_id", T.ngrams(F.col("words")).alias("g")).collect()}
    assert "solid state battery" in got[1] and "of the" not in got[1] and not got[2] and not got[3]


def test_mentions_need_a_cashtag_or_a_telling_alias_for_common_words(spark):
    registry = spark.createDataFrame([("AAP", "Apple", ["apple inc"]), ("ON", "On Semi", ["on", "on semi", "here"]), ("B2", "Beta", [])], "ticker string, name string, aliases array<string>")
    texts = ["$AAPL is up", "xaap1 AAP", "aapl", "on it", "$on it", "On Semi rises", "here now", "an Apple  Inc. deal", "an apple inc deal", "b2b", "1b2.", "", None, "AAP: law firm reminds investors of the class action"]
    df = spark.createDataFrame([(i, "s", t, "u", 2.5, "p") for i, t in enumerate(texts)], "key long, source string, text string, url string, weight double, published string")
    got = {(r["key"], r["ticker"]) for r in X.collect_mentions(df, registry).collect()}
    assert got == {(0, "AAP"), (1, "AAP"), (4, "ON"), (5, "ON"), (8, "AAP"), (10, "B2")}
    assert {r["mentions"] for r in X.collect_mentions(df, registry).collect()} == {3}


def test_ticker_confidence(spark):
    df = spark.createDataFrame([(1, "buy $ABC or (DEF) and GHI, ticker: JK, ARM, $ARM? CEO $CEO USD (AI) $T")], "doc_id long, text string")
    assert {r["ticker"]: r["confidence"] for r in T.ticker_candidates(df).collect()} == {"ABC": 3.0, "DEF": 2.4, "GHI": 1.0, "JK": 2.6, "ARM": 3.0, "T": 3.0}


def test_registry_keeps_names_and_unites_aliases(spark):
    schema = "ticker string, name string, aliases array<string>"
    old = spark.createDataFrame([("AA", "AA", ["aa"]), ("BB", "Bee", ["bb"])], schema)
    new = spark.createDataFrame([(1, "aa", "Ay", ["Ay Co"]), (2, "AA", "Later", None), (3, "BB", "Other", ["x"]), (4, "CEO", "No", ["n"])], "seq long, " + schema)
    assert {r["ticker"]: (r["name"], r["aliases"]) for r in X.register(old, new).collect()} == {"AA": ("Ay", ["aa", "ay co"]), "BB": ("Bee", ["bb", "x"])}


def test_state_tables_are_read_in_their_newest_version(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.load(spark, path, "x long").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.load_required(spark, path, "x long")
    tables.save(spark.range(3).withColumnRenamed("id", "x"), path)
    tables.save(tables.load(spark, path, "x long").filter("x > 0"), path)
    assert sorted(r["x"] for r in tables.load_required(spark, path, "x long").collect()) == [1, 2]


def test_feeds_survive_broken_responses(spark):
    bad = spark.createDataFrame([(1, "A", None), (2, "A", ""), (3, "A", "<html>{]"), (4, "A", "{}")], "response long, ticker string, value string")
    for found in (feeds.forum_listing(bad), feeds.article_list(bad), feeds.trending(bad), feeds.stream_messages(bad), feeds.mention_counts(bad), feeds.board_catalog(bad), feeds.chart_quotes(bad), feeds.feed_items(bad), feeds.daily_quotes(bad), feeds.industry_table(bad), feeds.short_volume(bad)):
        assert found.count() == 0


def test_classify_finds_a_planted_coil_and_its_release(spark):
    """200 wide days, 60 tight ones with hot attention, then a close over all of them on volume."""
    rng = random.Random(3)
    closes = [100 + rng.uniform(-30, 30) for _ in range(200)] + [100 + rng.uniform(-0.5, 0.5) for _ in range(100)]
    wiki = [10.0 + rng.uniform(-1, 1) for _ in range(200)] + [30.0] * 100
    for last, volume, state in ((100.0, 10.0, "coiled"), (300.0, 100.0, "released")):
        df = series(spark, [*closes, last], [10.0] * 300 + [volume], [*wiki, 30.0])
        (row,) = R.classify(df).collect()
        assert row["state"] == state and row["release_date"] == (DAY + dt.timedelta(300) if state == "released" else None)
    assert R.classify(series(spark, [100 + rng.uniform(-30, 30) for _ in range(300)], None, [10.0] * 300)).count() == 0


def test_classify_reads_the_ledger_once(spark):
    df = series(spark, [10.0] * 80)
    plan = R.classify(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_days_in_state_and_leaders(spark):
    day = lambda n: DAY + dt.timedelta(n)
    before = spark.createDataFrame([("A", "x", day(0)), ("B", "x", day(0))], "ticker string, state string, since date")
    now = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "ticker string, state string")
    got = {r["ticker"]: (r["since"], r["days"]) for r in A.days_in_state(before, now, F.lit(day(9))).collect()}
    assert got == {"A": (day(0), 9), "B": (day(9), 0), "C": (day(9), 0)}
    active = spark.createDataFrame([("A", day(0), day(20), "h", ["X"]), ("B", day(0), day(5), "h", ["Y"])], "ticker string, detected date, expires date, headline string, followers array<string>")
    triggers = spark.createDataFrame([("A", "again"), ("B", "new")], "ticker string, headline string")
    industries = spark.createDataFrame([("A", 1), ("B", 2), ("S", 2)], "ticker string, sub int")
    edges = spark.createDataFrame([("B", "N", 3)], "src string, dst string, n long")
    led = {r["ticker"]: (r["headline"], r["followers"]) for r in A.leaders(active, triggers, industries, edges, F.lit(day(9))).collect()}
    assert led == {"A": ("h", ["X"]), "B": ("new", ["N", "S"])}


def test_oldest_graded_entries_leave_the_log(spark):
    day = lambda n: DAY + dt.timedelta(n)
    log = spark.createDataFrame([("a", "release", "A", None, day(0), 10.0), ("b", "release", "A", None, day(1), 10.0)], "id string, type string, ticker string, theme long, date date, base_price double")
    grades = spark.createDataFrame([("a", 30, 0.5)], "id string, horizon int, ret double")
    bench = series(spark, [1.0] * 60).select("date", "close")
    members = spark.createDataFrame([], "theme long, ticker string")
    entries, graded = A.updated_log(log, grades, log.withColumn("id", F.concat("id", F.lit("2"))), series(spark, [11.0] * 60), members, bench, F.lit(day(31)), horizons=(30,), keep=3)
    assert sorted(r["id"] for r in entries.collect()) == ["a2", "b", "b2"]
    assert {(r["id"], round(r["ret"], 6)) for r in graded.collect()} == {("b", 0.1), ("a2", 0.1), ("b2", 0.1)}
