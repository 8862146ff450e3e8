"""Faults that showed on larger tables, on small ones made to show them."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import board as B
from tidemark.operators import graph as G
from tidemark.operators import ledger as L
from tidemark.operators import phrases as P
from tidemark.operators import rolling as R
from tidemark.plans.alerts import calibration_run
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.session import dealt, spread
from tidemark.sources import feeds as S

SF = "/root/testdata/sf0.001"


def test_users_of_any_number_are_registered(spark, tmp_path):
    """Tickers of over five characters, as from the ten-thousandth user on."""
    spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") * 10_007).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["x5_registry"](spark, str(tmp_path)).select("ticker", "name", "aliases").collect()
    assert sorted(tuple(r) for r in got) == sorted(duck.execute(f"SELECT ticker, name, aliases FROM ({ORACLES['x5_registry']})").fetchall())


def test_labels_dont_depend_on_the_order_of_sums(spark):
    means = [0.25, 0.08, -0.18, -0.04]
    rows = [(x, x * (1 + e)) for x in means for e in (-4e-16, 0.0, 4e-16)] + [(0.0801, 0.0801), (-0.0401, -0.0401)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", B.sentiment_label(F.col("y")).alias("label")).distinct().collect()
    assert sorted((r["x"], r["label"]) for r in got) == [(-0.18, "Soft"), (-0.0401, "Soft"), (-0.04, "Neutral"), (0.08, "Neutral"), (0.0801, "Positive"), (0.25, "Positive")]


def test_feed_texts_are_computed_once(spark):
    """Titles, links and dates cleaned once each, not once for every mention in the expressions; few full partitions dealt out."""
    feeds = spark.createDataFrame([(1, "<item><title>A &amp;#65; b &#x42; title</title><link>l</link></item><item><title>t</title></item>")], "response long, value string")
    items = S.forum_feed_items(feeds)
    assert [tuple(r) for r in items.collect()] == [(1, 0, "A A b B title", "l", 1.5, "")]
    assert items._jdf.queryExecution().optimizedPlan().toString().count("CDATA") <= 3
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(9, numPartitions=cores)).rdd.getNumPartitions() == 4 * cores


def test_a_calibration_run_computes_its_ledger_once(spark):
    """The benchmark alone is left to read line items; entries and grades read what has been written."""
    log, grades = calibration_run(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(log).count("l_orderkey") == 0 and plan(grades).count("l_orderkey") <= 1


def test_leader_drift_needs_no_communities(spark, monkeypatch):
    monkeypatch.setattr(G, "communities", None)
    assert QUERIES["g5_leader_drift"](spark, SF).columns == ["ticker", "was", "now"]


def test_partitions_grow_with_the_files(spark):
    """A number of partitions that is asked for is not merged; small input stays as it is."""
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_suppkey")
    assert dealt(rows, "l_orderkey", mb=1).rdd.getNumPartitions() == 10
    assert dealt(rows, "l_orderkey").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert dealt(rows, "l_orderkey", mb=1).distinct().rdd.getNumPartitions() == 10


def test_followers_of_all_tickers(spark):
    """Without tickers asked for, of those in an industry and those in an edge alone; the same rows as when all are asked for."""
    industries = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "ticker long, sub long")
    edges = spark.createDataFrame([(1, 9, 5), (3, 9, 2)], "src long, dst long, n long")
    asked = spark.createDataFrame([(1,), (2,), (3,), (9,)], "ticker long")
    got = {r["ticker"]: r["followers"] for r in A.followers(None, industries, edges).collect()}
    assert got == {1: [2, 9], 2: [1], 3: [9], 9: [1, 3]} == {r["ticker"]: r["followers"] for r in A.followers(asked, industries, edges).collect()}


def test_upserts_of_large_ledgers_keep_their_partitions(spark, monkeypatch):
    """Each step that sorts or hashes the ledger asks for its partitions."""
    asked = []
    monkeypatch.setattr(L, "dealt", lambda df, *keys: asked.append(keys) or df)
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, 1.0, 1.0, 1.0)], "ticker long, date date, mentions long, close double, volume double, wiki double")
    assert L.upsert(rows, rows).count() == 1 and asked == [("ticker",)] * 3


def test_rolling_statistics_take_many_tickers_a_call(spark, tmp_path):
    """The same values as a ticker at a time, with unknown values, tickers of one day and rows without a ticker."""
    rng = np.random.default_rng(5)
    sizes = {None: 70, **{2**60 + t: int(rng.choice([1, 2, 59, 60, 61, 130, 330])) for t in range(40)}}
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i)) for t, n in sizes.items() for i in range(n)]
    numbers = np.round(rng.normal(100, 30, (len(rows), 3)), 1)
    numbers[rng.random(numbers.shape) < 0.02] = np.nan
    spark.createDataFrame([(*r, *map(float, x)) for r, x in zip(rows, numbers)], "ticker long, date date, close double, volume double, wiki double").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    calls = R.per_ticker(df, "rows int", lambda d, first: {"rows": len(d)}).select("ticker", "rows").distinct().collect()
    assert {(r["ticker"] is None, r["rows"]) for r in calls} == {(True, 70), (False, len(rows) - 70)} and {r["ticker"] for r in calls} == set(sizes)

    got = R.trailing_median(R.compression(df), "wiki", 100).withColumn("ticker", F.col("ticker").cast("string")).toPandas().sort_values("date")
    for _, d in got.groupby("ticker", dropna=False):
        closes = d["close"].rolling(60)
        spread = (closes.max() - closes.min()) / closes.max()
        ranks = spread.rolling(252, min_periods=1)
        wanted = {"range": spread, "percentile": (100 * ranks.rank(method="max") / ranks.count()).where(spread.notna()), "median": d["wiki"].rolling(100, min_periods=1).median()}
        for c, x in wanted.items():
            pd.testing.assert_series_equal(d[c], x, check_names=False, rtol=1e-12)


def test_regimes_hand_on_days_that_tell_and_the_same_releases(spark, tmp_path):
    """Releases by the windows of release_triggers; qualifying days and each ticker's last one, numbered within the ticker."""
    rng = np.random.default_rng(6)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(i), float(x), float(v), float(w)) for t in range(30) for i, (x, v, w) in enumerate(rng.lognormal(3, 0.3, (250, 3)))]
    rows = [(t, d, None if t < 10 and i % 41 == 0 else x, float("nan") if i % 37 == 0 else v, w) for i, (t, d, x, v, w) in enumerate(rows)]
    spark.createDataFrame(rows, "ticker long, date date, close double, volume double, wiki double").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    days = R.regime_days(df, "wiki", 0.2, 50.0).collect()
    wanted = {(r["ticker"], r["date"]) for r in R.release_triggers(df).filter("release").collect()}
    assert {(r["ticker"], r["date"]) for r in days if r["release"]} == wanted and len(wanted) > 5
    assert {r["ticker"] for r in days if r["idx"] == 250} == set(range(30)) and max(r["idx"] for r in days) == 250
    for t in range(30):
        hits = sorted((r["idx"], r["run"]) for r in days if r["ticker"] == t and r["qualifies"])
        new = [i for i in range(len(hits)) if i == 0 or hits[i][0] - hits[i - 1][0] > 11]
        assert [run for _, run in hits] == [sum(j <= i for j in new) for i in range(len(hits))]
    assert len(days) < df.count() / 2 and any(r["qualifies"] for r in days)


def test_frequent_phrases_are_counted_once_a_round(spark):
    """What chooses among the counts reads them from files, however often."""
    items = spark.createDataFrame([("CNBC", "T", f"widget demand lifts supplier {i % 3}", f"https://h{i}.example/") for i in range(9)], "source string, ticker string, title string, url string")
    plans = []
    got = P.most_frequent(items, 2, None, lambda found: plans.append(found._jdf.queryExecution().optimizedPlan().toString()) or found)
    assert got.count() == 2 and plans and not any("Aggregate" in x or "Generate" in x for x in plans)
