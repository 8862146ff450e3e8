"""Bloom filters, summaries by bucket and running totals, against plain versions."""

import random
import re
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blooms
from tidemark.operators import phrases as P
from tidemark.operators import screen as C
from tidemark.operators import state as S

HISTORY = "week string, phrase string, n long"


@pytest.mark.parametrize("blocks", [1, 16, blooms.SMALL_BLOCKS + 1])
def test_a_filter_holds_what_was_put_in_and_little_else(spark, blocks):
    values = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("phrase"), (F.col("id") % 3).alias("week"))
    parts = blooms.build(values.unionByName(spark.createDataFrame([(None, 1)], "phrase string, week long")), "phrase", blocks, "week")
    asked = values.select("phrase").unionByName(spark.range(3000).select(F.concat(F.lit("q"), "id").alias("phrase"))).unionByName(spark.createDataFrame([(None,), ("",)], "phrase string"))
    got = blooms.marked(asked, "phrase", blooms.merged(parts), blocks).collect()
    assert len(got) == 6002
    assert all(r["maybe"] for r in got if (r["phrase"] or "").startswith("p"))
    assert sum(r["maybe"] for r in got if (r["phrase"] or "").startswith("q")) < 150
    assert [r["maybe"] for r in got if r["phrase"] is None] == [False]


@pytest.mark.parametrize("blocks", [1, 8])
def test_filtered_acceleration_is_acceleration(spark, blocks):
    rng = random.Random(blocks)
    rows = [(f"2024-W{w:02d}", f"p{p}", rng.randint(1, 6)) for w in range(1, 9) for p in rng.sample(range(400), 90)]
    history = spark.createDataFrame(rows, HISTORY)
    filters = blooms.build(history, "phrase", blocks, "week")
    for week in ("2024-W08", "2024-W03", "2024-W20"):
        found = history.filter(F.col("week") == week)
        wanted = {tuple(r) for r in S.acceleration(history, week).collect()}
        assert {tuple(r) for r in S.filtered_acceleration(found, history, filters, week, blocks).collect()} == wanted


def test_first_week_has_no_filters(spark):
    found = spark.createDataFrame([("2024-W01", "a b", 2), ("2024-W01", "c d", 0)], HISTORY)
    filters = blooms.build(found.limit(0), "phrase", 4, "week")
    got = S.filtered_acceleration(found, found.limit(0), filters, "2024-W01", 4)
    assert {tuple(r) for r in got.collect()} == {("a b", 2, True, True), ("c d", 0, True, False)}


def test_only_possible_repeats_meet_the_history(spark):
    history = spark.range(5000).select(F.lit("2024-W01").alias("week"), F.concat(F.lit("old "), "id").alias("phrase"), F.lit(1).cast("long").alias("n"))
    found = spark.range(40).select(F.concat(F.lit("new "), "id").alias("phrase"), F.lit(1).cast("long").alias("n")).unionByName(history.limit(2).select("phrase", "n"))
    repeats = blooms.build(blooms.marked(found, "phrase", blooms.build(history, "phrase", 16), 16).filter("maybe"), "phrase", 16)
    assert 2 <= blooms.marked(history, "phrase", repeats, 16).filter("maybe").count() < 20


def items(spark, titles):
    return spark.createDataFrame([("CNBC", f"T{i % 7}", t, f"https://h{i % 5}.example/{i}") for i, t in enumerate(titles)], "source string, ticker string, title string, url string")


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_most_frequent_are_the_first_of_all(spark, buckets):
    rng = random.Random(buckets)
    words = [f"word{i}" for i in range(30)]
    heads = items(spark, [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(30)], k=rng.randint(0, 9))) for _ in range(300)] + [None, ""])
    every = P.extracted(heads).orderBy(F.desc("n"), "phrase")
    for k in (1, 25):
        assert [tuple(r) for r in P.most_frequent(heads, k, buckets=buckets).collect()] == [tuple(r) for r in every.limit(k).collect()]
    even = lambda rows: rows.filter("n % 2 = 0")
    assert [tuple(r) for r in P.most_frequent(heads, 10, fit=even, buckets=buckets).collect()] == [tuple(r) for r in even(every).limit(10).collect()]


def test_most_frequent_of_few_and_of_none(spark):
    assert sorted(r["phrase"] for r in P.most_frequent(items(spark, ["solid state battery"]), 40).collect()) == ["solid state", "solid state battery", "state battery"]
    assert P.most_frequent(items(spark, ["", None]), 40).collect() == []


def test_frequent_shortlist_adds_the_week_so_far(spark):
    """The list is ordered by the week's whole count, which its headlines may have only a part of."""
    heads = items(spark, ["solid state battery"] * 3 + ["quiet quantum leap"] * 5)
    history = spark.createDataFrame([("2024-W03", "solid state", 9), ("2024-W03", "gone phrase", 50), ("2024-W02", "quantum leap", 8), ("2024-W01", "state battery", 1)], HISTORY)
    wanted = P.shortlist(history, P.extracted(heads), "2024-W03", 2)
    for buckets in (1, 4096):
        got = P.frequent_shortlist(history, heads, "2024-W03", 2, buckets=buckets).collect()
        assert got == wanted.collect()
    assert got[0]["phrase"] == "solid state" and got[0]["n"] == 12


def test_a_summary_has_no_more_rows_than_buckets_and_parts_add_up(spark):
    rows = spark.range(500).select(F.concat(F.lit("p"), "id").alias("phrase"), F.lit(2).cast("long").alias("n"))
    whole = {tuple(r) for r in P.bucket_totals(rows, 16).collect()}
    parts = Counter()
    for part in (rows.limit(200), rows.exceptAll(rows.limit(200))):
        parts.update({r["bucket"]: r["total"] for r in P.bucket_totals(part, 16).collect()})
    assert len(whole) <= 16 and set(parts.items()) == whole


def events(spark, rng, n=400):
    start = datetime(2024, 1, 1)
    rows = [(f"T{rng.randint(0, 4)}", rng.choice("abc"), start + timedelta(hours=rng.randint(0, 24 * 25)), rng.choice([None, 0, 1, 2, 5])) for _ in range(n)] + [("T0", "a", None, 3)]
    return spark.createDataFrame(rows, "ticker string, source string, ts timestamp, mentions long")


def test_ranges_from_running_totals_are_range_totals(spark):
    made = events(spark, random.Random(5))
    asked = [(i, date(2023, 12, 28) + timedelta(days=i % 30), date(2023, 12, 28) + timedelta(days=i % 30 + i // 10)) for i in range(100)]
    got = C.totals_of_ranges(C.running_totals(made), spark.createDataFrame(asked, "range_id long, start date, end date")).collect()
    by = {(r["range_id"], r["ticker"]): (r["mentions"], r["before"]) for r in got}
    assert len(by) == len(got)
    for i, start, end in asked[::9]:
        totals = C.range_totals(made, F.lit(start), F.lit(end)).filter("mentions IS NOT NULL OR before IS NOT NULL").collect()
        assert {k[1]: v for k, v in by.items() if k[0] == i} == {r["ticker"]: (r["mentions"], r["before"]) for r in totals}


def test_many_ranges_read_the_events_once(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, random.Random(6)).write.parquet(path)
    ranges = spark.range(100).select(F.col("id").alias("range_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("start")).withColumn("end", F.col("start"))
    out = C.totals_of_ranges(C.running_totals(spark.read.parquet(path)), ranges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Relation", plan)) == 1


def test_ranges_by_source_empty_and_too_many(spark):
    running = C.running_totals(events(spark, random.Random(7)))
    ask = lambda *days: spark.createDataFrame([(1, *days)], "range_id long, start date, end date")
    one = C.totals_of_ranges(running, ask(date(2024, 1, 5), date(2024, 1, 9)), ["a"]).collect()
    both = C.totals_of_ranges(running, ask(date(2024, 1, 5), date(2024, 1, 9)), ["a", "b", "c"]).collect()
    assert sum(r["mentions"] or 0 for r in one) < sum(r["mentions"] or 0 for r in both)
    assert C.totals_of_ranges(running, ask(date(2024, 1, 9), date(2024, 1, 5))).collect() == []
    assert C.totals_of_ranges(running.limit(0), ask(date(2024, 1, 5), date(2024, 1, 9))).collect() == []
    with pytest.raises(ValueError):
        C.totals_of_ranges(running, spark.range(3).select(F.col("id").alias("range_id"), F.current_date().alias("start"), F.current_date().alias("end")), most=2)
