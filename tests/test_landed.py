"""The data source over landed files, and the nearest known close, against plain versions."""

import datetime as dt
import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state as S
from tidemark.sources import feeds, landed

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "landed"
    (at / "sub").mkdir(parents=True)
    (at / "a.json").write_text('{"x": 1}')
    (at / "b.json").write_text('{"x": ')
    (at / "sub/c.json").write_bytes(b'{"x": "\xff"}')
    (at / "d.json.gz").write_bytes(gzip.compress(b'{"x": 4}'))
    (at / "e.json.gz").write_bytes(gzip.compress(b'{"x": 5}' * 99)[:20])
    (at / "f.json").write_text("")
    (at / ".g.json").write_text("{}")
    (at / "_SUCCESS").write_text("")
    return at


def test_broken_files_are_rows(spark, folder):
    rows = landed.read(spark, str(folder), "json", partition_bytes="10").collect()
    got = {r["path"].removeprefix(f"{folder}/"): (r["value"], (r["corrupt"] or "").split(":")[0].split(" (")[0]) for r in rows}
    assert got == {"a.json": ('{"x": 1}', ""), "b.json": (None, "no JSON"), "sub/c.json": (None, "no UTF-8 at byte 7"), "d.json.gz": ('{"x": 4}', ""), "e.json.gz": (None, "unreadable"), "f.json": (None, "no JSON")}
    assert landed.read(spark, str(folder), "json", partition_bytes="10").rdd.getNumPartitions() > 2
    assert landed.read(spark, f"file://{folder}", "text").count() == 6
    assert landed.read(spark, str(folder / "none")).count() == 0
    with pytest.raises(Exception, match="kind is one of"):
        landed.read(spark, str(folder), "yaml").collect()


def test_lines_are_records(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b'{"x": 1}\r\nnot json\n\n[2]\n\xff\n"last"')
    rows = landed.read(spark, str(tmp_path), "jsonl").orderBy("record").collect()
    assert [(r["record"], r["value"]) for r in rows] == [(0, '{"x": 1}'), (1, None), (2, None), (3, "[2]"), (4, None), (5, '"last"')]
    assert [r["corrupt"] is None for r in landed.read(spark, str(tmp_path), "lines").orderBy("record").collect()] == [True] * 4 + [False, True]


def test_feeds_over_landed_responses(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"0": {"cik_str": 12, "ticker": "ab", "title": "AB CORP"}, "1": {"ticker": "no"}, "2": {"cik_str": 3, "ticker": "AB", "title": "older"}}))
    (tmp_path / "broken.json").write_text("<html>")
    got = feeds.ticker_titles(landed.read(spark, str(tmp_path), "json").filter("corrupt IS NULL"))
    assert [tuple(r) for r in got.collect()] == [("AB", "0000000012", "AB CORP")]


def test_a_stream_gives_each_file_once(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    stream = landed.read_stream(spark, str(at), "json", settle="0").select("path", "value", "corrupt")

    def run():
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for i in range(3):
        (at / f"{i}.json").write_text(f"[{i}]" if i else "broken")
        os.utime(at / f"{i}.json", (1_700_000_000 + i // 2, 1_700_000_000 + i // 2))
    run()
    run()  # a restart
    (at / "3.json").write_text("[3]")
    (at / "4.json").write_text("[4]")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["path"][-6:], r["value"]) for r in rows) == [("0.json", None), *((f"{i}.json", f"[{i}]") for i in range(1, 5))]


@pytest.mark.parametrize("tolerance", [0, 1, 5, 90])
def test_nearest_close_at_any_tolerance(spark, tolerance):
    rng = random.Random(tolerance)
    days = {t: sorted(rng.sample(range(-200, 700), rng.choice([1, 5, 120]))) for t in "abc"}
    ledger = [(t, DAY + dt.timedelta(d), None if rng.random() < 0.2 else float(d)) for t, ds in days.items() for d in ds]
    probes = [(i, rng.choice("abcd"), DAY + dt.timedelta(rng.randrange(-300, 800))) for i in range(300)] + [(300, "a", None), (301, None, DAY)] + [(302 + i, "b", DAY) for i in range(50)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = S.nearest_close(df(probes, "id long, ticker string, date date"), df(ledger, "ticker string, date date, close double"), tolerance)
    got = {r["id"]: (r["near_date"], r["near_close"]) for r in found.collect()}
    assert len(got) == len(probes)
    for i, t, d in probes:
        known = [(abs((day - d).days), day, c) for k, day, c in ledger if d is not None and k == t and c is not None and abs((day - d).days) <= tolerance]
        assert got[i] == (min(known)[1:] if known else (None, None))


def test_rows_sorted_do_not_depend_on_the_tolerance(spark):
    ledger = spark.range(2000).select(F.lit("a").alias("ticker"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
    probes = spark.range(500).select("id", F.lit("a").alias("ticker"), F.date_add(F.lit(DAY), (F.col("id") % 50).cast("int")).alias("date"))
    for tolerance in (5, 90):
        assert S.nearest_close(probes, ledger, tolerance).filter("near_close = id % 50").count() == 500
        size = 2 * tolerance + 1
        copies = ledger.select(F.unix_date("date").alias("d")).select(F.size(F.array_distinct(F.array(F.floor((F.col("d") - tolerance) / size), F.floor((F.col("d") + tolerance) / size)))).alias("n")).agg(F.sum("n")).first()[0]
        assert copies <= 2 * 2000
