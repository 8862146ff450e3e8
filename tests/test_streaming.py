"""Streaming folds against their batch forms, over files that arrive one after another."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.sources import tables
from tidemark.streaming import folds

T0 = dt.datetime(2024, 1, 1)
EVENTS = "seq long, ts timestamp, ticker long, mentions long"


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of files, read one a batch, and the same rows at rest."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
        at = str(tmp_path / "in")
        files = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(at)
        return files, spark.read.schema(schema + ", part int").parquet(at)

    return make


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def events(days, ticker=1):
    return [(i, T0 + dt.timedelta(days=d), ticker, 2) for i, d in enumerate(days)]


def test_tumbling_windows_drop_rows_behind_the_watermark(spark, arriving, tmp_path):
    far = (99, T0 + dt.timedelta(days=30), 1, 1)
    stream, _ = arriving([events([0.1, 0.2, 1.1]), [far], [far], [(7, T0, 1, 50)]], EVENTS)
    got = {(r["start"], r["mentions"]) for r in run(folds.mention_windows(stream), tmp_path, "tumbling")}
    assert got == {(T0, 4), (T0 + dt.timedelta(1), 2)}


def test_sessions_and_sliding_windows(spark, arriving, tmp_path):
    stream, _ = arriving([events([0, 0.1, 0.2, 1.0]), [(99, T0 + dt.timedelta(days=30), 1, 1)]], EVENTS)
    assert sorted(r["mentions"] for r in run(folds.mention_sessions(stream), tmp_path, "sessions")) == [2, 6]
    assert sum(r["mentions"] for r in run(folds.mention_windows(stream, "2 days", "1 day"), tmp_path, "sliding")) == 16


def test_weeks_start_on_monday(spark, arriving, tmp_path):
    stream, _ = arriving([events([0, 6.9, 7.1]), [(99, T0 + dt.timedelta(days=60), 1, 1)]], EVENTS)
    assert {(r["week"], r["mentions"]) for r in run(folds.weekly_mentions(stream), tmp_path, "weeks")} == {("2024-W01", 4), ("2024-W02", 2)}


def test_events_that_arrive_again_count_once(spark, arriving, tmp_path):
    stream, _ = arriving([events([0, 0.1]), events([0, 0.1])], EVENTS)
    assert len(run(folds.arrivals(stream), tmp_path, "once")) == 2


def test_ledger_stream_equals_upserts_of_its_batches(spark, arriving, tmp_path):
    row = lambda seq, ticker, day, close: (seq, ticker, dt.date(2024, 1, day), 1, close, 1.0, None)
    batches = [[row(1, 1, 1, 1.0), row(2, 1, 2, 2.0), row(3, 1, 2, 3.0)], [row(4, 1, 2, None), row(5, 2, 1, 5.0)]]
    stream, _ = arriving(batches, "seq long, ticker long, date date, mentions long, close double, volume double, wiki double")
    path = str(tmp_path / "ledger")
    folds.fold_ledger(stream, path, str(tmp_path / "check")).awaitTermination(120)
    got = tables.load(spark, path, folds.LEDGER).select("ticker", "date", "close").collect()
    assert {(r["ticker"], r["date"].day, r["close"]) for r in got} == {(1, 1, 1.0), (1, 2, None), (2, 1, 5.0)}
    assert L.NUMBERS == ("mentions", "close", "volume", "wiki")


def test_state_changes_come_out_once(spark, arriving, tmp_path):
    stream, _ = arriving([[(1, 1, "a"), (2, 1, "a"), (3, 2, "b")], [(4, 1, "c"), (5, 2, "b")]], "seq long, ticker long, state string")
    got = {(r["ticker"], r["was"], r["now"], r["seq"]) for r in run(folds.state_changes(stream.select("seq", "ticker", "state")), tmp_path, "changes")}
    assert got == {(1, None, "a", 1), (2, None, "b", 3), (1, "a", "c", 4)}


def test_alerts_are_sent_by_priority(spark, arriving, tmp_path):
    stream, _ = arriving([[("x", "high"), ("y", "normal")]], "subject string, priority string")
    at = tmp_path / "sent"
    at.mkdir()

    def send(events):
        for e in events:
            (at / e["subject"]).write_text(e["priority"])

    folds.alert(stream, send, str(tmp_path / "alerts"), F.col("priority") == "high").awaitTermination(120)
    assert [p.name for p in at.iterdir()] == ["x"]
