"""Expiring state in streams, incremental state tables and the outbox."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import ledger as L
from tidemark.sources import deltas, files
from tidemark.streaming import folds, leases, outbox

DAY = dt.date(2024, 1, 1)
LEDGER = "ticker long, date date, mentions long, close double, volume double, wiki double"


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of files, read one a batch in the given order."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
        return spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name).collect()


def test_leaders_of_a_stream_are_those_of_daily_runs(spark, arriving, tmp_path):
    """Triggers out of order within the lateness, on the day of expiry, the day after, and several a day."""
    rng = random.Random(7)
    days = {t: sorted(rng.choices(range(600), k=6)) for t in "BCDE"} | {"A": [0, 5, 182, 183, 365, 366, 400]}
    rows = [(t, DAY + dt.timedelta(d), f"{t}{d}{x}") for t, ds in days.items() for d in ds for x in "xy"]
    industries = spark.createDataFrame([(t, "s1" if t < "D" else "s2") for t in "ABCDEFG"], "ticker string, sub string")
    edges = spark.createDataFrame([("A", "G", 5), ("F", "Z", 2)], "src string, dst string, n long")
    arrival = sorted(rows, key=lambda r: (r[1] - DAY).days + rng.randint(0, 6))
    batches = [arrival[i : i + 9] for i in range(0, len(arrival), 9)]
    far = [("A", DAY + dt.timedelta(2000), "end")]
    stream = arriving([*batches, far, far], "ticker string, date date, headline string")
    got = run(leases.leaders(stream, industries, edges, late="7 days"), tmp_path, "leaders")

    active = spark.createDataFrame([], "ticker string, detected date, expires date, headline string, followers array<string>")
    by_day = {}
    for t, d, h in rows:
        by_day.setdefault(d, {})[t] = max(h, by_day.get(d, {}).get(t, ""))
    want = set()
    for d in sorted(by_day):
        triggers = spark.createDataFrame(list(by_day[d].items()), "ticker string, headline string")
        held = A.leaders(active, triggers, industries, edges, F.lit(d)).collect()
        want |= {(r["ticker"], r["detected"], r["expires"], r["headline"], tuple(r["followers"])) for r in held}
        active = spark.createDataFrame(held, active.schema)
    granted = [(r["ticker"], r["detected"], r["expires"], r["headline"], tuple(r["followers"])) for r in got if r["event"] == "granted"]
    assert len(granted) == len(set(granted)) and set(granted) == want
    assert {r[1] for r in granted if r[0] == "A"} == {DAY, DAY + dt.timedelta(183), DAY + dt.timedelta(366)}
    expired = {(r["ticker"], r["detected"], r["expires"]) for r in got if r["event"] == "expired"}
    assert expired == {r[:3] for r in want}, "all have expired by the last watermark"


def test_rows_behind_the_watermark_and_checks_by_age(spark, arriving, tmp_path):
    at = lambda d: DAY + dt.timedelta(d)
    stream = arriving([[("p", at(40)), ("q", at(40))], [("p", at(60))], [("p", at(0)), (None, at(61)), ("p", None)], [("p", at(71)), ("q", at(70))], [("z", at(500))], [("z", at(501))]], "phrase string, date date")
    got = {(r["phrase"], r["checked"]) for r in run(leases.checks(stream, max_age=30, late="2 days"), tmp_path, "checks")}
    assert got == {("p", at(40)), ("q", at(40)), ("p", at(71))}


def ledger_rows(tickers, day, close=1.0):
    return [(t, DAY + dt.timedelta(day), 1, close, 2.0, None) for t in tickers]


def test_a_small_batch_writes_a_small_delta(spark, tmp_path):
    path = str(tmp_path / "table")
    rng = random.Random(1)
    everything = [r for d in range(100) for t in range(1000) for r in ledger_rows([t], d, rng.random())]
    rng.shuffle(everything)
    frame = lambda rows: spark.createDataFrame(rows, LEDGER)
    deltas.upsert(frame(everything), path, ["ticker", "date"], buckets=2)
    whole = spark.createDataFrame(everything, LEDGER).count()
    change = [r for d in range(100) for r in ledger_rows(range(0, 1000, 100), d, -1.0)]
    now = deltas.upsert(frame(change), path, ["ticker", "date"])
    new = spark.read.parquet(f"{path}/data/segment={max(s for x in now.segments.values() for s in x)}")
    assert new.count() == 1000 == whole // 100
    got = deltas.read(spark, path, LEDGER, ["ticker", "date"])
    assert got.count() == whole and {r["ticker"] for r in got.filter("close = -1").select("ticker").distinct().collect()} == set(range(0, 1000, 100))
    assert sum(files.size(spark, f"{path}/data/{s}") for s in files.names(spark, f"{path}/data")[1:]) < 0.02 * files.size(spark, f"{path}/data")


def test_versions_replays_compaction_and_removal(spark, tmp_path):
    path, keys = str(tmp_path / "table"), ["ticker", "date"]
    frame = lambda rows: spark.createDataFrame(rows, LEDGER)
    rows = lambda at=None: sorted((r["ticker"], r["date"], r["close"]) for r in deltas.read(spark, path, LEDGER, keys, at).collect())
    assert rows() == [] and deltas.vacuum(spark, path) == [] and deltas.compact(spark, path, LEDGER, keys) is None
    want = {}
    rng = random.Random(2)
    for n in range(6):
        batch = ledger_rows(rng.sample(range(30), 12), rng.randrange(3), float(n))
        done = deltas.upsert(frame(batch), path, keys, "w", n, buckets=4)
        assert deltas.upsert(frame(ledger_rows([1], 0, 99.0)), path, keys, "w", n) == done, "a replay changes nothing"
        want |= {r[:2]: r[3] for r in batch}
    expected = sorted((*k, c) for k, c in want.items())
    assert rows() == expected
    before = deltas.snapshot(spark, path)
    reader = deltas.read(spark, path, LEDGER, keys, before)
    gone = [t for t, _ in sorted(want)[:3]]
    deltas.upsert(frame([r for t in gone for r in ledger_rows([t], 0)] + [r for t in gone for d in (1, 2) for r in ledger_rows([t], d)]), path, keys, "w", 6, deletes=True)
    after = deltas.compact(spark, path, LEDGER, keys, most=1, keep=lambda df: L.newest(df, 2))
    assert all(len(s) == 1 for s in after.segments.values()) and after.writers == {"w": 6}
    assert sorted((r["ticker"], r["date"], r["close"]) for r in reader.collect()) == expected == rows(before), "a reader keeps its version"
    left = sorted((r["ticker"], r["date"], r["close"]) for r in L.newest(frame([(t, d, 1, c, 2.0, None) for (t, d), c in want.items() if t not in gone]), 2).collect())
    assert rows() == left
    (tmp_path / "table/data" / f"segment={'0' * 11}1-orphan").mkdir()
    removed = deltas.vacuum(spark, path, versions=1)
    assert f"segment={'0' * 11}1-orphan" in removed and rows() == left
    assert deltas.snapshot(spark, path, before.version) is None and len(files.names(spark, f"{path}/data")) == 1


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    path, keys = str(tmp_path / "table"), ["ticker", "date"]
    deltas.upsert(spark.createDataFrame(ledger_rows([1, 2], 0), LEDGER), path, keys)
    (tmp_path / "table/versions/000000000002").mkdir()
    assert deltas.snapshot(spark, path).version == 1 and deltas.read(spark, path, LEDGER, keys).count() == 2


def test_ledger_stream_into_deltas(spark, arriving, tmp_path):
    row = lambda seq, ticker, day, close: (seq, ticker, DAY + dt.timedelta(day), 1, close, 1.0, None)
    stream = arriving([[row(1, 1, 0, 1.0), row(2, 1, 1, 2.0), row(3, 1, 1, 3.0)], [row(4, 1, 1, None), row(5, 2, 0, 5.0)], [row(6, 2, 1, 6.0)]], f"seq long, {LEDGER}")
    path = str(tmp_path / "ledger")
    folds.ledger_deltas(stream, path, str(tmp_path / "check"), keep=1, most=1).awaitTermination(300)
    got = {(r["ticker"], (r["date"] - DAY).days, r["close"]) for r in folds.load_ledger(spark, path, keep=1).collect()}
    assert got == {(1, 1, None), (2, 1, 6.0)}
    assert deltas.snapshot(spark, path).writers["stream"] == 2


def test_a_failing_sink_gets_each_event_once(spark, arriving, tmp_path):
    schema = "subject string, priority string"
    rows = [(f"s{i}", "high") for i in range(20)] + [("same", "high")] * 2 + [("low", "normal")]
    path, sent = str(tmp_path / "outbox"), tmp_path / "sent"
    sent.mkdir()
    stream = arriving([rows[:12], rows[12:]], schema)
    outbox.fill(stream.select("subject", "priority"), path, str(tmp_path / "check"), F.col("priority") == "high").awaitTermination(300)
    batch = spark.createDataFrame(rows[:12], schema)
    outbox.put(batch, path, 0)  # as after a failure
    outbox.put(batch, path, 0)

    def send(event):
        if event["subject"] in ("s5", "s15") and not (sent / "up").exists():
            raise OSError("down")
        with open(sent / f"{event['id']}-{event['subject']}", "x"):  # fails if it was sent before
            pass

    first, left = outbox.deliver(spark, path, schema, send)
    assert 0 < left < 22 and first + left == 22
    (sent / "up").touch()
    assert outbox.deliver(spark, path, schema, send) == (22, 0) == outbox.deliver(spark, path, schema, send)
    names = [p.name.rsplit("-", 1)[1] for p in sent.iterdir() if p.name != "up"]
    assert sorted(names) == sorted(s for s, p in rows if p == "high")


def test_outbox_without_events(spark, tmp_path):
    assert outbox.deliver(spark, str(tmp_path / "none"), "subject string", lambda e: None) == (0, 0)
