"""The ledger of a refresh, on built rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import ledger as L

ROWS = "ticker string, date date, mentions long, share_of_voice double, close double, volume double, wiki double"
META = "ticker string, name string, sector string, sub string, article string, first_seen date"
EVENTS = "seq long, ticker string, source string, mentions long, last_price double, volume double"
REGISTRY = "ticker string, name string, sector string, industry string, article string"
SIGNALS = "ticker string, name string, sector string, industry string, description_url string"
TODAY = dt.date(2024, 6, 1)


def ago(days):
    return TODAY - dt.timedelta(days)


def run(spark, rows, events, meta=(), registry=(), signals=(), protected=(), **more):
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    ledger, known = L.run(frame(rows, ROWS), frame(meta, META), frame(events, EVENTS), frame(registry, REGISTRY), frame(signals, SIGNALS), frame([(p,) for p in protected], "ticker string"), F.lit(TODAY), **more)
    return {(r["ticker"], r["date"]): tuple(r)[2:] for r in ledger.collect()}, {r["ticker"]: tuple(r)[1:] for r in known.collect()}


def test_every_known_or_active_ticker_gets_a_row(spark):
    old = [("A", ago(1), 5, 0.5, 10.0, 100.0, 7.0), ("B", ago(2), 5, 0.5, None, 9.0, 8.0)]
    events = [(1, "A", "Price/Volume", 3, 11.0, 50.0), (2, "A", "Price/Volume", 0, float("nan"), 60.0), (3, "A", "Reddit", None, 99.0, 1.0), (4, "C", "Reddit", 1, 5.0, 5.0), (5, "", "Reddit", 50, None, None), (6, None, "Reddit", 50, None, None)]
    got, _ = run(spark, old, events)
    assert got[("A", TODAY)] == (3, 0.75, 11.0, 50.0, None)
    assert got[("B", TODAY)] == (0, 0.0, None, None, None)
    assert got[("C", TODAY)] == (1, 0.25, None, None, None)
    assert got[("A", ago(1))] == (5, 0.5, 10.0, 100.0, 7.0) and len(got) == 5


def test_a_later_run_of_the_day_replaces_its_row_and_keeps_the_close(spark):
    old = [("A", ago(1), 5, 0.5, 10.0, 100.0, 7.0), ("A", TODAY, 2, 1.0, 12.0, 100.0, 7.0)]
    got, _ = run(spark, old, [(1, "A", "Reddit", 4, None, None)])
    assert got == {("A", ago(1)): (5, 0.5, 10.0, 100.0, 7.0), ("A", TODAY): (4, 1.0, 12.0, None, None)}


def test_dormant_tickers_go_with_their_meta_unless_protected(spark):
    old = [(t, ago(days), n, 0.0, 1.0, 1.0, None) for t, days, n in (("OLD", 91, 1), ("SAFE", 91, 1), ("EDGE", 90, 1), ("QUIET", 95, 0), ("QUIET", 5, 0))]
    meta = [(t, t, None, None, None, ago(200)) for t in ("OLD", "SAFE", "EDGE", "QUIET")]
    got, known = run(spark, old, [(1, "NEW", "Reddit", 1, None, None)], meta, protected=["SAFE"])
    assert {t for t, _ in got} == set(known) == {"SAFE", "EDGE", "NEW"}
    assert known["NEW"][-1] == TODAY and known["SAFE"][-1] == ago(200)


def test_meta_is_the_signals_then_the_registrys_then_the_old(spark):
    old = [("A", ago(1), 1, 0.0, 1.0, 1.0, None), ("B", ago(1), 1, 0.0, 1.0, 1.0, None)]
    meta = [("A", "Old A", "old", "old", "old", ago(9)), ("B", "Old B", "old", None, None, ago(9))]
    registry = [("A", "List A", "", None, "List article"), ("C", "List C", "tech", "chips", "C")]
    signals = [("A", None, None, "soft", "https://w.example/wiki/A_%26_B"), ("B", "Unlisted", "x", "x", None), ("C", " ", None, None, "https://w.example/about")]
    _, known = run(spark, old, [(1, "C", "Reddit", 1, None, None)], meta, registry, signals)
    assert known == {"A": ("List A", "old", "soft", "A & B", ago(9)), "B": ("Old B", "old", None, None, ago(9)), "C": ("List C", "tech", "chips", "C", TODAY)}


def test_no_events_change_nothing_and_the_newest_rows_stay(spark):
    old = [("A", ago(i), 1, 0.0, 1.0, 1.0, None) for i in range(1, 5)]
    meta = [("A", "Old A", None, None, None, ago(9))]
    got, known = run(spark, old, [], meta, keep=2)
    assert len(got) == 4 and set(known) == {"A"}
    got, _ = run(spark, old, [(1, "A", "Reddit", 1, None, None)], meta, keep=2)
    assert {d for _, d in got} == {TODAY, ago(1)}
