"""Detail texts, risks, exports, log entries, names and caps on constructed rows."""

import csv
import datetime as dt
import io

from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import board as B
from tidemark.operators import discovery as X
from tidemark.operators import screen as C

DAY = dt.date(2026, 1, 1)


def test_trend_texts(spark):
    rows = [
        (2.04, 4.25, 0, 0, 1, 10.0, None), (1.3, 2.9, 2, 3, 2, 10.0, "Energy"), (1.5, 12.0, 3, 0, 2, 10.0, None), (1.0, 3.0, 1, 0, 1, 10.0, None),
        (1.0, 0.0, 1200, 4, 5, 10.0, "Tech"), (1.0, 0.0, 3, 5, 2, 10.0, ""), (1.0, 0.0, 0, 0, 4, 41.6, None), (1.0, -9.0, 0, 0, 1, 41.5, None), (None, None, 0, 0, 2, 7.0, None), (1.0, 0.0, 0, 0, 1, 7.0, "Tech"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v double, m double, s long, n long, a int, score double, sector string")
    said = C.trend_text(*(F.col(c) for c in ("v", "m", "s", "n", "a", "score", "sector")))
    got = [r["t"] for r in df.select("i", said.alias("t")).orderBy("i").collect()]
    assert got == [
        "Under-the-radar: volume running 2.0× normal with price up 4.3% — crowd attention hasn't arrived yet, making this an early-mover signal.",
        "Under-the-radar: volume running 1.3× normal — crowd attention hasn't arrived yet, making this an early-mover signal.",
        "Retail: strong 12.0% price move · 1.5× normal volume · 3 social mentions.",
        "Price/volume: 3.0% price move.",
        "Retail: 1,200 social mentions · 4 news hits · 5 data platforms · Tech.",
        "News: 3 social mentions · 5 news hits.",
        "Multi-source: 4 data platforms.",
        "Composite signal: 42/100 across 1 data source — no single dominant catalyst yet.",
        "Composite signal: 7/100 across 2 data sources — no single dominant catalyst yet.",
        "Multi-source: Tech.",
    ]


BOARD = "ticker string, mentions long, momentum double, sentiment double, price_move double, relative_volume double, last_price double, signal_score double, from_a long, from_b long, from_c long"


def board(spark, *rows):
    return spark.createDataFrame(rows, BOARD)


def test_very_small_companies_are_a_risk(spark):
    plain = board(spark, *(((t, 5, 20.0, 0.1, 1.0, 1.5, 3.0, 40.0, 2, 2, 1)) for t in "stuvwxyz"))
    caps = spark.createDataFrame(list(zip("stuvwxyz", (None, 0.0, -5.0, 2.4e7, 2.5e7, 9.99e7, 1e8, float("nan")))), "ticker string, market_cap double")
    profile = lambda df: {r["ticker"]: (r["setup_score"], r["risks"]) for r in B.profile(df, ["a"], ["b"], ["c"]).collect()}
    was, got = profile(plain), profile(plain.join(caps, "ticker"))
    small = {t: was[t][0] - got[t][0] for t in was}
    assert small == {"s": 0, "t": 0, "u": 0, "v": 8, "w": 5, "x": 5, "y": 0, "z": 0}
    assert {t: got[t][1] for t in "vyz"} == {"v": "Micro-cap volatility", "y": "", "z": ""}


def test_exported_lines_are_csv(spark, tmp_path):
    rows = board(spark, ("A", 5, None, 0.1239, -0.05, 1.5, None, 40.06, 2, 2, 1), ("B", 7, 12.345, -1.0, 13.0, 9.0, 12.0, 99.0, 7, 0, 0), ("C", 1, 0.0, 0.0, 0.0, 1.0, 1.25, 0.0, 0, 0, 1))
    named = rows.join(spark.createDataFrame([("A", 'Acme "The, Best" Inc'), ("B", "")], "ticker string, name string"), "ticker", "left")
    B.save_csv(B.export_rows(B.profile(named, ["a"], ["b"], ["c"]), ["a", "b", "c"]), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    got = list(csv.DictReader(io.StringIO("".join(f.read_text() for f in files))))
    assert len(files) == 1 and [r["rank"] for r in got] == ["1", "2", "3"]
    by = {r["ticker"]: r for r in got}
    assert (by["A"]["name"], by["B"]["name"], by["C"]["name"]) == ('Acme "The, Best" Inc', "B", "C")
    assert (by["A"]["market_price"], by["B"]["market_price"], by["C"]["market_price"]) == ("", "12", "1.25")
    assert (by["A"]["momentum_percent"], by["B"]["momentum_percent"], by["A"]["sentiment"], by["A"]["attention_score"]) == ("", "12.35", "0.124", "40.1")
    assert by["B"]["risk_flags"] == "Extended move | Extreme volume | One-source heavy" and by["B"]["stage"] == "Crowded"
    assert (by["B"]["a"], by["B"]["c"], by["C"]["c"]) == ("7", "0", "1")


def test_log_entries_are_releases_dead_coils_and_theme_stages(spark):
    springs = spark.createDataFrame([("release", "SO"), ("dead-coil", "AL"), ("new-coil-hot-theme", "CO"), ("release", "NAN"), ("release", "NONE")], "type string, ticker string")
    themes = spark.createDataFrame([("theme-stage-transition", "power", "wave"), ("theme-stage-transition", "quiet", None), ("other", "x", "wave")], "type string, theme string, stage string")
    ledger = spark.createDataFrame([("SO", DAY, 18.0), ("SO", dt.date(2025, 1, 1), 1.0), ("AL", DAY, 90.0), ("CO", DAY, 5.0), ("NAN", DAY, float("nan"))], "ticker string, date date, close double")
    got = {r["id"]: (r["type"], r["ticker"], r["theme"], r["stage"], r["date"], r["base_price"]) for r in A.log_entries(springs, themes, ledger, F.lit(DAY)).collect()}
    assert got == {
        "release-SO-2026-01-01": ("release", "SO", None, None, DAY, 18.0), "dead-coil-AL-2026-01-01": ("dead-coil", "AL", None, None, DAY, 90.0),
        "theme-stage-power-wave-2026-01-01": ("theme-stage", None, "power", "wave", DAY, None),
    }


def test_names_and_caps(spark):
    signals = spark.createDataFrame([("AB", "AB", 2.0), ("cd", None, 2.0), ("EF", "Kept", None), ("GH", "", 5.0), ("IJ", "IJ", float("inf")), ("KL", "KL", 3.0)], "ticker string, name string, last_price double")
    titles = spark.createDataFrame([("AB", "1", "AB O'NEIL CORP"), ("CD", "2", "Cd Works"), ("EF", "3", "E"), ("GH", "4", ""), ("IJ", "5", "I J")], "ticker string, cik string, title string")
    shares = spark.createDataFrame([("1", 3e8), ("2", 10.4), ("3", 5.0), ("4", 0.0), ("5", 5.0)], "cik string, shares double")
    got = {r["ticker"]: (r["name"], r["market_cap"], r["cap_tier"]) for r in X.enrich_caps(signals, titles, shares).collect()}
    assert got == {"AB": ("Ab O'Neil Corp", 600_000_000, "large"), "cd": ("Cd Works", 21, "small"), "EF": ("Kept", None, None), "GH": ("", None, None), "IJ": ("I J", None, None), "KL": ("KL", None, None)}
