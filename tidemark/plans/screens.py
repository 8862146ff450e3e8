"""Queries of the board's filters, ranges and tiers, and of trends, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.operators import board as B
from tidemark.operators import rolling as R
from tidemark.operators import screen as C
from tidemark.operators import state as S
from tidemark.plans import bindings as D
from tidemark.plans.queries import ACTIVE, BOARD, CLAMP, HOT, LEDGER, MID, RE, SETUP, TOTAL, profiled, query, r6, signal_board

CHOSEN = ("click", "purchase")
NOW = "2024-02-01"


@query("f5_cap_tier", "SELECT c_custkey AS ticker, CASE WHEN c_acctbal * 100000 >= 5e8 THEN 'large' WHEN c_acctbal > 0 THEN 'small' END AS tier FROM customer")
def f5_cap_tier(spark, sf_dir):
    return D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), C.cap_tier(F.col("c_acctbal") * 100000).alias("tier"))


@query("f6_attention_group", BOARD + """, p AS (SELECT *, row_number() OVER (ORDER BY mentions) AS i, count(*) OVER () AS n FROM board WHERE mentions > 0),
t AS (SELECT greatest(5, max(mentions)) AS threshold FROM p WHERE i = least(n - 1, floor(0.7::DOUBLE * n)::BIGINT) + 1)
SELECT ticker, CASE WHEN mentions > 0 AND mentions >= threshold THEN 'attention' WHEN relative_volume >= 1.3 AND mentions < threshold THEN 'quiet' END AS attention FROM board, t""")
def f6_attention_group(spark, sf_dir):
    board = signal_board(spark, sf_dir)
    limit = B.attention_threshold(board, "mentions")
    rows = board.join(F.broadcast(limit), F.lit(True))  # limit is one row
    return rows.select("ticker", C.attention_group(F.col("mentions"), F.col("relative_volume"), F.col("threshold")).alias("attention"))


@query("f7_watchlist", BOARD + " SELECT ticker, mentions FROM board WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def f7_watchlist(spark, sf_dir):
    watched = D.read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))
    return signal_board(spark, sf_dir).join(watched, "ticker", "left_semi").select("ticker", "mentions")


@query("f8_range_totals", "WITH " + D.EVENTS_SQL + """ SELECT ticker, sum(mentions) FILTER (CAST(ts AS DATE) >= DATE '2024-01-15')::BIGINT AS mentions, sum(mentions) FILTER (CAST(ts AS DATE) < DATE '2024-01-15')::BIGINT AS before
FROM mention WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1""")
def f8_range_totals(spark, sf_dir):
    return C.range_totals(D.mention_events(spark, sf_dir), F.lit("2024-01-15").cast("date"), F.lit("2024-01-21").cast("date"))


RANGES = "SELECT o AS range_id, DATE '2024-01-01' + (o % 31)::INT AS start, DATE '2024-01-01' + (o % 31 + o // 31 * 3)::INT AS \"end\" FROM (SELECT DISTINCT o_orderkey % 124 AS o FROM orders)"


@query("f8_many_ranges", "WITH " + D.EVENTS_SQL + f""", daily AS (SELECT ticker, CAST(ts AS DATE) AS day, sum(mentions) AS mentions FROM mention GROUP BY 1, 2), asked AS ({RANGES})
SELECT range_id, ticker, sum(mentions) FILTER (day >= start)::BIGINT AS mentions, sum(mentions) FILTER (day < start)::BIGINT AS before FROM asked JOIN daily ON day BETWEEN start - (date_diff('day', start, "end") + 1)::INT AND "end" GROUP BY 1, 2""")
def f8_many_ranges(spark, sf_dir):
    """Ranges of 1, 4, 7 and 10 days from each day of a month, all from one reading of the events."""
    o = F.col("o_orderkey") % 124
    first = F.date_add(F.lit("2024-01-01").cast("date"), (o % 31).cast("int"))
    ranges = D.read(spark, sf_dir, "orders").select(o.alias("range_id"), first.alias("start"), F.date_add(first, (F.floor(o / 31) * 3).cast("int")).alias("end")).distinct()
    return C.totals_of_ranges(C.running_totals(D.mention_events(spark, sf_dir)), ranges)


@query("f9_filtered_board", BOARD + f""", x AS (SELECT * REPLACE ({TOTAL(CHOSEN)} AS mentions) FROM board), y AS (SELECT * FROM x WHERE mentions > 0 AND ticker::VARCHAR LIKE '%1%'),
z AS (SELECT ticker, mentions, 30 * sqrt(mentions / greatest(1, max(mentions) OVER ())) + 22 * {CLAMP("coalesce(momentum, 0) / 80 + 0.25::DOUBLE")} + 18 * {CLAMP("(sentiment + 0.25::DOUBLE) / 0.7::DOUBLE")}
 + 12 * {CLAMP("price_move / 6")} + 10 * {CLAMP("CASE WHEN relative_volume > 0 AND relative_volume <= 25 THEN relative_volume ELSE 1 END / 2.5::DOUBLE")} + 8 * {ACTIVE(CHOSEN)} / 5.0::DOUBLE AS raw FROM y)
SELECT ticker, mentions::BIGINT AS mentions, round(least(100, raw * 85 / greatest(1, max(raw) OVER ())), 6) AS peer_score FROM z""")
def f9_filtered_board(spark, sf_dir):
    return C.filtered_board(signal_board(spark, sf_dir), CHOSEN, "1", len(D.SOURCES)).select("ticker", "mentions", *r6("peer_score"))


@query("f10_capped_volume", "WITH " + D.EVENTS_SQL + " SELECT seq, CASE WHEN (relative_volume - 1) * 10 > 0 AND (relative_volume - 1) * 10 <= 25 THEN (relative_volume - 1) * 10 ELSE 1 END::DOUBLE AS volume FROM mention")
def f10_capped_volume(spark, sf_dir):
    return D.mention_events(spark, sf_dir).select("seq", B.capped_volume((F.col("relative_volume") - 1) * 10).alias("volume"))


@query("w17_trend", "WITH d AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date, count(*) AS mentions FROM events GROUP BY 1, 2) SELECT ticker, count(*) AS points, arg_min(mentions, date) AS first, arg_max(mentions, date) AS last, round((arg_max(mentions, date) - arg_min(mentions, date)) * 100.0::DOUBLE / arg_min(mentions, date), 6) AS change FROM d GROUP BY 1")
def w17_trend(spark, sf_dir):
    days = D.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("mentions"))
    return C.trend(days).select("ticker", "points", "first", "last", *r6("change"))


RATIO = """, v AS (SELECT ticker, mentions, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger),
w AS (SELECT ticker, CASE WHEN count(*) >= 30 THEN avg(mentions) FILTER (age <= 90) / CASE WHEN avg(mentions) FILTER (age > 90) = 0 THEN 0.0001 ELSE avg(mentions) FILTER (age > 90) END END AS ratio FROM v GROUP BY 1)"""


@query("a11_volume_ratio", LEDGER + RATIO + " SELECT ticker, round(ratio, 6) AS ratio, ratio >= 2 AS confirmed FROM w")
def a11_volume_ratio(spark, sf_dir):
    return C.volume_ratio(D.ledger(spark, sf_dir), "mentions").select("ticker", *r6("ratio"), "confirmed")


QUARTERS = LEDGER + """, q AS (SELECT ticker, year(date)::INT AS year, quarter(date)::INT AS quarter, sum(mentions)::BIGINT AS n FROM ledger GROUP BY 1, 2, 3),
l AS (SELECT *, lag(n) OVER o AS b1, lag(n, 2) OVER o AS b2, row_number() OVER (PARTITION BY ticker ORDER BY year DESC, quarter DESC) AS age FROM q WINDOW o AS (PARTITION BY ticker ORDER BY year, quarter)),
e AS (SELECT l.*, q.n AS ago FROM l LEFT JOIN q ON q.ticker = l.ticker AND q.year = l.year - 1 AND q.quarter = l.quarter WHERE age = 1 AND b1 IS NOT NULL),
k AS (SELECT ticker, CASE WHEN ago > 0 THEN n::DOUBLE / ago END AS ratio, CASE WHEN ago > 0 THEN n >= 10 AND n >= 2 * ago ELSE coalesce(n > b1 AND b1 > b2, false) END AS confirmed, CASE WHEN ago > 0 THEN 'year' ELSE 'trend' END AS basis FROM e)"""


def quarters(spark, sf_dir):
    return D.ledger(spark, sf_dir).groupBy("ticker", F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(F.sum("mentions").alias("n"))


@query("a12_quarter_acceleration", QUARTERS + " SELECT ticker, round(ratio, 6) AS ratio, confirmed, basis FROM k")
def a12_quarter_acceleration(spark, sf_dir):
    return C.quarter_acceleration(quarters(spark, sf_dir)).select("ticker", *r6("ratio"), "confirmed", "basis")


@query("sc7_phrase_score", QUARTERS + RATIO + " SELECT ticker, round((least(1, coalesce(w.ratio, 0) / 4) + CASE WHEN confirmed THEN coalesce(least(1, k.ratio / 4), 0.75::DOUBLE) ELSE 0 END) / 2, 6) AS score FROM k JOIN w USING (ticker)")
def sc7_phrase_score(spark, sf_dir):
    late = C.volume_ratio(D.ledger(spark, sf_dir), "mentions").select("ticker", F.col("ratio").alias("timeline"))
    both = C.quarter_acceleration(quarters(spark, sf_dir)).join(late, "ticker")
    return both.select("ticker", F.round(C.phrase_score(F.col("timeline"), F.col("confirmed"), F.col("ratio")), 6).alias("score"))


@query("tk5_buy_candidates", SETUP + """, f AS (SELECT s.ticker, stage, setup_score, mentions FROM setups s JOIN board b ON s.ticker = b.ticker WHERE setup_score >= 20 AND mentions >= 2),
c AS (SELECT count(*) AS calm FROM f WHERE stage NOT IN ('Crowded', 'Cooling'))
SELECT ticker, stage, setup_score FROM f, c WHERE calm < 4 OR stage NOT IN ('Crowded', 'Cooling') ORDER BY setup_score DESC, ticker LIMIT 4""")
def tk5_buy_candidates(spark, sf_dir):
    return C.buy_candidates(profiled(spark, sf_dir)).select("ticker", "stage", "setup_score")


@query("so2_except", "SELECT DISTINCT user_id AS ticker FROM events EXCEPT SELECT s_suppkey FROM supplier")
def so2_except(spark, sf_dir):
    covered = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"))
    return D.read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker")).join(covered, "ticker", "left_anti").distinct()


@query("so4_replace_days", LEDGER + f""", r AS (SELECT ticker, date, CASE WHEN date > {MID} THEN mentions + 1 ELSE mentions END AS mentions FROM ledger)
SELECT * FROM r WHERE date IN (SELECT DISTINCT date FROM r ORDER BY date DESC LIMIT 120)""")
def so4_replace_days(spark, sf_dir):
    rows = D.ledger(spark, sf_dir).select("ticker", "date", "mentions")
    batch = rows.filter(F.col("date") > F.lit("1998-06-30").cast("date")).withColumn("mentions", F.col("mentions") + 1)
    return C.replace_days(rows, batch).select("ticker", "date", "mentions")


@query("sf8_quarter_range", "SELECT o_orderkey AS id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS first, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS last FROM orders")
def sf8_quarter_range(spark, sf_dir):
    first, last = C.quarter_range(F.col("o_orderdate").cast("date"))
    return D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("first"), last.alias("last"))


@query("sf10_signed", "SELECT s_suppkey AS ticker, format('{:+.1f}', floor(s_acctbal * 10 + 0.5::DOUBLE) / 10.0::DOUBLE) AS balance FROM supplier")
def sf10_signed(spark, sf_dir):
    return D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), C.signed(F.col("s_acctbal")).alias("balance"))


@query("sf16_relative_time", f"""WITH x AS (SELECT event_id, greatest(0, floor(epoch(TIMESTAMP '{NOW}' - ts) / 60))::BIGINT AS m FROM events)
SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM x""")
def sf16_relative_time(spark, sf_dir):
    return D.read(spark, sf_dir, "events").select("event_id", C.relative_time(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")).alias("age"))


SPRINGS = LEDGER + f""", m AS (SELECT ticker, date, CASE WHEN volume >= 60 THEN 'released' WHEN volume >= 20 THEN 'coiled' ELSE 'dead' END AS state FROM ledger),
a AS (SELECT ticker, arg_max(state, date) AS was FROM m WHERE date <= {MID} GROUP BY 1), b AS (SELECT ticker, arg_max(state, date) AS now FROM m GROUP BY 1)"""


@query("st6_spring_events", SPRINGS + """ SELECT ticker, was, now, CASE WHEN now = 'dead' THEN 'normal' ELSE 'high' END AS priority FROM b LEFT JOIN a USING (ticker)
WHERE was IS DISTINCT FROM now AND (now <> 'coiled' OR ticker % 2 = 0)""")
def st6_spring_events(spark, sf_dir):
    days = D.ledger(spark, sf_dir).select("ticker", "date", F.when(F.col("volume") >= 60, "released").when(F.col("volume") >= 20, "coiled").otherwise("dead").alias("state"))
    at = lambda rows: rows.groupBy("ticker").agg(F.max_by("state", "date").alias("state"))
    hot = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker")).filter("ticker % 2 = 0")
    return S.spring_events(at(days.filter(F.col("date") <= F.lit("1998-06-30").cast("date"))), at(days), hot).select("ticker", "was", "now", "priority")


@query("en1_profiles", "SELECT s_suppkey AS ticker, s_name AS name, n_name AS industry, r_name AS sector, CASE WHEN s_acctbal * 100000 >= 5e8 THEN 'large' WHEN s_acctbal > 0 THEN 'small' END AS tier FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def en1_profiles(spark, sf_dir):
    supplier, nation, region = (D.read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"), C.cap_tier(F.col("s_acctbal") * 100000).alias("tier"))
