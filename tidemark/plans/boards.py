"""Queries of the shown board, its order and texts, springs and ranges, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import board as B
from tidemark.operators import headlines as N
from tidemark.operators import ledger as L
from tidemark.operators import rolling as R
from tidemark.operators import screen as C
from tidemark.operators import themes as H
from tidemark.plans import bindings as D
from tidemark.plans.news import CATALYST_RE, RANKED, TOP, V
from tidemark.plans.queries import ACTIVE, BOARD, CLAMP, CLASSIFY, LEDGER, SCORE, SETUP, T252, profiled, query, r6, relaxed, signal_board


def own_ticker(df):
    return df.withColumn("ticker", F.substring("ticker", 2, 12).cast("long"))


MODES = {"mentions": "mentions", "momentum": "coalesce(momentum, 0)", "score": "setup_score"}
SHOWN = SETUP + ", whole AS (SELECT board.*, setup_score, stage FROM board JOIN setups USING (ticker))"


@query("tk1_sorted_board", SHOWN.replace("JOIN setups USING", "JOIN (SELECT ticker, setup_score, stage FROM setups) USING") + " " + " UNION ALL ".join(f"SELECT '{m}' AS mode, ticker, place FROM (SELECT ticker, row_number() OVER (ORDER BY {k} DESC, ticker) AS place FROM whole) WHERE place <= 50" for m, k in MODES.items()))
def tk1_sorted_board(spark, sf_dir):
    board = profiled(spark, sf_dir)
    parts = [B.shown(board, m).select(F.lit(m).alias("mode"), "ticker", "place") for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tk10_shown_board", SETUP + " SELECT ticker, setup_score, row_number() OVER (ORDER BY setup_score DESC, ticker) AS place FROM setups QUALIFY place <= 50")
def tk10_shown_board(spark, sf_dir):
    return B.shown(profiled(spark, sf_dir), "score").select("ticker", "setup_score", "place")


SIGNALLED = "signal_score AS (SELECT *, greatest(0, least(100, " + SCORE + ")) AS signal_score FROM board)"


@query("sc6_composite", BOARD + f""", {SIGNALLED} SELECT ticker, round(100 * (0.31::DOUBLE * {CLAMP("signal_score / 85")} + 0.17::DOUBLE * {CLAMP("(coalesce(momentum, 0) + 10) / 80")} + 0.15::DOUBLE * {CLAMP("(sentiment + 0.2::DOUBLE) / 0.65::DOUBLE")}
 + 0.13::DOUBLE * {CLAMP("(price_move + 1) / 7")} + 0.09::DOUBLE * {CLAMP("relative_volume / 2.5::DOUBLE")} + 0.08::DOUBLE * {ACTIVE(D.SOURCES)} / {len(D.SOURCES)}.0::DOUBLE + 0.07::DOUBLE * {CLAMP("from_error / greatest(8, mentions)::DOUBLE")}), 6) AS composite FROM signal_score""")
def sc6_composite(spark, sf_dir):
    return B.composite(B.attention_score(signal_board(spark, sf_dir), D.SOURCES), D.SOURCES, "error").select("ticker", *r6("composite"))


GROUPED = {"social": D.SOCIAL, "news": D.CATALYST, "market": D.MARKET}
PARTS = " UNION ALL ".join(
    [f"SELECT ticker, 'group' AS kind, '{g}' AS name, {' + '.join(f'from_{s}' for s in ss)} AS mentions FROM board" for g, ss in GROUPED.items()]
    + [f"SELECT ticker, 'source', '{s}', from_{s} FROM board" for s in D.SOURCES]
)


@query("a16_source_breakdown", BOARD + f", p AS ({PARTS}) SELECT ticker, kind, name, mentions::BIGINT AS mentions, round(mentions::DOUBLE / max(mentions) OVER (PARTITION BY ticker, kind), 6) AS share FROM p WHERE mentions > 0")
def a16_source_breakdown(spark, sf_dir):
    return B.source_breakdown(signal_board(spark, sf_dir), GROUPED).withColumn("share", F.round("share", 6))


TOPS = RANKED.removeprefix("WITH " + D.HEAD_SQL) + ", " + TOP(V.NEWS_SOURCES)


@query("p5_board_rows", SETUP + ", " + D.HEAD_SQL + TOPS + f""", own AS (SELECT CAST(substr(ticker, 2) AS BIGINT) AS ticker, title, is_news FROM top),
s AS (SELECT ticker, setup_score, row_number() OVER (ORDER BY setup_score DESC, ticker) AS place FROM setups QUALIFY place <= 50)
SELECT place, s.ticker, coalesce(s_name, s.ticker::VARCHAR) AS name, setup_score, CASE WHEN momentum IS NULL THEN 'new' ELSE format('{{:+.1f}}%', momentum) END AS momentum, {", ".join(f"round(from_{x}::DOUBLE / greatest(1, mentions), 6) AS mix_{x}" for x in D.SOURCES)},
  CASE WHEN regexp_matches(title, '{CATALYST_RE}') THEN CASE WHEN is_news THEN 'News' ELSE 'Buzz' END END AS badge FROM s JOIN board USING (ticker) LEFT JOIN supplier ON s_suppkey = s.ticker AND s_acctbal > 0 LEFT JOIN own ON own.ticker = s.ticker""")
def p5_board_rows(spark, sf_dir):
    top = own_ticker(N.top_headline(D.headlines(spark, sf_dir)))
    names = D.read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"))
    return B.board_rows(profiled(spark, sf_dir), D.SOURCES, top, names)


@query("p3_stock_names", "SELECT DISTINCT user_id AS ticker, coalesce(s_name, user_id::VARCHAR) AS name FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def p3_stock_names(spark, sf_dir):
    names = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"))
    rows = D.read(spark, sf_dir, "events").select(F.col("user_id").alias("ticker")).distinct().join(names, "ticker", "left")
    return rows.select("ticker", F.coalesce("name", F.col("ticker").cast("string")).alias("name"))


@query("p1_closes", LEDGER + " SELECT ticker, count(*) AS n, round(list_sum(list(close ORDER BY date)[1:5]), 6) AS first_five FROM ledger GROUP BY 1")
def p1_closes(spark, sf_dir):
    five = F.aggregate(F.slice("closes", 1, 5), F.lit(0.0), lambda a, x: a + x)
    return C.closes(D.ledger(spark, sf_dir)).select("ticker", F.size("closes").cast("long").alias("n"), F.round(five, 6).alias("first_five"))


@query("p2_snapshots", "SELECT 'history' AS case, o_custkey AS ticker, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'none', user_id, count(*) FROM events GROUP BY 2")
def p2_snapshots(spark, sf_dir):
    """The history where there is one, else the current snapshot."""
    counted = lambda table, key: D.read(spark, sf_dir, table).groupBy(F.col(key).alias("ticker")).agg(F.count("*").alias("n"))
    history, current = counted("orders", "o_custkey"), counted("events", "user_id")
    return C.snapshots(history, current).withColumn("case", F.lit("history")).unionByName(C.snapshots(history.filter("n > 1000000000"), current).withColumn("case", F.lit("none")))


DAILY = "WITH " + D.EVENTS_SQL + f""", daily AS (SELECT CAST(ts AS DATE) AS generated, ticker, sum(mentions)::BIGINT AS mentions, sum(sentiment * mentions) / sum(mentions) AS sentiment, sum(price_move * mentions) / sum(mentions) AS price_move,
 sum(relative_volume * mentions) / sum(mentions) AS relative_volume, arg_max(last_price, seq) FILTER (last_price IS NOT NULL) AS last_price, {", ".join(f"coalesce(sum(mentions) FILTER (source = '{s}'), 0)::BIGINT AS from_{s}" for s in D.SOURCES)} FROM mention GROUP BY 1, 2),
r AS (SELECT ticker, sum(mentions)::BIGINT AS mentions, sum(sentiment * mentions) / sum(mentions) AS sentiment, sum(price_move * mentions) / sum(mentions) AS price_move, sum(CASE WHEN relative_volume > 0 AND relative_volume <= 25 THEN relative_volume ELSE 1 END * mentions) / sum(mentions) AS relative_volume,
 arg_max(last_price, generated) FILTER (last_price IS NOT NULL) AS last_price, {", ".join(f"sum(from_{s})::BIGINT AS from_{s}" for s in D.SOURCES)} FROM daily WHERE generated BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' GROUP BY 1),
b AS (SELECT ticker, sum(mentions) AS before FROM daily WHERE generated BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1),
x AS (SELECT r.*, (mentions - before) * 100.0::DOUBLE / before AS momentum FROM r LEFT JOIN b USING (ticker)),
y AS (SELECT *, 30 * sqrt(mentions / greatest(1, max(mentions) OVER ())) + 22 * {CLAMP("coalesce(momentum, 0) / 80 + 0.25::DOUBLE")} + 18 * {CLAMP("(sentiment + 0.25::DOUBLE) / 0.7::DOUBLE")} + 12 * {CLAMP("price_move / 6")} + 10 * {CLAMP("relative_volume / 2.5::DOUBLE")} + 8 * {ACTIVE(D.SOURCES)} / 18.0::DOUBLE AS raw FROM x)"""


@query("a2_range_signals", DAILY + " SELECT ticker, mentions, round(sentiment, 6) AS sentiment, last_price, round(momentum, 6) AS momentum, round(least(100, raw * 85 / greatest(1, (SELECT max(raw) FROM y))), 6) AS peer_score FROM y ORDER BY peer_score DESC, ticker LIMIT 75")
def a2_range_signals(spark, sf_dir):
    events = D.mention_events(spark, sf_dir).withColumn("generated", F.col("ts").cast("date"))
    daily = B.signals(events, D.SOURCES, "generated")
    between = lambda a, b: daily.filter(F.col("generated").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    out = C.range_signals(between("2024-01-15", "2024-01-21"), between("2024-01-08", "2024-01-14").select("ticker", "mentions"), D.SOURCES, 18)
    return out.select("ticker", "mentions", *r6("sentiment"), "last_price", *r6("momentum", "peer_score"))


@query("sf18_labels", """SELECT c_custkey AS ticker, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_acctbal * 1e8 >= 1e12 THEN format('${:.2f}T', floor(c_acctbal * 1e8 / 1e12 * 100 + 0.5) / 100.0) WHEN c_acctbal * 1e8 >= 1e9 THEN format('${:.1f}B', floor(c_acctbal * 1e8 / 1e9 * 10 + 0.5) / 10.0) ELSE format('${:.0f}M', floor(c_acctbal * 1e8 / 1e6 + 0.5)) END ELSE 'n/a' END AS cap,
 format('{:+.1f}%', floor(c_acctbal / 100 * 10 + 0.5) / 10.0) AS move FROM customer""")
def sf18_labels(spark, sf_dir):
    return D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), C.cap_label(F.col("c_acctbal") * 1e8).alias("cap"), C.move_text(F.col("c_acctbal") / 100).alias("move"))


@query("sf10_grouped", "SELECT o_orderkey AS id, format('{:,}', round(o_totalprice)::BIGINT) AS price, greatest(1000, least(5000, o_totalprice)) AS clamped FROM orders")
def sf10_grouped(spark, sf_dir):
    rounded = F.round("o_totalprice").cast("long")
    return D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.grouped_digits(rounded).alias("price"), C.clamped(F.col("o_totalprice"), F.lit(1000.0), F.lit(5000.0)).alias("clamped"))


@query("sf17_dates", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) - 30 AS before, CAST(o_orderdate AS DATE) + 90 <= DATE '1998-06-01' AS reachable FROM orders")
def sf17_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.days_ago(day, 30).alias("before"), C.is_reachable(day, 90, F.lit("1998-06-01").cast("date")).alias("reachable"))


# --- springs --------------------------------------------------------------------------

DISCOUNTED = ("ASIA",)
SPRING = CLASSIFY + """, ends AS (SELECT ticker, arg_max(persistence, date) AS persistence, arg_max(percentile, date) AS percentile FROM (SELECT ticker, date, persistence, coalesce(percentile, 'nan'::DOUBLE) AS percentile FROM comp) GROUP BY 1),
spring AS (SELECT c.ticker, state, r_name AS sector, s_nationkey % 4 = 0 AS in_hot_theme, r_name = 'ASIA' AND s_nationkey % 4 <> 0 AS discounted, persistence, CASE WHEN isnan(percentile) THEN 100 ELSE percentile END AS percentile, sessions
  FROM coil c JOIN ends USING (ticker) JOIN supplier ON s_suppkey = c.ticker JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
SPRING_KEY = "in_hot_theme DESC, discounted, CASE state WHEN 'released' THEN 0 WHEN 'coiled' THEN 1 ELSE 2 END, persistence DESC, percentile, ticker"


def spring_board(spark, sf_dir):
    s, n, r = (D.read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    sectors = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))
    return R.spring_board(relaxed(spark, sf_dir), sectors, s.filter("s_nationkey % 4 = 0").select(F.col("s_suppkey").alias("ticker")), DISCOUNTED)


@query("sm5_spring_board", SPRING + " SELECT ticker, state, sector, in_hot_theme, discounted, round(persistence, 6) AS persistence, round(percentile, 6) AS percentile FROM spring")
def sm5_spring_board(spark, sf_dir):
    return spring_board(spark, sf_dir).select("ticker", "state", "sector", "in_hot_theme", "discounted", *r6("persistence"), F.round(F.coalesce("percentile", F.lit(100.0)), 6).alias("percentile"))


@query("tk2_spring_order", SPRING + f" SELECT ticker, state, row_number() OVER (ORDER BY {SPRING_KEY}) AS place FROM spring ORDER BY place LIMIT 20")
def tk2_spring_order(spark, sf_dir):
    top = spring_board(spark, sf_dir).orderBy(*R.spring_order()).limit(20)
    return top.select("ticker", "state", F.row_number().over(B.W.orderBy(*R.spring_order())).cast("long").alias("place"))  # 20 rows


@query("tk10_spring_columns", SPRING + f" SELECT state, ticker, row_number() OVER (PARTITION BY state ORDER BY {SPRING_KEY}) AS place FROM spring QUALIFY place <= CASE state WHEN 'released' THEN 8 ELSE 6 END")
def tk10_spring_columns(spark, sf_dir):
    ranked = B.top_per_group(spring_board(spark, sf_dir), "state", R.spring_order(), 8)
    return ranked.filter((F.col("rank") <= 6) | (F.col("state") == "released")).select("state", "ticker", F.col("rank").cast("long").alias("place"))


@query("tk9_member_order", CLASSIFY + " SELECT ticker, state, CASE state WHEN 'released' THEN 5 WHEN 'coiled' THEN 2 ELSE 4 END AS member_rank, CASE state WHEN 'released' THEN 0 WHEN 'coiled' THEN 1 ELSE 2 END AS coil_rank FROM coil")
def tk9_member_order(spark, sf_dir):
    """Ranks of states in both orders; a state that an order lacks comes last."""
    rank = lambda o: R.state_rank(F.col("state"), o).cast("int")
    return relaxed(spark, sf_dir).select("ticker", "state", rank(R.MEMBER_ORDER).alias("member_rank"), rank(R.COIL_ORDER).alias("coil_rank"))


@query("j4_hot_theme_members", """WITH th AS (SELECT n_nationkey AS theme, CASE n_nationkey % 4 WHEN 0 THEN 'diffusion' WHEN 1 THEN 'wave' WHEN 2 THEN 'quiet' ELSE 'decay' END AS stage FROM nation)
SELECT DISTINCT s_suppkey AS ticker FROM supplier JOIN th ON theme = s_nationkey WHERE stage IN ('diffusion', 'wave')""")
def j4_hot_theme_members(spark, sf_dir):
    k = F.col("n_nationkey")
    themes = D.read(spark, sf_dir, "nation").select(k.alias("theme"), F.when(k % 4 == 0, "diffusion").when(k % 4 == 1, "wave").when(k % 4 == 2, "quiet").otherwise("decay").alias("stage"))
    return H.hot_tickers(themes, D.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("theme"), F.col("s_suppkey").alias("ticker")))


@query("w11_attention_hot", LEDGER + f""", v AS (SELECT *, CASE WHEN ticker % 2 = 1 THEN wiki END AS views, round(mentions::DOUBLE / sum(mentions) OVER (PARTITION BY date), 6) AS voice FROM ledger),
s AS (SELECT ticker, date, CASE WHEN count(views) OVER p >= 200 THEN views WHEN count(voice) FILTER (date >= DATE '1995-01-01') OVER p >= 200 THEN CASE WHEN date >= DATE '1995-01-01' THEN voice END END AS x FROM v WINDOW p AS (PARTITION BY ticker)),
m AS (SELECT *, quantile_cont(x, 0.5) OVER {T252} AS median FROM s) SELECT ticker, CASE WHEN arg_max(coalesce(median, -1), date) >= 0 THEN arg_max(coalesce(median > 0 AND x >= median * 1.25, false), date) END AS hot FROM m GROUP BY 1""")
def w11_attention_hot(spark, sf_dir):
    rows = L.share_of_voice(D.ledger(spark, sf_dir)).withColumn("first_seen", F.lit("1995-01-01").cast("date"))
    return R.attention_hot(rows.withColumn("wiki", F.when(F.col("ticker") % 2 == 1, F.col("wiki"))))


@query("j2_filled_sectors", "SELECT s_suppkey AS ticker, coalesce(CASE WHEN s_nationkey % 3 > 0 THEN r_name END, 'meta ' || s_name) AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def j2_filled_sectors(spark, sf_dir):
    """Sector of the industry table, else of the ticker's own record; tickers that the ledger lacks drop out."""
    s, n, r = (D.read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    table = s.filter("s_nationkey % 3 > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("listed"))
    own = s.select(F.col("s_suppkey").alias("ticker"), F.concat(F.lit("meta "), "s_name").alias("own"))
    known = D.ledger(spark, sf_dir).select("ticker").distinct()
    return own.join(known, "ticker", "left_semi").join(table, "ticker", "left").select("ticker", F.coalesce("listed", "own").alias("sector"))
