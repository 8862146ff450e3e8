"""One query for each operator of the blueprint, over whole tables, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.operators import board as B
from tidemark.operators import graph as G
from tidemark.operators import ledger as L
from tidemark.operators import rolling as R
from tidemark.operators import state as S
from tidemark.operators import themes as H
from tidemark.plans import bindings as D
from tidemark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coil states with a lower persistence: these tables hold no regime at the default."""
    return R.classify(D.ledger(spark, sf_dir), least_persistence=0.45)


LEDGER = "WITH " + D.LEDGER_SQL
LAST = "(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)"
MID = "DATE '1998-06-30'"


# --- ledger folds ---------------------------------------------------------------------


@query("st4_ledger", LEDGER + " SELECT ticker, date, mentions, close, volume, wiki, round(mentions::DOUBLE / sum(mentions) OVER (PARTITION BY date), 6) AS share_of_voice FROM ledger")
def st4_ledger(spark, sf_dir):
    return L.share_of_voice(D.ledger(spark, sf_dir)).select("ticker", "date", "mentions", "close", "volume", "wiki", "share_of_voice")


@query("st1_upsert", LEDGER + f""", merged AS (
  SELECT ticker, date, mentions + CASE WHEN date > {MID} THEN 1 ELSE 0 END AS mentions, CASE WHEN date <= {MID} THEN close END AS close, volume, CASE WHEN date > {MID} THEN volume ELSE wiki END AS wiki,
         row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger)
SELECT ticker, date, mentions, close, volume, wiki FROM merged WHERE age <= 400""")  # fmt: skip
def st1_upsert(spark, sf_dir):
    ledger = D.ledger(spark, sf_dir)
    batch = ledger.filter("date > DATE '1998-06-30'").select("ticker", "date", (F.col("mentions") + 1).alias("mentions"), F.lit(None).cast("double").alias("close"), "volume", F.col("volume").alias("wiki"))
    return L.upsert(ledger, batch)


@query("st2_backfill", LEDGER + f"""
SELECT ticker, date, CASE WHEN date <= {MID} THEN mentions ELSE 0 END AS mentions, close, CASE WHEN date <= {MID} AND mentions > 1 THEN volume ELSE volume + 1 END AS volume,
       CASE WHEN date <= {MID} THEN wiki END AS wiki FROM ledger QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 400""")  # fmt: skip
def st2_backfill(spark, sf_dir):
    ledger = D.ledger(spark, sf_dir)
    holed = ledger.filter("date <= DATE '1998-06-30'").withColumn("volume", F.when(F.col("mentions") > 1, F.col("volume")).otherwise(F.lit(float("nan"))))
    return L.merge_backfill(holed, ledger.withColumn("volume", F.col("volume") + 1))


@query("st3_pageviews", LEDGER + f" SELECT ticker, date, mentions, close, volume, CASE WHEN date > {MID} THEN volume ELSE wiki END AS wiki FROM ledger")
def st3_pageviews(spark, sf_dir):
    ledger = D.ledger(spark, sf_dir)
    return L.merge_pageviews(ledger, ledger.filter("date > DATE '1998-06-30'").select("ticker", "date", F.col("volume").alias("views")))


@query("w18_locf", LEDGER + " SELECT ticker, date, last_value(CASE WHEN mentions > 1 THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close_locf FROM ledger")
def w18_locf(spark, sf_dir):
    return L.carry_forward(D.ledger(spark, sf_dir).withColumn("close", F.when(F.col("mentions") > 1, F.col("close")))).select("ticker", "date", "close_locf")


@query("f12_prune", LEDGER + f"""
SELECT ticker, max(date) AS last_seen FROM ledger WHERE ticker NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 1) GROUP BY ticker HAVING max(date) < {LAST} - 3""")
def f12_prune(spark, sf_dir):
    ledger = D.ledger(spark, sf_dir)
    today = ledger.agg(F.max("date")).first()[0]
    protected = D.read(spark, sf_dir, "supplier").filter("s_nationkey = 1").select(F.col("s_suppkey").alias("ticker"))
    return L.stale(ledger, protected, F.lit(today), 3)


# --- rolling --------------------------------------------------------------------------

W_SQL = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND {})"
T252, T60, P60, P252 = W_SQL.format(251, "CURRENT ROW"), W_SQL.format(59, "CURRENT ROW"), W_SQL.format(60, "1 PRECEDING"), W_SQL.format(252, "1 PRECEDING")
HOT = LEDGER + f""", med AS (SELECT *, quantile_cont(wiki, 0.5) OVER {T252} AS median FROM ledger),
hot AS (SELECT *, coalesce(median > 0 AND wiki >= median * 1.25, false) AS hot FROM med)"""
PERSIST = HOT + f", persist AS (SELECT *, avg(hot::INT::DOUBLE) OVER {T60} AS persistence FROM hot)"
COMPRESS = PERSIST + f""", spread AS (SELECT *, CASE WHEN count(close) OVER {T60} = 60 THEN (max(close) OVER {T60} - min(close) OVER {T60}) / max(close) OVER {T60} END AS range FROM persist),
lists AS (SELECT *, list_filter(list(range) OVER {T252}, lambda x: x IS NOT NULL) AS xs FROM spread),
comp AS (SELECT * EXCLUDE (xs), CASE WHEN range IS NOT NULL THEN 100.0::DOUBLE * len(list_filter(xs, lambda x: x <= range)) / len(xs) END AS percentile FROM lists)"""
RELEASE = f"""(row_number() OVER (PARTITION BY ticker ORDER BY date) > 60 AND close > max(close) OVER {P60} AND volume >= 1.5 * avg(volume) OVER {P60})"""
#: These tables' prices are noise around a mean, where the default trigger never fires.
EASY = {"window": 20, "volume_ratio": 0.5}
P20 = W_SQL.format(20, "1 PRECEDING")
EASY_RELEASE = f"(row_number() OVER (PARTITION BY ticker ORDER BY date) > 20 AND close > max(close) OVER {P20} AND volume >= 0.5 * avg(volume) OVER {P20})"
REGIMES = COMPRESS + f""", flagged AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, coalesce({RELEASE}, false) AS release FROM comp),
hits AS (SELECT *, CASE WHEN coalesce(idx - lag(idx) OVER (PARTITION BY ticker ORDER BY date) > 11, true) THEN 1 ELSE 0 END AS new FROM flagged WHERE persistence >= 0.45 AND percentile <= 35),
runs AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY date) AS run FROM hits),
regimes AS (SELECT ticker, min(date) AS regime_start, max(date) AS regime_end, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS sessions FROM runs GROUP BY ticker, run HAVING count(*) >= 15)"""


@query("w1_trailing_median", HOT + " SELECT ticker, date, round(median, 6) AS median FROM hot")
def w1_trailing_median(spark, sf_dir):
    return R.trailing_median(D.ledger(spark, sf_dir), "wiki").select("ticker", "date", *r6("median"))


@query("w3_hot_flags", HOT + " SELECT ticker, date, hot FROM hot")
def w3_hot_flags(spark, sf_dir):
    return R.hot_flags(D.ledger(spark, sf_dir)).select("ticker", "date", "hot")


@query("w4_persistence", PERSIST + " SELECT ticker, date, round(persistence, 6) AS persistence FROM persist")
def w4_persistence(spark, sf_dir):
    return R.persistence(R.hot_flags(D.ledger(spark, sf_dir))).select("ticker", "date", *r6("persistence"))


@query("w5_compression", COMPRESS + " SELECT ticker, date, round(range, 6) AS range, round(percentile, 6) AS percentile FROM comp")
def w5_compression(spark, sf_dir):
    return R.compression(D.ledger(spark, sf_dir)).select("ticker", "date", *r6("range", "percentile"))


@query("w2_percentile_rank", LEDGER + """, lists AS (SELECT ticker, date, volume, list(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING) AS xs FROM ledger)
SELECT ticker, date, round(100.0::DOUBLE * len(list_filter(xs, lambda x: x <= volume)) / len(xs), 6) AS pct FROM lists""")
def w2_percentile_rank(spark, sf_dir):
    ranked = D.ledger(spark, sf_dir).withColumn("pct", R.percentile_rank(F.col("volume"), F.collect_list("volume").over(R.trailing(60))))
    return ranked.select("ticker", "date", *r6("pct"))


@query("w6_regimes", REGIMES + " SELECT * FROM regimes")
def w6_regimes(spark, sf_dir):
    days = R.compression(R.persistence(R.hot_flags(D.ledger(spark, sf_dir))))
    return R.merge_regimes(days.withColumn("qualifies", F.coalesce((F.col("persistence") >= 0.45) & (F.col("percentile") <= 35), F.lit(False)))).withColumns({c: F.col(c).cast("long") for c in ("start_idx", "end_idx")})


@query("w7_release_trigger", LEDGER + f" SELECT ticker, date, close, volume FROM ledger QUALIFY {EASY_RELEASE}")
def w7_release_trigger(spark, sf_dir):
    return R.release_triggers(D.ledger(spark, sf_dir), **EASY).filter("release").select("ticker", "date", "close", "volume")


@query("w8_first_release", LEDGER + f""", x AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx, {EASY_RELEASE} AS release FROM ledger)
SELECT ticker, min(idx) FILTER (release AND idx >= 200) AS release_idx, min(date) FILTER (release AND idx >= 200) AS release_date FROM x GROUP BY ticker""")
def w8_first_release(spark, sf_dir):
    return R.first_release(R.release_triggers(D.ledger(spark, sf_dir), **EASY).withColumn("from_idx", F.lit(200)), "from_idx").withColumn("release_idx", F.col("release_idx").cast("long"))


@query("w9_volume_slope", LEDGER + """, x AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger),
y AS (SELECT *, sum(CASE WHEN close > before THEN volume WHEN close < before THEN -volume ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS obv, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM x WHERE age <= 60 AND before IS NOT NULL),
z AS (SELECT ticker, max(n) AS n, avg(obv) FILTER (i <= n // 2) AS a, avg(obv) FILTER (i > n // 2) AS b FROM y GROUP BY ticker)
SELECT ticker, CASE WHEN n >= 5 THEN CASE WHEN b > a * 1.05::DOUBLE THEN 'up' WHEN b < a * 0.95::DOUBLE THEN 'down' ELSE 'flat' END END AS obv FROM z""")  # fmt: skip
def w9_volume_slope(spark, sf_dir):
    return R.volume_slope(D.ledger(spark, sf_dir))


HIGH = f"""high AS (SELECT ticker, count(close) >= 252 AS known, coalesce(bool_or(above) FILTER (age <= 60), false) AS new_high FROM (
  SELECT ticker, close, coalesce(count(close) OVER {P252} = 252 AND close > max(close) OVER {P252}, false) AS above, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger) GROUP BY ticker)"""
REL = """aged AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger), bage AS (SELECT close, row_number() OVER (ORDER BY date DESC) AS age FROM bench),
rel AS (SELECT ticker, max(close) FILTER (age = 1) / max(close) FILTER (age = 91) - 1 - (SELECT max(close) FILTER (age = 1) / max(close) FILTER (age = 91) - 1 FROM bage) AS rel FROM aged GROUP BY ticker)"""
RET = """ret AS (SELECT ticker, close / nullif(earlier, 0) - 1 AS return_12m, close / mean - 1 AS extension FROM (SELECT ticker, close, lag(close, 252) OVER w AS earlier,
  CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) = 200 THEN avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) END AS mean, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age
  FROM ledger WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE age = 1)"""


@query("w10_new_high", LEDGER + f", {HIGH} SELECT * FROM high")
def w10_new_high(spark, sf_dir):
    return R.new_high(D.ledger(spark, sf_dir))


@query("w13_returns", LEDGER + f", {RET} SELECT ticker, round(return_12m, 6) AS return_12m, round(extension, 6) AS extension FROM ret")
def w13_returns(spark, sf_dir):
    return R.returns(D.ledger(spark, sf_dir)).select("ticker", *r6("return_12m", "extension"))


@query("w14_attention_ratio", LEDGER + ", x AS (SELECT ticker, arg_max(wiki, date) AS latest, list_sort(list(wiki)) AS xs FROM ledger GROUP BY ticker) SELECT ticker, CASE WHEN len(xs) >= 20 THEN round(latest / xs[len(xs) // 2 + 1], 6) END AS ratio FROM x")
def w14_attention_ratio(spark, sf_dir):
    return R.attention_ratio(D.ledger(spark, sf_dir)).select("ticker", *r6("ratio"))


@query("a10_average_volume", LEDGER + f" SELECT ticker, date, CASE WHEN count(volume) OVER {P60} >= 30 THEN round(avg(volume) OVER {P60}, 6) END AS avg_volume FROM ledger")
def a10_average_volume(spark, sf_dir):
    return R.average_volume(D.ledger(spark, sf_dir)).select("ticker", "date", *r6("avg_volume"))


PROOF = LEDGER + f""", p AS (SELECT ticker, date, close, volume, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS move, CASE WHEN count(volume) OVER {P60} >= 30 THEN avg(volume) OVER {P60} END AS avg_volume FROM ledger),
proof AS (SELECT * FROM p WHERE move >= 0.08 AND volume / avg_volume >= 3)"""


@query("w20_sparkline", LEDGER + """, x AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger QUALIFY age <= 60)
SELECT ticker, date, round((close - min(close) OVER (PARTITION BY ticker)) / (max(close) OVER (PARTITION BY ticker) - min(close) OVER (PARTITION BY ticker)), 6) AS y FROM x""")
def w20_sparkline(spark, sf_dir):
    ledger = D.ledger(spark, sf_dir)
    dates = ledger.withColumn("age", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))).filter("age <= 60")
    i = dates.withColumn("i", F.row_number().over(W.partitionBy("ticker").orderBy("date")) - 1).select("ticker", "date", "i")
    points = R.sparkline(ledger).select("ticker", F.posexplode("spark").alias("i", "y"))
    return points.join(i, ["ticker", "i"]).select("ticker", "date", F.round("y", 6).alias("y"))


CLASSIFY = REGIMES + """, latest AS (SELECT * FROM regimes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY end_idx DESC) = 1),
size AS (SELECT ticker, count(*) AS n, max(date) AS as_of FROM ledger GROUP BY ticker),
rls AS (SELECT f.ticker, min(idx) AS release_idx, min(date) AS release_date FROM flagged f JOIN latest l ON f.ticker = l.ticker AND idx > end_idx WHERE release GROUP BY 1),
coil AS (SELECT ticker, CASE WHEN release_idx IS NOT NULL THEN 'released' WHEN n - end_idx > 126 THEN 'dead' ELSE 'coiled' END AS state, regime_start, regime_end, sessions, release_date,
  greatest(0, n - coalesce(release_idx, CASE WHEN n - end_idx > 126 THEN end_idx + 126 ELSE start_idx END)) AS days_in_state, as_of
  FROM latest JOIN size USING (ticker) LEFT JOIN rls USING (ticker))"""


@query("sm2_classify", CLASSIFY + " SELECT * FROM coil")
def sm2_classify(spark, sf_dir):
    return relaxed(spark, sf_dir).drop("persistence", "percentile")


# --- themes ---------------------------------------------------------------------------

FLAGS = LEDGER + f", {D.BENCH_SQL}, {D.THEMES_SQL}, {HIGH}, {REL}" + f""", hotx AS (SELECT ticker, date, wiki, coalesce(wiki >= 1.25 * quantile_cont(wiki, 0.5) OVER {T252}, false) AS hot FROM ledger),
hotl AS (SELECT ticker, CASE WHEN count(wiki) >= 200 THEN arg_max(hot, date) END AS attn_hit FROM hotx GROUP BY ticker),
flags AS (SELECT ticker, rel >= 0.15 AS rel_hit, CASE WHEN known THEN new_high END AS high_hit, attn_hit FROM rel JOIN high USING (ticker) JOIN hotl USING (ticker))"""
DECAY = """lens AS (SELECT ticker, max(age) AS len FROM aged GROUP BY 1),
common AS (SELECT theme, least(min(len), (SELECT max(age) FROM bage)) AS common FROM themes JOIN lens USING (ticker) GROUP BY theme HAVING count(*) >= 3 AND least(min(len), (SELECT max(age) FROM bage)) > 101),
idx AS (SELECT c.theme, a.age, avg(a.close / b.close - ba.close / bb.close) AS x FROM common c JOIN themes t USING (theme) JOIN aged a ON a.ticker = t.ticker AND a.age <= 101 JOIN aged b ON b.ticker = t.ticker AND b.age = c.common
  JOIN bage ba ON ba.age = a.age JOIN bage bb ON bb.age = c.common GROUP BY 1, 2),
decay AS (SELECT theme, max(x) FILTER (age = 1) < avg(x) FILTER (age > 1) AS decay FROM idx GROUP BY theme HAVING count(*) >= 100)"""


@query("j8_relative_return", LEDGER + f", {D.BENCH_SQL}, {REL} SELECT ticker, round(rel, 6) AS rel FROM rel")
def j8_relative_return(spark, sf_dir):
    return H.relative_return(D.ledger(spark, sf_dir), D.benchmark(spark, sf_dir)).select("ticker", *r6("rel"))


@query("a4_universe_breadth", FLAGS + " SELECT count(*) AS members, round(avg(rel_hit::INT), 6) AS rel, round(avg(high_hit::INT), 6) AS high, round(avg(attn_hit::INT), 6) AS attn FROM flags")
def a4_universe_breadth(spark, sf_dir):
    return H.breadth(H.ticker_flags(D.ledger(spark, sf_dir), D.benchmark(spark, sf_dir))).select("members", *r6("rel", "high", "attn"))


@query("w12_decay", LEDGER + f", {D.BENCH_SQL}, {D.THEMES_SQL}, {REL}, {DECAY} SELECT * FROM decay")
def w12_decay(spark, sf_dir):
    return H.decay_signal(D.ledger(spark, sf_dir), D.themes(spark, sf_dir), D.benchmark(spark, sf_dir))


@query("a5_theme_heat", FLAGS + f", {DECAY}" + """, th AS (SELECT theme, count(*) AS members, avg(rel_hit::INT) AS rel, avg(high_hit::INT) AS high, avg(attn_hit::INT) AS attn FROM themes JOIN flags USING (ticker) GROUP BY theme),
al AS (SELECT coalesce(avg(rel_hit::INT), 0) AS rel, coalesce(avg(high_hit::INT), 0) AS high, coalesce(avg(attn_hit::INT), 0) AS attn FROM flags),
ex AS (SELECT theme, members, decay, greatest(0, coalesce(th.rel - al.rel, 0)) AS rel, greatest(0, coalesce(th.high - al.high, 0)) AS high, greatest(0, coalesce(th.attn - al.attn, 0)) AS attn FROM th CROSS JOIN al LEFT JOIN decay USING (theme))
SELECT theme, members, CASE WHEN members >= 3 THEN floor(100 * (.30::DOUBLE * rel + .25::DOUBLE * high + .25::DOUBLE * attn) + .5::DOUBLE)::BIGINT END AS heat,
  CASE WHEN members < 3 THEN 'insufficient-data' WHEN coalesce(decay, false) THEN 'decay' WHEN rel >= .35 THEN 'wave' WHEN attn >= .30 THEN 'diffusion' WHEN attn >= .15 THEN 'naming' ELSE 'quiet' END AS stage FROM ex""")  # fmt: skip
def a5_theme_heat(spark, sf_dir):
    ledger, themes, bench = D.ledger(spark, sf_dir), D.themes(spark, sf_dir), D.benchmark(spark, sf_dir)
    return H.theme_heat(H.ticker_flags(ledger, bench), themes, H.decay_signal(ledger, themes, bench))


@query("sm4_member_states", CLASSIFY + f", {D.BENCH_SQL}, {HIGH}, {REL}, {RET}" + """, st AS (SELECT ticker, CASE WHEN state IN ('coiled', 'dead') THEN state WHEN return_12m >= .5 AND extension > .3 THEN 'ran'
  WHEN state = 'released' OR new_high THEN 'running' WHEN rel < .10 THEN 'lagging' END AS member_state FROM ret JOIN high USING (ticker) JOIN rel USING (ticker) LEFT JOIN coil USING (ticker))
SELECT * FROM st WHERE member_state IS NOT NULL""")  # fmt: skip
def sm4_member_states(spark, sf_dir):
    ledger = D.ledger(spark, sf_dir)
    return H.member_states(R.latest(ledger), H.bench_gain(D.benchmark(spark, sf_dir)), relaxed(spark, sf_dir))


# --- signals and boards ---------------------------------------------------------------

BOARD = "WITH " + D.SIGNAL_SQL
N = len(D.SOURCES)
ACTIVE = lambda sources: "(" + " + ".join(f"(from_{s} > 0)::INT" for s in sources) + ")"
TOTAL = lambda sources: "(" + " + ".join(f"from_{s}" for s in sources) + ")"
CLAMP = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
SCORE = f"""(27 * sqrt(mentions / greatest(1, max(mentions) OVER ())) + 20 * {CLAMP("coalesce(momentum, 0) / 80 + 0.25::DOUBLE")} + 17 * {CLAMP("(sentiment + 0.25::DOUBLE) / 0.7::DOUBLE")}
  + 12 * {CLAMP("price_move / 6")} + 9 * {CLAMP("relative_volume / 2.5::DOUBLE")} + 9 * {ACTIVE(D.SOURCES)} / {N}.0::DOUBLE)"""


def signal_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.mention_events(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    before = B.signals(events.filter(F.col("ts") < cut), D.SOURCES)
    return B.with_momentum(B.signals(events.filter(F.col("ts") >= cut), D.SOURCES), before)


@query("a1_signals", BOARD + " SELECT ticker, mentions, round(sentiment, 6) AS sentiment, round(price_move, 6) AS price_move, round(relative_volume, 6) AS relative_volume, last_price, " + ", ".join(f"from_{s}" for s in D.SOURCES) + ", round(momentum, 6) AS momentum FROM board")
def a1_signals(spark, sf_dir):
    return signal_board(spark, sf_dir).select("ticker", "mentions", *r6("sentiment", "price_move", "relative_volume"), "last_price", *(f"from_{s}" for s in D.SOURCES), *r6("momentum"))


@query("a3_mention_totals", "WITH " + D.EVENTS_SQL + " SELECT ticker, sum(mentions)::BIGINT AS mentions FROM mention GROUP BY ticker")
def a3_mention_totals(spark, sf_dir):
    return D.mention_events(spark, sf_dir).groupBy("ticker").agg(F.sum("mentions").alias("mentions"))


@query("a7_attention_threshold", BOARD + ", x AS (SELECT mentions AS x, row_number() OVER (ORDER BY mentions) AS i, count(*) OVER () AS n FROM board WHERE mentions > 0) SELECT greatest(5.0::DOUBLE, max(x)) AS threshold FROM x WHERE i = least(n - 1, floor(0.7::DOUBLE * n)) + 1")
def a7_attention_threshold(spark, sf_dir):
    return B.attention_threshold(signal_board(spark, sf_dir), "mentions")


@query("sc1_attention_score", BOARD + f" SELECT ticker, round(greatest(0, least(100, {SCORE})), 6) AS signal_score FROM board")
def sc1_attention_score(spark, sf_dir):
    return B.attention_score(signal_board(spark, sf_dir), D.SOURCES).select("ticker", *r6("signal_score"))


@query("sc2_peer_score", BOARD + f""", x AS (SELECT ticker, 30 * sqrt(mentions / greatest(1, max(mentions) OVER ())) + 22 * {CLAMP("coalesce(momentum, 0) / 80 + 0.25::DOUBLE")} + 18 * {CLAMP("(sentiment + 0.25::DOUBLE) / 0.7::DOUBLE")}
  + 12 * {CLAMP("price_move / 6")} + 10 * {CLAMP("CASE WHEN relative_volume > 0 AND relative_volume <= 25 THEN relative_volume ELSE 1 END / 2.5::DOUBLE")} + 8 * {ACTIVE(D.SOURCES)} / 18.0::DOUBLE AS raw FROM board)
SELECT ticker, round(least(100, raw * 85 / greatest(1, max(raw) OVER ())), 6) AS peer_score FROM x""")  # fmt: skip
def sc2_peer_score(spark, sf_dir):
    return B.peer_score(signal_board(spark, sf_dir), D.SOURCES, 18).select("ticker", *r6("peer_score"))


S_, C_, M_ = TOTAL(D.SOCIAL), TOTAL(D.CATALYST), TOTAL(D.MARKET)
STAGE_SQL = f"""CASE WHEN price_move >= 12 OR (relative_volume >= 8 AND {S_} + {C_} >= 3) THEN 'Crowded' WHEN coalesce(momentum, 0) <= -15 OR price_move <= -3 THEN 'Cooling'
  WHEN {C_} > 0 AND price_move > 0 AND relative_volume >= 1.2 THEN 'Confirmed' WHEN relative_volume >= 1.2 AND {S_} + {C_} < 5 AND price_move < 6 THEN 'Early ignition' WHEN coalesce(momentum, 0) >= 15 OR {S_} + {C_} >= 5 THEN 'Building' ELSE 'Watching' END"""
GROUPS = f"(({S_} > 0)::INT + ({C_} > 0)::INT + ({M_} > 0)::INT)"


@query("sm1_ticker_stage", BOARD + f""" SELECT ticker, {STAGE_SQL} AS stage, CASE WHEN {ACTIVE(D.CATALYST)} >= 2 AND {GROUPS} = 3 THEN 'Strong evidence' WHEN {ACTIVE(D.CATALYST)} >= 1 AND {GROUPS} >= 2 THEN 'Corroborated'
  WHEN {GROUPS} >= 2 THEN 'Developing' ELSE 'Thin evidence' END AS evidence FROM board""")  # fmt: skip
def sm1_ticker_stage(spark, sf_dir):
    return profiled(spark, sf_dir).select("ticker", "stage", "evidence")


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.profile(B.attention_score(signal_board(spark, sf_dir), D.SOURCES), D.SOCIAL, D.CATALYST, D.MARKET)


CONC = f"(greatest({', '.join(f'from_{s}' for s in D.SOURCES)})::DOUBLE / greatest(1, {TOTAL(D.SOURCES)}))"
SETUP = BOARD + f""", scored AS (SELECT *, greatest(0, least(100, {SCORE})) AS signal_score FROM board), setup AS (SELECT *, {STAGE_SQL} AS stage,
  100 * (0.14::DOUBLE * {CLAMP("signal_score / 85")} + 0.22::DOUBLE * CASE WHEN coalesce(momentum, 0) = 0 THEN 0.35::DOUBLE ELSE {CLAMP("(momentum + 5) / 65")} END
  + 0.2::DOUBLE * (0.65::DOUBLE * {GROUPS} / 3 + 0.35::DOUBLE * {CLAMP(ACTIVE(D.SOURCES) + " / 6.0::DOUBLE")}) + 0.22::DOUBLE * (0.55::DOUBLE * {CLAMP("(price_move + 0.5::DOUBLE) / 6.5::DOUBLE")} + 0.45::DOUBLE * {CLAMP("(relative_volume - 1) / 2.5::DOUBLE")})
  + 0.22::DOUBLE * {CLAMP(ACTIVE(D.CATALYST) + " / 3.0::DOUBLE")}) AS raw,
  CASE WHEN price_move >= 12 THEN least(25, (price_move - 12) * 1.1::DOUBLE + 5) ELSE 0 END + CASE WHEN relative_volume >= 8 THEN least(8, (relative_volume - 8) * 0.8::DOUBLE + 2) ELSE 0 END
  + CASE WHEN {CONC} >= 0.75 THEN least(8, ({CONC} - 0.75::DOUBLE) * 28 + 2) ELSE 0 END + CASE WHEN {S_} > 0 AND {C_} = 0 AND price_move >= 5 THEN 6 ELSE 0 END
  + CASE WHEN {GROUPS} <= 1 THEN 10 ELSE 0 END + CASE WHEN price_move <= -3 THEN 6 ELSE 0 END AS penalty FROM scored),
setups AS (SELECT ticker, stage, price_move, floor(100 * {CLAMP("(raw - penalty) / 100")} + 0.5::DOUBLE)::BIGINT AS setup_score FROM setup)"""


@query("sc3_setup_score", SETUP + " SELECT ticker, setup_score FROM setups")
def sc3_setup_score(spark, sf_dir):
    return profiled(spark, sf_dir).select("ticker", "setup_score")


@query("tk7_movers", SETUP + " SELECT stage, ticker, setup_score, row_number() OVER (PARTITION BY stage ORDER BY setup_score DESC, ticker) AS rank FROM setups QUALIFY rank <= 5")
def tk7_movers(spark, sf_dir):
    return B.top_per_group(profiled(spark, sf_dir), "stage", [F.desc("setup_score"), F.col("ticker")], 5).select("stage", "ticker", "setup_score", F.col("rank").cast("long").alias("rank"))


@query("snk2_export_rows", SETUP + " SELECT ticker, stage, setup_score FROM setups ORDER BY setup_score DESC, ticker LIMIT 50")
def snk2_export_rows(spark, sf_dir):
    return profiled(spark, sf_dir).orderBy(F.desc("setup_score"), "ticker").limit(50).select("ticker", "stage", "setup_score")


@query("w16_rank_changes", """WITH s AS (SELECT CAST(ts AS DATE) AS snapshot, user_id AS ticker, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY n DESC, ticker) AS rank, dense_rank() OVER (ORDER BY snapshot) AS no FROM s)
SELECT a.snapshot, a.ticker, a.rank, b.rank - a.rank AS change FROM r a LEFT JOIN r b ON a.ticker = b.ticker AND a.no = b.no + 1""")  # fmt: skip
def w16_rank_changes(spark, sf_dir):
    snapshots = D.mention_events(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("snapshot"), "ticker").agg(F.count("*").alias("n"))
    return B.rank_changes(snapshots, "n").withColumns({c: F.col(c).cast("long") for c in ("rank", "change")})


@query("sf13_sentiment_label", BOARD + " SELECT ticker, CASE WHEN sentiment > 0.25::DOUBLE THEN 'Bullish' WHEN sentiment > 0.08::DOUBLE THEN 'Positive' WHEN sentiment < -0.18::DOUBLE THEN 'Bearish' WHEN sentiment < -0.04::DOUBLE THEN 'Soft' ELSE 'Neutral' END AS label FROM board")
def sf13_sentiment_label(spark, sf_dir):
    return signal_board(spark, sf_dir).select("ticker", B.sentiment_label(F.col("sentiment")).alias("label"))


# --- text -----------------------------------------------------------------------------

RE = lambda words: r"\b(?:" + "|".join(w.replace("'", "''") for w in words) + r")\b"


@query("sf1_sentiment", f"""WITH x AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{RE(V.POSITIVE)}')) AS p, len(regexp_extract_all(lower(text), '{RE(V.NEGATIVE)}')) AS n FROM documents)
SELECT doc_id, round((p - n) / greatest(3, p + n + 1)::DOUBLE, 6) AS sentiment FROM x""")
def sf1_sentiment(spark, sf_dir):
    return spread(D.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.round(T.sentiment(F.col("text")), 6).alias("sentiment"))


@query("f2_market_context", f"SELECT doc_id, regexp_matches(text, '(?i){RE(V.MARKET)}') AS market FROM documents")
def f2_market_context(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select("doc_id", T.has_market_context(F.col("text")).alias("market"))


@query("sf3_page_title", r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def sf3_page_title(spark, sf_dir):
    return D.read(spark, sf_dir, "pages").select("page_id", T.text_between(F.col("html"), "title").alias("title"))


@query("sf2_clean_markup", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!\[CDATA\[|\]\]>', '', 'g'), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS text FROM pages""")
def sf2_clean_markup(spark, sf_dir):
    return D.read(spark, sf_dir, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query("sf6_hosts", r"SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def sf6_hosts(spark, sf_dir):
    return D.read(spark, sf_dir, "pages").groupBy(T.host_of(F.col("url"), F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("sf7_iso_week", "SELECT isoyear(ts)::VARCHAR || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week, user_id AS ticker, count(*) AS n FROM events GROUP BY 1, 2")
def sf7_iso_week(spark, sf_dir):
    return S.weekly(D.mention_events(spark, sf_dir), T.iso_week(F.col("ts")), 56, "ticker").select("week", "ticker", "n")


# --- graph ----------------------------------------------------------------------------

EDGES = """WITH m AS (SELECT DISTINCT l_orderkey AS url, l_suppkey AS ticker FROM lineitem), edges AS (SELECT a.ticker AS src, b.ticker AS dst, count(*) AS n FROM m a JOIN m b ON a.url = b.url AND a.ticker < b.ticker GROUP BY 1, 2)"""
WAYS = ", ways AS (SELECT src, dst, n FROM edges UNION ALL SELECT dst, src, n FROM edges)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pairs(D.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("g1_co_mentions", EDGES + " SELECT * FROM edges")
def g1_co_mentions(spark, sf_dir):
    return edges(spark, sf_dir)


@query("tk8_top_neighbors", EDGES + WAYS + " SELECT src AS ticker, dst AS neighbor, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM ways QUALIFY rank <= 8")
def tk8_top_neighbors(spark, sf_dir):
    return G.top_neighbors(edges(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("g3_modularity", EDGES + WAYS + """, d AS (SELECT s_nationkey AS c, sum(n) AS deg FROM ways JOIN supplier ON src = s_suppkey GROUP BY 1), i AS (SELECT a.s_nationkey AS c, sum(n) FILTER (a.s_nationkey = b.s_nationkey) AS inner_n FROM edges JOIN supplier a ON src = a.s_suppkey JOIN supplier b ON dst = b.s_suppkey GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS m FROM edges)
SELECT round(sum(coalesce(inner_n, 0) / m - pow(deg / (2 * m), 2)), 6) AS q FROM d LEFT JOIN i USING (c) CROSS JOIN t""")  # fmt: skip
def g3_modularity(spark, sf_dir):
    nations = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("community"))
    return G.modularity(edges(spark, sf_dir), nations).select(*r6("q"))


@query("g6_siblings", "SELECT a.s_suppkey AS ticker, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey QUALIFY row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_suppkey) <= 15")
def g6_siblings(spark, sf_dir):
    """First 15 others of each nation: they are among its first 16, so no more are joined."""
    own = D.read(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("ticker"))
    first = B.top_per_group(own, "s_nationkey", [F.col("ticker")], 16).select("s_nationkey", F.col("ticker").alias("sibling"))
    pairs = own.join(first, "s_nationkey").filter("ticker <> sibling")
    return B.top_per_group(pairs, "ticker", [F.col("sibling")], 15).select("ticker", "sibling")


# --- states ---------------------------------------------------------------------------


@query("j7_nearest_close", LEDGER + """, p AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders),
h AS (SELECT id, l.date AS near_date, close AS near_close, row_number() OVER (PARTITION BY id ORDER BY abs(l.date - p.date), l.date) AS i FROM p JOIN ledger l ON l.ticker = p.ticker AND l.date BETWEEN p.date - 5 AND p.date + 5)
SELECT p.id, p.ticker, p.date, near_date, near_close FROM p LEFT JOIN h ON h.id = p.id AND i = 1""")  # fmt: skip
def j7_nearest_close(spark, sf_dir):
    n = D.read(spark, sf_dir, "supplier").count()
    probes = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % n).alias("ticker"), F.col("o_orderdate").cast("date").alias("date"))
    return S.nearest_close(probes, D.ledger(spark, sf_dir))


RELEASES = LEDGER + f""", ev AS (SELECT ticker::VARCHAR || '@' || date::VARCHAR AS id, ticker, date, close AS base_price, CASE WHEN volume >= 100 THEN 'heavy' ELSE 'light' END AS type FROM ledger QUALIFY {EASY_RELEASE}),
due AS (SELECT ev.*, h AS horizon, date + h AS target FROM ev, unnest([30, 90, 180, 365]) AS u(h) WHERE date + h <= {LAST}),
g AS (SELECT due.id, due.type, horizon, base_price, arg_min(l.close, abs(l.date - target) * 100000 + (l.date - DATE '1990-01-01')) AS near FROM due LEFT JOIN ledger l ON l.ticker = due.ticker AND l.date BETWEEN target - 5 AND target + 5 GROUP BY ALL),
graded AS (SELECT id, type, horizon, near / base_price - 1 AS ret FROM g)"""


def release_events(ledger: DataFrame) -> DataFrame:
    return R.release_triggers(ledger, **EASY).filter("release").select(
        F.concat(F.col("ticker").cast("string"), F.lit("@"), F.col("date").cast("string")).alias("id"), "ticker", "date", F.col("close").alias("base_price"), F.when(F.col("volume") >= 100, "heavy").otherwise("light").alias("type")
    )


def releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ledger = D.ledger(spark, sf_dir)
    events = release_events(ledger)
    return events, S.grade(events, ledger, F.lit(ledger.agg(F.max("date")).first()[0]))


@query("a6_calibration", RELEASES + " SELECT type, horizon, count(*) AS graded, round(avg((ret > 0)::INT), 6) AS win_rate, round(quantile_cont(ret, 0.5), 6) AS median FROM graded WHERE ret IS NOT NULL GROUP BY 1, 2")
def a6_calibration(spark, sf_dir):
    return S.calibration(*releases(spark, sf_dir)).select("type", "horizon", "graded", *r6("win_rate", "median"))


STATES = LEDGER + ", states AS (SELECT ticker, date, CASE WHEN volume >= 60 THEN 'busy' WHEN volume >= 20 THEN 'usual' ELSE 'thin' END AS state FROM ledger)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ledger(spark, sf_dir).select("ticker", "date", F.when(F.col("volume") >= 60, "busy").when(F.col("volume") >= 20, "usual").otherwise("thin").alias("state"))


SPLIT = STATES + f", was AS (SELECT ticker, arg_max(state, date) AS state FROM states WHERE date <= {MID} GROUP BY 1), cur AS (SELECT ticker, arg_max(state, date) AS state FROM states GROUP BY 1)"


@query("j10_state_changes", SPLIT + " SELECT cur.ticker, cur.state AS now, was.state AS was FROM cur LEFT JOIN was USING (ticker) WHERE cur.state IS DISTINCT FROM was.state")
def j10_state_changes(spark, sf_dir):
    rows = states(spark, sf_dir)
    latest = lambda df: df.groupBy("ticker").agg(F.max_by("state", "date").alias("state"))
    return S.changes(latest(rows.filter("date <= DATE '1998-06-30'")), latest(rows))


@query("so5_registry", """WITH x AS (SELECT n_regionkey AS theme, s_suppkey AS ticker, 0 AS place, 'region' AS src FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT s_nationkey % 5, s_suppkey, 1, 'manual' FROM supplier)
SELECT theme, ticker, string_agg(src, '+' ORDER BY place) AS src FROM x GROUP BY 1, 2""")
def so5_registry(spark, sf_dir):
    manual = D.read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("theme"), F.col("s_suppkey").alias("ticker"), F.lit("manual").alias("src"))
    return S.registry(D.themes(spark, sf_dir).withColumn("src", F.lit("region")), manual)


@query("j11_ordered_union", """WITH x AS (SELECT s_suppkey AS ticker, 'rich' AS reason, 0 AS p FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, 'local', 1 FROM supplier WHERE s_nationkey < 5)
SELECT ticker, arg_min(reason, p) AS reason FROM x GROUP BY ticker""")
def j11_ordered_union(spark, sf_dir):
    s = D.read(spark, sf_dir, "supplier")
    part = lambda where, why: s.filter(where).select(F.col("s_suppkey").alias("ticker"), F.lit(why).alias("reason"))
    return S.ordered_union([part("s_acctbal > 5000", "rich"), part("s_nationkey < 5", "local")], "ticker")


@query("so3_latest_expiry", "SELECT user_id AS ticker, arg_max(event_type, ts) AS reason, max(ts) AS expires FROM events GROUP BY 1")
def so3_latest_expiry(spark, sf_dir):
    return S.latest_expiry(D.mention_events(spark, sf_dir).select("ticker", F.col("source").alias("reason"), F.col("ts").alias("expires"), "seq"))


@query("a13_ranked", "WITH " + D.EVENTS_SQL + " SELECT ticker, sum(mentions)::BIGINT AS mentions FROM mention GROUP BY 1 ORDER BY mentions DESC, ticker LIMIT 25")
def a13_ranked(spark, sf_dir):
    return a3_mention_totals(spark, sf_dir).orderBy(F.desc("mentions"), "ticker").limit(25)
