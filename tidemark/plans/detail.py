"""Queries of risks, detail texts, exports, log entries, names and caps, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import board as B
from tidemark.operators import discovery as X
from tidemark.operators import screen as C
from tidemark.operators import state as S
from tidemark.plans import bindings as D
from tidemark.plans.alerts import ALERTS, day, run_alerts, theme_stages
from tidemark.plans.boards import SIGNALLED
from tidemark.plans.queries import ACTIVE, BOARD, C_, CLAMP, CONC, GROUPS, M_, S_, SETUP, query, r6, signal_board
from tidemark.session import shared_dir
from tidemark.sources import feeds

CAPS = """caps AS (SELECT c_custkey AS ticker, c_acctbal * 12000 AS market_cap, replace(c_name, '#', ' "') || '"' AS name FROM customer)"""
RISKS = f"""list_filter([CASE WHEN price_move >= 12 THEN 'Extended move' END, CASE WHEN relative_volume >= 8 THEN 'Extreme volume' END, CASE WHEN {CONC} >= 0.75 THEN 'One-source heavy' END,
  CASE WHEN market_cap > 0 AND market_cap < 1e8 THEN 'Micro-cap volatility' END, CASE WHEN {S_} > 0 AND {C_} = 0 THEN 'No verified catalyst' END, CASE WHEN {GROUPS} <= 1 THEN 'Thin evidence' END,
  CASE WHEN price_move <= -3 THEN 'Price not confirming' END], lambda x: x IS NOT NULL)[1:3]"""
EVIDENCE = f"CASE WHEN {ACTIVE(D.CATALYST)} >= 2 AND {GROUPS} = 3 THEN 'Strong evidence' WHEN {ACTIVE(D.CATALYST)} >= 1 AND {GROUPS} >= 2 THEN 'Corroborated' WHEN {GROUPS} >= 2 THEN 'Developing' ELSE 'Thin evidence' END"
CAPPED = SETUP.replace(", setup AS (", f", {CAPS}, setup AS (", 1).replace(
    "AS penalty FROM scored)", f"+ CASE WHEN market_cap > 0 AND market_cap < 25e6 THEN 8 WHEN market_cap > 0 AND market_cap < 1e8 THEN 5 ELSE 0 END AS penalty, {RISKS} AS risks, {EVIDENCE} AS evidence, market_cap, name FROM scored LEFT JOIN caps USING (ticker))", 1
) + f""", capped AS (SELECT *, floor(100 * {CLAMP("(raw - penalty) / 100")} + 0.5::DOUBLE)::BIGINT AS setup_score FROM setup)"""


def capped(spark, sf_dir):
    """The board with a profile, made-up market caps and names with quotes in them."""
    caps = D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), (F.col("c_acctbal") * 12000).alias("market_cap"), F.concat(F.replace("c_name", F.lit("#"), F.lit(' "')), F.lit('"')).alias("name"))
    board = B.attention_score(signal_board(spark, sf_dir), D.SOURCES).join(caps, "ticker", "left")
    return B.profile(board, D.SOCIAL, D.CATALYST, D.MARKET)


@query("sc4_risks", CAPPED + " SELECT ticker, setup_score, array_to_string(risks, ', ') AS risks FROM capped")
def sc4_risks(spark, sf_dir):
    return capped(spark, sf_dir).select("ticker", F.col("setup_score").cast("long").alias("setup_score"), "risks")


FIX = lambda x, n: f"format('{{:.{n}f}}', floor({x} * {10**n} + 0.5::DOUBLE) / {10**n}.0::DOUBLE)"
QUOTE = lambda x: f"""'"' || replace({x}, '"', '""') || '"'"""
HEADING = ",".join(["rank", "ticker", "name", "market_price", "setup_score", "attention_score", "stage", "evidence", "risk_flags", "mentions", "momentum_percent", "sentiment", "price_move_percent", "relative_volume", *D.SOURCES])


@query("snk2_csv_lines", CAPPED + f""", shown AS (SELECT *, row_number() OVER (ORDER BY setup_score DESC, ticker) AS place FROM capped QUALIFY place <= 50)
SELECT '{HEADING}' AS line UNION ALL SELECT place || ',' || ticker || ',' || {QUOTE("coalesce(name, ticker::VARCHAR)")} || ',' || coalesce(regexp_replace(last_price::VARCHAR, '\\.0$', ''), '') || ',' || setup_score || ',' || {FIX("signal_score", 1)} || ',' || {QUOTE("stage")} || ',' ||
 {QUOTE("evidence")} || ',' || {QUOTE("array_to_string(risks, ' | ')")} || ',' || mentions || ',' || coalesce({FIX("momentum", 2)}, '') || ',' || {FIX("sentiment", 3)} || ',' || {FIX("price_move", 2)} || ',' || {FIX("relative_volume", 2)}
 {"".join(f" || ',' || from_{s}" for s in D.SOURCES)} FROM shown""")  # fmt: skip
def snk2_csv_lines(spark, sf_dir):
    """The export is written and read again, as its reader would."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    B.save_csv(B.export_rows(capped(spark, sf_dir), D.SOURCES), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


LOUD, CROWD, COVERED, UP = "relative_volume >= 1.3", f"{S_} >= 3", f"{C_} >= 4", "price_move >= 3"


@query("sm6_trend_text", BOARD + f""", {SIGNALLED}, p AS (SELECT *, {ACTIVE(D.SOURCES)} AS n, 'sector ' || ticker % 4 AS sector FROM signal_score),
q AS (SELECT *, list_filter([CASE WHEN {UP} THEN CASE WHEN price_move >= 10 THEN 'strong ' ELSE '' END || {FIX("price_move", 1)} || '% price move' END, CASE WHEN {LOUD} THEN {FIX("relative_volume", 1)} || '× normal volume' END,
 CASE WHEN {CROWD} THEN format('{{:,}}', ({S_})::BIGINT) || ' social mention' || CASE WHEN {S_} = 1 THEN '' ELSE 's' END END, CASE WHEN {COVERED} THEN format('{{:,}}', ({C_})::BIGINT) || ' news hit' || CASE WHEN {C_} = 1 THEN '' ELSE 's' END END,
 CASE WHEN n >= 4 THEN n || ' data platforms' END, CASE WHEN ticker % 4 > 0 THEN sector END], lambda x: x IS NOT NULL) AS parts FROM p)
SELECT ticker, CASE WHEN {LOUD} AND NOT {CROWD} AND NOT {COVERED} THEN 'Under-the-radar: volume running ' || {FIX("relative_volume", 1)} || '× normal' || CASE WHEN {UP} THEN ' with price up ' || {FIX("price_move", 1)} || '%' ELSE '' END || ' — crowd attention hasn''t arrived yet, making this an early-mover signal.'
 WHEN len(parts) = 0 THEN 'Composite signal: ' || {FIX("signal_score", 0)} || '/100 across ' || n || ' data source' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' — no single dominant catalyst yet.'
 ELSE CASE WHEN {S_} >= {C_} AND {CROWD} THEN 'Retail' WHEN {COVERED} THEN 'News' WHEN {UP} OR {LOUD} THEN 'Price/volume' ELSE 'Multi-source' END || ': ' || array_to_string(parts, ' · ') || '.' END AS said FROM q""")  # fmt: skip
def sm6_trend_text(spark, sf_dir):
    board = B.attention_score(signal_board(spark, sf_dir), D.SOURCES)
    sector = F.when(F.col("ticker") % 4 > 0, F.concat(F.lit("sector "), F.col("ticker") % 4))
    said = C.trend_text(F.col("relative_volume"), F.col("price_move"), B.total(D.SOCIAL), B.total(D.CATALYST), B.active(D.SOURCES), F.col("signal_score"), sector)
    return board.select("ticker", said.alias("said"))


@query("st11_log_entries", ALERTS + """, lc AS (SELECT ticker, arg_max(close, date) AS base_price FROM ledger GROUP BY 1)
SELECT type || '-' || subject || '-1998-09-01' AS id, type, lc.ticker, NULL::BIGINT AS theme, NULL::VARCHAR AS stage, DATE '1998-09-01' AS date, round(base_price, 6) AS base_price FROM new JOIN lc ON subject = lc.ticker::VARCHAR WHERE type IN ('release', 'dead-coil')
UNION ALL SELECT 'theme-stage-' || theme || '-' || now || '-1998-09-01', 'theme-stage', NULL, theme, now, DATE '1998-09-01', NULL FROM b JOIN a USING (theme) WHERE a.was <> now AND now NOT IN ('insufficient-data', 'quiet')""")
def st11_log_entries(spark, sf_dir):
    springs = run_alerts(spark, sf_dir)[0].filter("type NOT IN ('theme-stage-transition', 'weekly-digest')").select("type", F.col("subject").cast("long").alias("ticker"))
    themes = S.theme_events(*theme_stages(spark, sf_dir)).select(F.lit("theme-stage-transition").alias("type"), "theme", F.col("now").alias("stage"))
    entries = A.log_entries(springs, themes, D.ledger(spark, sf_dir), day("1998-09-01"))
    return entries.withColumn("base_price", F.round("base_price", 6))


# --- official names and caps ----------------------------------------------------------

TITLES = """listed AS (SELECT c_custkey::VARCHAR AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS cik, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || ' HOLDINGS' ELSE c_mktsegment || ' Works' END AS title FROM customer WHERE c_custkey % 7 > 0)"""


def titles(spark, sf_dir):
    """The company list as its publisher lays it out, a response for each nation; some records are broken."""
    k = F.col("c_custkey")
    title = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" HOLDINGS"))).otherwise(F.concat("c_mktsegment", F.lit(" Works")))
    record = F.struct(F.when(k % 7 > 0, k).alias("cik_str"), k.cast("string").alias("ticker"), title.alias("title"))
    pages = D.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.cast("string"), record)))).alias("value"))
    return feeds.ticker_titles(pages)


@query("src18_title_map", f"WITH {TITLES} SELECT * FROM listed")
def src18_title_map(spark, sf_dir):
    return titles(spark, sf_dir)


@query("en1_names_and_caps", BOARD + f""", {TITLES}, s AS (SELECT ticker, CASE ticker % 3 WHEN 1 THEN ticker::VARCHAR WHEN 2 THEN 'Kept ' || ticker END AS name, last_price FROM board),
e AS (SELECT s.*, nullif(title, '') AS title, CASE WHEN last_price > 0 AND c_nationkey > 0 THEN c_nationkey * 1000000.0::DOUBLE * last_price END AS cap FROM s LEFT JOIN listed ON listed.ticker = s.ticker::VARCHAR LEFT JOIN customer ON c_custkey = s.ticker AND listed.cik IS NOT NULL)
SELECT ticker, CASE WHEN name IS NULL OR name = ticker::VARCHAR THEN coalesce(CASE WHEN title = upper(title) THEN list_aggregate(list_transform(string_split(lower(title), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') ELSE title END, name) ELSE name END AS name,
 floor(cap + 0.5::DOUBLE)::BIGINT AS market_cap, CASE WHEN cap >= 5e8 THEN 'large' WHEN cap > 0 THEN 'small' END AS cap_tier FROM e""")
def en1_names_and_caps(spark, sf_dir):
    k = F.col("ticker")
    name = F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, F.concat(F.lit("Kept "), k.cast("string")))
    signals = signal_board(spark, sf_dir).select("ticker", name.alias("name"), "last_price")
    shares = D.read(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), (F.col("c_nationkey") * 1000000).alias("shares"))
    return X.enrich_caps(signals, titles(spark, sf_dir), shares).select("ticker", "name", "market_cap", "cap_tier")
