"""The operators' inputs made from the given tables, in DataFrame form and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread

SOURCES = ("click", "error", "purchase", "signup", "view")
SOCIAL, CATALYST, MARKET = ("click", "view"), ("purchase", "signup"), ("error",)

LEDGER_SQL = """ledger AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS mentions,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (100.0::DOUBLE * sum(l_quantity)) AS close,
         sum(l_quantity) AS volume, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS wiki
  FROM lineitem GROUP BY 1, 2)"""
BENCH_SQL = """bench AS (
  SELECT CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (100.0::DOUBLE * sum(l_quantity)) AS close FROM lineitem GROUP BY 1)"""
THEMES_SQL = "themes AS (SELECT n_regionkey AS theme, s_suppkey AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
EVENTS_SQL = """mention AS (
  SELECT event_id AS seq, user_id AS ticker, event_type AS source, ts, greatest(1, CAST(floor(value + 0.5) AS BIGINT)) AS mentions,
         (k % 21 - 10) / 10.0::DOUBLE AS sentiment, CAST(k % 17 - 5 AS DOUBLE) AS price_move, 0.5::DOUBLE + (k % 9) / 2.0::DOUBLE AS relative_volume,
         CASE WHEN k % 4 > 0 THEN value END AS last_price
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
SIGNAL_SQL = EVENTS_SQL + """, signal AS (
  SELECT ticker, sum(mentions)::BIGINT AS mentions, sum(sentiment * mentions) / sum(mentions) AS sentiment, sum(price_move * mentions) / sum(mentions) AS price_move,
         sum(relative_volume * mentions) / sum(mentions) AS relative_volume, arg_max(last_price, seq) FILTER (last_price IS NOT NULL) AS last_price,
         """ + ", ".join(f"coalesce(sum(mentions) FILTER (source = '{s}'), 0)::BIGINT AS from_{s}" for s in SOURCES) + """
  FROM mention WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ticker),
before AS (SELECT ticker, sum(mentions) AS before FROM mention WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ticker),
board AS (SELECT signal.*, (mentions - before) * 100.0::DOUBLE / before AS momentum FROM signal LEFT JOIN before USING (ticker))"""  # fmt: skip


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier days. Prices are summed in whole cents, so sums don't depend on their order."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.count("*").alias("mentions"), (cents / (100.0 * F.sum("l_quantity"))).alias("close"), F.sum("l_quantity").alias("volume"), (cents / F.lit(100.0)).alias("wiki")
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((cents / (100.0 * F.sum("l_quantity"))).alias("close"))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("theme"))
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("theme", F.col("s_suppkey").alias("ticker"))


def mention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("ticker"), F.col("event_type").alias("source"), "ts",
        F.greatest(F.lit(1), F.floor(F.col("value") + 0.5)).cast("long").alias("mentions"), ((k % 21 - 10) / F.lit(10.0)).alias("sentiment"),
        (k % 17 - 5).cast("double").alias("price_move"), (0.5 + (k % 9) / F.lit(2.0)).alias("relative_volume"), F.when(k % 4 > 0, F.col("value")).alias("last_price"),
    )


# --- headlines: titles put together from events --------------------------------------

HEAD_SOURCES = ("CNBC", "Google News", "Reddit", "GDELT News", "Price/Volume", "4chan", "SEC Filings")
PHRASES = (
    "shares surge as earnings beat the market", "to acquire a rival, analysts say", "price +3.2 today", "class action: law firm reminds investors of the deadline",
    "stock falls after weak revenue guidance", "is talked of on a forum", "Trending on StockTwits (#4)", "co-packaged optics demand lifts suppliers example.com France",
    "", "unveils a new widget on CEO call",
)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


HEAD_SQL = f"""head AS (SELECT seq, ticker, source, CASE WHEN seq % 10 = 8 THEN '' ELSE CASE k % 4 WHEN 0 THEN '$' || ticker WHEN 1 THEN '(' || ticker || ')' WHEN 2 THEN 'Supplier ' || user_id ELSE ticker END || ' ' || list_extract({sql_list(PHRASES)}, seq % 10 + 1) END AS title,
    'https://' || event_type || '.example/' || (seq // 3) AS url, ts AS published, 1 + (k % 5) / 2.0::DOUBLE AS weight, CAST(k % 17 - 5 AS DOUBLE) AS price_move, 0.5::DOUBLE + (k % 9) / 2.0::DOUBLE AS relative_volume
  FROM (SELECT event_id AS seq, 'T' || user_id AS ticker, user_id, event_type, ts, k, list_extract({sql_list(HEAD_SOURCES)}, k % 7 + 1) AS source FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""
REGISTRY_SQL = """reg AS (SELECT DISTINCT 'T' || user_id AS ticker, 'Supplier ' || user_id || ' Holdings Inc.' AS name, ['supplier ' || user_id] AS aliases FROM events WHERE user_id % 3 <> 0
  UNION ALL SELECT 'ON', 'On Semi', ['on', 'on semi', 'optics demand'] UNION ALL SELECT 'A', 'Agilent', ['a', 'analysts'])"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ticker, source, title, url, published, weight, price_move, relative_volume): one item an event."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf_dir, "events").withColumns({"k": k, "seq": F.col("event_id"), "ticker": F.concat(F.lit("T"), "user_id")})
    who = F.when(F.col("k") % 4 == 0, F.concat(F.lit("$"), "ticker")).when(F.col("k") % 4 == 1, F.concat(F.lit("("), "ticker", F.lit(")"))).when(F.col("k") % 4 == 2, F.concat(F.lit("Supplier "), "user_id")).otherwise(F.col("ticker"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    title = F.when(F.col("seq") % 10 == 8, "").otherwise(F.concat(who, F.lit(" "), pick(PHRASES, F.col("seq") % 10)))
    return e.select(
        "seq", "ticker", pick(HEAD_SOURCES, F.col("k") % 7).alias("source"), title.alias("title"), F.concat(F.lit("https://"), "event_type", F.lit(".example/"), F.floor(F.col("seq") / 3).cast("long")).alias("url"),
        F.col("ts").alias("published"), (1 + (F.col("k") % 5) / 2.0).alias("weight"), (F.col("k") % 17 - 5).cast("double").alias("price_move"), (0.5 + (F.col("k") % 9) / F.lit(2.0)).alias("relative_volume"),
    )


def headline_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, name, aliases): two thirds of the users, and two gated tickers."""
    u = read(spark, sf_dir, "events").filter("user_id % 3 <> 0").select("user_id").distinct()
    some = u.select(F.concat(F.lit("T"), "user_id").alias("ticker"), F.concat(F.lit("Supplier "), "user_id", F.lit(" Holdings Inc.")).alias("name"), F.array(F.concat(F.lit("supplier "), "user_id")).alias("aliases"))
    gated = spark.createDataFrame([("ON", "On Semi", ["on", "on semi", "optics demand"]), ("A", "Agilent", ["a", "analysts"])], some.schema)
    return some.unionByName(gated)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as texts to match: (key, source, text, url, weight, published)."""
    return spread(headlines(spark, sf_dir)).select(F.col("seq").alias("key"), "source", F.col("title").alias("text"), "url", "weight", "published")
