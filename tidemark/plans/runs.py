"""Queries that run streams and state tables over the given tables, with the oracle SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.plans import bindings as D
from tidemark.plans.alerts import ALERTS, LEADERS, NEWS19, day, edges, proof_quarters, run_alerts
from tidemark.plans.queries import ORACLES, query
from tidemark.session import dealt, shared_dir
from tidemark.sources import deltas, landed
from tidemark.streaming import folds, leases, outbox


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("st13_leader_leases", LEADERS.replace(NEWS19, NEWS19.replace("WITH ", "WITH RECURSIVE ", 1), 1) + """, held AS (SELECT ticker, min(date) AS detected FROM hit GROUP BY 1 UNION ALL SELECT hit.ticker, min(date) FROM held JOIN hit ON hit.ticker = held.ticker AND date > detected + 182 GROUP BY hit.ticker, detected)
SELECT held.ticker, event, detected, detected + 182 AS expires, headline, coalesce(followers, []) AS followers FROM held JOIN hit ON hit.ticker = held.ticker AND date = detected LEFT JOIN fol ON fol.ticker = held.ticker, (SELECT unnest(['granted', 'expired']) AS event)""")
def st13_leader_leases(spark, sf_dir):
    """All triggers as a stream; one far in the future moves the watermark past every expiry."""
    at, s = folder(spark, "leases"), D.read(spark, sf_dir, "supplier")
    triggers = proof_quarters(spark, sf_dir).select("ticker", "date", "headline")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("ticker"), day("2100-01-01").alias("date"), F.lit("").alias("headline"))
    triggers.unionByName(end).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(triggers.schema).parquet(f"{at}/in")
    found = leases.leaders(stream, s.select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("sub")), edges(spark, sf_dir))
    found.writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start(f"{at}/out", format="parquet").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").filter("ticker >= 0")


@query("st1_delta_ledger", ORACLES["st1_upsert"])
def st1_delta_ledger(spark, sf_dir):
    """The ledger, then a later batch as a delta, a replay of it with other values, and a compaction."""
    at, ledger = folder(spark, "deltas"), D.ledger(spark, sf_dir)
    late = F.col("date") > day("1998-06-30")
    deltas.upsert(ledger, at, folds.LEDGER_KEYS, "run", 0)
    batch = ledger.filter(late).select("ticker", "date", (F.col("mentions") + 1).alias("mentions"), F.lit(None).cast("double").alias("close"), "volume", F.col("volume").cast("double").alias("wiki"))
    deltas.upsert(batch, at, folds.LEDGER_KEYS, "run", 1)
    deltas.upsert(batch.withColumn("mentions", F.lit(0).cast("long")), at, folds.LEDGER_KEYS, "run", 1)
    deltas.compact(spark, at, ledger.schema, folds.LEDGER_KEYS, 1, lambda rows: L.newest(rows, 400))
    deltas.vacuum(spark, at, 1)
    return L.newest(dealt(deltas.read(spark, at, ledger.schema, folds.LEDGER_KEYS), "ticker"), 400)


def _flaky(event):
    if event["subject"].endswith("7"):
        raise OSError("the sink is down")


@query("snk3_outbox", ALERTS + " SELECT type, priority, subject, 1::BIGINT AS acks FROM (SELECT * FROM new UNION ALL SELECT DATE '1998-09-01', 'weekly-digest', 'normal', '')")
def snk3_outbox(spark, sf_dir):
    """Every alert is acknowledged once, though its batch is put twice and the sink fails in the first delivery."""
    at, schema = folder(spark, "outbox"), "type string, priority string, subject string"
    alerts = run_alerts(spark, sf_dir)[0].select("type", "priority", "subject")
    outbox.put(alerts, at, 0)
    outbox.put(alerts, at, 0)
    outbox.deliver(spark, at, schema, _flaky)
    outbox.deliver(spark, at, schema, lambda event: None)
    events = spark.read.parquet(f"{at}/events").drop("batch")
    acks = spark.read.schema(outbox.ACKS).parquet(f"{at}/acks").groupBy("id").agg(F.count("*").alias("acks"))
    return events.join(acks, "id", "left").select("type", "priority", "subject", "acks")


@query("src3_landed_records", "SELECT page_id, CASE WHEN page_id % 7 > 0 THEN url END AS url, page_id % 7 = 0 AS corrupt FROM pages")
def src3_landed_records(spark, sf_dir):
    """All pages landed as lines of JSON, every seventh one cut off, and read by the registered source."""
    at = folder(spark, "landed")
    whole = F.to_json(F.struct("page_id", "url"))
    cut = F.concat(F.col("page_id").cast("string"), F.lit(" "), F.substring(whole, 1, 9))
    D.read(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 7 > 0, whole).otherwise(cut).alias("value")).write.text(at)
    rows = landed.read(spark, at, "jsonl")
    r = F.from_json("value", "page_id bigint, url string")
    broken = F.regexp_extract("corrupt", r"\): (\d+) ", 1)
    return rows.select(F.coalesce(r["page_id"], broken.try_cast("long")).alias("page_id"), r["url"].alias("url"), F.col("corrupt").isNotNull().alias("corrupt"))


RUN = "WITH " + D.LEDGER_SQL + ", " + D.EVENTS_SQL + """, old AS (SELECT ticker, date, mentions, round(mentions::DOUBLE / sum(mentions) OVER (PARTITION BY date), 6) AS share_of_voice, close, volume::DOUBLE AS volume, wiki FROM ledger),
act AS (SELECT ticker, sum(mentions) AS m, arg_max(last_price, seq) FILTER (source = 'view' AND last_price IS NOT NULL) AS close, arg_max(relative_volume, seq) FILTER (source = 'view' AND last_price IS NOT NULL) AS volume FROM mention GROUP BY 1),
last AS (SELECT ticker, arg_max(close, date) AS close FROM old GROUP BY 1),
now AS (SELECT coalesce(act.ticker, last.ticker) AS ticker, DATE '2002-02-01' AS date, coalesce(m, 0)::BIGINT AS mentions, round(coalesce(m, 0)::DOUBLE / (SELECT sum(m) FROM act), 6) AS share_of_voice, coalesce(act.close, last.close) AS close, act.volume, NULL::DOUBLE AS wiki FROM act FULL JOIN last ON act.ticker = last.ticker),
joined AS (SELECT * FROM old WHERE date <> DATE '2002-02-01' UNION ALL SELECT * FROM now), whole AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 400),
gone AS (SELECT ticker FROM whole WHERE ticker NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 1) GROUP BY 1 HAVING coalesce(max(date) FILTER (mentions > 0), min(date)) < DATE '2002-02-01' - 90)"""


def ledger_run(spark, sf_dir):
    """A run over all events on a ledger that ends some months before, so that dormant tickers go."""
    old = L.share_of_voice(D.ledger(spark, sf_dir)).withColumn("volume", F.col("volume").cast("double"))
    events = D.mention_events(spark, sf_dir)
    told = events.select("seq", "ticker", F.when(F.col("source") == "view", "Price/Volume").otherwise(F.col("source")).alias("source"), "mentions", "last_price", F.col("relative_volume").alias("volume"))
    s, c = D.read(spark, sf_dir, "supplier"), D.read(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    key = F.col("s_suppkey").alias("ticker")
    meta = old.select("ticker").distinct().join(s.select(key, F.col("s_name").alias("name"), none.alias("sector"), F.lit("known").alias("sub"), none.alias("article"), day("1992-01-01").alias("first_seen")), "ticker")
    k = F.col("c_custkey")
    registry = c.filter(k % 7 > 0).select(k.alias("ticker"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("sector"), none.alias("industry"), F.concat(F.lit("Article "), k).alias("article"))
    u = F.col("ticker")
    url = F.when(u % 4 == 0, F.concat(F.lit("https://w.example/wiki/Page_"), u, F.lit("%2C_Inc.")))
    signals = events.select("ticker").distinct().select("ticker", F.when(u % 2 == 0, F.concat(F.lit("Signal "), u)).alias("name"), none.alias("sector"), F.lit("told").alias("industry"), url.alias("description_url"))
    return L.run(old, meta, told, registry, signals, s.filter("s_nationkey = 1").select(key), day("2002-02-01"))


@query("x8_ledger_run", RUN + " SELECT * FROM whole WHERE ticker NOT IN (SELECT ticker FROM gone)")
def x8_ledger_run(spark, sf_dir):
    return ledger_run(spark, sf_dir)[0]


@query("x8_meta", RUN + """ SELECT n.ticker, coalesce(CASE WHEN c_custkey % 7 > 0 THEN coalesce(CASE WHEN act.ticker % 2 = 0 THEN 'Signal ' || act.ticker END, CASE WHEN c_custkey % 3 > 0 THEN c_name END) END, s_name) AS name,
 CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS sector, coalesce(CASE WHEN c_custkey % 7 > 0 AND act.ticker IS NOT NULL THEN 'told' END, CASE WHEN s_suppkey IS NOT NULL THEN 'known' END) AS sub,
 CASE WHEN c_custkey % 7 > 0 THEN CASE WHEN act.ticker % 4 = 0 THEN 'Page ' || act.ticker || ', Inc.' ELSE 'Article ' || c_custkey END END AS article, CASE WHEN s_suppkey IS NOT NULL THEN DATE '1992-01-01' ELSE DATE '2002-02-01' END AS first_seen
FROM now n LEFT JOIN act ON act.ticker = n.ticker LEFT JOIN last ON last.ticker = n.ticker LEFT JOIN supplier ON s_suppkey = last.ticker LEFT JOIN customer ON c_custkey = n.ticker WHERE n.ticker NOT IN (SELECT ticker FROM gone)""")
def x8_meta(spark, sf_dir):
    return ledger_run(spark, sf_dir)[1]
