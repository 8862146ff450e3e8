"""Queries of the landed feeds, with their oracle SQL. The raw responses are put together from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.plans import bindings as D
from tidemark.plans.news import COMMON, HEAD, quoted
from tidemark.plans.queries import LEDGER, RE, query, r6
from tidemark.session import spread
from tidemark.sources import feeds as S

HALF = lambda x: f"floor({x} + 0.5)::BIGINT"


def rows_of(spark, sf_dir, table):
    return D.read(spark, sf_dir, table)


SHORT = """x AS (SELECT 'S' || l_suppkey AS ticker, sum(CASE WHEN l_returnflag = 'N' OR l_suppkey % 3 = 0 THEN l_quantity ELSE 0 END)::BIGINT * 100 AS short, sum(l_quantity)::BIGINT * 100 AS total FROM lineitem GROUP BY l_suppkey)"""


@query("src1_short_volume", f"""WITH {SHORT}, y AS (SELECT *, short::DOUBLE / total AS ratio FROM x WHERE length(ticker) <= 5 AND short >= 50000)
SELECT DATE '2024-01-02' AS date, ticker, short::DOUBLE AS short, total::DOUBLE AS total, greatest(1, {HALF("ratio * 10 + log10(short + 1)")}) AS mentions, CASE WHEN ratio > 0.55::DOUBLE THEN -0.1::DOUBLE ELSE 0.0 END AS sentiment, round(1 + least(2.0::DOUBLE, ratio), 6) AS relative_volume
FROM y WHERE ratio >= 0.30::DOUBLE ORDER BY short * ratio DESC, ticker LIMIT 200""")
def src1_short_volume(spark, sf_dir):
    short = F.when((F.col("l_returnflag") == "N") | (F.col("l_suppkey") % 3 == 0), F.col("l_quantity")).otherwise(0)
    sums = rows_of(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(short).cast("long").alias("s"), F.sum("l_quantity").cast("long").alias("t"))
    line = F.concat(F.lit("20240102|S"), "l_suppkey", F.lit("|"), F.col("s") * 100, F.lit("|0|"), F.col("t") * 100)
    lines = sums.select(line.alias("value")).unionByName(spark.createDataFrame([("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume",), ("broken",)], "value string"))
    events = S.latest_day(S.short_volume(lines), F.lit("2024-01-05").cast("date"))
    return events.withColumn("relative_volume", F.round("relative_volume", 6))


LISTED = "(SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, * FROM events)"


@query("src2_forum_listing", f"SELECT 'post ' || seq || ' about ' || event_type AS title, 'https://f.example/p/' || seq AS url, round(greatest(1, log10(k * 3 + 10) * 3 + k / 40.0::DOUBLE), 6) AS weight FROM {LISTED}")
def src2_forum_listing(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    post = F.struct(F.concat(F.lit("post "), "event_id").alias("title"), F.concat(F.lit("about "), "event_type").alias("selftext"), F.concat(F.lit("/p/"), "event_id").alias("permalink"), (k * 3).alias("score"), k.alias("num_comments"))
    value = F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data")))
    return S.forum_listing(rows_of(spark, sf_dir, "events").select(value.alias("value")), "https://f.example").select("title", "url", *r6("weight"))


def feed(spark, sf_dir):
    """A feed for each headline's event, of one RSS item and one Atom entry."""
    h = spread(D.headlines(spark, sf_dir))
    rss = F.concat(F.lit("<rss><channel>\n<item>\n<title><![CDATA["), "title", F.lit("]]></title><link>"), "url", F.lit("</link><pubDate>p"), "seq", F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry a='1'><summary>Note &amp; more "), "seq", F.lit("</summary><content>in full</content><link rel='x' href='https://l.example/"), "seq", F.lit("'/><updated>u"), "seq", F.lit("</updated></entry></channel></rss>"))
    return h.select(F.col("seq").alias("response"), F.concat(rss, atom).alias("value"), "source", "ticker")


ITEMS = HEAD + """, items AS (SELECT seq AS response, 0 AS seq, source, trim(title) AS title, url, 'p' || seq AS published FROM head UNION ALL SELECT seq, 1, source, 'Note & more ' || seq, 'https://l.example/' || seq, 'u' || seq FROM head)"""


@query("src3_feed_items", ITEMS + " SELECT response, seq, title, url, 2.0::DOUBLE AS weight, published FROM items")
def src3_feed_items(spark, sf_dir):
    return S.feed_items(feed(spark, sf_dir))


@query("src4_forum_feed_items", ITEMS + " SELECT response, seq, title, url, 1.5::DOUBLE AS weight, published FROM items WHERE length(title) > 5")
def src4_forum_feed_items(spark, sf_dir):
    return S.forum_feed_items(feed(spark, sf_dir))


KEY120 = "left(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 120)"


@query("src5_swept_wires", HEAD + f", w AS (SELECT k.*, url[9:12] AS wire FROM head k WHERE length(title) >= 12) SELECT seq, wire, title FROM w QUALIFY row_number() OVER (PARTITION BY {KEY120} ORDER BY wire, seq) = 1")
def src5_swept_wires(spark, sf_dir):
    items = D.headlines(spark, sf_dir).select("seq", F.substring("url", 9, 4).alias("wire"), "title")
    return S.swept_wires(items).select("seq", "wire", "title")


@query("src6_first_source", HEAD + """, a AS (SELECT DISTINCT ticker FROM head WHERE source = 'CNBC' AND price_move > 9), b AS (SELECT ticker, seq FROM head WHERE source = 'Google News')
SELECT ticker, seq FROM head WHERE source = 'CNBC' AND price_move > 9 UNION ALL SELECT ticker, seq FROM b WHERE ticker NOT IN (SELECT ticker FROM a)""")
def src6_first_source(spark, sf_dir):
    h = D.headlines(spark, sf_dir)
    return S.first_source([h.filter("source = 'CNBC' AND price_move > 9").select("ticker", "seq"), h.filter("source = 'Google News'").select("ticker", "seq")])


@query("src7_article_list", HEAD + f", t AS (SELECT 0 AS response, trim(title || ' site.example ' || source) AS title, url, 2.0::DOUBLE AS weight, TIMESTAMP '2024-01-01 02:03:04' + to_days((seq % 9)::INT) AS published, seq FROM head) SELECT response, title, url, weight, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM t WHERE regexp_matches(title, '(?i){RE(V.MARKET)}')")
def src7_article_list(spark, sf_dir):
    h = D.headlines(spark, sf_dir)
    stamp = F.concat(F.lit("2024010"), F.col("seq") % 9 + 1, F.lit("T020304Z"))
    article = F.struct("title", "url", F.lit("site.example").alias("domain"), F.col("source").alias("sourceCountry"), stamp.alias("seendate"))
    value = F.to_json(F.struct(F.array(article).alias("articles")))
    found = S.article_list(h.select(F.col("seq").alias("response"), value.alias("value")))
    return found.select(F.lit(0).alias("response"), "title", "url", "weight", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("src8_discovery_items", HEAD + f""", j AS (SELECT *, seq % 10 AS job FROM head), p AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS place FROM j), m AS (SELECT * FROM p WHERE place <= 12 AND regexp_matches(title, '(?i){RE(V.MARKET)}')),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY title, url ORDER BY job, seq) = 1) SELECT job, seq, title, url, 2.5::DOUBLE AS weight FROM u ORDER BY job, seq LIMIT 100""")
def src8_discovery_items(spark, sf_dir):
    return S.discovery_items(D.headlines(spark, sf_dir).withColumn("job", F.col("seq") % 10))


@query("src9_trending", """WITH t AS (SELECT o_orderkey AS response, 'S' || l_suppkey AS ticker, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_suppkey, l_linenumber) AS rank, count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT response, ticker, 'Stock ' || ticker AS name, rank, greatest(1, floor((n - rank + 1)::DOUBLE / n * 5 + 0.5))::BIGINT AS mentions FROM t WHERE length(ticker) <= 5""")
def src9_trending(spark, sf_dir):
    entry = F.struct("l_suppkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("symbol"), F.concat(F.lit("Stock S"), "l_suppkey").alias("title"))
    listed = rows_of(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("symbols"))  # an order's few lines
    return S.trending(listed.select(F.col("l_orderkey").alias("response"), F.to_json(F.struct("symbols")).alias("value"))).withColumn("rank", F.col("rank").cast("long"))


@query("src10_stream_messages", """WITH m AS (SELECT conv_id AS ticker, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role, text FROM conversations WHERE text IS NOT NULL)
SELECT ticker, place - 1 AS seq, left(text, 240) AS title, CASE role WHEN 'user' THEN 0.3 WHEN 'assistant' THEN -0.3 ELSE 0.0 END::DOUBLE AS sentiment FROM m WHERE place <= 8""")
def src10_stream_messages(spark, sf_dir):
    tag = F.when(F.col("role") == "user", "Bullish").when(F.col("role") == "assistant", "Bearish")
    message = F.struct("turn", F.col("text").alias("body"), F.struct(F.struct(tag.alias("basic")).alias("sentiment")).alias("entities"))
    streams = rows_of(spark, sf_dir, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))  # a conversation's turns
    return S.stream_messages(streams.select(F.col("conv_id").alias("ticker"), F.to_json(F.struct("messages")).alias("value"))).withColumn("seq", F.col("seq").cast("long"))


@query("src11_mention_counts", f"SELECT 'C' || c_custkey AS ticker, greatest(1, {HALF('log10(abs(c_acctbal) + 1) * 3')}) AS mentions, CASE WHEN c_nationkey > 0 THEN abs(c_acctbal) > c_nationkey * 100 END AS rising FROM customer WHERE length('C' || c_custkey) <= 5 AND abs(c_acctbal) > 0")
def src11_mention_counts(spark, sf_dir):
    entry = F.struct(F.concat(F.lit("c"), "c_custkey").alias("ticker"), F.abs("c_acctbal").alias("mentions"), (F.col("c_nationkey") * 100).alias("mentions_24h_ago"))
    return S.mention_counts(rows_of(spark, sf_dir, "customer").select(F.to_json(F.struct(F.array(entry).alias("results"))).alias("value")))


@query("src12_comment_mentions", HEAD + f""", c AS (SELECT seq AS key, 'T' || (CAST(substr(ticker, 2) AS BIGINT) // 2 * 2) AS ticker, title FROM head), r AS (SELECT DISTINCT 'T' || user_id AS ticker FROM events)
SELECT key, ticker FROM c JOIN r USING (ticker) WHERE regexp_matches(title, '(?i)\\$' || ticker || '\\b') OR contains(lower(title), 'widget') OR (length(ticker) >= 4 AND ticker NOT IN ({COMMON}) AND regexp_matches(title, '(^|[^A-Za-z0-9])' || ticker || '([^A-Za-z0-9]|$)'))""")
def src12_comment_mentions(spark, sf_dir):
    even = F.concat(F.lit("T"), F.floor(F.substring("ticker", 2, 9).cast("long") / 2).cast("long") * 2)
    hits = D.headlines(spark, sf_dir).select(F.col("seq").alias("key"), even.alias("ticker"), F.col("title").alias("text"))
    registry = rows_of(spark, sf_dir, "events").select(F.concat(F.lit("T"), "user_id").alias("ticker")).distinct().withColumn("name", F.lit("The Widget Holdings, Inc."))
    return S.comment_mentions(hits, registry)


@query("src13_board_catalog", f"SELECT event_id AS no, event_type || ' & ' || user_id AS text, least(5, 1 + {HALF('k / 40.0::DOUBLE')}) AS weight FROM {LISTED}")
def src13_board_catalog(spark, sf_dir):
    thread = F.struct(F.col("event_id").alias("no"), F.col("event_type").alias("sub"), F.concat(F.lit("<b>&amp;</b> "), "user_id").alias("com"), F.get_json_object("props", "$.k").cast("double").alias("replies"))
    return S.board_catalog(rows_of(spark, sf_dir, "events").select(F.to_json(F.array(F.struct(F.array(thread).alias("threads")))).alias("value"))).withColumn("weight", F.col("weight").cast("long"))


MOVE = "SELECT ticker, last_price, round((last_price - before) * 100 / before, 6) AS price_move, round(CASE WHEN avg_volume <> 0 THEN volume / avg_volume ELSE 1 END, 6) AS relative_volume, volume"
LAST6 = LEDGER + """, a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger),
q6 AS (SELECT ticker, max(close) FILTER (age = 1) AS last_price, max(close) FILTER (age = 2) AS before, max(volume) FILTER (age = 1) AS volume, avg(volume) FILTER (age BETWEEN 2 AND 6) AS avg_volume, max(date) AS as_of FROM a WHERE age <= 6 GROUP BY 1),
q5 AS (SELECT ticker, max(close) FILTER (age = 1) * CASE WHEN ticker % 4 = 0 THEN 1.5::DOUBLE ELSE 1 END AS last_price, max(close) FILTER (age = 2) AS before, max(volume) FILTER (age = 1) AS volume, avg(volume) FILTER (age BETWEEN 2 AND 5) AS avg_volume FROM a WHERE age <= 5 GROUP BY 1)"""


def charts(spark, sf_dir):
    """Chart responses of each ticker's last five days; every fourth reports a raised market price."""
    ledger = D.ledger(spark, sf_dir)
    age = F.row_number().over(S.W.partitionBy("ticker").orderBy(F.desc("date")))
    days = ledger.withColumn("age", age).filter("age <= 5").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close", "volume"))).alias("d"))
    last = F.element_at("d", -1)["close"]
    meta = F.struct(F.concat(F.lit("s"), "ticker").alias("symbol"), F.when(F.col("ticker") % 4 == 0, last * 1.5).alias("regularMarketPrice"))
    quote = F.struct(F.transform("d", lambda x: x["close"]).alias("close"), F.transform("d", lambda x: x["volume"]).alias("volume"))
    chart = F.struct(F.array(F.struct(meta.alias("meta"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result"))
    return days.select(F.concat(F.lit("S"), "ticker").alias("ticker"), F.to_json(F.struct(chart.alias("chart"))).alias("value"))


def price_lines(spark, sf_dir):
    return D.ledger(spark, sf_dir).select(F.concat(F.lit("S"), "ticker").alias("ticker"), F.concat_ws(",", F.col("date").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), F.col("close").cast("string"), F.col("volume").cast("string")).alias("value"))


def own(df):
    return df.withColumn("ticker", F.substring("ticker", 2, 12).cast("long"))


@query("src14_chart_quotes", LAST6 + f" {MOVE} FROM q5 WHERE before IS NOT NULL")
def src14_chart_quotes(spark, sf_dir):
    return own(S.chart_quotes(charts(spark, sf_dir))).select("ticker", "last_price", *r6("price_move", "relative_volume"), "volume")


@query("src15_daily_quotes", LAST6 + f" {MOVE}, as_of FROM q6 WHERE before IS NOT NULL")
def src15_daily_quotes(spark, sf_dir):
    return own(S.daily_quotes(price_lines(spark, sf_dir))).select("ticker", "last_price", *r6("price_move", "relative_volume"), "volume", "as_of")


@query("src16_reconciled_quotes", LAST6 + """, y AS (SELECT * FROM q5 WHERE before IS NOT NULL AND ticker % 5 <> 1), s AS (SELECT * FROM q6 WHERE before IS NOT NULL AND ticker % 7 <> 1)
SELECT coalesce(y.ticker, s.ticker) AS ticker, CASE WHEN y.ticker IS NULL OR (s.ticker IS NOT NULL AND abs(y.last_price - s.last_price) / greatest(0.01::DOUBLE, s.last_price) > 0.25::DOUBLE) THEN s.last_price ELSE y.last_price END AS last_price,
  coalesce(abs(y.last_price - s.last_price) / greatest(0.01::DOUBLE, s.last_price) > 0.25::DOUBLE, false) AS mismatch FROM y FULL JOIN s ON y.ticker = s.ticker""")
def src16_reconciled_quotes(spark, sf_dir):
    a, b = own(S.chart_quotes(charts(spark, sf_dir))).filter("ticker % 5 <> 1"), own(S.daily_quotes(price_lines(spark, sf_dir))).filter("ticker % 7 <> 1")
    return S.reconciled_quotes(a, b).select("ticker", "last_price", F.col("note").isNotNull().alias("mismatch"))


@query("src17_price_history", LEDGER + " SELECT ticker, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM ledger WHERE mentions < 3) WHERE age <= 50")
def src17_price_history(spark, sf_dir):
    rows = D.ledger(spark, sf_dir).withColumn("close", F.when(F.col("mentions") < 3, F.col("close")).otherwise(F.lit(float("nan"))))
    return S.price_history(rows, 50)


@query("src17_pageviews", LEDGER + " SELECT ticker AS article, date, volume AS views FROM ledger")
def src17_pageviews(spark, sf_dir):
    item = F.struct(F.concat(F.date_format("date", "yyyyMMdd"), F.lit("00")).alias("timestamp"), F.col("volume").alias("views"))
    return S.pageviews(D.ledger(spark, sf_dir).select(F.col("ticker").alias("article"), F.to_json(F.struct(F.array(item).alias("items"))).alias("value")))


@query("src18_latest_filed", "SELECT o_custkey AS ticker, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS value FROM orders GROUP BY 1")
def src18_latest_filed(spark, sf_dir):
    return S.latest_filed(rows_of(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("filed")))


@query("src18_quarter_counts", """WITH q AS (SELECT unnest(range(1998 * 4 + 2 - 7, 1998 * 4 + 3)) AS q), p AS (SELECT DISTINCT o_orderpriority AS phrase FROM orders), n AS (SELECT o_orderpriority AS phrase, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT phrase, (q // 4)::INT AS year, (q % 4 + 1)::INT AS quarter, coalesce(n, 0) AS n FROM p CROSS JOIN q LEFT JOIN n USING (phrase, q)""")
def src18_quarter_counts(spark, sf_dir):
    filings = rows_of(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phrase"), F.col("o_orderdate").cast("date").alias("date"))
    return S.quarter_counts(filings, F.lit("1998-08-02").cast("date"))


@query("src19_industry_table", "SELECT 'S-' || upper(c.t) AS ticker, n_name AS name, 'Sector ' || r_name AS sector, r_name AS sub, '000' || n_nationkey AS cik FROM nation JOIN region ON r_regionkey = n_regionkey, (SELECT unnest(['a', 'b']) AS t) c WHERE c.t = 'a' OR n_nationkey % 2 = 0")
def src19_industry_table(spark, sf_dir):
    n = rows_of(spark, sf_dir, "nation").join(rows_of(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = lambda mark: F.concat(F.lit("\n|-\n|{{Symbol|S." + mark + "}}\n|[[Page of "), "n_name", F.lit("|"), "n_name", F.lit("]]||'''Sector "), "r_name", F.lit("'''||[["), "r_name", F.lit("]]{{ref}}||x||y||000"), "n_nationkey")
    odd = F.when(F.col("n_nationkey") % 2 == 0, line("B")).otherwise(F.lit("\n|-\n|{{Symbol|ODD}}\n|No sector||||"))
    page = F.concat(F.lit('intro\n{| class="wikitable sortable"\n! heads'), line("A"), odd, F.lit("\n|}\n{| class=\"wikitable\"\n|-\n|{{Symbol|NO}}\n|a||b||c||d||e||f\n|}"))
    return S.industry_table(n.select(page.alias("value")))


@query("src22_failures", HEAD + """, g AS (SELECT source || ' <ticker>: fetch failed ' || seq % 7 AS message, min(seq) AS seq, count(*) AS n FROM head GROUP BY 1)
SELECT seq, n, CASE WHEN n > 1 THEN n || 'x ' || message ELSE message END AS line FROM g ORDER BY seq LIMIT 20""")
def src22_failures(spark, sf_dir):
    h = D.headlines(spark, sf_dir)
    return S.summarised_failures(h.select("seq", F.concat("source", F.lit(" "), "ticker", F.lit(": fetch failed "), F.col("seq") % 7).alias("message")))


# --- text helpers ---------------------------------------------------------------------


@query("sf5_articles", """SELECT page_id, nullif(replace('Page ' || page_id || ' é_of', '_', ' '), '') AS article FROM pages""")
def sf5_articles(spark, sf_dir):
    url = F.concat(F.lit("https://w.example/wiki/Page%20"), "page_id", F.lit("%20%C3%A9_of?x=1#top"))
    return rows_of(spark, sf_dir, "pages").select("page_id", T.article_of(url).alias("article"))


@query("sf9_digit_times", "SELECT event_id AS seq, strftime(CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN date_trunc('day', ts) ELSE TIMESTAMP '2024-02-01' END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def sf9_digit_times(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(k == 1, F.date_format("ts", "yyyyMMdd")).otherwise("soon")
    at = T.digits_to_timestamp(text, F.lit("2024-02-01").cast("timestamp"))
    return rows_of(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("sf11_company_texts", r"""SELECT p_partkey AS id, list_aggregate(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title,
  trim(regexp_replace(replace(p_name, ' ', '') || 'Electronic' || 'Works', '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS spaced, left('One ' || p_name || '. Two! Three?', 12 + length(p_name) % 3 - 1) AS cut FROM part""".replace("left('One ' || p_name || '. Two! Three?', 12 + length(p_name) % 3 - 1) AS cut", "CASE WHEN length('One ' || p_name || '.  Two!') > 18 THEN trim(left('One ' || p_name || '.  Two!', 17)) || '…' ELSE 'One ' || p_name || '.  Two!' END AS cut"))
def sf11_company_texts(spark, sf_dir):
    p = rows_of(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), T.company_title(F.upper(F.concat_ws(" ", "p_name", "p_type"))).alias("title"), T.spaced_camel_case(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("ElectronicWorks"))).alias("spaced"),
        T.first_sentences(F.concat(F.lit("One "), "p_name", F.lit(". Two! Three?")), 2, 18).alias("cut"),
    )


@query("sf14_timelines", LEDGER + " SELECT ticker, count(*) AS n, sum(volume) AS volume FROM ledger GROUP BY 1")
def sf14_timelines(spark, sf_dir):
    point = F.struct(F.col("date").cast("string").alias("date"), F.col("volume").alias("value"))
    listed = D.ledger(spark, sf_dir).groupBy("ticker").agg(F.array_sort(F.collect_list(point)).alias("data"))  # a ticker's days
    json = F.to_json(F.struct(F.array(F.struct("data")).alias("timeline")))
    points = listed.select("ticker", F.explode(T.timeline_points(json)).alias("p"))
    return points.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("p.value").alias("volume"))


@query("sf15_company_matches", f"""WITH x AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 5 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN true WHEN 1 THEN a NOT IN ({quoted(V.COMPANY_STOP_WORDS)}) WHEN 2 THEN true WHEN 3 THEN false ELSE false END AS same FROM x""")
def sf15_company_matches(spark, sf_dir):
    """The name in full; a shorter title; a longer title of a company; of a song; and another name."""
    k = F.col("p_partkey") % 5
    title = F.when(k == 0, F.col("p_name")).when(k == 1, F.split("p_name", " ")[0]).when(k.isin(2, 3), F.concat("p_name", F.lit(" Extra"))).otherwise("Other Thing")
    about = F.when(k.isin(0, 1), F.lit(None)).when(k == 2, "American software maker").when(k == 3, "1999 song").otherwise("supplier of rings")
    about = F.when(k == 2, "American software and film provider").otherwise(about)
    return rows_of(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.is_company_match(F.concat("p_name", F.lit(", Inc.")), title, about).alias("same"))


@query("sf8_weekdays", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, list_reverse(list_sort(list_filter(list_transform(range(0, 14), lambda i: CAST(o_orderdate AS DATE) - i::INT), lambda d: isodow(d) <= 5)))[1:9]::VARCHAR[] AS days FROM orders")
def sf8_weekdays(spark, sf_dir):
    days = rows_of(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.select("date", F.transform(S.recent_weekdays(F.col("date"), 9), lambda d: d.cast("string")).alias("days"))
