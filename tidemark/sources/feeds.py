"""Landed feeds as DataFrames: files that a fetcher has put down, parsed by Spark.

`landed.read` and `landed.read_stream` read files; the functions here take rows with the raw text in
`value` and what tells one response from another in further columns, so they also serve as steps of a stream.
Items are (title, url, weight, published); values that can't be read give null, not an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.operators.discovery import rounded
from tidemark.operators.ledger import finite


def number(x: Column) -> Column:
    return finite(x.try_cast("double"))


def ticker_titles(responses: DataFrame) -> DataFrame:
    """(ticker, cik, title) of the official company list, a JSON object of records; cik with ten digits.

    Of several records of a ticker the largest cik holds.
    """
    record = "struct<cik_str: bigint, ticker: string, title: string>"
    each = responses.select(F.explode(F.map_values(F.from_json("value", f"map<string, {record}>"))).alias("r")).filter("r.cik_str IS NOT NULL AND r.ticker <> ''")
    rows = each.select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"), F.coalesce("r.title", F.lit("")).alias("title"))
    return rows.groupBy("ticker").agg(F.max(F.struct("cik", "title")).alias("r")).select("ticker", "r.*")


# --- delimited files ------------------------------------------------------------------


def short_volume(lines: DataFrame, min_ratio: float = 0.30, min_short: int = 50_000, limit: int = 200) -> DataFrame:
    """Events of the heaviest short sales of a day: (date, ticker, short, total, mentions, sentiment, relative_volume).

    lines: `date|symbol|short|exempt|total`; headings and broken lines drop out.
    """
    cell = lambda i: F.try_element_at(F.split("value", r"\|"), F.lit(i + 1))
    rows = lines.select(F.try_to_timestamp(cell(0), F.lit("yyyyMMdd")).cast("date").alias("date"), cell(1).alias("ticker"), number(cell(2)).alias("short"), number(cell(4)).alias("total"))
    ratio = F.col("short") / F.col("total")
    rows = rows.filter(T.is_possible_ticker(F.col("ticker")) & ~F.col("ticker").isin(*V.AMBIGUOUS_TICKERS) & (F.col("total") > 0) & F.col("short").isNotNull())
    best = rows.filter((ratio >= min_ratio) & (F.col("short") >= min_short)).orderBy(F.desc(F.col("short") * ratio), "ticker").limit(limit)
    return best.select(
        "date", "ticker", "short", "total", F.greatest(F.lit(1), rounded(ratio * 10 + F.log10(F.col("short") + 1))).alias("mentions"),
        F.when(ratio > 0.55, -0.1).otherwise(0.0).alias("sentiment"), (1 + F.least(F.lit(2.0), ratio)).alias("relative_volume"),
    )


def latest_day(events: DataFrame, today: Column, weekdays: int = 9) -> DataFrame:
    """Rows of the newest date among the last weekdays up to today, none if there is no such date."""
    age = F.datediff(today, "date")
    recent = events.filter((age >= 0) & (weekdays_between(F.col("date"), today) < weekdays) & ~F.dayofweek("date").isin(1, 7))
    return recent.join(recent.agg(F.max("date").alias("date")), "date", "left_semi")


def weekdays_between(first: Column, last: Column) -> Column:
    """Weekdays after `first`, up to `last`."""
    days = F.when(first < last, F.sequence(F.date_add(first, 1), last)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)))


def recent_weekdays(today: Column, n: int) -> Column:
    """The last n weekdays up to today, newest first."""
    days = F.sequence(today, F.date_sub(today, 2 * n + 4), F.expr("INTERVAL -1 DAY"))
    return F.slice(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, n)


def daily_quotes(lines: DataFrame, last_rows: int = 6) -> DataFrame:
    """(ticker, last_price, price_move, relative_volume, volume, as_of) from `date,open,high,low,close,volume` lines of each ticker.

    The move is of the last two closes; volume is compared with the mean of the rows before,
    `last_rows` at most.
    """
    cell = lambda i: F.try_element_at(F.split("value", ","), F.lit(i + 1))
    rows = lines.select("ticker", F.to_date(F.try_to_timestamp(cell(0), F.lit("yyyy-MM-dd"))).alias("date"), number(cell(4)).alias("close"), number(cell(5)).alias("volume")).filter("date IS NOT NULL AND close IS NOT NULL")
    recent = rows.withColumn("age", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))).filter(F.col("age") <= last_rows)
    at = lambda c, age: F.max(F.when(F.col("age") == age, F.col(c)))
    one = recent.groupBy("ticker").agg(
        at("close", 1).alias("last_price"), at("close", 2).alias("before"), F.max_by("volume", F.when(F.col("volume").isNotNull(), -F.col("age"))).alias("volume"),
        F.count("volume").alias("volumes"), F.sum("volume").alias("all_volume"), F.max("date").alias("as_of"),
    ).filter("before IS NOT NULL AND volumes > 0")
    return one.select("ticker", "last_price", *_moves(F.col("volume"), (F.col("all_volume") - F.col("volume")) / F.greatest(F.lit(1), F.col("volumes") - 1)), "volume", "as_of")


def _moves(volume: Column, average: Column) -> tuple[Column, Column]:
    move = F.try_divide((F.col("last_price") - F.col("before")) * 100, "before").alias("price_move")
    return move, F.when(average != 0, volume / average).otherwise(1.0).alias("relative_volume")


# --- JSON -----------------------------------------------------------------------------

_CHART = "chart struct<result: array<struct<meta: struct<symbol: string, regularMarketPrice: double, regularMarketTime: long, longName: string, shortName: string>, indicators: struct<quote: array<struct<close: array<double>, volume: array<double>>>>>>>"


def chart_quotes(responses: DataFrame) -> DataFrame:
    """(ticker, name, last_price, price_move, relative_volume, volume, as_of) from chart responses (ticker, value).

    None where the response is of another symbol or has under two closes or volumes.
    """
    r = F.from_json("value", _CHART)["chart"]["result"][0]
    quote = F.col("r.indicators.quote")[0]
    known = lambda a: F.filter(F.coalesce(a, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x))
    rows = responses.select("ticker", r.alias("r")).select("ticker", "r.meta", known(quote["close"]).alias("closes"), known(quote["volume"]).alias("volumes"))
    same = F.col("meta.symbol").isNull() | (F.upper("meta.symbol") == F.upper("ticker"))
    rows = rows.filter(same & (F.size("closes") >= 2) & (F.size("volumes") >= 2))
    last = F.coalesce(finite(F.col("meta.regularMarketPrice")), F.element_at("closes", -1))
    rows = rows.select("*", last.alias("last_price"), F.element_at("closes", -2).alias("before"), F.element_at("volumes", -1).alias("volume"))
    earlier = F.aggregate(F.slice("volumes", F.lit(1), F.size("volumes") - 1), F.lit(0.0), lambda a, x: a + x) / (F.size("volumes") - 1)
    name = F.coalesce("meta.longName", "meta.shortName", "meta.symbol", "ticker")
    return rows.select("ticker", name.alias("name"), "last_price", *_moves(F.col("volume"), earlier), "volume", F.timestamp_seconds("meta.regularMarketTime").alias("as_of"))


def reconciled_quotes(first: DataFrame, second: DataFrame, gap: float = 0.25) -> DataFrame:
    """(ticker, last_price, price_move, relative_volume, note): the first source's quote, the second's where their prices are `gap` apart or only it has one."""
    columns = ("last_price", "price_move", "relative_volume")
    a = first.select("ticker", F.struct(*columns).alias("a"))
    b = second.select("ticker", F.struct(*columns).alias("b"))
    far = F.coalesce(F.abs(F.col("a.last_price") - F.col("b.last_price")) / F.greatest(F.lit(0.01), F.col("b.last_price")) > gap, F.lit(False))
    chosen = F.when(F.col("a").isNull() | far, F.col("b")).otherwise(F.col("a"))
    note = F.when(far, F.concat(F.lit("mismatch "), F.format_string("%.2f", "a.last_price")))
    return a.join(b, "ticker", "full_outer").select("ticker", chosen.alias("q"), note.alias("note")).select("ticker", "q.*", "note")


_LISTING = "data struct<children: array<struct<data: struct<title: string, selftext: string, url_overridden_by_dest: string, permalink: string, score: double, num_comments: double, created_utc: double>>>>"


def forum_listing(responses: DataFrame, site: str = "") -> DataFrame:
    """Items of forum listings: title and body; weighted by score and comments."""
    x = responses.select(F.explode(F.from_json("value", _LISTING)["data"]["children"]).alias("c")).select("c.data.*")
    weight = F.greatest(F.lit(1.0), F.log10(F.coalesce("score", F.lit(0.0)) + 10) * 3 + F.coalesce("num_comments", F.lit(0.0)) / 40)
    title = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    return x.select(title.alias("title"), F.coalesce("url_overridden_by_dest", F.concat(F.lit(site), "permalink")).alias("url"), weight.alias("weight"), F.timestamp_seconds("created_utc").alias("published"))


def article_list(responses: DataFrame, limit: int = 80) -> DataFrame:
    """Items of article listings about the market: title, site and country; the first `limit` of a response in its order."""
    schema = "articles array<struct<title: string, url: string, domain: string, sourceCountry: string, seendate: string>>"
    x = responses.select("response", F.posexplode(F.from_json("value", schema)["articles"]).alias("seq", "a")).select("response", "seq", "a.*")
    title = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit("")), F.coalesce("sourceCountry", F.lit(""))))
    about = x.select("response", "seq", title.alias("title"), "url", F.lit(2.0).alias("weight"), T.digits_to_timestamp(F.col("seendate"), F.lit(None).cast("timestamp")).alias("published")).filter(T.has_market_context(F.col("title")))
    return about.withColumn("n", F.row_number().over(W.partitionBy("response").orderBy("seq"))).filter(F.col("n") <= limit).drop("n", "seq")


def trending(responses: DataFrame) -> DataFrame:
    """(response, ticker, name, rank, mentions): 5 mentions for the head of a trending list down to 1 at its end."""
    symbols = F.from_json("value", "symbols array<struct<symbol: string, title: string>>")["symbols"]
    rows = responses.select("response", symbols.alias("s")).select("response", F.size("s").alias("n"), F.posexplode("s").alias("i", "s"))
    ticker = F.upper("s.symbol")
    weight = F.greatest(F.lit(1), rounded((F.col("n") - F.col("i")) / F.col("n") * 5))
    return rows.select("response", ticker.alias("ticker"), F.coalesce("s.title", ticker).alias("name"), (F.col("i") + 1).alias("rank"), weight.alias("mentions")).filter(T.is_possible_ticker(F.col("ticker")))


def stream_messages(responses: DataFrame, first: int = 8) -> DataFrame:
    """(ticker, seq, title, sentiment): the first messages of each ticker's stream (ticker, value), by their author's tag."""
    schema = "messages array<struct<body: string, entities: struct<sentiment: struct<basic: string>>>>"
    rows = responses.select("ticker", F.posexplode(F.slice(F.from_json("value", schema)["messages"], 1, first)).alias("seq", "m"))
    tag = F.col("m.entities.sentiment.basic")
    sentiment = F.when(tag == "Bullish", 0.3).when(tag == "Bearish", -0.3).otherwise(0.0)
    return rows.select("ticker", "seq", F.substring(F.coalesce("m.body", F.concat("ticker", F.lit(" chatter"))), 1, 240).alias("title"), sentiment.alias("sentiment"))


def mention_counts(responses: DataFrame) -> DataFrame:
    """(ticker, mentions, rising): counts of an aggregator, on a log scale; rising null without an earlier count."""
    schema = "results array<struct<ticker: string, mentions: double, mentions_24h_ago: double>>"
    rows = responses.select(F.explode(F.from_json("value", schema)["results"]).alias("r")).select(F.upper("r.ticker").alias("ticker"), F.col("r.mentions").alias("n"), F.col("r.mentions_24h_ago").alias("before"))
    rows = rows.filter(T.is_possible_ticker(F.col("ticker")) & (F.col("n") > 0))
    return rows.select("ticker", F.greatest(F.lit(1), rounded(F.log10(F.col("n") + 1) * 3)).alias("mentions"), F.when(F.col("before") > 0, F.col("n") > F.col("before")).alias("rising"))


def comment_mentions(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, ticker): comments found for a ticker (key, ticker, text) that do mention it.

    By cashtag, by the first telling word of the company's name, or by the bare symbol where
    it has four characters or more and is no common word. Ambiguous tickers have none.
    """
    clean = T.company_for_search(F.col("name"))
    telling = F.filter(F.split(clean, " "), lambda w: (F.length(w) >= 4) & ~T.is_common_word(w))
    words = registry.select("ticker", F.when(F.upper(clean) != F.col("ticker"), F.lower(F.try_element_at(telling, F.lit(1)))).alias("word"))
    text = T.clean_markup(F.col("text"))
    bare = (F.length("ticker") >= 4) & ~T.is_common_word(F.col("ticker"))
    rows = hits.select("key", "ticker", text.alias("text")).join(words, "ticker").filter(~F.col("ticker").isin(*V.AMBIGUOUS_TICKERS))
    tagged = F.regexp_like(F.col("text"), F.concat(F.lit(r"(?i)\$"), "ticker", F.lit(r"(?![A-Za-z0-9_])")))
    worded = F.regexp_like(F.col("text"), F.concat(F.lit("(^|[^A-Za-z0-9])"), "ticker", F.lit("([^A-Za-z0-9]|$)")))
    return rows.filter(tagged | F.coalesce(F.contains(F.lower("text"), F.col("word")), F.lit(False)) | (bare & worded)).select("key", "ticker").distinct()


def board_catalog(responses: DataFrame) -> DataFrame:
    """(no, text, weight): threads of a board's catalog, weighted by replies, 5 at most."""
    rows = responses.select(F.explode(F.from_json("value", "array<struct<threads: array<struct<no: long, sub: string, com: string, replies: double>>>>")).alias("p")).select(F.explode("p.threads").alias("t")).select("t.*")
    text = T.clean_markup(F.concat(F.coalesce("sub", F.lit("")), F.lit(" "), F.coalesce("com", F.lit(""))))
    return rows.select("no", text.alias("text"), F.least(F.lit(5), 1 + rounded(F.coalesce("replies", F.lit(0.0)) / 40)).alias("weight")).filter("text <> ''")


# --- RSS and Atom ---------------------------------------------------------------------


def feed_items(responses: DataFrame, weight: float = 2.0, content: bool = False, min_title: int = 0) -> DataFrame:
    """(response, seq, title, url, weight, published) of each item or entry of feeds (response, value).

    Titles fall back to summaries (and contents); links to their href, then to the feed's own.
    """
    blocks = F.regexp_extract_all("value", F.lit(r"(?is)<(item|entry)(?![A-Za-z0-9_]).*?</\1>"), F.lit(0))
    rows = responses.select("response", F.posexplode(blocks).alias("seq", "x"))

    def some(*found: Column) -> Column:
        """The first that isn't empty, each computed once and only if it is reached."""
        return T.once(found[0], lambda f: F.when(f != "", f).otherwise(some(*found[1:]))) if found else F.lit("")

    first = lambda *found: T.clean_markup(some(*found))
    inside = lambda tag: T.text_between(F.col("x"), tag)
    title = first(inside("title"), inside("summary"), *([inside("content")] if content else []))
    url = first(inside("link"), T.attr_between(F.col("x"), "link", "href"), F.col("response").cast("string"))
    item = F.struct(title.alias("title"), url.alias("url"), F.lit(weight).alias("weight"), first(inside("published"), inside("updated"), inside("pubDate")).alias("published"))
    items = rows.select("response", "seq", F.explode(F.array(item)).alias("i")).select("response", "seq", "i.*")  # exploded: a filter would compute titles again
    return items.filter(F.length("title") > min_title) if min_title else items


def forum_feed_items(responses: DataFrame) -> DataFrame:
    return feed_items(responses, 1.5, content=True, min_title=5)


def title_key(title: Column, length: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(title), r"\s+", " ")), 1, length)


def swept_wires(items: DataFrame, min_title: int = 12, key_length: int = 120) -> DataFrame:
    """Items of several wires (wire, seq, title, ...), each headline once: from the first wire and place that has it."""
    rows = items.filter(F.length("title") >= min_title).withColumn("title_key", title_key(F.col("title"), key_length))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("title_key").orderBy("wire", "seq"))).filter("n = 1").drop("n", "title_key")


def first_source(frames: Sequence[DataFrame], key: str = "ticker") -> DataFrame:
    """For each key the rows of the first frame that has any."""
    whole, covered = frames[0], frames[0].select(key)
    for f in frames[1:]:
        whole = whole.unionByName(f.join(covered, key, "left_anti"))
        covered = covered.union(f.select(key))
    return whole


def discovery_items(items: DataFrame, first: int = 12, limit: int = 100, weight: float = 2.5) -> DataFrame:
    """The first items of each search (job, seq, title, url) that are about the market, each title and url once, `limit` in all."""
    rows = items.withColumn("place", F.row_number().over(W.partitionBy("job").orderBy("seq"))).filter((F.col("place") <= first) & T.has_market_context(F.col("title")))
    once = rows.withColumn("n", F.row_number().over(W.partitionBy("title", "url").orderBy("job", "seq"))).filter("n = 1")
    return once.orderBy("job", "seq").limit(limit).select("job", "seq", "title", "url", F.lit(weight).alias("weight"))


# --- lookups --------------------------------------------------------------------------


def price_history(rows: DataFrame, keep: int = 400) -> DataFrame:
    """(ticker, date, close, volume): days with a finite close, the newest `keep` of each ticker."""
    known = rows.select("ticker", "date", finite(F.col("close")).alias("close"), finite(F.col("volume")).alias("volume")).filter("close IS NOT NULL")
    return known.withColumn("age", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))).filter(F.col("age") <= keep).drop("age")


def pageviews(responses: DataFrame) -> DataFrame:
    """(article, date, views) from view counts (article, value) with 10-digit stamps."""
    items = F.from_json("value", "items array<struct<timestamp: string, views: double>>")["items"]
    rows = responses.select("article", F.explode(items).alias("i"))
    return rows.select("article", F.try_to_timestamp(F.substring("i.timestamp", 1, 8), F.lit("yyyyMMdd")).cast("date").alias("date"), F.col("i.views").alias("views")).filter("date IS NOT NULL")


def latest_filed(facts: DataFrame, key: str = "ticker", value: str = "value", filed: str = "filed") -> DataFrame:
    """(key, value): the value filed last, the larger one of the same day."""
    return facts.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(filed, value)).alias(value))


def quarter_counts(filings: DataFrame, today: Column, quarters: int = 8) -> DataFrame:
    """(phrase, year, quarter, n): filings of the trailing quarters up to today's, quarters without any included."""
    at = lambda d: F.year(d) * 4 + F.quarter(d) - 1
    counts = filings.withColumn("q", at(F.col("date"))).groupBy("phrase", "q").agg(F.count("*").alias("n"))
    spine = filings.select("phrase").distinct().select("phrase", F.explode(F.sequence(at(today) - (quarters - 1), at(today))).alias("q"))
    rows = spine.join(counts, ["phrase", "q"], "left")
    return rows.select("phrase", F.floor(F.col("q") / 4).cast("int").alias("year"), (F.col("q") % 4 + 1).cast("int").alias("quarter"), F.coalesce("n", F.lit(0)).alias("n"))


def clean_wikitext(text: Column) -> Column:
    linked = F.regexp_replace(F.regexp_replace(text, r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]]+)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(linked, r"\{\{[^}]*\}\}", ""), "'''", ""))


def industry_table(pages: DataFrame) -> DataFrame:
    """(ticker, name, sector, sub, cik) from the first table of a page's wikitext (value), rows with sector and sub only."""
    table = F.regexp_extract("value", r'(?s)(\{\| class="wikitable.*?)(?:\n\|\}|$)', 1)
    behind = lambda a: F.slice(a, F.lit(2), F.greatest(F.lit(0), F.size(a) - 1))
    rows = pages.select(F.explode(behind(F.split(table, r"\n\|-\n"))).alias("row"))
    lines = F.filter(F.split("row", "\n"), lambda x: x != "")
    symbol = F.regexp_extract(lines[0], r"Symbol\|([A-Z.\-]+)", 1)
    cells = F.split(F.array_join(behind(lines), " "), r"\|\|")
    at = lambda i: F.nullif(clean_wikitext(F.regexp_replace(F.try_element_at(F.col("cells"), F.lit(i + 1)), r"^\|", "")), F.lit(""))
    parsed = rows.select(F.replace(symbol, F.lit("."), F.lit("-")).alias("ticker"), cells.alias("cells")).filter("ticker <> ''")
    return parsed.select("ticker", F.coalesce(at(0), "ticker").alias("name"), at(1).alias("sector"), at(2).alias("sub"), at(5).alias("cik")).filter("sector IS NOT NULL AND sub IS NOT NULL")


def summarised_failures(failures: DataFrame, limit: int = 20) -> DataFrame:
    """(seq, n, line): failures (seq, message) that differ by the ticker only as one counted line, in order of first sight."""
    key = F.regexp_replace(F.col("message"), r"^(.*?) [A-Z][A-Z0-9.-]{0,6}:", "$1 <ticker>:")
    groups = failures.groupBy(key.alias("message")).agg(F.count("*").alias("n"), F.min("seq").alias("seq")).orderBy("seq").limit(limit)
    return groups.select("seq", "n", F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("x "), "message")).otherwise(F.col("message")).alias("line"))
