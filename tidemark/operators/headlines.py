"""Headlines of tickers: order, the one to show, evidence, the market-news feed.

Items are (seq, ticker, source, title, url, published).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.sources.feeds import title_key


def ranked(items: DataFrame, keep: int | None = 6) -> DataFrame:
    """items with quality and rank: best quality first, then the newest; `keep` of each ticker, or all."""
    rows = items.withColumn("quality", T.headline_quality(F.col("title")))
    order = W.partitionBy("ticker").orderBy(F.desc("quality"), F.desc_nulls_last("published"), "seq")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= keep) if keep else out


def top_headline(items: DataFrame, news: Sequence[str] = V.NEWS_SOURCES) -> DataFrame:
    """(ticker, seq, title, is_news): the best news article, else a post of quality 2 or more."""
    is_news = F.col("source").isin(*news)
    fit = items.withColumn("quality", T.headline_quality(F.col("title"))).withColumn("is_news", is_news).filter((F.col("is_news") & (F.col("quality") >= 1)) | (F.col("quality") >= 2))
    order = F.struct(~F.col("is_news"), -F.col("quality"), -F.unix_micros(F.col("published").cast("timestamp")), "seq")
    return fit.groupBy("ticker").agg(F.min_by(F.struct("seq", "title", "is_news"), order).alias("t")).select("ticker", "t.*")


def evidence(items: DataFrame, top: DataFrame, keep: int = 5) -> DataFrame:
    """(ticker, seq, place): the first headlines in rank order whose title is not that of the top headline."""
    rows = ranked(items).filter("title <> ''").join(top.select("ticker", F.col("title").alias("top_title")), "ticker", "left").filter(~F.col("title").eqNullSafe(F.col("top_title")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("ticker").orderBy("rank"))).filter(F.col("place") <= keep).select("ticker", "seq", "place")


def market_news(items: DataFrame, quotes: DataFrame, limit: int = 14, min_move: float = 1.5, min_title: int = 12, sources: Sequence[str] = V.FRONT_NEWS_SOURCES) -> DataFrame:
    """(ticker, seq, title, coverage, price_move, impact): news of tickers that moved, by impact.

    quotes: (ticker, price_move, relative_volume). A story counts once for each title; the one
    shown has an impact word if any has, and is the newest of those.
    """
    moved = quotes.filter(F.abs("price_move") >= min_move).select("ticker", "price_move", F.when(F.coalesce("relative_volume", F.lit(0.0)) == 0, 1.0).otherwise(F.col("relative_volume")).alias("relative_volume"))
    rows = items.filter(F.col("source").isin(*sources)).withColumn("title", F.trim("title")).filter(F.length("title") >= min_title).join(moved.select("ticker"), "ticker", "left_semi")
    once = rows.withColumn("title_key", title_key(F.col("title"), 90)).groupBy("ticker", "title_key").agg(F.min_by(F.struct("seq", "title", "published"), "seq").alias("s")).select("ticker", "s.*")
    order = F.struct(~F.col("title").rlike(T.words_pattern(V.IMPACT, True)), -F.unix_micros(F.col("published").cast("timestamp")), "seq")
    best = once.groupBy("ticker").agg(F.min_by(F.struct("seq", "title"), order).alias("s"), F.count("*").alias("coverage"))
    impact = F.abs("price_move") + F.col("coverage") * 3 + F.greatest(F.lit(0.0), F.col("relative_volume") - 1) * 3
    return best.join(moved, "ticker").select("ticker", "s.seq", F.substring("s.title", 1, 200).alias("title"), "coverage", "price_move", impact.alias("impact")).orderBy(F.desc("impact"), "ticker").limit(limit)


def news_feed(published: DataFrame, derived: DataFrame, limit: int = 8) -> DataFrame:
    """The published feed (place, ticker, title, price_move, ...) without marketing, `limit` rows; the derived one where that leaves none."""
    kept = published.filter((F.col("title") != "") & ~T.is_solicitation(F.col("title")) & F.col("price_move").isNotNull()).orderBy("place").limit(limit)
    has = kept.limit(1).agg((F.count("*") > 0).alias("has"))
    return kept.unionByName(derived.join(F.broadcast(has), F.lit(True)).filter("NOT has").drop("has"), allowMissingColumns=True)  # has is one row


def derived_feed(items: DataFrame, board: DataFrame, limit: int = 8, min_move: float = 1.5, sources: Sequence[str] = V.FRONT_NEWS_SOURCES) -> DataFrame:
    """(place, ticker, title, price_move) from a board (ticker, price_move, relative_volume): moved tickers with news, by move, stories and volume."""
    told = items.filter(F.col("source").isin(*sources) & (F.col("title") != "") & ~T.is_solicitation(F.col("title")))
    newest = told.groupBy("ticker").agg(F.max_by("title", F.struct("published", -F.col("seq"))).alias("title"), F.max_by("source", F.struct("published", -F.col("seq"))).alias("source"), F.count("*").alias("stories"))
    rows = newest.join(board.filter(F.abs("price_move") >= min_move).select("ticker", "price_move", "relative_volume"), "ticker")
    weight = F.abs("price_move") + F.col("stories") * 5 + F.greatest(F.lit(0.0), F.col("relative_volume") - 1) * 4
    best = rows.withColumn("weight", weight).orderBy(F.desc("weight"), "ticker").limit(limit)
    return best.select(F.row_number().over(W.orderBy(F.desc("weight"), "ticker")).alias("place"), "ticker", T.news_title(F.col("source"), F.col("title")).alias("title"), "price_move")  # limit rows


def is_stale(generated: Column, now: Column, hours: int = 36) -> Column:
    """Whether a snapshot is over `hours` old; one without a time is."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(generated) > hours * 3_600_000_000, F.lit(True))


def is_throttled(failures: Column, sources: Sequence[str] = V.FRONT_NEWS_SOURCES) -> Column:
    """Whether any failure text names a news source and a throttling status."""
    return F.exists(failures, lambda f: f.rlike(T.either(sources)) & f.rlike(r"(?i)(?<![A-Za-z0-9_])(429|403|throttl)"))
