"""Phrases of headlines: counts by week, shortlists, confirmation, themes.

History is (week, phrase, n). Extracted phrases are (phrase, n, domains, tickers).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.session import shared_dir

from . import screen as C
from . import state as S

#: Buckets of a summary: 65536 numbers, half a megabyte a task.
BUCKETS = 1 << 16


def extracted(items: DataFrame, sources: Sequence[str] | None = V.NEWS_SOURCES) -> DataFrame:
    """(phrase, n, domains, tickers) of items (source, ticker, title, url): headlines with a phrase, their hosts (else sources), their tickers."""
    return counted(grams(items, sources))


def grams(items: DataFrame, sources: Sequence[str] | None = V.NEWS_SOURCES) -> DataFrame:
    """(ticker, domain, phrase): a row for each phrase of a headline."""
    told = items.filter(F.coalesce(F.col("title"), F.lit("")) != "")
    if sources is not None:
        told = told.filter(F.col("source").isin(*sources))
    worded = told.select("ticker", T.host_of(F.col("url"), F.coalesce("source", F.lit("unknown"))).alias("domain"), T.tokens(F.col("title")).alias("words"))
    return worded.select("ticker", "domain", F.explode(T.ngrams(F.col("words"))).alias("phrase"))


def counted(grams: DataFrame) -> DataFrame:
    return grams.groupBy("phrase").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"), F.countDistinct("ticker").alias("tickers"))


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, total) of (phrase, n): a summary of at most `buckets` rows. No phrase has more than its bucket's total; totals of parts add up."""
    return rows.groupBy(_bucket(buckets).alias("bucket")).agg(F.sum("n").alias("total"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("phrase"), F.lit(buckets)).cast("int")


def most_frequent(items: DataFrame, k: int, sources: Sequence[str] | None = V.NEWS_SOURCES, fit: Callable[[DataFrame], DataFrame] | None = None, earlier: DataFrame | None = None, buckets: int = BUCKETS, step: int = 4) -> DataFrame:
    """The first k rows of `extracted`, of those that `fit` keeps, by falling n and phrase.

    Phrases are first counted by bucket, so a task hands on `buckets` numbers at most, whatever its headlines say.
    Only phrases of buckets that reach a bound are then counted by themselves; once k rows reach it none of the
    others can come before them. The bound starts at half the k-th largest total and falls by `step`
    until then, or to 1, where all phrases are counted: at once where half of all rows are in the buckets
    already. `fit` may add to n what `earlier` (phrase, n) holds, and no more; it gets counts that are
    written once a round, as it may read them several times.
    """
    shared_dir(items.sparkSession)  # checkpoints need a folder
    every = grams(items, sources)
    weights = every.select("phrase", F.lit(1).cast("long").alias("n"))
    totals = bucket_totals(weights if earlier is None else weights.unionByName(earlier.select("phrase", "n")), buckets).checkpoint()
    largest = totals.orderBy(F.desc("total")).limit(k).agg(F.min("total")).first()[0]
    bound = max((largest or 0) // 2, 1)
    over = lambda least: F.sum(F.when(F.col("total") >= least, F.col("total")))
    while True:
        heavy = totals.filter(F.col("total") >= bound).select("bucket")
        rows = counted(every.withColumn("bucket", _bucket(buckets)).join(F.broadcast(heavy), "bucket", "left_semi"))  # `buckets` numbers at most
        rows = rows if fit is None else fit(rows.checkpoint())
        found = rows.filter(F.col("n") >= bound).orderBy(F.desc("n"), "phrase").limit(k).checkpoint()  # k rows
        if bound == 1 or found.count() == k:
            return found
        many = totals.agg(F.coalesce(over(bound), F.lit(0)) * 2 >= F.sum("total")).first()[0]
        bound = 1 if many else max(bound // step, 1)


def merged(history: DataFrame, found: DataFrame, week: str, keep: int, *key: str) -> DataFrame:
    """History with counts (key, n) added to a week's, the newest `keep` weeks of it."""
    whole = history.select("week", *key, "n").unionByName(found.select(F.lit(week).alias("week"), *key, "n"))
    newest = whole.select("week").distinct().orderBy(F.desc("week")).limit(keep)
    return whole.join(F.broadcast(newest), "week").groupBy("week", *key).agg(F.sum("n").alias("n"))  # keep rows


def shortlist(history: DataFrame, found: DataFrame, week: str, limit: int = 40, min_domains: int = 2, keep: int = 56) -> DataFrame:
    """(phrase, n, domains, tickers): novel and accelerating phrases of the week, of several hosts, the most frequent first."""
    rows = accelerating(history, found, week, min_domains, keep)
    return rows.orderBy(F.desc("n"), "phrase").limit(limit)


def accelerating(history: DataFrame, found: DataFrame, week: str, min_domains: int = 2, keep: int = 56) -> DataFrame:
    """(phrase, n, domains, tickers): all that a shortlist chooses from."""
    whole = merged(history, found, week, keep, "phrase")
    fit = S.acceleration(whole, week).filter("novel AND accelerating").select("phrase", F.col("n"))
    rows = found.filter(F.col("domains") >= min_domains).drop("n").join(fit, "phrase")
    return rows.select("phrase", "n", "domains", "tickers")


def frequent_shortlist(history: DataFrame, items: DataFrame, week: str, limit: int = 40, min_domains: int = 2, keep: int = 56, sources: Sequence[str] | None = V.NEWS_SOURCES, buckets: int = BUCKETS) -> DataFrame:
    """shortlist of the week's items, without counting every phrase of them: see most_frequent."""
    now = history.filter(F.col("week") == week).groupBy("phrase").agg(F.sum("n").alias("n"))
    return most_frequent(items, limit, sources, lambda found: accelerating(history, found, week, min_domains, keep), now, buckets)


def confirmed(candidates: DataFrame, timelines: DataFrame, quarters: DataFrame, cache: DataFrame, today: Column, daily: int = 5, weekly: int = 8, max_age: int = 30) -> DataFrame:
    """(phrase, n, ratio, news, filings, confirmed): candidates confirmed by news volume and by filings.

    Of the candidates in order, the first `daily` with a timeline (ticker names the phrase) and
    the first `weekly` with quarter counts are assessed; other news ratios come from the cache
    (phrase, ratio, confirmed, checked) where they are at most max_age days old.
    """
    order = F.struct((-F.col("n")).alias("n"), "phrase")

    def first(rows: DataFrame, k: int) -> DataFrame:
        return candidates.select("phrase", "n").join(rows.select("phrase").distinct(), "phrase", "left_semi").orderBy(order).limit(k).select("phrase")

    news = C.volume_ratio(timelines.withColumnRenamed("phrase", "ticker"), "value").select(F.col("ticker").alias("phrase"), F.col("ratio").alias("fresh"), F.col("confirmed").alias("fresh_news")).filter("fresh IS NOT NULL")
    news = news.join(first(news, daily), "phrase", "left_semi")
    filed = C.quarter_acceleration(quarters.withColumnRenamed("phrase", "ticker")).select(F.col("ticker").alias("phrase"), F.col("confirmed").alias("filings"))
    filed = filed.join(first(filed, weekly), "phrase", "left_semi")
    old = cache.filter(F.datediff(today, "checked") <= max_age).select("phrase", F.col("ratio").alias("old"), F.col("confirmed").alias("old_news"))
    rows = candidates.join(news, "phrase", "left").join(old, "phrase", "left").join(filed, "phrase", "left")
    both = rows.select("phrase", "n", F.coalesce("fresh", "old").alias("ratio"), F.when(F.col("fresh").isNotNull(), F.col("fresh_news")).otherwise(F.col("old_news")).alias("news"), "filings")
    return both.withColumn("confirmed", F.coalesce(F.col("news") & F.col("filings"), F.lit(False)))


def theme_phrases(phrases: DataFrame, themes: DataFrame, limit: int = 40) -> DataFrame:
    """(theme, phrase): for each theme of (theme, phrase) the first confirmed phrase that holds one of its phrases or is held by one.

    phrases: (phrase, n), a shortlist of `limit` rows at most: it goes along as one array.
    """
    listed = phrases.orderBy(F.desc("n"), "phrase").limit(limit).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "phrase"))).alias("confirmed"))
    rows = themes.select("theme", F.lower("phrase").alias("own")).join(F.broadcast(listed), F.lit(True))  # listed is one row
    hits = rows.select("theme", F.explode(F.filter("confirmed", lambda c: F.contains(c["phrase"], F.col("own")) | F.contains(F.col("own"), c["phrase"]))).alias("c"))
    return hits.groupBy("theme").agg(F.min("c").alias("c")).select("theme", "c.phrase")
