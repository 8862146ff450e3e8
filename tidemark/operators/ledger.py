"""Daily ledger folds. A ledger has one row for each (ticker, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.session import dealt

NUMBERS = ("mentions", "close", "volume", "wiki")


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def share_of_voice(ledger: DataFrame) -> DataFrame:
    """Adds share_of_voice: a ticker's part of its day's mentions, six places; 0 without any.

    The day totals are one small row a day, joined back rather than windowed: a day is not a
    partition that should hold all tickers.
    """
    totals = ledger.groupBy("date").agg(F.sum("mentions").alias("day_mentions"))
    share = F.coalesce(F.try_divide("mentions", "day_mentions"), F.lit(0.0))
    return ledger.join(totals, "date").withColumn("share_of_voice", F.round(share, 6)).drop("day_mentions")


def newest(ledger: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` rows of each ticker."""
    age = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    return ledger.withColumn("age", age).filter(F.col("age") <= keep).drop("age")


def upsert(ledger: DataFrame, batch: DataFrame, keep: int = 400, merge: bool = False) -> DataFrame:
    """Batch rows in place of ledger rows of the same ticker and date; the newest `keep` rows of each ticker stay.

    merge: values that the batch lacks are taken from the row it replaces.
    """
    keys = ["ticker", "date"]
    new = batch.select(*keys, *(F.col(c).alias(f"new_{c}") for c in NUMBERS), F.lit(True).alias("new"))
    value = lambda c: F.coalesce(f"new_{c}", c) if merge else F.when(F.col("new"), F.col(f"new_{c}")).otherwise(F.col(c))
    merged = dealt(ledger, "ticker").join(dealt(new, "ticker"), keys, "full_outer").select(*keys, *(value(c).alias(c) for c in NUMBERS))
    return newest(dealt(merged, "ticker"), keep)


def merge_backfill(ledger: DataFrame, late: DataFrame, keep: int = 400) -> DataFrame:
    """Late closes and volumes fill what is missing or not finite on existing days; other days come in with no mentions."""
    keys = ["ticker", "date"]
    late = late.select(*keys, F.col("close").alias("late_close"), F.col("volume").alias("late_volume"))
    filled = ledger.join(late, keys, "full_outer").select(
        *keys, F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce(finite(F.col("close")), "late_close").alias("close"),
        F.coalesce(finite(F.col("volume")), "late_volume").alias("volume"), "wiki",
    )
    return newest(filled, keep)


def merge_pageviews(ledger: DataFrame, views: DataFrame) -> DataFrame:
    """New views (ticker, date, views) over old ones; days that the ledger lacks are ignored."""
    return ledger.join(views, ["ticker", "date"], "left").withColumn("wiki", F.coalesce("views", "wiki")).drop("views")


def carry_forward(ledger: DataFrame, column: str = "close", out: str = "close_locf") -> DataFrame:
    """Last known value of a column up to each day."""
    return ledger.withColumn(out, F.last(finite(F.col(column)), ignorenulls=True).over(W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))


def stale(ledger: DataFrame, protected: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Tickers to prune: not protected, and last mentioned (else first seen) before the cutoff."""
    seen = F.coalesce(F.max(F.when(F.col("mentions") > 0, F.col("date"))), F.min("date"))
    last = ledger.groupBy("ticker").agg(seen.alias("last_seen"))
    return last.filter(F.col("last_seen") < F.date_sub(today, days)).join(protected.select("ticker"), "ticker", "left_anti")


def run(ledger: DataFrame, meta: DataFrame, events: DataFrame, registry: DataFrame, signals: DataFrame, protected: DataFrame, today: Column, days: int = 90, keep: int = 400) -> tuple[DataFrame, DataFrame]:
    """A refresh from its events: the new ledger (ticker, date, mentions, share_of_voice, close, volume, wiki) and meta (ticker, name, sector, sub, article, first_seen).

    Every ticker with events or in the ledger gets today's row: its mentions and their share of all, the last
    finite price told by Price/Volume with its volume, else the close of its newest day and no volume. A row of today
    is replaced, the newest `keep` stay, and unprotected tickers without mentions for `days` days go.
    Meta comes from the signal, else the registry, else what was known; first_seen is today for new tickers.
    events: (seq, ticker, source, mentions, last_price, volume); those without a ticker don't count, null mentions are 0.
    registry: (ticker, name, sector, industry, article); signals: (ticker, name, sector, industry, description_url).
    Without any event nothing changes.
    """
    columns = ["ticker", "date", "mentions", "share_of_voice", "close", "volume", "wiki"]
    if events.isEmpty():
        return ledger.select(*columns), meta
    told = events.filter(F.coalesce(F.col("ticker").cast("string"), F.lit("")) != "")
    price = finite(F.col("last_price"))
    quote = F.when((F.col("source") == "Price/Volume") & price.isNotNull(), F.struct("seq", price.alias("close"), finite(F.col("volume")).alias("volume")))
    active = told.groupBy("ticker").agg(F.sum(F.coalesce("mentions", F.lit(0))).alias("new_mentions"), F.max(quote).alias("quote"))
    total = active.agg(F.sum("new_mentions").alias("total"))
    newest_day = ledger.groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"))
    rows = newest_day.withColumn("old", F.lit(True)).join(active, "ticker", "full_outer").join(F.broadcast(total), F.lit(True))  # total is one row
    mentions = F.coalesce("new_mentions", F.lit(0))
    share = F.when(F.col("total") > 0, F.round(mentions / F.col("total"), 6)).otherwise(0.0)
    now = rows.select(
        "ticker", today.alias("date"), mentions.alias("mentions"), share.alias("share_of_voice"), F.coalesce("quote.close", "last_close").alias("close"),
        F.col("quote.volume").alias("volume"), F.lit(None).cast("double").alias("wiki"),
    )
    before = ledger.filter(F.col("date") != today).select(*columns)
    whole = newest(before.unionByName(now), keep)
    gone = stale(whole, protected, today, days).select("ticker")
    new = rows.select("ticker", F.when(F.col("old").isNull(), today).alias("seen"))
    said = lambda c: F.when(F.trim(c) != "", F.col(c))
    listed = registry.select("ticker", F.lit(True).alias("listed"), *(said(c).alias(f"listed_{c}") for c in ("name", "sector", "industry", "article")))
    shown = signals.select("ticker", *(said(c).alias(f"shown_{c}") for c in ("name", "sector", "industry")), T.article_of(F.col("description_url")).alias("shown_article"))
    known = new.join(listed, "ticker", "left").join(shown, "ticker", "left").join(meta, "ticker", "left")
    fresh = lambda c, old: F.coalesce(F.when(F.col("listed").isNotNull(), F.col(f"shown_{c}")), f"listed_{c}", old)
    after = known.select("ticker", fresh("name", "name").alias("name"), fresh("sector", "sector").alias("sector"), fresh("industry", "sub").alias("sub"), fresh("article", "article").alias("article"), F.coalesce("first_seen", "seen").alias("first_seen"))
    return whole.join(gone, "ticker", "left_anti"), after.join(gone, "ticker", "left_anti")
