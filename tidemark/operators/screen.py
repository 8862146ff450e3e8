"""Filters, ranges, tiers and short texts of a board; trends of series."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V

from .board import capped_volume, fixed, peer_score, total
from .ledger import finite


def cap_tier(cap: Column, large: float = 5e8) -> Column:
    """large or small by market cap; null where it is unknown or not positive."""
    return F.when(cap >= large, "large").when(cap > 0, "small")


def attention_group(attention: Column, volume: Column, threshold: Column, busy: float = 1.3) -> Column:
    """attention from the threshold on, quiet below it on raised volume, else null."""
    return F.when((attention > 0) & (attention >= threshold), "attention").when((volume >= busy) & (attention < threshold), "quiet")


def range_totals(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """(ticker, mentions, before): totals of the days start..end and of the equally long range before; null where absent.

    One aggregation over both ranges, so the events are read and shuffled once.
    """
    day = F.col("ts").cast("date")
    length = F.datediff(end, start) + 1
    inside = events.filter((day >= F.date_sub(start, length)) & (day <= end))
    now = F.when(day >= start, F.col("mentions"))
    return inside.groupBy("ticker").agg(F.sum(now).alias("mentions"), F.sum(F.when(day < start, F.col("mentions"))).alias("before"))


def running_totals(events: DataFrame) -> DataFrame:
    """(ticker, source, day, until, mentions, known): totals up to the end of each day with events; they hold until before `until`, null: from then on.

    known counts the events whose mentions aren't null. A day's events are one row before the window runs, so a
    window holds a row for each day of a ticker and source, however many events there are.
    """
    daily = events.filter("ts IS NOT NULL").groupBy("ticker", "source", F.col("ts").cast("date").alias("day")).agg(F.sum("mentions").alias("mentions"), F.count("mentions").alias("known"))
    order = W.partitionBy("ticker", "source").orderBy("day")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return daily.select("ticker", "source", "day", F.lead("day").over(order).alias("until"), F.sum("mentions").over(upto).alias("mentions"), F.sum("known").over(upto).alias("known"))


def totals_of_ranges(running: DataFrame, ranges: DataFrame, sources: Sequence[str] | None = None, most: int = 100_000) -> DataFrame:
    """(range_id, ticker, mentions, before) for each of ranges (range_id, start, end): range_totals of them all, from running totals read once.

    A total is the difference of two lookups: up to the range's end and up to the day before its start; the equally
    long range before takes one more. Ranges go along with the tasks as one list, so more than
    `most` of them raise ValueError: they are to be asked for in parts. Rows are those with known mentions in either range.
    """
    if ranges.count() > most:
        raise ValueError(f"more than {most} ranges: ask for them in parts")
    length = F.datediff("end", "start") + 1
    edge = lambda day, now, then: F.struct(day.alias("at"), F.col("range_id"), F.lit(now).alias("now"), F.lit(then).alias("then"))
    edges = ranges.filter(F.col("start") <= F.col("end")).select(F.explode(F.array(edge(F.col("end"), 1, 0), edge(F.date_sub("start", 1), -1, 1), edge(F.date_sub("start", length + 1), 0, -1))).alias("e"))
    asked = edges.agg(F.collect_list("e").alias("edges"))
    rows = running if sources is None else running.filter(F.col("source").isin(*sources))
    holds = lambda e: (e["at"] >= F.col("day")) & (F.col("until").isNull() | (e["at"] < F.col("until")))
    looked = rows.join(F.broadcast(asked), F.lit(True)).select("ticker", "mentions", "known", F.explode(F.filter("edges", holds)).alias("e"))  # one row of at most 3 * most edges
    part = lambda c, side: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col(f"e.{side}"))
    sums = looked.groupBy("e.range_id", "ticker").agg(*(part(c, side).alias(f"{c}_{side}") for c in ("mentions", "known") for side in ("now", "then")))
    shown = lambda side: F.when(F.col(f"known_{side}") > 0, F.col(f"mentions_{side}"))
    return sums.filter("known_now > 0 OR known_then > 0").select("range_id", "ticker", shown("now").alias("mentions"), shown("then").alias("before"))


def filtered_board(board: DataFrame, chosen: Sequence[str], search: str, of: int) -> DataFrame:
    """The board over the chosen sources only: mentions of those, none dropped to zero, searched, scored against its peers."""
    rows = board.withColumn("mentions", total(chosen)).filter("mentions > 0").filter(F.contains(F.upper(F.col("ticker").cast("string")), F.lit(search.upper())))
    return peer_score(rows, chosen, of)


def blocked_sources(sources: DataFrame, failures: DataFrame) -> DataFrame:
    """(source, blocked, first) of sources: whether a failure (seq, message) names one before its colon, and the first message that starts with it.

    A message is cut at its colon and at its spaces before it, so sources join by equality.
    """
    head = F.trim(F.regexp_extract("message", "^([^:]+):", 1))
    words = F.split(head, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    named = failures.select("seq", "message", head.alias("head"), F.explode(prefixes).alias("source")).filter("source <> ''")
    found = named.groupBy("source").agg(F.bool_or(F.col("source") == F.col("head")).alias("blocked"), F.min_by("message", "seq").alias("first"))
    blocked = F.coalesce("blocked", F.lit(False))
    return sources.select("source").join(found, "source", "left").select("source", blocked.alias("blocked"), F.when(blocked, F.col("first")).alias("first"))


def buy_candidates(board: DataFrame, k: int = 4, least_score: int = 20, least_mentions: int = 2) -> DataFrame:
    """Best k of the eligible rows; rows neither crowded nor cooling only, if there are k of those."""
    fit = board.filter((F.col("setup_score") >= least_score) & (F.col("mentions") >= least_mentions))
    late = F.col("stage").isin("Crowded", "Cooling")
    calm = fit.agg(F.count_if(~late).alias("calm"))
    chosen = fit.join(F.broadcast(calm), F.lit(True)).filter((F.col("calm") < k) | ~late)  # calm is one row
    return chosen.orderBy(F.desc("setup_score"), "ticker").limit(k).drop("calm")


def volume_ratio(points: DataFrame, column: str, recent: int = 90, least: int = 30, confirmed: float = 2.0) -> DataFrame:
    """(ticker, ratio, confirmed): mean of the newest `recent` points over that of the others; null under `least` points or without others."""
    age = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    x, new = finite(F.col(column).cast("double")), F.col("age") <= recent
    means = points.withColumn("age", age).groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(F.when(new, x)).alias("late"), F.avg(F.when(~new, x)).alias("early")
    )
    ratio = F.when(F.col("n") >= least, F.col("late") / F.when(F.col("early") == 0, 0.0001).otherwise(F.col("early")))
    return means.select("ticker", ratio.alias("ratio")).withColumn("confirmed", F.col("ratio") >= confirmed)


def quarter_acceleration(quarters: DataFrame, least: int = 10, ratio: float = 2.0) -> DataFrame:
    """(ticker, ratio, confirmed, basis) of each ticker's latest quarter of (ticker, year, quarter, n).

    On the year before where that quarter is known; else the last three must rise. Null under two quarters.
    """
    order = W.partitionBy("ticker").orderBy("year", "quarter")
    rows = quarters.withColumns({"b1": F.lag("n", 1).over(order), "b2": F.lag("n", 2).over(order), "age": F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("year"), F.desc("quarter")))})
    year_ago = quarters.select("ticker", (F.col("year") + 1).alias("year"), "quarter", F.col("n").alias("then"))
    last = rows.filter("age = 1 AND b1 IS NOT NULL").join(year_ago, ["ticker", "year", "quarter"], "left")
    yearly = F.col("then") > 0
    grown = F.try_divide(F.col("n").cast("double"), F.col("then"))
    rising = F.coalesce((F.col("n") > F.col("b1")) & (F.col("b1") > F.col("b2")), F.lit(False))
    return last.select(
        "ticker", F.when(yearly, grown).alias("ratio"), F.when(yearly, (F.col("n") >= least) & (grown >= ratio)).otherwise(rising).alias("confirmed"),
        F.when(yearly, "year").otherwise("trend").alias("basis"),
    )


def phrase_score(timeline: Column, confirmed: Column, quarterly: Column) -> Column:
    """Language score 0 to 1 of a timeline ratio and of a confirmed quarterly one."""
    filings = F.when(confirmed, F.when(quarterly.isNotNull(), F.least(F.lit(1.0), quarterly / 4)).otherwise(0.75)).otherwise(0.0)
    return (F.least(F.lit(1.0), F.coalesce(timeline, F.lit(0.0)) / 4) + filings) / 2


def trend(series: DataFrame, column: str = "mentions") -> DataFrame:
    """(ticker, points, first, last, change): of (ticker, date, column); change in percent, null on a zero start."""
    both = series.groupBy("ticker").agg(F.count("*").alias("points"), F.min_by(column, "date").alias("first"), F.max_by(column, "date").alias("last"))
    return both.withColumn("change", F.try_divide((F.col("last") - F.col("first")) * 100.0, F.nullif(F.col("first"), F.lit(0))))


def replace_days(history: DataFrame, batch: DataFrame, key: str = "date", keep: int = 120) -> DataFrame:
    """history without the batch's days, and the batch; the newest `keep` days stay."""
    rows = history.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)
    newest = rows.select(key).distinct().orderBy(F.desc(key)).limit(keep)
    return rows.join(F.broadcast(newest), key, "left_semi")  # keep rows


def signed(x: Column) -> Column:
    """One decimal with its sign, halves up; null where x is."""
    return F.when(x.isNotNull(), F.format_string("%+.1f", F.floor(x * 10 + 0.5) / F.lit(10.0)))


def quarter_range(date: Column) -> tuple[Column, Column]:
    """First and last day of the date's quarter."""
    first = F.trunc(date, "quarter")
    return first, F.date_sub(F.add_months(first, 3), 1)


def relative_time(at: Column, now: Column) -> Column:
    """Minutes, hours or days ago."""
    minutes = F.greatest(F.lit(0), F.timestamp_diff("MINUTE", at, now)).cast("long")
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def trend_text(volume: Column, move: Column, social: Column, news: Column, active: Column, score: Column, sector: Column | None = None, busy: float = 1.3, up: float = 3.0, strong: float = 10.0, talk: int = 3, hits: int = 4, platforms: int = 4) -> Column:
    """What moves a ticker, in a sentence: a quiet mover first, else its lead and magnitudes, else its composite signal.

    social and news are mentions, active the number of sources with any.
    """
    said, one = V.TREND_TEXT, lambda x: fixed(x, 1)
    loud, up_now = F.coalesce(volume >= busy, F.lit(False)), F.coalesce(move >= up, F.lit(False))
    crowd, covered = social >= talk, news >= hits
    plural = lambda n, word: F.when(n == 1, word).otherwise(word + "s")
    part = lambda key, **values: F.concat(*(values[x] if x in values else F.lit(x) for x in re.split(r"\{(\w+)\}", said[key])))
    quiet = part("quiet", volume=one(volume), price=F.when(up_now, part("quiet_price", move=one(move))).otherwise(""))
    parts = F.array_compact(F.array(
        F.when(up_now, part("move", strong=F.when(move >= strong, said["strong"]).otherwise(""), move=one(move))), F.when(loud, part("volume", volume=one(volume))),
        F.when(crowd, part("social", n=grouped_digits(social), word=plural(social, said["mention"]))), F.when(covered, part("news", n=grouped_digits(news), word=plural(news, said["hit"]))),
        F.when(active >= platforms, part("platforms", n=active.cast("string"))), F.lit(None).cast("string") if sector is None else F.nullif(sector, F.lit("")),
    ))
    lead = F.when((social >= news) & crowd, said["by_social"]).when(covered, said["by_news"]).when(up_now | loud, said["by_price"]).otherwise(said["by_many"])
    composite = part("composite", score=fixed(score, 0), n=active.cast("string"), word=plural(active, said["source"]))
    return F.when(loud & ~crowd & ~covered, quiet).when(F.size(parts) == 0, composite).otherwise(F.concat(lead, F.lit(": "), F.array_join(parts, said["joint"]), F.lit(".")))


def range_signals(daily: DataFrame, before: DataFrame, sources: Sequence[str], of: int, limit: int = 75) -> DataFrame:
    """Signals of several days taken together, the best `limit` by peer score.

    daily: (generated, ticker, mentions, sentiment, price_move, relative_volume, last_price,
    from_ each source), one row a ticker and snapshot; before: (ticker, mentions) of an earlier
    range. Means are weighted by mentions, the price is the latest known one; momentum is null
    for a ticker new to the board and 0 where there is no earlier range at all.
    """
    mean = lambda x, default: F.coalesce(F.try_divide(F.sum(x * F.col("mentions")), F.sum("mentions")), F.lit(default))
    price = finite(F.col("last_price"))
    rows = daily.groupBy("ticker").agg(
        F.sum("mentions").alias("mentions"), mean(F.coalesce("sentiment", F.lit(0.0)), 0.0).alias("sentiment"), mean(F.coalesce("price_move", F.lit(0.0)), 0.0).alias("price_move"),
        mean(capped_volume(F.col("relative_volume")), 1.0).alias("relative_volume"), F.max_by(price, F.when(price.isNotNull(), F.col("generated"))).alias("last_price"),
        *(F.sum(f"from_{s}").alias(f"from_{s}") for s in sources),
    )
    earlier = before.groupBy("ticker").agg(F.sum("mentions").alias("before"))
    had = before.limit(1).agg((F.count("*") > 0).alias("had"))
    change = F.when(F.coalesce("before", F.lit(0)) > 0, (F.col("mentions") - F.col("before")) * 100.0 / F.col("before")).when(~F.col("had"), 0.0)
    both = rows.join(earlier, "ticker", "left").join(F.broadcast(had), F.lit(True)).withColumn("momentum", change).drop("before", "had")  # had is one row
    return peer_score(both, sources, of).orderBy(F.desc("peer_score"), "ticker").limit(limit)


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def grouped_digits(x: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(x, 0)


def cap_label(cap: Column) -> Column:
    """Market cap as $1.23T, $4.5B, $6M; n/a where it is unknown or not positive."""
    scaled = lambda unit, places: F.format_string(f"$%.{places}f", F.floor(cap / unit * 10**places + 0.5) / F.lit(10.0**places))
    text = F.when(cap >= 1e12, F.concat(scaled(1e12, 2), F.lit("T"))).when(cap >= 1e9, F.concat(scaled(1e9, 1), F.lit("B")))
    return F.when(cap > 0, text.otherwise(F.concat(scaled(1e6, 0), F.lit("M")))).otherwise("n/a")


def move_text(move: Column) -> Column:
    """Price move in percent with its sign, n/a where it is unknown."""
    return F.coalesce(F.concat(signed(finite(move)), F.lit("%")), F.lit("n/a"))


def days_ago(today: Column, days: int) -> Column:
    return F.date_sub(today, days)


def is_reachable(date: Column, days: int, today: Column) -> Column:
    """Whether a horizon of days after a date has come."""
    return F.date_add(date, days) <= today


def snapshots(history: DataFrame, current: DataFrame) -> DataFrame:
    """The history, or the current snapshot where there is none."""
    had = history.limit(1).agg((F.count("*") > 0).alias("had"))
    return history.unionByName(current.join(F.broadcast(had), F.lit(True)).filter("NOT had").drop("had"))  # one row


def closes(ledger: DataFrame) -> DataFrame:
    """(ticker, closes): each ticker's closes in order of date."""
    packed = ledger.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("days"))  # a ticker's kept days
    return packed.select("ticker", F.transform("days", lambda d: d["close"]).alias("closes"))
