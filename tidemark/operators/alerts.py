"""Alerts on state changes, their log and grades, leaders with an expiry, protected tickers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V
from tidemark.session import kept

from . import graph as G
from . import state as S
from .ledger import finite

TITLES = {"release": "released", "new-coil-hot-theme": "coiling in a hot theme", "dead-coil": "coil demoted", "proof-quarter": "proof quarter"}
TAGS = {"release": "rocket", "new-coil-hot-theme": "coil,fire", "dead-coil": "skull", "theme-stage-transition": "chart_with_upwards_trend", "proof-quarter": "loudspeaker", "weekly-digest": "calendar"}


def digest(themes: DataFrame, springs: DataFrame, top: int = 5) -> DataFrame:
    """(themes array<struct<heat, theme, stage>>, coiled, released, dead): one row for a week."""
    best = themes.filter("heat IS NOT NULL").orderBy(F.desc("heat"), "theme").limit(top)
    listed = best.agg(F.sort_array(F.collect_list(F.struct("heat", (-F.col("theme")).alias("order"), "theme", "stage")), asc=False).alias("t"))  # top rows
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return springs.agg(count("coiled"), count("released"), count("dead")).join(listed, F.lit(True)).select(F.transform("t", lambda t: F.struct(t["theme"].alias("theme"), t["stage"].alias("stage"), t["heat"].alias("heat"))).alias("themes"), "coiled", "released", "dead")


def spring_alerts(previous: DataFrame, current: DataFrame, hot: DataFrame) -> DataFrame:
    """(type, priority, subject) of state changes."""
    kind = F.when(F.col("now") == "released", "release").when(F.col("now") == "coiled", "new-coil-hot-theme").otherwise("dead-coil")
    return S.spring_events(previous, current, hot).select(kind.alias("type"), "priority", F.col("ticker").cast("string").alias("subject"))


def theme_alerts(previous: DataFrame, current: DataFrame) -> DataFrame:
    rows = S.theme_events(previous, current)
    return rows.select(F.lit("theme-stage-transition").alias("type"), "priority", F.concat_ws(" > ", F.col("theme").cast("string"), "now").alias("subject"))


def messages(alerts: DataFrame) -> DataFrame:
    """alerts with the title and tags of a notification."""
    ends = F.lit(None)
    tags = F.lit("bell")
    for kind, end in TITLES.items():
        ends = F.when(F.col("type") == kind, F.concat("subject", F.lit(" " + end))).otherwise(ends)
    for kind, tag in TAGS.items():
        tags = F.when(F.col("type") == kind, tag).otherwise(tags)
    title = F.when(F.col("type") == "theme-stage-transition", F.concat(F.lit("theme "), "subject")).when(F.col("type") == "weekly-digest", "weekly digest").otherwise(F.coalesce(ends, F.lit("alert")))
    return alerts.withColumn("title", title).withColumn("tags", tags)


def alert_log(log: DataFrame, new: DataFrame, week: str, keep: int = 200) -> DataFrame:
    """The newest `keep` of new alerts (date, type, priority, subject) and the log; a week's digest only once."""
    had = log.filter((F.col("type") == "weekly-digest") & (T.iso_week(F.col("date")) == week)).select("type").distinct()
    fresh = new.join(had, "type", "left_anti")
    return fresh.unionByName(log).orderBy(F.desc("date"), "type", "subject").limit(keep)


def commit(previous: DataFrame, current: DataFrame, key: str, state: str = "state") -> DataFrame:
    """State table after a run: the current rows replace the table; keys that are gone go."""
    return current.select(key, state)


def days_in_state(previous: DataFrame, current: DataFrame, date: Column, key: str = "ticker") -> DataFrame:
    """(key, state, since, days) after a run: since is kept while the state is unchanged."""
    was = previous.select(key, F.col("state").alias("was"), F.col("since").alias("was_since"))
    since = F.when(F.col("state").eqNullSafe(F.col("was")), F.coalesce("was_since", date)).otherwise(date)
    return current.select(key, "state").join(was, key, "left").select(key, "state", since.alias("since"), F.datediff(date, since).alias("days"))


def basket_returns(probes: DataFrame, members: DataFrame, ledger: DataFrame, bench: DataFrame) -> DataFrame:
    """(id, ret): mean member return less the benchmark's between two days of (id, theme, from_date, to_date).

    Closes are the nearest known; null where the benchmark or all members lack one. Only the days
    that are near to one asked for are read of the ledger.
    """
    asked = probes.select(F.explode(F.array("from_date", "to_date")).alias("date")).distinct()
    near_days = asked.select(F.explode(F.sequence(F.date_sub("date", 5), F.date_add("date", 5))).alias("date")).distinct()
    ledger = ledger.join(F.broadcast(near_days), "date", "left_semi")  # days of the calendar
    ends = lambda d: d.select("id", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from_date").alias("date")), F.struct(F.lit("to").alias("end"), F.col("to_date").alias("date")))).alias("e"), *[c for c in d.columns if c in ("ticker",)]).select("*", "e.*").drop("e")
    pairs = probes.join(members.select("theme", "ticker"), "theme")
    one = pairs.select(F.concat_ws(":", "id", "ticker").alias("probe"), "id", "ticker", "from_date", "to_date")

    def returns(rows: DataFrame, closes: DataFrame) -> DataFrame:
        """(probe, ret) of (probe, ticker, from_date, to_date)."""
        days = ends(rows.select(F.col("probe").alias("id"), "ticker", "from_date", "to_date"))
        near = S.nearest_close(days.select(F.concat_ws("|", "id", "end").alias("id"), "ticker", "date"), closes)
        both = near.select(F.substring_index("id", "|", 1).alias("probe"), F.substring_index("id", "|", -1).alias("end"), "near_close")
        at = lambda end: F.max(F.when(F.col("end") == end, F.col("near_close")))
        pair = both.groupBy("probe").agg(at("from").alias("a"), at("to").alias("b"))
        return pair.select("probe", (F.try_divide("b", F.when(F.col("a") > 0, F.col("a"))) - 1).alias("ret"))

    market = returns(probes.select(F.col("id").alias("probe"), F.lit(0).alias("ticker"), "from_date", "to_date"), bench.withColumn("ticker", F.lit(0)))
    mean = one.select("probe", "id").join(returns(one, ledger), "probe").groupBy("id").agg(F.avg("ret").alias("mean"))
    return probes.select("id").join(mean, "id", "left").join(market.withColumnRenamed("probe", "id"), "id", "left").select("id", (F.col("mean") - F.col("ret")).alias("ret"))


def updated_log(log: DataFrame, grades: DataFrame, new: DataFrame, ledger: DataFrame, members: DataFrame, bench: DataFrame, today: Column, horizons: Sequence[int] = S.HORIZONS, keep: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Log (id, type, ticker, theme, date, base_price) and grades (id, horizon, ret) after a run.

    New entries come in by id once. Each horizon that can be reached and has no grade gets one;
    a null grade stays as it is. Over `keep` entries the oldest fully graded ones go. Entries and given
    grades are read several times, so they are written to the shared folder first.
    """
    entries = kept(log.unionByName(new.join(log.select("id"), "id", "left_anti").dropDuplicates(["id"])), "entries")
    grades = kept(grades, "grades")
    due = entries.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target", F.date_add("date", F.col("horizon"))).filter(F.col("target") <= today)
    due = due.join(grades.select("id", "horizon"), ["id", "horizon"], "left_anti").withColumn("probe", F.concat_ws("#", "id", "horizon"))
    single = due.filter("ticker IS NOT NULL")
    near = S.nearest_close(single.select(F.col("probe").alias("id"), "ticker", F.col("target").alias("date")), ledger).select(F.col("id").alias("probe"), "near_close")
    own = single.join(near, "probe").select("id", "horizon", (F.try_divide("near_close", F.when(F.col("base_price") > 0, F.col("base_price"))) - 1).alias("ret"))
    grouped = due.filter("ticker IS NULL AND theme IS NOT NULL").select(F.col("probe").alias("id"), "theme", F.col("date").alias("from_date"), F.col("target").alias("to_date"))
    basket = basket_returns(grouped, members, ledger, bench).select(F.substring_index("id", "#", 1).alias("id"), F.substring_index("id", "#", -1).cast("int").alias("horizon"), "ret")
    graded = grades.unionByName(own).unionByName(basket)
    full = graded.groupBy("id").agg((F.countDistinct("horizon") == len(horizons)).alias("full"))
    excess = entries.count() - keep
    if excess > 0:
        entries = entries.join(entries.join(full.filter("full"), "id").orderBy("date", "id").limit(excess).select("id"), "id", "left_anti")
    return entries, graded.join(entries.select("id"), "id", "left_semi")


def log_entries(springs: DataFrame, themes: DataFrame, ledger: DataFrame, date: Column) -> DataFrame:
    """(id, type, ticker, theme, stage, date, base_price): a run's events that can be graded, with ids that a second run gives again.

    springs: (type, ticker), of which releases and dead coils with a known last close count;
    themes: (type, theme, stage), the transitions with a stage.
    """
    last = ledger.groupBy("ticker").agg(finite(F.max_by("close", "date")).alias("base_price")).filter("base_price IS NOT NULL")
    own = springs.filter(F.col("type").isin("release", "dead-coil")).select("type", "ticker").join(last, "ticker")
    theme, stage = F.col("theme").cast("string"), F.nullif(F.col("stage"), F.lit(""))
    moved = themes.filter((F.col("type") == "theme-stage-transition") & stage.isNotNull())
    none = lambda c, df: F.lit(None).cast(dict(df.dtypes)[c]).alias(c)
    return own.select(
        F.concat_ws("-", "type", F.col("ticker").cast("string"), date.cast("string")).alias("id"), "type", "ticker", none("theme", themes), none("stage", themes), date.alias("date"), "base_price"
    ).unionByName(moved.select(
        F.concat_ws("-", F.lit("theme-stage"), theme, stage, date.cast("string")).alias("id"), F.lit("theme-stage").alias("type"), none("ticker", springs), "theme", "stage", date.alias("date"), F.lit(None).cast("double").alias("base_price")
    ))


def pending(log: DataFrame, grades: DataFrame, horizons: int = len(S.HORIZONS)) -> DataFrame:
    """Entries of the log with a horizon not yet graded."""
    full = grades.groupBy("id").agg(F.countDistinct("horizon").alias("n")).filter(F.col("n") >= horizons)
    return log.join(full, "id", "left_anti")


def protected(members: DataFrame, springs: DataFrame, leaders: DataFrame, open_entries: DataFrame) -> DataFrame:
    """Tickers never pruned: theme members, live coils, leaders with their followers, entries not fully graded."""
    live = springs.filter(F.col("state").isin("coiled", "released")).select("ticker")
    led = F.concat(F.array("ticker"), F.coalesce("followers", F.array().cast(dict(leaders.dtypes)["followers"])))
    tickers = members.select("ticker").union(live).union(leaders.select(F.explode(led).alias("ticker"))).union(open_entries.filter("ticker IS NOT NULL").select("ticker"))
    return tickers.distinct()


def proof_headlines(days: DataFrame, headlines: DataFrame) -> DataFrame:
    """days (ticker, ...) with headline, the first one by seq with a word of earnings news; days without one drop out."""
    hits = headlines.filter(F.col("title").rlike(T.words_pattern(V.EARNINGS, True)))
    first = hits.groupBy("ticker").agg(F.substring(F.min_by("title", "seq"), 1, 200).alias("headline"))
    return days.join(first, "ticker")


def followers(tickers: DataFrame | None, industries: DataFrame, edges: DataFrame, siblings: int = 15, neighbors: int = 8) -> DataFrame:
    """(ticker, followers) of tickers, or of all where none are given: the first others of the industry by ticker, and the heaviest co-mentions."""
    others = industries.select("sub", F.col("ticker").alias("other"))
    first = others.withColumn("n", F.row_number().over(W.partitionBy("sub").orderBy("other"))).filter(F.col("n") <= siblings + 1)  # the ticker itself, if among them, is left out
    own = industries.select("ticker", "sub")
    near = (own if tickers is None else tickers.select("ticker").join(own, "ticker")).join(first, "sub").filter("ticker <> other")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("ticker").orderBy("other"))).filter(F.col("n") <= siblings).select("ticker", "other")
    linked = G.top_neighbors(edges, neighbors, tickers).select("ticker", F.col("neighbor").alias("other"))
    return near.unionByName(linked).groupBy("ticker").agg(F.array_sort(F.collect_set("other")).alias("followers"))


def leaders(active: DataFrame, triggers: DataFrame, industries: DataFrame, edges: DataFrame, date: Column, ttl: int = 182, siblings: int = 15, neighbors: int = 8) -> DataFrame:
    """(ticker, detected, expires, headline, followers): leaders that haven't expired, and new ones that are not yet leaders.

    followers: the first others of the industry by ticker, and the heaviest co-mentions.
    """
    live = active.filter(F.col("expires") >= date)
    new = triggers.join(live.select("ticker"), "ticker", "left_anti")
    found = followers(new, industries, edges, siblings, neighbors)
    fresh = new.join(found, "ticker", "left").select("ticker", date.alias("detected"), F.date_add(date, ttl).alias("expires"), "headline", F.coalesce("followers", F.array().cast(dict(live.dtypes)["followers"])).alias("followers"))
    return live.select("ticker", "detected", "expires", "headline", "followers").unionByName(fresh)


def hot_monitor(led: DataFrame) -> DataFrame:
    """(ticker, reason, expires): followers of leaders with their latest expiry, ties to the earlier leader."""
    rows = led.select(F.explode("followers").alias("ticker"), F.col("ticker").alias("reason"), "expires")
    return rows.groupBy("ticker").agg(F.min_by("reason", F.struct((-F.unix_date("expires")).alias("late"), "reason")).alias("reason"), F.max("expires").alias("expires"))
