"""States, events on their changes, forward grading, ordered unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blooms

HORIZONS = (30, 90, 180, 365)


def changes(previous: DataFrame, current: DataFrame, key: str = "ticker", state: str = "state") -> DataFrame:
    """(key, was, now) of the rows whose state differs from the previous one, new ones included."""
    was = previous.select(key, F.col(state).alias("was"))
    return current.select(key, F.col(state).alias("now")).join(was, key, "left").filter(~F.col("was").eqNullSafe(F.col("now")))


def spring_events(previous: DataFrame, current: DataFrame, hot: DataFrame) -> DataFrame:
    """Alerts on state changes: released high; coiled high, for hot tickers only; dead normal."""
    rows = changes(previous, current).join(hot.select("ticker", F.lit(True).alias("hot")), "ticker", "left")
    level = F.when(F.col("now") == "released", "high").when((F.col("now") == "coiled") & F.col("hot"), "high").when(F.col("now") == "dead", "normal")
    return rows.select("ticker", "was", "now", level.alias("priority")).filter("priority IS NOT NULL")


def theme_events(previous: DataFrame, current: DataFrame, mute: Sequence[str] = ("insufficient-data", "quiet")) -> DataFrame:
    """Alerts on stage changes of themes seen before; high for diffusion and decay."""
    rows = changes(previous, current, "theme", "stage").filter(F.col("was").isNotNull() & ~F.col("now").isin(*mute))
    return rows.withColumn("priority", F.when(F.col("now").isin("diffusion", "decay"), "high").otherwise("normal"))


def since(history: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, state, since): start of the current unbroken state in (key, date, state)."""
    order = W.partitionBy(key).orderBy("date")
    starts = history.withColumn("before", F.lag("state").over(order)).withColumn("last", F.last("state").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    new = ~F.col("state").eqNullSafe(F.col("before"))
    return starts.groupBy(key).agg(F.max_by("state", "date").alias("state"), F.max(F.when(new, F.col("date"))).alias("since"))


def weekly(events: DataFrame, week: Column, keep: int, *key: str) -> DataFrame:
    """Counts of each key by week, of the newest `keep` weeks."""
    counts = events.withColumn("week", week).groupBy("week", *key).agg(F.count("*").alias("n"))
    newest = counts.select("week").distinct().orderBy(F.desc("week")).limit(keep)
    return counts.join(F.broadcast(newest), "week")  # keep rows


def acceleration(history: DataFrame, week: str, ratio: float = 2.0, weeks: int = 4, novel: int = 3) -> DataFrame:
    """(phrase, n, novel, accelerating) of one week of (week, phrase, n), against the others."""
    others = history.filter(F.col("week") != week)
    recent = others.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
    size = recent.agg(F.count("*").alias("weeks"))
    all_time = others.groupBy("phrase").agg(F.sum("n").alias("before"))
    late = others.join(F.broadcast(recent), "week").groupBy("phrase").agg(F.sum("n").alias("late"))  # weeks rows
    now = history.filter(F.col("week") == week).select("phrase", "n").join(all_time, "phrase", "left").join(late, "phrase", "left").join(F.broadcast(size), F.lit(True))  # one row
    mean = F.coalesce(F.try_divide(F.coalesce("late", F.lit(0)), F.col("weeks")), F.lit(0.0))
    return now.select("phrase", "n", (F.coalesce("before", F.lit(0)) <= novel).alias("novel"), F.when(mean == 0, F.col("n") > 0).otherwise(F.col("n") >= ratio * mean).alias("accelerating"))


def filtered_acceleration(found: DataFrame, history: DataFrame, filters: DataFrame, week: str, blocks: int, ratio: float = 2.0, weeks: int = 4, novel: int = 3) -> DataFrame:
    """acceleration's rows for the phrases found (phrase, n) in a week, by way of Bloom filters.

    history: (week, phrase, n); filters: (week, block, bits) of each of its weeks. A phrase that no filter holds is new;
    of the history only what a filter of the other phrases holds is aggregated and joined. What seems
    to be repeated and isn't comes out of that join without a match, so the rows are exact.
    """
    others = filters.filter(F.col("week") != week)
    recent = others.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
    size = recent.agg(F.count("*").alias("weeks"))
    asked = blooms.marked(found.select("phrase", "n"), "phrase", blooms.merged(others), blocks)
    repeats = blooms.build(asked.filter("maybe"), "phrase", blocks)
    past = blooms.marked(history.filter(F.col("week") != week), "phrase", repeats, blocks).filter("maybe")
    late = past.join(F.broadcast(recent.withColumn("late", F.lit(True))), "week", "left")  # weeks rows
    known = late.groupBy("phrase").agg(F.sum("n").alias("before"), F.sum(F.when(F.col("late"), F.col("n"))).alias("late"))
    rows = asked.filter("maybe").select("phrase", "n").join(known, "phrase", "left").join(F.broadcast(size), F.lit(True))  # one row
    mean = F.coalesce(F.try_divide(F.coalesce("late", F.lit(0)), F.col("weeks")), F.lit(0.0))
    seen = rows.select("phrase", "n", (F.coalesce("before", F.lit(0)) <= novel).alias("novel"), F.when(mean == 0, F.col("n") > 0).otherwise(F.col("n") >= ratio * mean).alias("accelerating"))
    new = asked.filter(~F.col("maybe")).select("phrase", "n", F.lit(True).alias("novel"), (F.col("n") > 0).alias("accelerating"))
    return seen.unionByName(new)


def nearest_close(probes: DataFrame, ledger: DataFrame, tolerance: int = 5) -> DataFrame:
    """probes with near_date and near_close: the known close nearest in time, ties to the earlier day; null beyond tolerance.

    Time is cut into blocks of 2 * tolerance + 1 days. The distinct days asked for go into their block,
    closes into the one or two that they can be near to; in a block both are sorted together, once,
    and the last and the next close carried along. So what is shuffled doesn't depend on the
    tolerance, and neither many probes of a ticker nor a long history make one large task.
    probes: (id, ticker, date).
    """
    size = 2 * tolerance + 1
    block = lambda day: F.floor(day / size)
    day = F.unix_date("date")
    asked = probes.select("ticker", "date").distinct().select("ticker", block(day).alias("block"), day.alias("day"), F.lit(None).cast("double").alias("close"), F.lit(True).alias("asked"))
    known = ledger.filter(F.col("close").isNotNull()).select("ticker", F.explode(F.array_distinct(F.array(block(day - tolerance), block(day + tolerance)))).alias("block"), day.alias("day"), F.col("close").cast("double").alias("close"), F.lit(False).alias("asked"))
    here = F.when(~F.col("asked"), F.struct("day", "close"))
    order = W.partitionBy("ticker", "block").orderBy("day", "asked")  # at most a few days and a close for each
    before = F.last(here, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    both = known.unionByName(asked).withColumns({"before": before, "after": after}).filter("asked")
    far = lambda c: F.abs(F.col(c)["day"] - F.col("day"))
    near = F.when(far("after") < F.coalesce(far("before"), F.lit(tolerance + 1)), F.col("after")).otherwise(F.col("before"))
    hits = both.withColumn("near", near).filter(F.abs(F.col("near")["day"] - F.col("day")) <= tolerance)
    hits = hits.select("ticker", F.date_from_unix_date("day").alias("date"), F.date_from_unix_date("near.day").alias("near_date"), F.col("near.close").alias("near_close"))
    return probes.join(hits, ["ticker", "date"], "left").select(*probes.columns, "near_date", "near_close")


def grade(events: DataFrame, ledger: DataFrame, today: Column, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(id, horizon, ret) of every horizon that can be reached by today; ret null where no close is near."""
    due = events.select("id", "ticker", "base_price", "date", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    due = due.withColumn("target", F.date_add("date", F.col("horizon"))).filter(F.col("target") <= today)
    probes = due.select(F.concat_ws(":", "id", "horizon").alias("id"), "ticker", F.col("target").alias("date"), F.col("id").alias("event"), "horizon", "base_price")
    near = nearest_close(probes.select("id", "ticker", "date"), ledger)
    return probes.join(near.select("id", "near_close"), "id").select(F.col("event").alias("id"), "horizon", (F.try_divide("near_close", F.when(F.col("base_price") > 0, F.col("base_price"))) - 1).alias("ret"))


def calibration(events: DataFrame, grades: DataFrame) -> DataFrame:
    """(type, horizon, graded, win_rate, median) over the known returns."""
    known = events.select("id", "type").join(grades, "id").filter("ret IS NOT NULL")
    return known.groupBy("type", "horizon").agg(F.count("*").alias("graded"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.percentile("ret", 0.5).alias("median"))


def ordered_union(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of frames, the first frame's row of each key winning."""
    numbered = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)]
    whole = numbered[0]
    for f in numbered[1:]:
        whole = whole.unionByName(f)
    best = F.row_number().over(W.partitionBy(key).orderBy("priority", *[c for c in frames[0].columns if c != key]))
    return whole.withColumn("place", best).filter("place = 1").drop("place", "priority")


def latest_expiry(frames: DataFrame) -> DataFrame:
    """(ticker, reason, expires): the latest expiry of each ticker, ties to the first in seq."""
    return frames.groupBy("ticker").agg(F.max_by("reason", F.struct("expires", -F.col("seq"))).alias("reason"), F.max("expires").alias("expires"))


def registry(*memberships: DataFrame) -> DataFrame:
    """(theme, ticker, src): union of memberships (theme, ticker, src), with where each comes from."""
    whole = memberships[0].select("theme", "ticker", "src", F.lit(0).alias("place"))
    for i, m in enumerate(memberships[1:], 1):
        whole = whole.unionByName(m.select("theme", "ticker", "src", F.lit(i).alias("place")))
    from_ = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place", "src"))), lambda x: x["src"]), "+")
    return whole.groupBy("theme", "ticker").agg(from_.alias("src"))
