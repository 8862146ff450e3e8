"""Rolling statistics of each ticker's series, ordered by date.

The ledger is aggregated to a row for each ticker and day, so a window partition holds the
days of one ticker and stays small however many events a ticker has. Trailing medians and
ranks of long windows run through pandas, in time that grows with the logarithm of the window:
Spark's own frames count a window anew for every row. A call takes the tickers of one bucket,
as calls cost more than the days of one ticker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import dealt, file_bytes

from .ledger import finite

#: Bytes of files for a bucket of tickers: about 10,000 ledger rows.
BUCKET_BYTES = 128 << 10


def by_date() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("date")


def trailing(rows: int) -> WindowSpec:
    """The current row and those before it, `rows` in all."""
    return by_date().rowsBetween(1 - rows, 0)


def prior(rows: int) -> WindowSpec:
    """The `rows` rows before the current one."""
    return by_date().rowsBetween(-rows, -1)


def bucketed(df: DataFrame) -> DataFrame:
    """df with _bucket, partitioned by it: some tickers each, as many buckets as the files behind df ask for; one a ticker where there are none.

    Rows without a ticker have a bucket of their own, so that the others' stay whole numbers in pandas.
    """
    of_ticker, size = F.xxhash64("ticker"), file_bytes(df)
    bucket = F.pmod(of_ticker, F.lit(size // BUCKET_BYTES + 1)) if size else of_ticker
    return dealt(df.withColumn("_bucket", F.when(F.col("ticker").isNotNull(), bucket).otherwise(F.lit(-1))).repartition("_bucket"), "_bucket")


def per_ticker(df: DataFrame, added: str, compute: Callable[[pd.DataFrame, np.ndarray], dict], kept: Sequence[str] | None = None, told: str = "") -> DataFrame:
    """df with columns that `compute` makes from the rows of some tickers, each in order of date, and the place of each row's ticker's first row.

    kept: columns of df to return, else all. told: a boolean column added, whose rows alone are
    returned. Dates go as day numbers: pandas would make an object of each.
    """

    def step(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values(["ticker", "date"], ignore_index=True)
        codes = pd.factorize(days["ticker"], use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        made = compute(days, np.repeat(starts, np.diff(starts, append=len(days))))
        done = days[[c for c, _ in returned]].assign(**made)
        return done[done[told]] if told else done

    names = [part.split()[0] for part in added.split(", ")]
    sent = [(c, t) for c, t in df.dtypes if c not in names]
    returned = [(c, t) for c, t in sent if kept is None or c in kept]
    dates = [c for c, t in sent if t == "date"]
    rows = bucketed(df).select("_bucket", *(F.unix_date(c).alias(c) if c in dates else F.col(c) for c, _ in sent))
    done = rows.groupBy("_bucket").applyInPandas(step, ", ".join(f"{c} {'int' if c in dates else t}" for c, t in returned) + ", " + added)
    return done.withColumns({c: F.date_from_unix_date(c) for c, _ in returned if c in dates})


class Trailing(BaseIndexer):
    """The current row and those before it, window_size in all, from `first`, the first row of its ticker, on."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        ends = np.arange(1, num_values + 1)
        return np.maximum(ends - self.window_size, self.first), ends


def rolling(x: pd.Series, first: np.ndarray, window: int, least: int = 1):
    return x.rolling(Trailing(window_size=window, first=first), min_periods=least)


def known(x: pd.Series) -> pd.Series:
    x = x.astype(float)
    return x.where(np.isfinite(x))


def trailing_median(df: DataFrame, column: str, window: int = 252, out: str = "median") -> DataFrame:
    return per_ticker(df, f"{out} double", lambda d, first: {out: rolling(known(d[column]), first, window).median()})


def percentile_rank(value: Column, series: Column) -> Column:
    """Share in percent of an array's values that are at most `value`."""
    return F.try_divide(F.lit(100.0) * F.size(F.filter(series, lambda x: x <= value)), F.size(series))


def hot_flags(df: DataFrame, column: str = "wiki", ratio: float = 1.25, window: int = 252) -> DataFrame:
    """Adds hot: the value is ratio times its trailing median or more; false where unknown."""
    hot = (F.col("median") > 0) & (finite(F.col(column)) >= F.col("median") * ratio)
    return trailing_median(df, column, window).withColumn("hot", F.coalesce(hot, F.lit(False)))


def persistence(df: DataFrame, window: int = 60) -> DataFrame:
    """Adds persistence: hot share of the trailing window, partial ones included."""
    return df.withColumn("persistence", F.avg(F.col("hot").cast("double")).over(trailing(window)))


def compression(df: DataFrame, window: int = 60, rank_window: int = 252) -> DataFrame:
    """Adds range, the relative spread of full windows of closes, and its trailing percentile."""
    return per_ticker(df, "range double, percentile double", lambda d, first: _compressed(d, first, window, rank_window))


def _compressed(d: pd.DataFrame, first: np.ndarray, window: int, rank_window: int) -> dict[str, pd.Series]:
    closes = rolling(known(d["close"]), first, window, window)
    top = closes.max()
    spread = ((top - closes.min()) / top).where(top > 0)
    ranks = rolling(spread, first, rank_window)
    return {"range": spread, "percentile": (100 * ranks.rank(method="max") / ranks.count()).where(spread.notna())}


def regime_days(df: DataFrame, column: str, least_persistence: float, most_percentile: float, gap: int = 10, ratio: float = 1.25, window: int = 60, long_window: int = 252) -> DataFrame:
    """Days that qualify, days of release and the last of each ticker (ticker, date, close, volume, column).

    (ticker, date, idx, persistence, percentile, qualifies, release, run, the number of the regime
    that a day belongs to or follows).
    """

    def compute(d: pd.DataFrame, first: np.ndarray) -> dict:
        x = known(d[column])
        median = rolling(x, first, long_window).median()
        hot = ((median > 0) & (x >= median * ratio)).astype(float)
        persistence = rolling(hot, first, window).mean()
        percentile = _compressed(d, first, window, long_window)["percentile"]
        qualifies = ((persistence >= least_persistence) & (percentile <= most_percentile)).to_numpy()
        hits = np.flatnonzero(qualifies)
        new = np.zeros(len(d), np.int64)
        new[hits] = (np.diff(hits, prepend=-gap - 2) > gap + 1) | (np.diff(first[hits], prepend=-1) != 0)
        runs = np.cumsum(new)
        release, last = _released(d, first), np.diff(first, append=len(d)) != 0
        return {
            "idx": np.arange(1, len(d) + 1) - first, "persistence": persistence, "percentile": percentile, "qualifies": qualifies, "release": release,
            "run": runs - (runs - new)[first], "told": qualifies | release | last,
        }

    added = "idx int, persistence double, percentile double, qualifies boolean, release boolean, run int, told boolean"
    return per_ticker(df, added, compute, ("ticker", "date"), "told").drop("told")


def merge_regimes(df: DataFrame, flag: str = "qualifies", gap: int = 10, min_sessions: int = 15) -> DataFrame:
    """(ticker, regime_start, regime_end, start_idx, end_idx, sessions): runs of flagged days over gaps of up to `gap` others."""
    hits = df.withColumn("idx", F.row_number().over(by_date())).filter(F.col(flag))
    new = F.coalesce(F.col("idx") - F.lag("idx").over(by_date()) > gap + 1, F.lit(True))
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by_date()))
    regimes = runs.groupBy("ticker", "run").agg(
        F.min("date").alias("regime_start"), F.max("date").alias("regime_end"),
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("sessions"),
    )
    return regimes.filter(F.col("sessions") >= min_sessions).drop("run")


def release_triggers(df: DataFrame, window: int = 60, volume_ratio: float = 1.5) -> DataFrame:
    """Adds release: a close above all of the prior window on raised volume."""
    close, volume = finite(F.col("close")), finite(F.col("volume"))
    average = F.avg(volume).over(prior(window))
    fires = (F.row_number().over(by_date()) > window) & (close > F.max(close).over(prior(window))) & (average > 0) & (volume >= average * volume_ratio)
    return df.withColumn("release", F.coalesce(fires, F.lit(False)))


def _released(d: pd.DataFrame, first: np.ndarray, window: int = 60, volume_ratio: float = 1.5) -> np.ndarray:
    """release of release_triggers, by the same sums in the same order."""
    close, volume = known(d["close"]).to_numpy(), known(d["volume"]).to_numpy()
    seen, counted = np.isfinite(volume), np.nan_to_num(volume)
    at = np.flatnonzero(np.arange(len(d)) - first >= window)
    top, total, n = np.full(len(at), np.nan), np.zeros(len(at)), np.zeros(len(at))
    for back in range(window, 0, -1):
        top = np.fmax(top, close[at - back])
        total += counted[at - back]
        n += seen[at - back]
    average = np.divide(total, n, out=np.zeros(len(at)), where=n > 0)
    fires = np.zeros(len(d), bool)
    fires[at] = (close[at] > top) & (average > 0) & (volume[at] >= average * volume_ratio)
    return fires


def first_release(df: DataFrame, start: str = "start_idx") -> DataFrame:
    """(ticker, release_idx, release_date): first trigger at or after the row number in `start`; null if none."""
    rows = df.withColumn("idx", F.row_number().over(by_date()))
    due = F.col("release") & (F.col("idx") >= F.col(start))
    return rows.groupBy("ticker").agg(F.min(F.when(due, F.col("idx"))).alias("release_idx"), F.min(F.when(due, F.col("date"))).alias("release_date"))


def volume_slope(df: DataFrame, window: int = 60, band: float = 0.05) -> DataFrame:
    """(ticker, obv): up, down or flat by the two halves of the signed volume's running sum; null under 5 points."""
    newest = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    before = F.lag("close").over(by_date())
    signed = F.when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0.0)
    known = finite(F.col("close")).isNotNull() & finite(before).isNotNull() & finite(F.col("volume")).isNotNull()
    points = df.withColumn("signed", F.when(known, signed)).withColumn("age", newest).filter((F.col("age") <= window) & F.col("signed").isNotNull())
    running = points.withColumn("sum", F.sum("signed").over(by_date().rowsBetween(W.unboundedPreceding, 0))).withColumn("i", F.row_number().over(by_date())).withColumn("n", F.count("*").over(W.partitionBy("ticker")))
    early = F.col("i") <= F.floor(F.col("n") / 2)
    halves = running.groupBy("ticker").agg(F.max("n").alias("n"), F.avg(F.when(early, F.col("sum"))).alias("first"), F.avg(F.when(~early, F.col("sum"))).alias("second"))
    slope = F.when(F.col("second") > F.col("first") * (1 + band), "up").when(F.col("second") < F.col("first") * (1 - band), "down").otherwise("flat")
    return halves.select("ticker", F.when(F.col("n") >= 5, slope).alias("obv"))


def latest(df: DataFrame, column: str = "wiki", recent: int = 60, window: int = 252, average: int = 200, rel_window: int = 90, ratio: float = 1.25, least: int = 200) -> DataFrame:
    """One row a ticker of what its last day shows, from one pass over its newest rows.

    (ticker, return_12m, extension: null where the history is too short; known, new_high: any of
    the recent days above all of its full prior window, known from `window` closes; gain over
    rel_window rows; attn_hit: the last attention is hot, null under `least` known values).
    """
    close, x = finite(F.col("close")), finite(F.col(column))
    back = W.partitionBy("ticker").orderBy(F.desc("date"))
    whole = W.partitionBy("ticker")
    rows = df.select("ticker", "date", close.alias("close"), x.alias("x")).select(
        "*", F.row_number().over(back).alias("age"), F.count("close").over(whole).alias("closes"), F.count("x").over(whole).alias("values")
    ).filter(F.col("age") <= recent + window)
    above = F.when(F.col("age") <= recent, (F.count("close").over(prior(window)) == window) & (F.col("close") > F.max("close").over(prior(window))))
    rows = rows.withColumn("above", F.coalesce(above, F.lit(False)))
    at = lambda age, c="close": F.max(F.when(F.col("age") == age, F.col(c)))
    recent_mean = F.when(F.count(F.when(F.col("age") <= average, F.col("close"))) == average, F.avg(F.when(F.col("age") <= average, F.col("close"))))
    one = rows.groupBy("ticker").agg(
        at(1).alias("now"), at(window + 1).alias("year_ago"), at(rel_window + 1).alias("then"), recent_mean.alias("mean"), F.bool_or("above").alias("new_high"),
        F.first("closes").alias("closes"), F.first("values").alias("values"), at(1, "x").alias("x"), F.percentile(F.when(F.col("age") <= window, F.col("x")), 0.5).alias("median"),
    )
    over = lambda base: F.try_divide("now", F.when(F.col(base) > 0, F.col(base))) - 1
    hot = F.coalesce((F.col("median") > 0) & (F.col("x") >= F.col("median") * ratio), F.lit(False))
    return one.select("ticker", over("year_ago").alias("return_12m"), (F.try_divide("now", "mean") - 1).alias("extension"), (F.col("closes") >= window).alias("known"), "new_high", over("then").alias("gain"), F.when(F.col("values") >= least, hot).alias("attn_hit"))


def new_high(df: DataFrame, recent: int = 60, window: int = 252) -> DataFrame:
    """(ticker, known, new_high): see latest."""
    return latest(df.withColumn("wiki", F.lit(0.0)), recent=recent, window=window).select("ticker", "known", "new_high")


def attention_series(df: DataFrame, least: int = 200) -> DataFrame:
    """df (with share_of_voice, first_seen) and the series that tells attention: views where `least` are known, else the
    share of voice since first_seen where that many are, else null."""
    whole = W.partitionBy("ticker")
    views, voice = finite(F.col("wiki").cast("double")), F.when(F.col("date") >= F.col("first_seen"), finite(F.col("share_of_voice").cast("double")))
    return df.withColumn("attention", F.when(F.count(views).over(whole) >= least, views).when(F.count(voice).over(whole) >= least, voice))


def attention_hot(df: DataFrame, window: int = 252, ratio: float = 1.25) -> DataFrame:
    """(ticker, hot) of the last day by attention_series; null where it is unknown."""
    age = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    rows = attention_series(df).withColumn("age", age).filter(F.col("age") <= window)
    one = rows.groupBy("ticker").agg(F.max(F.when(F.col("age") == 1, F.col("attention"))).alias("x"), F.percentile("attention", 0.5).alias("median"))
    return one.select("ticker", F.when(F.col("median").isNotNull(), F.coalesce((F.col("median") > 0) & (F.col("x") >= F.col("median") * ratio), F.lit(False))).alias("hot"))


def returns(df: DataFrame, year: int = 252, average: int = 200) -> DataFrame:
    """(ticker, return_12m, extension): of each ticker's last day; null where the history is too short."""
    close = finite(F.col("close"))
    then = F.lag(close, year).over(by_date())
    mean = F.when(F.count(close).over(trailing(average)) == average, F.avg(close).over(trailing(average)))
    age = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    rows = df.select("ticker", (F.try_divide(close, F.when(then > 0, then)) - 1).alias("return_12m"), (F.try_divide(close, mean) - 1).alias("extension"), age.alias("age"))
    return rows.filter("age = 1").drop("age")


def attention_ratio(df: DataFrame, column: str = "wiki", least: int = 20) -> DataFrame:
    """(ticker, ratio): latest value over the upper median of all."""
    known = df.withColumn("x", finite(F.col(column))).filter("x IS NOT NULL")
    ordered = F.array_sort(F.collect_list("x"))
    rows = known.groupBy("ticker").agg(F.max_by("x", "date").alias("latest"), ordered.alias("xs"))
    middle = F.element_at("xs", (F.floor(F.size("xs") / 2) + 1).cast("int"))
    return rows.select("ticker", F.when(F.size("xs") >= least, F.try_divide("latest", F.when(middle > 0, middle))).alias("ratio"))


def average_volume(df: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """Adds avg_volume: mean volume of the window before each day; null under `least` known days."""
    volume = finite(F.col("volume"))
    return df.withColumn("avg_volume", F.when(F.count(volume).over(prior(window)) >= least, F.avg(volume).over(prior(window))))


def proof_days(df: DataFrame, move: float = 0.08, ratio: float = 3.0) -> DataFrame:
    """Days whose close moved by `move` or more on `ratio` times the average volume."""
    change = F.try_divide("close", F.lag("close").over(by_date())) - 1
    days = average_volume(df).withColumn("move", change)
    return days.filter((F.col("move") >= move) & (F.try_divide("volume", "avg_volume") >= ratio))


def sparkline(df: DataFrame, points: int = 60) -> DataFrame:
    """(ticker, spark): the last closes scaled to 0..1."""
    age = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    rows = df.withColumn("age", age).filter((F.col("age") <= points) & finite(F.col("close")).isNotNull())
    packed = rows.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("xs"))
    low, high = F.array_min("xs"), F.array_max("xs")
    return packed.select("ticker", F.transform("xs", lambda x: F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))).alias("spark"))


def classify(ledger: DataFrame, least_persistence: float = 0.60, most_percentile: float = 35.0, dead_after: int = 126, column: str = "wiki", min_sessions: int = 15) -> DataFrame:
    """State of each ticker's latest regime, released, coiled or dead, with its dates, and the last day's persistence and percentile.

    Days are numbered by regime in one pass over each bucket of tickers, which hands on only days
    that tell a state; a row for each regime is left to the shuffle.
    """
    days = regime_days(ledger.select(*dict.fromkeys(("ticker", "date", "close", "volume", column))), column, least_persistence, most_percentile)
    hit = lambda c: F.when(F.col("qualifies"), F.col(c))
    runs = days.groupBy("ticker", "run").agg(
        F.max(hit("idx")).alias("end_idx"), F.min(hit("date")).alias("regime_start"), F.max(hit("date")).alias("regime_end"), F.min(hit("idx")).alias("start_idx"), F.count_if("qualifies").alias("sessions"),
        F.collect_list(F.when(F.col("release"), F.struct("idx", "date"))).alias("releases"), F.max("idx").alias("n"), F.max_by(F.struct("date", "persistence", "percentile"), "idx").alias("last"),
    )
    fields = ("end_idx", "regime_start", "regime_end", "start_idx", "sessions")
    one = runs.groupBy("ticker").agg(
        F.max(F.when(F.col("sessions") >= min_sessions, F.struct(*fields))).alias("r"), F.flatten(F.collect_list("releases")).alias("releases"), F.max("n").alias("n"), F.max_by("last", "n").alias("last")
    ).filter("r IS NOT NULL").select("ticker", "r.*", "n", "last", "releases")
    release = F.array_min(F.filter("releases", lambda x: x["idx"] > F.col("end_idx")))
    dead = F.col("n") - F.col("end_idx") > dead_after
    state = F.when(F.col("release").isNotNull(), "released").when(dead, "dead").otherwise("coiled")
    since = F.coalesce("release.idx", F.when(dead, F.col("end_idx") + dead_after).otherwise(F.col("start_idx")))
    return one.withColumn("release", release).select(
        "ticker", state.alias("state"), "regime_start", "regime_end", "sessions", F.col("release.date").alias("release_date"), F.greatest(F.lit(0), F.col("n") - since).cast("long").alias("days_in_state"),
        F.col("last.date").alias("as_of"), F.col("last.persistence").alias("persistence"), F.col("last.percentile").alias("percentile"),
    )


def spring_board(coils: DataFrame, sectors: DataFrame, hot: DataFrame, defensive: tuple[str, ...]) -> DataFrame:
    """coils with sector, in_hot_theme and discounted: a defensive sector outside hot themes. sectors: (ticker, sector); hot: (ticker)."""
    rows = coils.join(sectors.select("ticker", "sector"), "ticker", "left").join(hot.select("ticker", F.lit(True).alias("in_hot")).distinct(), "ticker", "left")
    rows = rows.withColumn("in_hot_theme", F.coalesce("in_hot", F.lit(False))).drop("in_hot")
    return rows.withColumn("discounted", F.coalesce(F.col("sector").isin(*defensive), F.lit(False)) & ~F.col("in_hot_theme"))


COIL_ORDER = ("released", "coiled", "dead")
MEMBER_ORDER = ("ran", "running", "coiled", "lagging", "dead")


def state_rank(state: Column, order: tuple[str, ...] = COIL_ORDER) -> Column:
    """Place of a state in an order, after all of it for others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), state), F.lit(0)) - 1, F.lit(len(order)))


def spring_order() -> list[Column]:
    """Hot themes first, discounted last, then by state, persistence and compression; ties by ticker."""
    return [F.desc("in_hot_theme"), F.asc("discounted"), state_rank(F.col("state")), F.desc("persistence"), F.coalesce("percentile", F.lit(100.0)), F.col("ticker")]
