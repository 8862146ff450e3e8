"""Peer-relative scores of tickers and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rolling
from .ledger import finite


def from_end(df: DataFrame, *key: str) -> DataFrame:
    """Adds age: 1 for the newest row of each key."""
    return df.withColumn("age", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("date")) if key else W.orderBy(F.desc("date"))))


def relative_return(ledger: DataFrame, benchmark: DataFrame, window: int = 90) -> DataFrame:
    """(ticker, rel): return over the last `window` rows less the benchmark's, by position from the end.

    benchmark: (date, close), one row a day.
    """

    def ends(df: DataFrame, key: list[str]) -> DataFrame:
        at = lambda age: F.max(F.when(F.col("age") == age, finite(F.col("close"))))
        return from_end(df, *key).filter(F.col("age").isin(1, window + 1)).groupBy(*key).agg(at(1).alias("now"), at(window + 1).alias("then"))

    gain = lambda: F.try_divide("now", F.when(F.col("then") > 0, F.col("then"))) - 1
    bench = ends(benchmark, []).select(gain().alias("bench"))
    members = ends(ledger, ["ticker"]).select("ticker", gain().alias("own"))
    return members.join(F.broadcast(bench), F.lit(True)).select("ticker", (F.col("own") - F.col("bench")).alias("rel"))  # bench is one row


def bench_gain(benchmark: DataFrame, window: int = 90) -> DataFrame:
    """(bench): the benchmark's return over its last `window` rows, one row."""
    at = lambda age: F.max(F.when(F.col("age") == age, finite(F.col("close"))))
    ends = from_end(benchmark).filter(F.col("age").isin(1, window + 1)).agg(at(1).alias("now"), at(window + 1).alias("then"))
    return ends.select((F.try_divide("now", F.when(F.col("then") > 0, F.col("then"))) - 1).alias("bench"))


def ticker_flags(ledger: DataFrame, benchmark: DataFrame, rel_hit: float = 0.15) -> DataFrame:
    """(ticker, rel_hit, high_hit, attn_hit): null where unknown."""
    rows = rolling.latest(ledger).join(F.broadcast(bench_gain(benchmark)), F.lit(True))  # one row
    return rows.select("ticker", (F.col("gain") - F.col("bench") >= rel_hit).alias("rel_hit"), F.when(F.col("known"), F.col("new_high")).alias("high_hit"), "attn_hit")


def hot_tickers(themes: DataFrame, registry: DataFrame) -> DataFrame:
    """(ticker): members of themes in the diffusion or wave stage."""
    return registry.join(themes.filter(F.col("stage").isin("diffusion", "wave")).select("theme"), "theme", "left_semi").select("ticker").distinct()


def breadth(flags: DataFrame, *key: str) -> DataFrame:
    """Share of known flags that are set, 0 where none is known, with the members counted."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return flags.groupBy(*key).agg(F.count("*").alias("members"), share("rel_hit").alias("rel"), share("high_hit").alias("high"), share("attn_hit").alias("attn"))


def stage(members: Column, decay: Column, rel: Column, attn: Column, language: Column) -> Column:
    return (
        F.when(members < 3, "insufficient-data").when(F.coalesce(decay, F.lit(False)), "decay").when(rel >= 0.35, "wave")
        .when(attn >= 0.30, "diffusion").when((attn >= 0.15) | (language > 0), "naming").otherwise("quiet")
    )


def theme_heat(flags: DataFrame, registry: DataFrame, decay: DataFrame, language: DataFrame | None = None) -> DataFrame:
    """Heat and stage of every theme: excess breadth of its members over all tickers.

    registry: (theme, ticker); decay: (theme, decay boolean); language: (theme, language), the
    score of a confirmed phrase, 0 for themes without one.
    """
    whole = breadth(flags).select(*(F.coalesce(c, F.lit(0.0)).alias(f"all_{c}") for c in ("rel", "high", "attn")))
    themes = breadth(registry.join(flags, "ticker"), "theme").join(F.broadcast(whole), F.lit(True)).join(decay, "theme", "left")  # whole is one row
    if language is not None:
        themes = themes.join(language, "theme", "left")
    language = F.lit(0.0) if language is None else F.coalesce("language", F.lit(0.0))
    excess = {c: F.greatest(F.lit(0.0), F.coalesce(F.col(c) - F.col(f"all_{c}"), F.lit(0.0))) for c in ("rel", "high", "attn")}
    heat = F.floor(100 * (0.30 * excess["rel"] + 0.25 * excess["high"] + 0.25 * excess["attn"] + 0.20 * language) + 0.5)
    return themes.select(
        "theme", "members", F.when(F.col("members") >= 3, heat).alias("heat"),
        stage(F.col("members"), F.col("decay"), excess["rel"], excess["attn"], language).alias("stage"),
    )


def decay_signal(ledger: DataFrame, registry: DataFrame, benchmark: DataFrame, window: int = 100) -> DataFrame:
    """(theme, decay): the members' mean relative index ends below its trailing mean.

    Series are aligned by position from the end over the theme's common length. A ticker's
    closes go through as one array, bounded by its days, so no day is ranked or joined by itself.
    """
    newest_first = lambda: F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]))
    own = ledger.groupBy("ticker").agg(newest_first().alias("own"))
    bench = benchmark.agg(newest_first().alias("bench"))
    common = registry.join(own.select("ticker", F.size("own").alias("length")), "ticker").groupBy("theme").agg(F.min("length").alias("common"), F.count("*").alias("members")).join(F.broadcast(bench.select(F.size("bench").alias("bench_length"))), F.lit(True))  # one row
    common = common.select("theme", "members", F.least("common", "bench_length").alias("common")).filter((F.col("members") >= 3) & (F.col("common") > window + 1))
    members = registry.join(common.drop("members"), "theme").join(own, "ticker").join(F.broadcast(bench), F.lit(True))  # one row of days
    bases = members.withColumns({"base": finite(F.get("own", F.col("common") - 1)), "bench_base": finite(F.get("bench", F.col("common") - 1))}).filter("base > 0 AND bench_base > 0")
    points = bases.select("theme", "base", "bench_base", F.posexplode(F.arrays_zip(F.slice("own", 1, window + 1).alias("close"), F.slice("bench", 1, window + 1).alias("bench"))).alias("place", "p"))
    index = points.groupBy("theme", (F.col("place") + 1).alias("age")).agg(F.avg(finite(F.col("p.close")) / F.col("base") - finite(F.col("p.bench")) / F.col("bench_base")).alias("x")).filter("x IS NOT NULL")
    last, rest = F.max(F.when(F.col("age") == 1, F.col("x"))), F.avg(F.when(F.col("age") > 1, F.col("x")))
    return index.groupBy("theme").agg(F.count("*").alias("n"), (last < rest).alias("decay")).filter(F.col("n") >= window).drop("n")


def member_states(latest: DataFrame, bench: DataFrame, coils: DataFrame) -> DataFrame:
    """(ticker, member_state): coil states win, then ran, running, lagging; others are left out.

    latest: rolling.latest; bench: bench_gain.
    """
    rows = latest.join(F.broadcast(bench), F.lit(True)).withColumn("rel", F.col("gain") - F.col("bench")).join(coils.select("ticker", "state"), "ticker", "left")  # bench is one row
    state = (
        F.when(F.col("state").isin("coiled", "dead"), F.col("state")).when((F.col("return_12m") >= 0.5) & (F.col("extension") > 0.3), "ran")
        .when((F.col("state") == "released") | F.col("new_high"), "running").when(F.col("rel") < 0.10, "lagging")
    )
    return rows.select("ticker", state.alias("member_state")).filter("member_state IS NOT NULL")
