"""Co-occurrence graphs. Edges are (src, dst, n) with src < dst."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import dealt, shared_dir


def pairs(mentions: DataFrame, item: str = "url", ticker: str = "ticker", exclude: DataFrame | None = None) -> DataFrame:
    """Edges: number of items that name both tickers. An item's tickers are distinct, so its pairs are bounded by the registry."""
    rows = dealt(mentions.select(F.col(item).alias("item"), F.col(ticker).alias("ticker")), "item").distinct()
    if exclude is not None:
        rows = rows.join(exclude, "ticker", "left_anti")
    both = rows.withColumnRenamed("ticker", "src").join(rows.withColumnRenamed("ticker", "dst"), "item").filter("src < dst")
    return dealt(both.select("src", "dst"), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def trailing(weeks: DataFrame, keep: int = 13) -> DataFrame:
    """Edges summed over the newest `keep` weeks of (week, src, dst, n)."""
    newest = weeks.select("week").distinct().orderBy(F.desc("week")).limit(keep)
    return weeks.join(F.broadcast(newest), "week").groupBy("src", "dst").agg(F.sum("n").alias("n"))  # keep rows


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))


def top_neighbors(edges: DataFrame, k: int = 8, of: DataFrame | None = None) -> DataFrame:
    """(ticker, neighbor, n, rank): heaviest neighbours of every ticker, or of those in `of` (ticker), ties to the smaller."""
    ways = both_ways(edges)
    ways = ways if of is None else ways.join(of.select(F.col("ticker").alias("src")).distinct(), "src", "left_semi")
    ranked = ways.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst")))
    return ranked.filter(F.col("rank") <= k).select(F.col("src").alias("ticker"), F.col("dst").alias("neighbor"), "n", "rank")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(q): modularity of a partition (ticker, community)."""
    side = lambda c: communities.select(F.col("ticker").alias(c), F.col("community").alias(f"{c}_in"))
    rows = edges.join(side("src"), "src").join(side("dst"), "dst")
    inside = rows.groupBy(F.col("src_in").alias("community")).agg(F.sum(F.when(F.col("src_in") == F.col("dst_in"), F.col("n"))).alias("inner"))
    degree = both_ways(edges).join(communities, F.col("src") == F.col("ticker")).groupBy("community").agg(F.sum("n").alias("degree"))
    m = edges.agg(F.sum("n").cast("double").alias("m"))
    parts = degree.join(inside, "community", "left").join(F.broadcast(m), F.lit(True))  # m is one row
    return parts.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("q"))


def communities(edges: DataFrame, passes: int = 20) -> DataFrame:
    """(ticker, community): greedy local moving by modularity, the very partition of a run ticker by ticker in their order.

    In a pass every ticker in turn joins the community of its neighbours with the largest positive
    gain, ties to that of the smallest neighbour. What a ticker sees is fixed by the moves of those
    before it and the places of those behind it at the pass's start, so a pass is the one fixed point
    of that rule: each round applies it to all tickers at once, on the moves of the round before,
    until no move changes. At least one more ticker is final after each round, and mostly far more.
    Only moves enter the running totals of a community. Ends with a pass without moves, or after `passes`.

    A community has the name of a ticker that began in it. Edges from a ticker to itself or of a null
    count for nothing, those given twice add up; no edges give no rows.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/communities-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    summed = edges.filter("src <> dst AND n > 0").groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n"))
    ways = kept(both_ways(summed).groupBy("src", "dst").agg(F.sum("n").alias("n")), "ways")
    own = ways.groupBy(F.col("src").alias("ticker")).agg(F.sum("n").alias("k"))
    state = kept(own.select("ticker", "k", F.col("ticker").alias("was"), F.col("ticker").alias("to"), F.lit(False).alias("changed")), "start")
    m2 = state.agg(F.sum("k")).first()[0]
    done, rounds = 0, 0
    while m2 and done < passes:
        rounds += 1
        state = kept(_moves(ways, state, m2), f"round{rounds % 2}")  # a round reads the one before and nothing older
        changed, moved = state.agg(F.max("changed"), F.max(F.col("to") != F.col("was"))).first()
        if not changed:
            done = done + 1 if moved else passes
            state = state.withColumn("was", F.col("to"))
    return state.select("ticker", F.col("to").alias("community"))


def _moves(ways: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """The state (ticker, k, was, to, changed) after a round of `communities`: moves chosen anew, given those in `to`."""
    there = state.select(F.col("ticker").alias("dst"), "was", "to")
    seen = F.when(F.col("dst") < F.col("src"), F.col("to")).otherwise(F.col("was"))
    options = ways.join(there, "dst").groupBy(F.col("src").alias("ticker"), seen.alias("community")).agg(F.sum("n").alias("into"), F.min("dst").alias("nearest"))
    begun = state.groupBy(F.col("was").alias("community")).agg(F.sum("k").alias("total"))
    movers = state.filter("to <> was")
    none = F.lit(None).cast("double")
    delta = lambda c, k: movers.select("ticker", F.col(c).alias("community"), none.alias("into"), F.lit(None).cast(state.schema["ticker"].dataType).alias("nearest"), k.alias("delta"))
    lines = options.withColumn("delta", F.lit(0.0)).unionByName(delta("to", F.col("k"))).unionByName(delta("was", -F.col("k")))
    before = W.partitionBy("community").orderBy("ticker").rangeBetween(W.unboundedPreceding, W.currentRow)  # of one ticker: no more rows than tickers
    # The moves up to a ticker, its own included: that one is taken off again below.
    asked = lines.withColumn("delta", F.sum("delta").over(before)).filter("into IS NOT NULL").join(begun, "community", "left").join(state, "ticker")
    itself = F.when(F.col("community") == F.col("to"), F.col("k")).otherwise(0.0)
    gain = F.col("into") - (F.coalesce("total", F.lit(0.0)) + F.col("delta") - itself) * F.col("k") / F.lit(m2)
    best = asked.withColumn("gain", gain).filter("gain > 0").groupBy("ticker").agg(F.min_by("community", F.struct(-F.col("gain"), "nearest")).alias("best"))
    to = F.coalesce("best", "was")
    return state.join(best, "ticker", "left").select("ticker", "k", "was", to.alias("to"), (to != F.col("to")).alias("changed"))


def co_mention(history: DataFrame, pairs: DataFrame, week: str, leaders: DataFrame, previous: DataFrame, keep: int = 13, least: int = 3, min_q: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run over the pairs of a week: the new history (week, src, dst, n), communities (ticker, community), leader drift.

    Communities of `least` members or more are given where the modularity of them all is min_q or
    more. Drift is (ticker, was, now) of leaders whose ordered neighbours have changed;
    previous: (ticker, neighbors).
    """
    after = _joined(history, pairs, week, keep)
    edges = trailing(after, keep)
    found = communities(edges)
    fit = modularity(edges, found).filter(F.col("q") >= min_q)
    large = found.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    inside = found.join(large.select("community"), "community", "left_semi").join(F.broadcast(fit.select(F.lit(True).alias("fit"))), F.lit(True)).select("ticker", "community")  # one row or none
    return after, inside, _drift(edges, leaders, previous)


def leader_drift(history: DataFrame, pairs: DataFrame, week: str, leaders: DataFrame, previous: DataFrame, keep: int = 13) -> DataFrame:
    """The drift of `co_mention` alone: it doesn't depend on the communities, which take many rounds."""
    return _drift(trailing(_joined(history, pairs, week, keep), keep), leaders, previous)


def _joined(history: DataFrame, pairs: DataFrame, week: str, keep: int) -> DataFrame:
    """The newest `keep` weeks (week, src, dst, n) of a history and the pairs of a week."""
    whole = history.select("week", "src", "dst", "n").unionByName(pairs.select(F.lit(week).alias("week"), "src", "dst", "n"))
    newest = whole.select("week").distinct().orderBy(F.desc("week")).limit(keep)
    return whole.join(F.broadcast(newest), "week").groupBy("week", "src", "dst").agg(F.sum("n").alias("n"))  # keep rows


def _drift(edges: DataFrame, leaders: DataFrame, previous: DataFrame) -> DataFrame:
    near = top_neighbors(edges, of=leaders).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor"))), lambda x: x["neighbor"]).alias("now"))
    drift = near.join(previous.select("ticker", F.col("neighbors").alias("was")), "ticker").filter(~F.col("now").eqNullSafe(F.col("was")))
    return drift.select("ticker", "was", "now")
