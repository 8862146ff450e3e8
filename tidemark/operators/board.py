"""Signals from mention events, their scores, stages and boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vocabulary as V

from .ledger import finite


#: Market cap under which a company is very small; the penalty is higher under a quarter of it.
MICRO_CAP = 100_000_000


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def capped_volume(x: Column, most: float = 25.0) -> Column:
    """Relative volume, 1 where it is unknown, not positive or over the cap."""
    return F.when((x > 0) & (x <= most), x).otherwise(F.lit(1.0))


def signals(events: DataFrame, sources: Sequence[str], *more: str) -> DataFrame:
    """One row for each ticker (and value of further key columns): totals, mention-weighted means, mentions by source and the last price.

    events: (seq, ticker, source, mentions, sentiment, price_move, relative_volume, last_price).
    One aggregation, partial on the map side: a hot ticker shuffles a row a partition.
    """
    mean = lambda c, default: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("mentions")), F.sum("mentions")), F.lit(default))
    by_source = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col("mentions"))), F.lit(0)).alias(f"from_{s}") for s in sources]
    known = F.when(F.col("last_price").isNotNull(), F.col("seq"))
    return events.groupBy(*more, "ticker").agg(
        F.sum("mentions").alias("mentions"), mean("sentiment", 0.0).alias("sentiment"), mean("price_move", 0.0).alias("price_move"),
        mean("relative_volume", 1.0).alias("relative_volume"), F.max_by("last_price", known).alias("last_price"), *by_source,
    )


def with_momentum(now: DataFrame, before: DataFrame) -> DataFrame:
    """Adds momentum: change of mentions in percent on (ticker, mentions) of before; null without any."""
    earlier = before.select("ticker", F.col("mentions").alias("before"))
    change = F.try_divide((F.col("mentions") - F.col("before")) * 100.0, F.nullif(F.col("before"), F.lit(0)))
    return now.join(earlier, "ticker", "left").withColumn("momentum", change).drop("before")


def active(sources: Sequence[str]) -> Column:
    """Number of the sources that mention the ticker."""
    return sum(((F.col(f"from_{s}") > 0).cast("int") for s in sources), F.lit(0))


def total(sources: Sequence[str]) -> Column:
    return sum((F.col(f"from_{s}") for s in sources), F.lit(0))


def attention_score(board: DataFrame, sources: Sequence[str], short: Column | None = None) -> DataFrame:
    """Adds signal_score, 0 to 100; the largest mentions are one aggregated row, joined back."""
    most = board.agg(F.greatest(F.lit(1), F.max("mentions")).alias("most"))
    score = (
        27 * F.sqrt(F.col("mentions") / F.col("most")) + 20 * clamp01(F.coalesce("momentum", F.lit(0.0)) / 80 + 0.25) + 17 * clamp01((F.col("sentiment") + 0.25) / 0.7)
        + 12 * clamp01(F.col("price_move") / 6) + 9 * clamp01(F.col("relative_volume") / 2.5) + 9 * active(sources) / len(sources)
        + 6 * clamp01((F.lit(0) if short is None else short) / F.greatest(F.lit(8), F.col("mentions")))
    )
    return board.join(F.broadcast(most), F.lit(True)).withColumn("signal_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).drop("most")  # most is one row


def peer_score(board: DataFrame, sources: Sequence[str], of: int) -> DataFrame:
    """Adds peer_score: weights without the short term, scaled so that the best row is at most 85."""
    most = board.agg(F.greatest(F.lit(1), F.max("mentions")).alias("most"))
    raw = (
        30 * F.sqrt(F.col("mentions") / F.col("most")) + 22 * clamp01(F.coalesce("momentum", F.lit(0.0)) / 80 + 0.25) + 18 * clamp01((F.col("sentiment") + 0.25) / 0.7)
        + 12 * clamp01(F.col("price_move") / 6) + 10 * clamp01(capped_volume(F.col("relative_volume")) / 2.5) + 8 * active(sources) / of
    )
    rows = board.join(F.broadcast(most), F.lit(True)).withColumn("raw", raw).drop("most")  # one row
    best = rows.agg(F.greatest(F.lit(1.0), F.max("raw")).alias("best"))
    return rows.join(F.broadcast(best), F.lit(True)).withColumn("peer_score", F.least(F.lit(100.0), F.col("raw") * 85 / F.col("best"))).drop("raw", "best")  # one row


def profile(board: DataFrame, social: Sequence[str], catalyst: Sequence[str], market: Sequence[str], filing: str | None = None, score: str = "signal_score") -> DataFrame:
    """Adds setup_score, stage, evidence and the first three risks.

    A column market_cap, where the board has one, adds the risk of very small companies.
    """
    every = [*social, *catalyst, *market]
    s, c, m = total(social), total(catalyst), total(market)
    groups = (s > 0).cast("int") + (c > 0).cast("int") + (m > 0).cast("int")
    n = active(every)
    concentration = F.when(n > 0, F.greatest(*(F.col(f"from_{x}") for x in every)) / F.greatest(F.lit(1), total(every))).otherwise(1.0)
    move, volume, momentum = F.col("price_move"), F.col("relative_volume"), F.coalesce("momentum", F.lit(0.0))
    accel = F.when(momentum == 0, 0.35).otherwise(clamp01((momentum + 5) / 65))
    spread = 0.65 * groups / 3 + 0.35 * clamp01(n / 6)
    confirmed = 0.55 * clamp01((move + 0.5) / 6.5) + 0.45 * clamp01((volume - 1) / 2.5)
    filed = F.when(F.col(f"from_{filing}") > 0, 0.2).otherwise(0.0) if filing else F.lit(0.0)
    news = clamp01(active(catalyst) / 3 + filed)
    cap = finite(F.col("market_cap").cast("double")) if "market_cap" in board.columns else F.lit(None).cast("double")
    flags = [
        (move >= 12, F.least(F.lit(25.0), (move - 12) * 1.1 + 5), "Extended move"),
        (volume >= 8, F.least(F.lit(8.0), (volume - 8) * 0.8 + 2), "Extreme volume"),
        (concentration >= 0.75, F.least(F.lit(8.0), (concentration - 0.75) * 28 + 2), "One-source heavy"),
        ((cap > 0) & (cap < MICRO_CAP), F.when(cap < MICRO_CAP / 4, 8.0).otherwise(5.0), "Micro-cap volatility"),
        ((s > 0) & (c == 0), F.when(move >= 5, 6.0).otherwise(0.0), "No verified catalyst"),
        (groups <= 1, F.lit(10.0), "Thin evidence"),
        (move <= -3, F.lit(6.0), "Price not confirming"),
    ]
    penalty = sum((F.when(on, cost).otherwise(0.0) for on, cost, _ in flags), F.lit(0.0))
    risks = F.slice(F.array_compact(F.array(*(F.when(on, name) for on, _, name in flags))), 1, 3)
    raw = 100 * (0.14 * clamp01(F.col(score) / 85) + 0.22 * accel + 0.2 * spread + 0.22 * confirmed + 0.22 * news)
    crowd = s + c
    stage = (
        F.when((move >= 12) | ((volume >= 8) & (crowd >= 3)), "Crowded").when((momentum <= -15) | (move <= -3), "Cooling")
        .when((c > 0) & (move > 0) & (volume >= 1.2), "Confirmed").when((volume >= 1.2) & (crowd < 5) & (move < 6), "Early ignition")
        .when((momentum >= 15) | (crowd >= 5), "Building").otherwise("Watching")
    )
    grade = F.when((active(catalyst) >= 2) & (groups == 3), "Strong evidence").when((active(catalyst) >= 1) & (groups >= 2), "Corroborated").when(groups >= 2, "Developing").otherwise("Thin evidence")
    return board.withColumns({"setup_score": F.floor(100 * clamp01((raw - penalty) / 100) + 0.5), "stage": stage, "evidence": grade, "risks": F.array_join(risks, ", ")})


def attention_threshold(board: DataFrame, column: str, quantile: float = 0.7, least: float = 5.0) -> DataFrame:
    """(threshold): nearest-rank quantile of the positive values, `least` or more; infinite without any.

    The values are counted into a histogram of powers of two first, so the rank is then sought
    among the values of one bin only.
    """
    positive = board.filter(F.col(column) > 0).select(F.col(column).alias("x"), F.floor(F.log2(F.col(column))).alias("bin"))
    bins = positive.groupBy("bin").agg(F.count("*").alias("n"))  # 64 bins of whole numbers
    ranked = bins.withColumn("upto", F.sum("n").over(W.orderBy("bin"))).withColumn("size", F.sum("n").over(W.partitionBy(F.lit(0))))
    at = F.least(F.col("size") - 1, F.floor(quantile * F.col("size")))
    home = ranked.filter((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select("bin", (at - (F.col("upto") - F.col("n"))).alias("place"))
    inside = positive.join(F.broadcast(home), "bin").groupBy("x", "place").agg(F.count("*").alias("n"))  # one row
    hit = inside.withColumn("upto", F.sum("n").over(W.orderBy("x"))).filter(F.col("upto") > F.col("place")).agg(F.min("x").alias("x"))
    return hit.select(F.coalesce(F.greatest(F.lit(least), F.col("x").cast("double")), F.lit(float("inf"))).alias("threshold"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def rank_changes(snapshots: DataFrame, metric: str) -> DataFrame:
    """(snapshot, ticker, rank, change): change of rank on the snapshot before; null where new."""
    ranked = snapshots.withColumn("rank", F.row_number().over(W.partitionBy("snapshot").orderBy(F.desc(metric), "ticker")))
    order = ranked.select("snapshot").distinct().withColumn("no", F.row_number().over(W.orderBy("snapshot")))  # one row a snapshot
    numbered = ranked.join(order, "snapshot")
    earlier = numbered.select("ticker", (F.col("no") + 1).alias("no"), F.col("rank").alias("was"))
    return numbered.join(earlier, ["ticker", "no"], "left").select("snapshot", "ticker", "rank", (F.col("was") - F.col("rank")).alias("change"))


def sentiment_label(x: Column) -> Column:
    """Label of a mean: rounded to 12 digits first, so that a mean at a bound is labelled alike in whatever order it was summed."""
    x = F.round(x, 12)
    return F.when(x > 0.25, "Bullish").when(x > 0.08, "Positive").when(x < -0.18, "Bearish").when(x < -0.04, "Soft").otherwise("Neutral")


def mode_order(mode: str) -> list[Column]:
    """Order of a board by mentions, by momentum (unknown as 0) or by setup score; ties by ticker."""
    key = {"mentions": F.col("mentions"), "momentum": F.coalesce("momentum", F.lit(0.0)), "score": F.col("setup_score")}[mode]
    return [F.desc(key), F.col("ticker")]


def shown(board: DataFrame, mode: str, limit: int = 50) -> DataFrame:
    """The first `limit` rows of a board with their place."""
    first = board.orderBy(*mode_order(mode)).limit(limit)
    return first.withColumn("place", F.row_number().over(W.orderBy(*mode_order(mode))).cast("long"))  # limit rows


def composite(board: DataFrame, sources: Sequence[str], short: str | None = None) -> DataFrame:
    """Adds composite, 0 to 100: the optional blend of signal score, momentum, sentiment, price, volume, breadth and short sales."""
    pressure = clamp01((F.col(f"from_{short}") if short else F.lit(0)) / F.greatest(F.lit(8), F.col("mentions")))
    parts = (
        (0.31, clamp01(F.col("signal_score") / 85)), (0.17, clamp01((F.coalesce("momentum", F.lit(0.0)) + 10) / 80)), (0.15, clamp01((F.col("sentiment") + 0.2) / 0.65)),
        (0.13, clamp01((F.col("price_move") + 1) / 7)), (0.09, clamp01(F.col("relative_volume") / 2.5)), (0.08, active(sources) / len(sources)), (0.07, pressure),
    )
    return board.withColumn("composite", 100 * sum((w * x for w, x in parts), F.lit(0.0)))


def source_breakdown(board: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(ticker, kind, name, mentions, share): groups and sources with mentions, their share of the largest of their kind."""
    parts = [F.struct(F.lit("group").alias("kind"), F.lit(g).alias("name"), total(s).cast("long").alias("mentions")) for g, s in groups.items()]
    parts += [F.struct(F.lit("source").alias("kind"), F.lit(x).alias("name"), F.col(f"from_{x}").cast("long").alias("mentions")) for s in groups.values() for x in s]
    rows = board.select("ticker", F.filter(F.array(*parts), lambda p: p["mentions"] > 0).alias("p"))
    most = lambda kind: F.array_max(F.transform(F.filter("p", lambda p: p["kind"] == kind), lambda p: p["mentions"]))
    flat = rows.select("ticker", most("group").alias("top_group"), most("source").alias("top_source"), F.explode("p").alias("x"))
    return flat.select("ticker", "x.*", (F.col("x.mentions") / F.when(F.col("x.kind") == "group", F.col("top_group")).otherwise(F.col("top_source"))).alias("share"))


def board_rows(board: DataFrame, sources: Sequence[str], top: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """Rows of a shown board: place, name (else the ticker), momentum as text, the mix of sources, a catalyst badge.

    top: (ticker, title, is_news), names: (ticker, name).
    """
    rows = shown(board, "score", limit).join(names.select("ticker", "name"), "ticker", "left").join(top.select("ticker", "title", "is_news"), "ticker", "left")
    momentum = F.when(F.col("momentum").isNull(), "new").otherwise(F.format_string("%+.1f%%", F.col("momentum")))
    badge = F.when(F.col("title").rlike(T.words_pattern(V.CATALYST, True)), F.when(F.col("is_news"), "News").otherwise("Buzz"))
    mix = [F.round(F.col(f"from_{s}") / F.greatest(F.lit(1), F.col("mentions")), 6).alias(f"mix_{s}") for s in sources]
    return rows.select("place", "ticker", F.coalesce("name", F.col("ticker").cast("string")).alias("name"), "setup_score", momentum.alias("momentum"), *mix, badge.alias("badge"))


def fixed(x: Column, places: int) -> Column:
    """x with a fixed number of places, halves up; null where x is."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", F.floor(x * 10**places + 0.5) / F.lit(float(10**places))))


def export_rows(board: DataFrame, sources: Sequence[str], limit: int = 50) -> DataFrame:
    """(place, line): the shown board as CSV, the heading at place 0.

    The board has a profile and a signal_score, and may have names. Texts are quoted, their quotes
    doubled; unknown prices and momenta are empty.
    """
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    ticker = F.col("ticker").cast("string")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), ticker) if "name" in board.columns else ticker
    price = F.regexp_replace(F.col("last_price").cast("string"), r"\.0$", "")
    cells = {
        "rank": F.col("place"), "ticker": ticker, "name": quoted(name), "market_price": F.coalesce(price, F.lit("")), "setup_score": F.col("setup_score").cast("long"),
        "attention_score": fixed(F.col("signal_score"), 1), "stage": quoted(F.col("stage")), "evidence": quoted(F.col("evidence")), "risk_flags": quoted(F.replace("risks", F.lit(", "), F.lit(" | "))),
        "mentions": F.col("mentions"), "momentum_percent": F.coalesce(fixed(F.col("momentum"), 2), F.lit("")), "sentiment": fixed(F.col("sentiment"), 3),
        "price_move_percent": fixed(F.col("price_move"), 2), "relative_volume": fixed(F.col("relative_volume"), 2), **{s: F.col(f"from_{s}") for s in sources},
    }
    lines = shown(board, "score", limit).select("place", F.concat_ws(",", *(c.cast("string") for c in cells.values())).alias("line"))
    heading = board.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(",".join(cells)).alias("line"))
    return heading.unionByName(lines)


def save_csv(rows: DataFrame, path: str) -> None:
    """Write (place, line) in their order as one text file; a board shows few rows."""
    rows.coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)
