"""Structured Streaming forms of the folds: windows with watermarks, table upserts, state changes.

Each takes a streaming DataFrame and gives one, or starts a query with foreachBatch. State is
kept by Spark: by window up to the watermark, or one small row a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text as T
from tidemark.operators import ledger as L
from tidemark.sources import deltas, tables


def arrivals(events: DataFrame, key: str = "seq", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events once each, however often they arrive within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def mention_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(start, end, ticker, mentions) of tumbling windows, or of sliding ones; later rows than the watermark drop out."""
    kept = events.withWatermark(ts, late)
    return _flat(kept.groupBy(F.window(ts, length, slide), "ticker").agg(F.sum("mentions").alias("mentions")))


def mention_sessions(events: DataFrame, gap: str = "6 hours", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(start, end, ticker, mentions) of runs of mentions with no pause of `gap`."""
    kept = events.withWatermark(ts, late)
    return _flat(kept.groupBy(F.session_window(ts, gap).alias("window"), "ticker").agg(F.sum("mentions").alias("mentions")))


def weekly_mentions(events: DataFrame, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """(week, ticker, mentions) by ISO week; weeks start on Monday, four days after the epoch's Thursday."""
    kept = events.withWatermark(ts, late)
    counts = kept.groupBy(F.window(ts, "7 days", "7 days", "4 days"), "ticker").agg(F.sum("mentions").alias("mentions"))
    return counts.select(T.iso_week(F.col("window.start")).alias("week"), "ticker", "mentions")


def _flat(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ticker", "mentions")


def fold(stream: DataFrame, path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Start a query that merges each micro-batch into the table at `path`.

    merge(table, batch) must give the same rows when a batch comes a second time, as the last
    batch does after a failure.
    """

    def step(batch: DataFrame, _: int) -> None:
        tables.save(merge(tables.load(batch.sparkSession, path, schema), batch), path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEDGER_KEYS = ("ticker", "date")
LEDGER = "ticker long, date date, mentions long, close double, volume double, wiki double"


def fold_ledger(days: DataFrame, path: str, checkpoint: str, keep: int = 400) -> StreamingQuery:
    """Keep the ledger at `path` up to date with a stream of its rows; of several rows of a day the last by seq holds."""

    def merge(ledger: DataFrame, batch: DataFrame) -> DataFrame:
        last = batch.groupBy("ticker", "date").agg(F.max_by(F.struct(*L.NUMBERS), "seq").alias("r")).select("ticker", "date", "r.*")
        return L.upsert(ledger, last, keep)

    return fold(days, path, LEDGER, merge, checkpoint)


def ledger_deltas(days: DataFrame, path: str, checkpoint: str, keep: int = 400, most: int = 8) -> StreamingQuery:
    """As fold_ledger, into an incremental table: a batch writes its own rows, and buckets are compacted once they have over `most` deltas."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("ticker", "date", *L.NUMBERS, "seq")
        last = rows.groupBy("ticker", "date").agg(F.max_by(F.struct(*L.NUMBERS), "seq").alias("r")).select("ticker", "date", "r.*")
        deltas.upsert(last, path, LEDGER_KEYS, "stream", number)
        deltas.compact(batch.sparkSession, path, LEDGER, LEDGER_KEYS, most, lambda ledger: L.newest(ledger, keep))
        deltas.vacuum(batch.sparkSession, path)

    return days.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_ledger(spark: SparkSession, path: str, keep: int = 400) -> DataFrame:
    """The ledger that ledger_deltas keeps."""
    return L.newest(deltas.read(spark, path, LEDGER, LEDGER_KEYS), keep)


def state_changes(states: DataFrame, key: str = "ticker", timeout: GroupStateTimeout = GroupStateTimeout.NoTimeout) -> DataFrame:
    """(key, was, now, seq) whenever the state of a key in (key, seq, state) differs from the one before it."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        was = held.get[0] if held.exists else None
        out = []
        for batch in batches:
            for seq, now in batch.sort_values("seq")[["seq", "state"]].itertuples(index=False):
                if now != was:
                    out.append((name[0], was, now, seq))
                    was = now
        if was is not None:
            held.update((was,))
        yield pd.DataFrame(out, columns=[key, "was", "now", "seq"])

    kind = dict(states.dtypes)[key]
    return states.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, was string, now string, seq long", "state string", "append", timeout)


def alert(events: DataFrame, send: Callable[[list[dict]], None] | None, checkpoint: str, priority: Column | None = None) -> StreamingQuery:
    """Start a query that hands each micro-batch's events to `send`, partition by partition; none is sent without one."""
    kept = events.filter(priority) if priority is not None else events

    def step(batch: DataFrame, _: int) -> None:
        if send is not None:
            batch.foreachPartition(lambda rows: send([r.asDict() for r in rows]))

    return kept.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
