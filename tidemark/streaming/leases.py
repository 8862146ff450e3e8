"""State with an expiry in event time: a key holds a lease for some days, and can get a new one only when that is over.

Rows may come late and in any order: they wait in the state until the watermark has passed their day
and are then taken day by day, so the result is that of one run a day over all rows. State
is one lease a key and the waiting days within the allowed lateness. Needs the RocksDB state store.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemark.operators import alerts as A
from tidemark.session import kept

_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86_400_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases(StatefulProcessor):
    """Rows (day number, payload) of a key become rows (key, event, start, end, payload)."""

    def __init__(self, key: str, days: int):
        self.row, self.days = Row(key, "event", "start", "end", "payload"), days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", "payload string")
        self.held = handle.getValueState("held", "start int, end int, payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        best: dict[int, str] = {}
        for day, payload in ((r["__day"], r["__payload"]) for r in rows):
            best[day] = max(best.get(day, payload), payload)
        for day, payload in best.items():
            if self.waiting.containsKey((day,)):
                payload = max(payload, self.waiting.getValue((day,))[0])
            self.waiting.updateValue((day,), (payload,))
            self.handle.registerTimer((day + 1) * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """Takes all days that the watermark has passed, in order, whichever timer it was."""
        passed = timerValues.getCurrentWatermarkInMs() // _DAY_MS  # days before this one are over
        held = self.held.get() if self.held.exists() else None
        out = []

        def end_before(day: int) -> None:
            nonlocal held
            if held is not None and held[1] < day:
                out.append(self.row(*key, "expired", *held))
                held = None

        for day in sorted(d for (d,) in self.waiting.keys() if d < passed):
            end_before(day)
            payload = self.waiting.getValue((day,))[0]
            self.waiting.removeKey((day,))
            if held is None:
                held = (day, day + self.days, payload)
                out.append(self.row(*key, "granted", *held))
                self.handle.registerTimer((held[1] + 1) * _DAY_MS)
        end_before(passed)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        return iter(out)

    def close(self) -> None:
        pass


def leases(requests: DataFrame, days: int, key: str = "ticker", date: str = "date", payload: str | None = None, late: str = "7 days") -> DataFrame:
    """(key, event, start, end, payload): leases granted and expired by a stream of requests (key, date, payload).

    A request is granted if its key has no lease; the lease holds through the day `days` later. Of
    several requests of a day the largest payload counts. Rows later than the watermark drop out; null keys or dates too.
    """
    requests.sparkSession.conf.set(_PROVIDER, _ROCKS)
    text = F.coalesce(F.col(payload).cast("string"), F.lit("")) if payload else F.lit("")
    rows = requests.filter(F.col(key).isNotNull() & F.col(date).isNotNull())
    rows = rows.select(F.col(key), F.unix_date(F.col(date).cast("date")).alias("__day"), text.alias("__payload"), F.col(date).cast("timestamp").alias("__at")).withWatermark("__at", late)
    kind = dict(requests.dtypes)[key]
    found = rows.groupBy(key).transformWithState(Leases(key, days), f"`{key}` {kind}, event string, start int, end int, payload string", "append", "EventTime")
    return found.select(key, "event", F.date_from_unix_date("start").alias("start"), F.date_from_unix_date("end").alias("end"), "payload")


def leaders(triggers: DataFrame, industries: DataFrame, edges: DataFrame, days: int = 182, late: str = "7 days") -> DataFrame:
    """(ticker, event, detected, expires, headline, followers): leaders as they are elevated and as they expire.

    triggers: a stream (ticker, date, headline); industries and edges as for `alerts.leaders`, at
    rest. The leaders of a day are those granted and not yet expired.
    """
    found = leases(triggers, days, payload="headline", late=late)
    who = kept(A.followers(None, industries, edges), "followers")  # each batch reads it again
    rows = found.join(who, "ticker", "left")
    return rows.select("ticker", "event", F.col("start").alias("detected"), F.col("end").alias("expires"), F.col("payload").alias("headline"), F.coalesce("followers", F.array().cast(dict(who.dtypes)["followers"])).alias("followers"))


def checks(phrases: DataFrame, max_age: int = 30, late: str = "7 days") -> DataFrame:
    """(phrase, checked): the days on which a phrase of a stream (phrase, date) needs a new confirmation, as the last one is over max_age days old."""
    found = leases(phrases, max_age, key="phrase", late=late)
    return found.filter("event = 'granted'").select("phrase", F.col("start").alias("checked"))
