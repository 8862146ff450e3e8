"""An outbox between alerts and whatever they are sent to.

A stream writes its events into the outbox by batch; a replayed batch writes the same folder again, so an
event is in it once. Delivery is a job of its own: it sends what has no acknowledgement yet and
writes one for each event that the sink took. A sink that fails gets the rest the next time and nothing twice.
Only where a task dies between a send and the end of its job is an event sent again, under the
same id, by which the sink can tell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.sources import files

ACKS = "id string, tries int, sent_at timestamp"


def put(events: DataFrame, path: str, batch: int, name: str = "alerts") -> None:
    """Write a batch's events (in place of what the same batch wrote before) with an id made of name, batch and content."""
    content = F.xxhash64(F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}))
    again = F.row_number().over(W.partitionBy("__content").orderBy(F.lit(0)))  # equal events are told apart by number
    rows = events.withColumn("__content", content)
    told = F.concat_ws("-", F.lit(name), F.lit(batch), F.hex("__content"), again)
    rows.withColumn("id", told).drop("__content").write.mode("overwrite").parquet(f"{path}/events/batch={name}-{batch}")


def fill(events: DataFrame, path: str, checkpoint: str, priority: Column | None = None, name: str = "alerts") -> StreamingQuery:
    """Start a query that puts each micro-batch of a stream into the outbox."""
    kept = events.filter(priority) if priority is not None else events
    step = lambda batch, number: put(batch, path, number, name)
    return kept.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events (id, ...) that no acknowledgement is known of."""
    whole = StructType.fromDDL(schema).add("id", "string")
    if not files.names(spark, f"{path}/events"):
        return spark.createDataFrame([], whole)
    events = spark.read.schema(whole).parquet(f"{path}/events").select(*whole.names)
    if not files.names(spark, f"{path}/acks"):
        return events
    return events.join(spark.read.schema(ACKS).parquet(f"{path}/acks").select("id"), "id", "left_anti")


def deliver(spark: SparkSession, path: str, schema: str, send: Callable[[dict], None], tries: int = 1) -> tuple[int, int]:
    """Send what is pending, partition by partition; the numbers of events acknowledged and left.

    send gets an event with its id and raises where the sink did not take it; after `tries`
    such failures of one event, the rest of its partition waits for the next delivery.
    """

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        down = False
        for batch in batches:
            taken = []
            for event in batch.to_dict("records") if not down else ():
                for k in range(1, tries + 1):
                    try:
                        send(event)
                    except Exception:  # noqa: BLE001 - whatever a sink raises leaves the event pending
                        down = k == tries
                    else:
                        taken.append((event["id"], k, pd.Timestamp.now("UTC")))
                        break
                if down:
                    break
            yield pd.DataFrame(taken, columns=["id", "tries", "sent_at"]).astype({"id": str, "tries": "int32", "sent_at": "datetime64[us, UTC]"})

    waiting = pending(spark, path, schema)
    waiting.mapInPandas(attempt, ACKS).write.parquet(f"{path}/acks/delivery={uuid.uuid4().hex}")
    left = pending(spark, path, schema).count()
    sent = spark.read.schema(ACKS).parquet(f"{path}/acks").count()
    return sent, left
