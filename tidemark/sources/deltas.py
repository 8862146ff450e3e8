"""Keyed state tables that grow by what changes: delta files by bucket, merged when read, compacted now and then.

A write is a segment: the changed rows only, in folders by a hash bucket of the first key. A version is a
small manifest: the live (segment, bucket) pairs and each writer's last batch. Segments never
change, so whoever has read a manifest sees one state of the table, whatever is written or compacted
meanwhile, until `vacuum` has removed that version. A row's newest segment holds.

Writers of a table take turns: a version is written under the next number, and a second writer that
finds the number taken fails. A batch that a writer has already committed changes nothing. What an
interrupted write leaves is in no manifest, and `vacuum` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from tidemark.session import dealt

from . import files

DELETED = "__deleted"


@dataclass(frozen=True)
class Snapshot:
    """One version: its number, buckets, last batch of each writer and live segments of each bucket in their order."""

    version: int
    buckets: int
    writers: dict[str, int]
    segments: dict[int, tuple[str, ...]]


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The newest complete version, or the one asked for; None where nothing has been written."""
    for name in reversed(files.names(spark, f"{path}/versions")):
        if (version is None or int(name) == version) and "_SUCCESS" in files.names(spark, f"{path}/versions/{name}"):
            held = json.loads(spark.read.text(f"{path}/versions/{name}").first()[0])
            return Snapshot(int(name), held["buckets"], held["writers"], {int(b): tuple(s) for b, s in held["segments"].items()})
    return None


def _commit(spark: SparkSession, path: str, new: Snapshot) -> Snapshot:
    held = json.dumps({"buckets": new.buckets, "writers": new.writers, "segments": {str(b): s for b, s in new.segments.items()}})
    spark.range(1).select(F.lit(held).alias("value")).coalesce(1).write.text(f"{path}/versions/{new.version:012d}")
    return new


def _write(rows: DataFrame, path: str, version: int, key: str, buckets: int) -> tuple[str, list[int]]:
    """A segment's name, and the buckets that it has rows in. A bucket's files are split by size, so a hot key needs no large task."""
    segment = f"{version:012d}-{uuid.uuid4().hex}"
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/segment={segment}")
    found = files.names(rows.sparkSession, f"{path}/data/segment={segment}")
    return segment, [int(n.removeprefix("bucket=")) for n in found if n.startswith("bucket=")]


def upsert(batch: DataFrame, path: str, keys: Sequence[str], writer: str = "", number: int | None = None, order: Column | None = None, buckets: int = 64, deletes: bool = False) -> Snapshot:
    """Write the batch's rows in place of those with the same keys, or delete those keys.

    Of several rows of a key the last by `order` holds. number: the batch's number; one that is not
    above the writer's last changes nothing. buckets holds for a new table only.
    """
    spark = batch.sparkSession
    now = snapshot(spark, path) or Snapshot(0, buckets, {}, {})
    if number is not None and number <= now.writers.get(writer, -1):
        return now
    values = [c for c in batch.columns if c not in keys]
    if order is not None:
        rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in values))
    else:
        rows = dealt(batch, *keys).dropDuplicates(list(keys))
    version = now.version + 1
    segment, touched = _write(rows.withColumn(DELETED, F.lit(deletes)), path, version, keys[0], now.buckets)
    segments = now.segments | {b: (*now.segments.get(b, ()), segment) for b in touched}
    writers = now.writers | ({writer: number} if number is not None else {})
    return _commit(spark, path, Snapshot(version, now.buckets, writers, segments))


def read(spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], at: Snapshot | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of a version (the newest, if none is given) in this schema, of all buckets or of some.

    Buckets with one segment are read as they are; only those with several are merged.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = at or snapshot(spark, path)
    live = {b: s for b, s in (at.segments if at else {}).items() if only is None or b in only}
    if not live:
        return spark.createDataFrame([], schema)
    stored = StructType(list(schema)).add(DELETED, BooleanType()).add("segment", StringType()).add("bucket", IntegerType())

    def rows(buckets: dict[int, tuple[str, ...]]) -> DataFrame:
        paths = [f"{path}/data/segment={s}/bucket={b}" for b, segments in buckets.items() for s in segments]
        return spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*paths)

    parts = []
    if alone := {b: s for b, s in live.items() if len(s) == 1}:
        parts.append(rows(alone).drop("segment", "bucket"))
    if several := {b: s for b, s in live.items() if len(s) > 1}:
        values = [c for c in schema.names if c not in keys] + [DELETED]
        newest = dealt(rows(several), *keys).groupBy(*keys).agg(F.max_by(F.struct(*values), "segment").alias("r"))
        parts.append(newest.select(*keys, *(F.col("r")[c].alias(c) for c in values)))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return whole.filter(~F.col(DELETED)).select(*schema.names)


def compact(spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], most: int = 8, keep: Callable[[DataFrame], DataFrame] | None = None) -> Snapshot | None:
    """Rewrite the buckets that have over `most` segments as one each, with the rows that `keep` leaves of them.

    keep must decide within the first key, as each bucket holds whole keys but is seen without the others.
    """
    now = snapshot(spark, path)
    full = [b for b, s in now.segments.items() if len(s) > most] if now else []
    if not full:
        return now
    rows = read(spark, path, schema, keys, now, full)
    version = now.version + 1
    segment, left = _write((keep(rows) if keep else rows).withColumn(DELETED, F.lit(False)), path, version, keys[0], now.buckets)
    segments = {b: s for b, s in now.segments.items() if b not in full} | {b: (segment,) for b in left}
    return _commit(spark, path, Snapshot(version, now.buckets, now.writers, segments))


def vacuum(spark: SparkSession, path: str, versions: int = 2) -> list[str]:
    """Remove all but the newest `versions` versions, and the segments that only they or no version uses; what a write under way makes stays."""
    numbers = files.names(spark, f"{path}/versions")
    kept = [s for n in numbers[-versions:] if (s := snapshot(spark, path, int(n)))]
    if not kept:
        return []
    for name in numbers[:-versions]:
        files.remove(spark, f"{path}/versions/{name}")
    used = {x for s in kept for segments in s.segments.values() for x in segments}
    old = [n for n in files.names(spark, f"{path}/data") if (name := n.removeprefix("segment=")) not in used and int(name.split("-")[0]) <= kept[-1].version]
    for name in old:
        files.remove(spark, f"{path}/data/{name}")
    return old
