"""State tables between runs: read with a default where there is none, written whole and swapped in.

A table is a folder of versions and a pointer to the newest complete one: readers never see a
half-written version, and a lost run leaves the last one in place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _newest(spark: SparkSession, path: str) -> str | None:
    try:
        pointers = spark.read.schema("at timestamp, version string").json(path + "/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return pointers.agg(F.max_by("version", F.struct("at", "version")).alias("v")).first()["v"]


def load(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The newest version, in this schema; no rows where nothing has been saved."""
    newest = _newest(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{newest}") if newest else spark.createDataFrame([], schema)


def load_required(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """As load, for tables that must be there."""
    if _newest(spark, path) is None:
        raise FileNotFoundError(path)
    return load(spark, path, schema)


def save(df: DataFrame, path: str) -> None:
    """Write all rows as a new version, then point to it. df may be made from the version before."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    df.sparkSession.range(1).select(F.current_timestamp().alias("at"), F.lit(version).alias("version")).coalesce(1).write.mode("append").json(path + "/versions")


def keep_previous(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Fresh rows, or the previous ones where nothing fresh has come."""
    return fresh if not fresh.isEmpty() else previous


def refreshed(cached: DataFrame, fetched: DataFrame, today: Column, at: str = "refreshed", days: int = 30) -> DataFrame:
    """Fetched rows where the cached ones are `days` old or none, and there are fetched rows; else the cached ones."""
    stale = cached.filter(F.datediff(today, at) < days).isEmpty()
    return fetched.withColumn(at, today) if stale and not fetched.isEmpty() else cached
