"""Sessions, and shipping of this package to executors that don't have it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip file, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly where its files give fewer than four partitions a core: for work that costs more than a shuffle of its input.

    Files of few row groups give partitions without rows, so as many partitions as cores can still be one full one.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: for what several steps of a query read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is made from."""
    return sum(files.size(df.sparkSession, f) for f in df.inputFiles())


def dealt(df: DataFrame, *keys: str, mb: int = 4) -> DataFrame:
    """df partitioned by keys, a partition for every `mb` MB of the files that it is made from; as it is where that gives no more than a partition a core.

    Spark merges partitions of a shuffle up to a size, and a few large tasks then sort and hash what
    they hold in memory that grows with the input. A number of partitions that is asked for stays.
    """
    spark = df.sparkSession
    parts = file_bytes(df) // (mb << 20)
    return df.repartition(parts, *keys) if parts > spark.sparkContext.defaultParallelism else df


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
