"""Session construction, table access and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32_000_000


def get_spark(app: str = "trivalent", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TRIVALENT_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` if the cluster names one.

    A folder of our own is made only where none is set and the session is local (tests, bench).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders written by this driver that nothing has removed yet.
_WRITTEN: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/trivalent-{label}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and a
    frame used twice is computed once.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    read = df.sparkSession.read
    out = read.parquet(path) if partition_by else read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized loop state once nothing reads it any more."""
    path = getattr(df, "written_at", None)
    if path:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all intermediates this driver wrote; for when the results of its queries have been read or saved, as frames not read yet lose their files."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its ``rows`` (counted unless given) of ``row_bytes`` stay within ``most`` bytes; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= most else df
