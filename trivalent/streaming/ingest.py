"""Incremental arrival of runs: exactly-once append with stateful dedupe, windows with late rows, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """A folder or file of Parquet as a stream, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(path)


def ingest_once(stream: DataFrame, keys: list[str], at: str, delay: str, out: str, checkpoint: str) -> None:
    """Append rows whose keys weren't seen within ``delay`` of event time; ends when all present files are in.

    Progress lies in ``checkpoint``: started again with the same folder, it goes on with files that came later.
    """
    fresh = stream.withColumn("event__", F.col(at).cast("timestamp")).withWatermark("event__", delay).dropDuplicatesWithinWatermark(keys).drop("event__")
    fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, at: str, width: str, delay: str, groups: list[str], out: str, checkpoint: str) -> None:
    """Tumbling event-time counts in append mode; a window is written when the watermark has passed it."""
    timed = stream.withColumn("event__", F.col(at).cast("timestamp")).withWatermark("event__", delay)
    counts = timed.groupBy(F.window("event__", width), *groups).agg(F.count("*").alias("rows"))
    flat = counts.select(F.col("window.start").alias("window_start"), *groups, "rows")
    flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], at: str, delay: str) -> DataFrame:
    """All rows of a folder through the stream, each key once."""
    out = scratch_path(spark, "ingested")
    ingest_once(stream_of(spark, path, schema), keys, at, delay, out, f"{out}-progress")
    return spark.read.schema(schema).parquet(out)
