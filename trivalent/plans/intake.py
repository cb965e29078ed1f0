"""Queries over the ways in: streams of runs and lines of checkpoint files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources.readers import complete_objects
from ..streaming.ingest import ingested


def streamed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each day after they came in as a stream, delivered twice or not."""
    path = f"{sf}/all_edge_pair_results.parquet"
    runs = ingested(spark, path, spark.read.parquet(path).schema, ["result_id"], "ingested_at", "3650 days")
    return runs.groupBy(F.date_format("finished_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("runs"), F.countDistinct("census_slice").alias("slices"))


def checkpoint_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Per checkpoint file its lines by state, and whether a broken line comes before the last."""
    lines = complete_objects(table(spark, sf, "census_records"), "record_json")
    last = F.max(F.struct("line_no", "state"))
    agg = lines.groupBy("source_file").agg(
        F.count("*").alias("lines"), F.count_if(F.col("state") == "object").alias("objects"), F.count_if(F.col("state") == "broken").alias("broken"),
        F.count_if(F.col("state") == "blank").alias("blank"), last.alias("last"),
    )
    return agg.select("source_file", "lines", "objects", "broken", "blank", (F.col("broken") > F.when(F.col("last.state") == "broken", 1).otherwise(0)).alias("broken_before_end"))


QUERIES = {"streamed_runs": streamed_runs, "checkpoint_lines": checkpoint_lines}
SQL = {
    "streamed_runs": "SELECT strftime(finished_at, '%Y-%m-%d') AS day, count(*) AS runs, count(DISTINCT census_slice) AS slices FROM (SELECT result_id, any_value(finished_at) AS finished_at, any_value(census_slice) AS census_slice FROM all_edge_pair_results GROUP BY 1) GROUP BY 1",
    "checkpoint_lines": """
WITH c AS (SELECT source_file, line_no, trim(record_json, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) AS t FROM census_records),
s AS (SELECT source_file, line_no, CASE WHEN coalesce(t, '') = '' THEN 'blank' WHEN json_valid(t) AND t[1] = '{' THEN 'object' ELSE 'broken' END AS state FROM c)
SELECT source_file, count(*) AS lines, count(*) FILTER (state = 'object') AS objects, count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'blank') AS blank,
  count(*) FILTER (state = 'broken') > CASE WHEN max({'l': line_no, 's': state}).s = 'broken' THEN 1 ELSE 0 END AS broken_before_end FROM s GROUP BY 1""",
}
