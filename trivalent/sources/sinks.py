"""Writers; Spark's commit protocol makes each atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """One canonical JSON text a row: columns by name, null members left out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_json_lines(df: DataFrame, path: str, order: list[str], gz: bool = True) -> None:
    """Range-sorted JSON lines; the parts read in turn are in order."""
    sorted_json(df.orderBy(*order)).write.option("compression", "gzip" if gz else "none").text(path)


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-free digest of a frame of any size, equal for equal multisets of rows."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("digest"))


def write_csv(df: DataFrame, path: str, columns: list[str], partition_by: list[str] | None = None) -> None:
    """A fixed list of columns, absent ones blank; a folder for each value of ``partition_by``."""
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    w = df.select(*have).write.option("header", True).option("emptyValue", "").option("nullValue", "")
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, relative_path) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(F.sha2("content", 256).alias("sha256"), plain.substr(F.lit(len(path.rstrip("/")) + 2), F.length("path")).alias("relative_path"))


def manifest_faults(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(relative_path, fault): missing, unlisted, different, or leading out of the folder."""
    out = declared.where(F.col("relative_path").rlike(r"(^/|(^|/)\.\.(/|$))")).select("relative_path", F.lit("outside").alias("fault"))
    both = declared.withColumnRenamed("sha256", "declared").join(actual.withColumnRenamed("sha256", "actual"), "relative_path", "full_outer")
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "unlisted").when(F.col("actual") != F.col("declared"), "different")
    return both.select("relative_path", kind.alias("fault")).where("fault is not null").unionByName(out)


def dimacs(clauses: DataFrame, variables: int, count: int) -> DataFrame:
    """(value) lines of a DIMACS file from (clause array<int>); the head line first when sorted by ``line``."""
    head = clauses.sparkSession.createDataFrame([(f"p cnf {variables} {count}", -1)], "value string, line long")
    body = clauses.select(F.concat(F.concat_ws(" ", F.transform("clause", lambda x: x.cast("string"))), F.lit(" 0")).alias("value"), F.monotonically_increasing_id().alias("line"))
    return head.unionByName(body)
