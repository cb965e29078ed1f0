"""Readers: planar_code as a data source, graph6, JSON lines and their checkpoints, CSV."""

from __future__ import annotations

import glob as globbing
import io
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .codecs import decode_graph6, decode_planar, encode_graph6, encode_planar

ROTATION = "file string, index long, rotation array<array<int>>"
_NESTED = T.ArrayType(T.ArrayType(T.IntegerType()))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _PlanarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(p for part in options["path"].split(",") for p in (globbing.glob(f"{part}/*") if os.path.isdir(part) else globbing.glob(part)))
        self.require = options.get("requireHeader", "false").lower() == "true"

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for k, rows in enumerate(decode_planar(f, self.require)):
                yield partition.path, k, rows


class PlanarCodeSource(DataSource):
    """``spark.read.format("planar_code").load(path)``: one partition a file, on a file system all executors see.

    A file is read as a stream of any length: its records have no marks that a reader could begin at, so it can't be parted.
    """

    @classmethod
    def name(cls) -> str:
        return "planar_code"

    def schema(self) -> str:
        return ROTATION

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PlanarReader(self.options)


def read_planar(spark: SparkSession, path: str, require_header: bool = False) -> DataFrame:
    """(file, index, rotation) of planar_code files anywhere Spark can read; files of at most 2 GB, which a row can hold."""

    @F.pandas_udf(T.ArrayType(_NESTED))
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: list(decode_planar(io.BytesIO(b), require_header)))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.posexplode(decode("content")).alias("index", "rotation"))


@F.pandas_udf(T.BinaryType())
def planar_bytes(rotation: pd.Series) -> pd.Series:
    """planar_code record of a rotation column, without header."""
    return rotation.map(lambda r: None if r is None else encode_planar([list(map(int, row)) for row in r]))


def planar_text(rotation: str) -> Column:
    """Text form of a rotation: order, then neighbour lists from 1, each ended by 0."""
    row = lambda r: F.concat_ws(" ", F.transform(r, lambda w: (w + 1).cast("string")), F.lit("0"))
    return F.concat_ws(" ", F.size(rotation).cast("string"), F.transform(F.col(rotation), row))


@F.pandas_udf(T.StructType([T.StructField("order", T.IntegerType()), T.StructField("edges", _NESTED)]))
def _graph6(lines: pd.Series) -> pd.DataFrame:
    decoded = [decode_graph6(s) for s in lines]
    return pd.DataFrame({"order": [n for n, _ in decoded], "edges": [[list(e) for e in es] for _, es in decoded]})


def graph6_edges(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(graph, order, u, v) of a column of graph6 lines; a line without edges gives one row of null ends."""
    g = lines.select(F.col(key).alias("graph"), _graph6(text).alias("g"))
    return g.select("graph", "g.order", F.explode_outer("g.edges").alias("e")).select("graph", "order", F.get("e", F.lit(0)).alias("u"), F.get("e", F.lit(1)).alias("v"))


@F.pandas_udf(T.StringType())
def graph6_line(order: pd.Series, edges: pd.Series) -> pd.Series:
    return pd.Series([encode_graph6(int(n), [tuple(map(int, e)) for e in es]) for n, es in zip(order, edges)])


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, plain or gz; blank lines are skipped, any other bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def complete_objects(lines: DataFrame, text: str = "value") -> DataFrame:
    """``lines`` with ``state``: blank, broken or object; a byte order mark before the object means nothing."""
    clean = F.btrim(F.col(text), F.lit(" \t\r\n﻿"))
    parsed = F.try_parse_json(clean)
    state = F.when(F.coalesce(clean, F.lit("")) == "", "blank").when(parsed.isNull() | ~clean.startswith("{"), "broken").otherwise("object")
    return lines.withColumn("state", state)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of checkpoint files: a broken last line without line end is passed over, any other is an error.

    Files are read whole lines at a time by Spark; the last line of each file is found by its position.
    """
    lines = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    last = numbered.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    marked = complete_objects(numbered.join(last, "file")).withColumn("is_last", F.struct("block", "at") == F.col("last"))
    bad = (F.col("state") == "broken") & ~F.col("is_last")
    told = F.raise_error(F.concat(F.lit("broken line in "), F.col("file"))).cast("boolean")
    kept = marked.where(F.when(bad, told).otherwise(F.col("state") == "object"))
    return kept.select("file", F.from_json("value", schema).alias("r")).select("file", "r.*")


def find_one(df: DataFrame, column: str, value: str) -> DataFrame:
    """The one row whose text in ``column`` is ``value``, without case and blanks; none or several are an error when the row is read."""
    hit = df.where(F.lower(F.btrim(F.col(column))) == value.strip().lower())
    one = hit.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("r"))
    told = F.raise_error(F.concat(F.lit(f"rows of {value}: "), F.col("n").cast("string"))).cast("boolean")
    return one.where(F.when(F.col("n") != 1, told).otherwise(True)).select("r.*")


def load_graphs(spark: SparkSession, source: str | os.PathLike) -> DataFrame:
    """Graphs from a path, by its ending (.g6, .jsonl and .jsonl.gz, .csv, .parquet, else planar_code), or, from a text that is no path, its graph6 line."""
    if isinstance(source, str):
        return graph6_edges(spark.createDataFrame([(source.strip(), source.strip())], "graph string, line string"), "graph", "line")
    path = os.fspath(source)
    if path.endswith(".g6"):
        lines = spark.read.text(path).where("value <> '' and not value like '>>%'")
        return graph6_edges(lines.select(F.col("value").alias("graph"), "value"), "graph", "value")
    if path.endswith((".jsonl", ".jsonl.gz", ".json")):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_planar(spark, path)


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; an empty field is null, ``True`` is true and any other flag false."""
    want = T._parse_datatype_string(schema)
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in want])).csv(path)
    filled = lambda n: F.nullif(F.col(n), F.lit(""))
    return raw.select(*[(filled(f.name) == "True").alias(f.name) if isinstance(f.dataType, T.BooleanType) else filled(f.name).cast(f.dataType).alias(f.name) for f in want])
