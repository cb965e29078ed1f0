"""The two copies of the reviewed bundles and review constraints, compared by reconciliation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import edge_set, norm_hash, text_set
from ..functions.records import canonical, differing_paths
from .reconcile import reconcile

LIST_FIELDS = ["planar_code_paths", "embedding_paths", "report_paths", "leaderboard_categories"]
COLUMNS = "dataset string, graph_hash string, constraint_index int, field_name string, diff_kind string"


@F.pandas_udf(T.BinaryType())
def _record_digest(text: pd.Series) -> pd.Series:
    """Of a record's one form; 128 bits, so that the record's text needn't come back from Python."""
    return text.map(lambda t: blake2b(canonical(t, "original_record").encode(), digest_size=16).digest())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _record_paths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([differing_paths(x, y, "original_record") for x, y in zip(a, b)])


def _rows(diff: DataFrame, dataset: str, fields: list[str]) -> DataFrame:
    """One row per difference; a key on one side only has the empty field name."""
    both = F.col("p").isNotNull() & F.col("m").isNotNull()
    plain = [F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in fields]
    names = F.filter(F.array(*plain), lambda x: x.isNotNull())
    if dataset == "bundle":
        names = F.concat(names, F.when(both, F.col("paths")).otherwise(F.array().cast("array<string>")))
    one_sided = F.array(F.struct(F.lit("").alias("field_name"), F.when(F.col("m").isNull(), "only_primary").otherwise("only_mirror").alias("diff_kind")))
    listed = F.transform(names, lambda n: F.struct(n.alias("field_name"), F.lit("differs").alias("diff_kind")))
    return diff.select("graph_hash", "constraint_index", F.explode(F.when(both, listed).otherwise(one_sided)).alias("d")).select(
        F.lit(dataset).alias("dataset"), "graph_hash", F.col("constraint_index").cast("int").alias("constraint_index"), "d.field_name", "d.diff_kind"
    )


def bundle_differences(primary: DataFrame, mirror: DataFrame) -> DataFrame:
    """Differences of two copies of the artifact bundles.

    Per copy and hash the latest row counts. List fields are sets, null being the empty set; a
    record that isn't JSON is compared as one text under ``original_record``; a null record has no
    members. Rows with a null hash are one key of their own. Extra columns are ignored.
    """

    def side(df: DataFrame) -> DataFrame:
        return df.select(norm_hash("graph_hash").alias("graph_hash"), F.lit(-1).alias("constraint_index"), *[text_set(c).alias(c) for c in LIST_FIELDS], "original_record", "copied_at")

    content = F.struct(F.to_json(F.struct(*LIST_FIELDS)), _record_digest("original_record"))
    diff = reconcile(side(primary), side(mirror), ["graph_hash", "constraint_index"], content, "copied_at", "bundles")
    return _rows(diff.withColumn("paths", _record_paths("p.original_record", "m.original_record")), "bundle", LIST_FIELDS)


def constraint_differences(constraints: DataFrame) -> DataFrame:
    """Differences of the two copies in one table of review constraints, told apart by ``held_by``.

    Edge lists are sets of undirected edges, null being the empty set. Rows of another holder are
    no copy and are left out. Null keys are values. Extra columns are ignored.
    """
    wanted = constraints.select(
        F.lower(F.trim("held_by")).alias("side"), norm_hash("graph_hash").alias("graph_hash"), "constraint_index",
        "analysis", edge_set("required_edges").alias("required_edges"), edge_set("forbidden_edges").alias("forbidden_edges"), "copied_at",
    )
    sides = [wanted.where(F.col("side") == s).drop("side") for s in ("primary", "mirror")]
    content = F.to_json(F.struct("analysis", "required_edges", "forbidden_edges"), {"ignoreNullFields": "false"})
    diff = reconcile(*sides, ["graph_hash", "constraint_index"], content, "copied_at", "constraints")
    return _rows(diff, "constraint", ["analysis", "required_edges", "forbidden_edges"])


def copy_differences(primary: DataFrame, mirror: DataFrame, constraints: DataFrame) -> DataFrame:
    """All differences of both datasets in the columns of ``COLUMNS``; the two are reconciled side by side."""
    with ThreadPoolExecutor(2) as pool:
        bundles, edges = pool.submit(bundle_differences, primary, mirror), pool.submit(constraint_differences, constraints)
        return bundles.result().unionByName(edges.result())
