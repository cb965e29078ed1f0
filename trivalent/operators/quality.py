"""Audits: constraints, completeness, contiguity, identity of sets, provenance, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule): one row for each rule that a row breaks; a rule that comes to null is broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def is_close(a: Column, b: Column, rel: float = 1e-12, abs_tol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))


def face_multiset_rules(faces: str, order: str, edges: str) -> dict[str, Column]:
    """A face multiset of a plane cubic bipartite graph: rising, m-n+2 faces, even sizes from 4, twice the edges in all."""
    f = F.col(faces)
    return {
        "faces_sorted": F.array_sort(f) == f,
        "face_count": F.size(f) == F.col(edges) - F.col(order) + 2,
        "face_sizes": F.forall(f, lambda x: (x >= 4) & (x % 2 == 0)),
        "face_sum": F.aggregate(f, F.lit(0).cast("bigint"), lambda a, x: a + x) == 2 * F.col(edges),
    }


def analysis_rules() -> dict[str, Column]:
    """Cross-field rules of one all-edge-pair run."""
    c = F.col
    pairs = c("edge_count") * (c("edge_count") - 1)
    times = ["median_query_time_seconds", "p95_query_time_seconds", "p99_query_time_seconds", "maximum_query_time_seconds"]
    rising = c(times[0]) <= c(times[1])
    for a, b in zip(times[1:], times[2:]):
        rising &= c(a) <= c(b)
    return {
        "cubic_edges": 2 * c("edge_count") == 3 * c("graph_order"),
        "pair_count": c("total_ordered_edge_pairs") == pairs,
        "witness_count": c("number_of_witness_cycles").between(1, c("number_of_constrained_sat_calls")),
        "cover_ratio": is_close(c("witness_cover_ratio"), F.try_divide(c("number_of_witness_cycles"), c("total_ordered_edge_pairs")), 1e-9),
        "average_pairs": is_close(c("average_pairs_certified_per_witness"), F.try_divide(c("total_ordered_edge_pairs"), c("number_of_witness_cycles")), 1e-9),
        "maximum_pairs": c("maximum_pairs_certified_by_one_witness").between(1, c("total_ordered_edge_pairs")),
        "times_rise": rising & (c(times[0]) >= 0),
        "agreements": c("backtracking_agreements") <= c("backtracking_queries"),
        "hash_shape": F.lower(F.trim("canonical_graph_hash")).rlike("^[0-9a-f]{64}$"),
        "hardest_pair": (F.size("hardest_ordered_pair") == 2) & F.forall("hardest_ordered_pair", lambda e: F.size(e) == 2),
    }


def contiguity(df: DataFrame, groups: list[str], index: str) -> DataFrame:
    """(groups, rows, distinct, lowest, highest, contiguous): whether an index runs without gap or repetition."""
    agg = df.groupBy(*groups).agg(F.count("*").alias("rows"), F.countDistinct(index).alias("distinct_values"), F.min(index).alias("lowest"), F.max(index).alias("highest"))
    ok = (F.col("rows") == F.col("distinct_values")) & (F.col("highest") - F.col("lowest") + 1 == F.col("rows"))
    return agg.withColumn("contiguous", F.coalesce(ok, F.lit(False)))


def gaps(df: DataFrame, groups: list[str], index: str) -> DataFrame:
    """(groups, gap_from, gap_to): missing stretches between the values of an index."""
    once = df.select(*groups, index).where(F.col(index).isNotNull()).distinct()
    after = F.lead(index).over(Window.partitionBy(*groups).orderBy(index))
    return once.withColumn("next__", after).where(F.col("next__") > F.col(index) + 1).select(*groups, (F.col(index) + 1).alias("gap_from"), (F.col("next__") - 1).alias("gap_to"))


def duplicates(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that occur more than once; a null key isn't one."""
    return df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("copies")).where("copies > 1")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, held_by): keys that one side has and the other hasn't; null is a key."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.exceptAll(right).withColumn("held_by", F.lit("left")).unionByName(right.exceptAll(left).withColumn("held_by", F.lit("right")))


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Resume: what isn't done yet."""
    return todo.join(done.select(*key), key, "left_anti")


def completeness(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, actual, expected) where a count differs from the reference count, a missing side being 0."""
    both = counts.join(expected, key, "full_outer").select(key, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("actual <> expected")


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, values, constant): provenance columns should hold one value in all rows."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("s")
    return df.select(parts).groupBy(F.col("s.column").alias("column")).agg(F.countDistinct(F.coalesce("s.v", F.lit("\0"))).alias("values")).withColumn("constant", F.col("values") <= 1)
