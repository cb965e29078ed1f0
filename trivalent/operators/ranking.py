"""Leaderboards, strata, controls and other deterministic selections; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import join_groups, tie_ranks, to_long


def leaderboards(df: DataFrame, key: str, metrics: list[str], top_k: int, groups: list[str] | None = None) -> DataFrame:
    """(groups, metric, place, key, value): the ``top_k`` largest values of each metric, ties by rising key.

    Spark limits each partition's groups before the shuffle, so few rows move. Nulls and NaN don't take part.
    """
    long = to_long(df, [*(groups or []), key], metrics).where(F.col("value").isNotNull() & ~F.isnan("value"))
    order = Window.partitionBy(*(groups or []), "metric").orderBy(F.desc("value"), F.asc(key))
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)


def stratified(strata: list[tuple[str, int, DataFrame]], key: str) -> DataFrame:
    """Union of ranked strata (code, priority, frame of key and position), each key once.

    Every reason is kept, in the order of priority and position; keys are ordered by their best reason.
    """
    parts = [f.select(key, F.struct(F.lit(priority).alias("priority"), F.col("position").cast("long").alias("position"), F.lit(code).alias("code")).alias("reason")) for code, priority, f in strata]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return grouped.select(key, F.get("reasons", F.lit(0))["priority"].alias("best_priority"), F.get("reasons", F.lit(0))["position"].alias("best_position"), F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"))


def jitter(df: DataFrame, at: list[str], key: str, step: float) -> DataFrame:
    """Centred offsets of rows that share a place: (position - (count - 1) / 2) * step, by rising key.

    Rows of equal key share their mean position; a place that very many rows share is spread over tasks.
    """
    ranks = tie_ranks(df, at, key).select(*at, key, F.col("less").alias("l__"), F.col("equal").alias("e__"), F.col("n").alias("n__"))
    offset = (F.col("l__") + (F.col("e__") - 1) / 2.0 - (F.col("n__") - 1) / 2.0) * step
    return join_groups(df, ranks, [*at, key]).select(*df.columns, offset.alias("offset"))


def audit_sample(df: DataFrame, groups: list[str], key: str, seed: str, size: int, whole_up_to: int) -> DataFrame:
    """A repeatable sample: groups of at most ``whole_up_to`` rows whole, else first, last and ``size`` by hash."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in groups], F.col(key).cast("string")), 256)
    order = Window.partitionBy(*groups).orderBy("h__", key)
    picked = df.withColumn("h__", h).withColumn("r__", F.row_number().over(order)).where(F.col("r__") <= size).select(*df.columns)
    spans = df.groupBy(*groups).agg(F.count("*").alias("c__"), F.min(key).alias("a__"), F.max(key).alias("z__"))
    ends = join_groups(df, spans, groups).where((F.col("c__") <= whole_up_to) | (F.col(key) == F.col("a__")) | (F.col(key) == F.col("z__"))).select(*df.columns)
    return picked.unionByName(ends).distinct()


def pruned(df: DataFrame, cap: str, cost: str, key: str, per_cap: int, overall: int) -> DataFrame:
    """The cheapest ``per_cap`` rows of each cap together with the ``overall`` cheapest of all."""
    best = df.withColumn("r__", F.row_number().over(Window.partitionBy(cap).orderBy(cost, key))).where(F.col("r__") <= per_cap).drop("r__")
    return best.unionByName(df.orderBy(cost, key).limit(overall)).distinct()


def largest_gaps(df: DataFrame, gap: str, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows of the largest gap, equal ones by rising ``ties``; rows without a gap take no part."""
    return df.where(F.col(gap).isNotNull()).orderBy(F.desc(gap), *[F.asc_nulls_first(t) for t in ties]).limit(n)


def best_sequence(candidates: DataFrame, moves: DataFrame) -> DataFrame:
    """(group, cost, choices): per group one candidate a stage, the cheapest in all; equal costs go to the lesser choices.

    ``candidates`` has (group, stage from 0, name, cost), ``moves`` (group, stage, name, next, cost) what it takes to go on.
    """
    from ..session import materialize

    stages = candidates.agg(F.max("stage")).first()[0]
    now = candidates.where("stage = 0").select("group", "name", F.struct(F.col("cost").alias("cost"), F.array("name").alias("choices")).alias("best"))
    for k in range(1, (stages or 0) + 1):
        step = moves.where(F.col("stage") == k - 1).select("group", "name", "next", F.col("cost").alias("move"))
        own = candidates.where(F.col("stage") == k).select("group", F.col("name").alias("next"), F.col("cost").alias("own"))
        grown = now.join(step, ["group", "name"]).join(own, ["group", "next"])
        total = F.struct((F.col("best.cost") + F.col("move") + F.col("own")).alias("cost"), F.concat("best.choices", F.array("next")).alias("choices"))
        now = materialize(grown.select("group", F.col("next").alias("name"), total.alias("b")).groupBy("group", "name").agg(F.min("b").alias("best")), "stage")
    return now.groupBy("group").agg(F.min("best").alias("b")).select("group", "b.cost", "b.choices")


def controls(df: DataFrame, key: str, picks: list[tuple[str, Column]]) -> DataFrame:
    """(code, key): for each pick in turn the least of its order among the rows not yet taken, ties by key."""
    taken: DataFrame | None = None
    for code, order in picks:
        rest = df if taken is None else df.join(taken.select(key), key, "left_anti")
        one = rest.agg(F.min_by(F.col(key), F.struct(order.alias("o"), F.col(key).alias("k"))).alias(key)).select(F.lit(code).alias("code"), key)
        taken = one if taken is None else taken.unionByName(one)
    return taken
