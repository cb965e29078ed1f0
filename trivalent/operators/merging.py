"""Joins that must be complete, comparisons field by field, compositions by state, and the extremal fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import separation


def merge_faults(left: DataFrame, right: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """(key, fault) of a merge that should be one to one: twice on a side, missing on a side, or unequal in ``same``."""
    twice = lambda df, side: df.groupBy(*key).count().where("count > 1").select(*key, F.lit(f"twice {side}").alias("fault"))
    a = left.select(*key, F.struct(*same).alias("l"))
    b = right.select(*key, F.struct(*same).alias("r"))
    both = a.join(b, key, "full_outer")
    fault = F.when(F.col("r").isNull(), "missing right").when(F.col("l").isNull(), "missing left").when(~F.col("l").eqNullSafe(F.col("r")), "unequal")
    return both.select(*key, fault.alias("fault")).where("fault is not null").unionByName(twice(left, "left")).unionByName(twice(right, "right"))


def evidence(leaders: DataFrame, held: dict[str, DataFrame], key: str, single: tuple[str, ...] = ()) -> DataFrame:
    """(key, a count for each name, faults): how many rows every leader has in each of ``held``, and what it lacks.

    A fault is ``no <name>`` where there is none, and ``several <name>`` where there is more than one of what should be ``single``. Leaders count once.
    """
    out = leaders.select(key).distinct()
    for name, df in held.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    told = [F.when(F.col(n) == 0, F.lit(f"no {n}")).when((F.col(n) > 1) & F.lit(n in single), F.lit(f"several {n}")) for n in held]
    return out.withColumn("faults", F.array_join(F.filter(F.array(*told), lambda f: f.isNotNull()), ", "))


def compare_fields(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], differ: Column) -> DataFrame:
    """(key, field, left, right): one row for each numeric field that differs by the rule ``differ`` over left and right.

    Keys on one side only take no part; a null differs from any value.
    """
    tall = lambda df, name: df.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("x")).select(*key, "x.field", F.col("x.v").alias(name))
    joined = tall(left, "left").join(tall(right, "right"), [*key, "field"])
    return joined.where(F.coalesce(differ, ~F.col("left").eqNullSafe(F.col("right"))))


def splice(left: DataFrame, right: DataFrame, cut: DataFrame) -> DataFrame:
    """(graph, state, edges): cycles of two sides joined on the port they leave out, with the cut edges of the other ports.

    Sides have (graph, state, edges array<struct<u,v>>), the right one with its vertices already moved
    beyond the left's; ``cut`` has (graph, port, u, v).
    """
    bridge = cut.select("graph", "port", F.struct("u", "v").alias("e"))
    spans = cut.select("graph", F.col("port").alias("state")).distinct().join(bridge, "graph").where("port <> state").groupBy("graph", "state").agg(F.collect_set("e").alias("bridge"))
    both = left.select("graph", "state", F.col("edges").alias("a")).join(right.select("graph", "state", F.col("edges").alias("b")), ["graph", "state"]).join(spans, ["graph", "state"])
    return both.select("graph", "state", F.array_sort(F.array_union(F.array_union("a", "b"), "bridge")).alias("edges"))


def compatible_states(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of four-port states (used ports, pairing) that close to one cycle: equal ports, and unequal pairings if all four are used."""
    r = right.select("graph", F.col("used").alias("used_r"), F.col("pairing").alias("pairing_r"), F.col("forests").alias("forests_r"))
    pairs = left.join(r, "graph").where(F.col("used") == F.col("used_r"))
    return pairs.where((F.size("used") == 2) | (F.col("pairing") != F.col("pairing_r"))).select("graph", "used", "pairing", "pairing_r", (F.col("forests") * F.col("forests_r")).alias("cycles"))


def verdicts(constraints: DataFrame, universe: DataFrame) -> DataFrame:
    """(graph, constraints, satisfied, holds, hardest): whether every constraint has its cycle, and the one with fewest.

    ``constraints`` has (graph, constraint_id, required, forbidden), ``universe`` (graph, selected): edge sets of all
    cycles. The property holds where no constraint is without a cycle; ties of the hardest go to the lesser id.
    """
    ok = (F.size(F.array_except("required", "selected")) == 0) & ~F.arrays_overlap("forbidden", "selected")
    met = constraints.join(universe, "graph", "left").groupBy("graph", "constraint_id").agg(F.count_if(ok).alias("cycles"))
    agg = met.groupBy("graph").agg(F.count("*").alias("constraints"), F.count_if(F.col("cycles") > 0).alias("satisfied"), F.min(F.struct("cycles", "constraint_id")).alias("h"))
    return agg.select("graph", "constraints", "satisfied", (F.col("constraints") == F.col("satisfied")).alias("holds"), F.col("h.constraint_id").alias("hardest"))


def extremal(pairs: DataFrame) -> DataFrame:
    """(graph, upper, exact): all graphs whose exact cover size can't be ruled out as the largest, resolved.

    Every graph has its greedy cover as an upper bound. The graphs of the largest bound are resolved exactly; those
    whose bound reaches the best exact value so far come next, until none is pending. Others keep a null.
    """
    upper = materialize(separation.greedy_cover(pairs).groupBy("graph").agg(F.count("*").alias("upper")), "upper")
    bound = upper.agg(F.max("upper")).first()[0]
    known: list[DataFrame] = []
    pending = upper.where(F.col("upper") == bound)
    while bound is not None and not pending.isEmpty():
        known.append(materialize(separation.minimum_cover(pairs.join(pending.select("graph"), "graph", "left_semi")).select("graph", F.col("cover_size").alias("exact")), "exact"))
        every = reduce(DataFrame.unionByName, known)
        best = every.agg(F.max("exact")).first()[0]
        pending = upper.where(F.col("upper") >= best).join(every.select("graph"), "graph", "left_anti")
    done = reduce(DataFrame.unionByName, known) if known else upper.select("graph", F.col("upper").alias("exact")).limit(0)
    return upper.join(done, "graph", "left")


def config_signature(options: dict) -> str:
    """sha256 of logical options by name; a resumed run must have the same."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
