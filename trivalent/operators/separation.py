"""Separation of ordered edge pairs by families of cycles: coverage, covers, packings, exact minima.

A cycle separates (e, f) if it holds e and not f. Edges with equal signatures (the set of cycles that
hold them) behave alike, so all work is on classes of edges: a pair of classes (A, B) stands for
nA*nB pairs, separated by exactly the cycles of A \\ B. All graphs are done at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize


def signature_classes(cycle_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, signature, members): classes of edges by the sorted ids of the cycles that hold them.

    ``cycle_edges`` has (graph, cycle_id, u, v), ``edges`` (graph, u, v) every edge of the graph once.
    """
    own = cycle_edges.groupBy("graph", "u", "v").agg(F.array_sort(F.collect_set("cycle_id")).alias("signature"))
    every = edges.select("graph", "u", "v").distinct().join(own, ["graph", "u", "v"], "left")
    kind = cycle_edges.schema["cycle_id"].dataType.simpleString()
    return every.groupBy("graph", F.coalesce("signature", F.array().cast(f"array<{kind}>")).alias("signature")).agg(F.count("*").alias("members"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """(graph, a, b, pairs, support): ordered pairs of classes, with the number of edge pairs and the cycles that separate them."""
    b = classes.select("graph", F.col("signature").alias("b"), F.col("members").alias("nb"))
    joined = classes.select("graph", F.col("signature").alias("a"), F.col("members").alias("na")).join(b, "graph")
    pairs = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb"))
    return joined.select("graph", "a", "b", pairs.alias("pairs"), F.array_except("a", "b").alias("support")).where("pairs > 0")


def coverage(pairs: DataFrame) -> DataFrame:
    """(graph, required_pairs, separated_pairs, separating): whether every ordered pair has its cycle."""
    agg = pairs.groupBy("graph").agg(F.sum("pairs").alias("required_pairs"), F.sum(F.when(F.size("support") > 0, F.col("pairs")).otherwise(0)).alias("separated_pairs"))
    return agg.withColumn("separating", F.col("required_pairs") == F.col("separated_pairs"))


def antichain(classes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(graph, edges, distinct_signatures, equal_pairs, nested_pairs, antichain) of the edge signatures; ``pairs`` are the ``class_pairs``, if known."""
    size = classes.groupBy("graph").agg(F.sum("members").alias("edges"), F.count("*").alias("distinct_signatures"), F.sum(F.col("members") * (F.col("members") - 1) / 2).cast("bigint").alias("equal_pairs"))
    bad = (class_pairs(classes) if pairs is None else pairs).where((F.size("support") == 0) & (F.col("a") != F.col("b"))).groupBy("graph").agg(F.sum("pairs").alias("nested_pairs"))
    out = size.join(bad, "graph", "left").withColumn("nested_pairs", F.coalesce("nested_pairs", F.lit(0)))
    return out.withColumn("antichain", (F.col("equal_pairs") == 0) & (F.col("nested_pairs") == 0))


def greedy_cover(pairs: DataFrame) -> DataFrame:
    """(graph, step, cycle_id, gain): in each step the cycle that separates most pairs left, the lowest id among equals.

    One step of every graph a round. Pairs that no cycle separates are passed over.
    """
    left = materialize(pairs.where("size(support) > 0").select("graph", "pairs", "support"), "left")
    picked, step = None, 0
    while not left.isEmpty():
        step += 1
        gains = left.select("graph", "pairs", F.explode("support").alias("cycle_id")).groupBy("graph", "cycle_id").agg(F.sum("pairs").alias("gain"))
        best = materialize(gains.groupBy("graph").agg(F.max_by(F.struct("cycle_id", "gain"), F.struct("gain", -F.col("cycle_id"))).alias("b")).select("graph", F.lit(step).alias("step"), "b.*"), "best")
        picked = best if picked is None else picked.unionByName(best)
        last, left = left, materialize(left.join(best.select("graph", "cycle_id"), "graph").where(~F.array_contains("support", F.col("cycle_id"))).drop("cycle_id"), "left")
        discard(last)
    return picked if picked is not None else pairs.select("graph", F.lit(0).alias("step"), F.lit(0).alias("cycle_id"), "pairs").limit(0)


def minimal_supports(pairs: DataFrame) -> DataFrame:
    """(graph, support): inclusion-minimal supports; covering these covers all."""
    s = materialize(pairs.select("graph", "support").where("size(support) > 0").distinct(), "supports")
    t = s.select("graph", F.col("support").alias("inner"))
    beaten = s.join(t, "graph").where((F.size("inner") < F.size("support")) & (F.size(F.array_except("inner", "support")) == 0)).select("graph", "support").distinct()
    return s.join(beaten, ["graph", "support"], "left_anti")


def greedy_packing(pairs: DataFrame) -> DataFrame:
    """(graph, support): pairwise disjoint supports, taken by rising (size, support): a lower bound of every cover.

    Each round takes all supports that come first among those they meet, which gives what a scan one by one gives.
    """
    s = minimal_supports(pairs).withColumn("rank", F.row_number().over(Window.partitionBy("graph").orderBy(F.size("support"), "support")))
    left = materialize(s, "packing")
    taken = None
    while not left.isEmpty():
        each = left.select("graph", "rank", "support", F.explode("support").alias("c"))
        first = each.groupBy("graph", "c").agg(F.min("rank").alias("first"))
        lead = each.join(first, ["graph", "c"]).groupBy("graph", "rank", "support").agg(F.max(F.col("rank") - F.col("first")).alias("behind")).where("behind = 0").select("graph", "rank", "support")
        lead = materialize(lead, "lead")
        taken = lead if taken is None else taken.unionByName(lead)
        used = lead.select("graph", F.explode("support").alias("c")).groupBy("graph").agg(F.collect_set("c").alias("used"))
        last, left = left, materialize(left.join(used, "graph", "left").where(F.col("used").isNull() | ~F.arrays_overlap("support", "used")).drop("used"), "packing")
        discard(last)
    return (taken if taken is not None else left).select("graph", "support")


def minimum_cover(pairs: DataFrame, most: int = 20_000_000) -> DataFrame:
    """(graph, cover_size, cover): a smallest family of cycles that meets every support; exact.

    A frontier of partial families of all graphs grows by one cycle a round: each family takes on, one
    by one, the cycles of the smallest support it doesn't meet, equal families are merged, and a graph is
    done in the first round in which a family meets all; no family outgrows the greedy cover. For
    universes of some tens of cycles: a frontier of more than ``most`` families is an error, as it would go on growing.
    Graphs with an unseparable pair have no row.
    """
    hopeless = pairs.where("size(support) = 0").select("graph").distinct()
    s = materialize(minimal_supports(pairs.join(hopeless, "graph", "left_anti")), "supports")
    upper = greedy_cover(pairs).groupBy("graph").agg(F.count("*").alias("upper"))
    kind = s.schema["support"].dataType.simpleString()
    now = materialize(s.select("graph").distinct().join(upper, "graph").select("graph", "upper", F.array().cast(kind).alias("family")), "family")
    done = None
    while not now.isEmpty():
        open_ = now.join(s, "graph").where(~F.arrays_overlap("family", "support"))
        next_ = open_.groupBy("graph", "upper", "family").agg(F.min(F.struct(F.size("support").alias("k"), "support")).alias("n"), F.count("*").alias("left"))
        met = materialize(now.join(next_.select("graph", "family"), ["graph", "family"], "left_anti").groupBy("graph").agg(F.min("family").alias("cover")), "met")
        done = met if done is None else done.unionByName(met)
        grown = next_.join(met.select("graph"), "graph", "left_anti").where(F.size("family") + 1 <= F.col("upper"))
        grown = grown.select("graph", "upper", F.explode("n.support").alias("c"), "family").select("graph", "upper", F.array_sort(F.concat("family", F.array("c"))).alias("family"))
        last, now = now, materialize(grown.distinct(), "family")
        discard(last)
        if (n := now.count()) > most:
            raise ValueError(f"{n} partial covers; the universe is too large for an exact cover")
    if done is None:
        done = s.select("graph", F.col("support").alias("cover")).limit(0)
    return done.select("graph", F.size("cover").alias("cover_size"), "cover")


def irredundant(cycle_members: DataFrame) -> DataFrame:
    """Of a covering family (graph, cycle_id, item) what is left when cycles are dropped, in rising order, while every item stays covered."""
    left = materialize(cycle_members.distinct(), "family")
    ids = left.select("graph", "cycle_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("graph").orderBy("cycle_id")))
    ids = materialize(ids, "ids")
    for k in range(1, (ids.agg(F.max("k")).first()[0] or 0) + 1):
        now = left.join(ids.where(F.col("k") == k).select("graph", "cycle_id"), ["graph", "cycle_id"])
        counts = left.groupBy("graph", "item").agg(F.count("*").alias("n"))
        free = now.join(counts, ["graph", "item"]).groupBy("graph", "cycle_id").agg(F.min("n").alias("n")).where("n >= 2")
        last, left = left, materialize(left.join(free.select("graph", "cycle_id"), ["graph", "cycle_id"], "left_anti"), "family")
        discard(last)
    return left.select("graph", "cycle_id").distinct()


def sperner_bound(edges: int) -> int:
    """Fewest cycles whose signatures can be an antichain of so many edges: least k with C(k, k//2) >= edges."""
    from math import comb

    k = 0
    while edges > 1 and comb(k, k // 2) < edges:
        k += 1
    return k


def witness_cover(supports: DataFrame) -> DataFrame:
    """(graph, step, item, cycle_id, certified): query by query, the least uncertified item gets its least cycle, which certifies all it can.

    ``supports`` has (graph, item, support): the cycles that certify an item. Items without a cycle are left
    uncertified; a graph is done when only such are left. One step of every graph a round.
    """
    left = materialize(supports.where("size(support) > 0").select("graph", "item", "support"), "uncertified")
    out, step = None, 0
    while not left.isEmpty():
        step += 1
        first = left.groupBy("graph").agg(F.min(F.struct("item", F.array_min("support").alias("cycle_id"))).alias("f")).select("graph", F.col("f.item").alias("first"), "f.cycle_id")
        hit = left.join(first, "graph").withColumn("hit", F.array_contains("support", F.col("cycle_id")))
        now = materialize(hit.where("hit").groupBy("graph", F.lit(step).alias("step"), F.col("first").alias("item"), "cycle_id").agg(F.count("*").alias("certified")), "witness")
        out = now if out is None else out.unionByName(now)
        last, left = left, materialize(hit.where(~F.col("hit")).select("graph", "item", "support"), "uncertified")
        discard(last)
    return out if out is not None else left.select("graph", F.lit(0).alias("step"), "item", F.array_min("support").alias("cycle_id"), F.lit(0).cast("bigint").alias("certified"))


def packing_summary(supports: DataFrame) -> DataFrame:
    """(graph, supports, members, distinct_members, largest, disjoint) of a family of supports (graph, support)."""
    size = supports.groupBy("graph").agg(F.count("*").alias("supports"), F.sum(F.size("support")).alias("members"), F.max(F.size("support")).alias("largest"))
    once = supports.select("graph", F.explode("support").alias("c")).groupBy("graph").agg(F.countDistinct("c").alias("distinct_members"))
    return size.join(once, "graph").withColumn("disjoint", F.col("members") == F.col("distinct_members"))
