"""Hamiltonian cycles and perfect matchings as frontiers of partial solutions, extended by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cycle_edges, norm_edge, open_cycle
from ..session import materialize
from .graph import components, normalized, vertices

WRITE_EVERY = 4


def _arcs(edges: DataFrame) -> DataFrame:
    e = normalized(edges).where("u <> v").select("graph", "u", "v")
    return e.unionByName(e.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))


def hamiltonian_cycles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, cycle): every Hamiltonian cycle once, open, from the least vertex, second below last.

    Partial paths of all graphs grow together, one vertex a round; graphs of fewer than three vertices have none.
    """
    ns = vertices(edges) if nodes is None else nodes.select("graph", "node").distinct()
    size = materialize(ns.groupBy("graph").agg(F.min("node").alias("s"), F.count("*").alias("n")).where("n >= 3"), "sizes")
    arcs = materialize(_arcs(edges), "arcs")
    most = size.agg(F.max("n")).first()[0] or 0
    paths = size.select("graph", "n", F.array("s").alias("path"), F.col("s").alias("u"))
    done = None
    for k in range(1, most):
        grown = paths.join(arcs, ["graph", "u"]).where(~F.array_contains("path", F.col("v")))
        paths = grown.select("graph", "n", F.concat("path", F.array("v")).alias("path"), F.col("v").alias("u"))
        if k % WRITE_EVERY == 0 or k == most - 1:
            paths = materialize(paths, "paths")
        whole = paths.where(F.col("n") == k + 1)
        done = whole if done is None else done.unionByName(whole)
        paths = paths.where(F.col("n") > k + 1)
    if done is None:
        return ns.select("graph", F.array("node").alias("cycle")).limit(0)
    back = arcs.select("graph", "u", F.col("v").alias("first"))
    closed = done.withColumn("first", F.get("path", F.lit(0))).join(back, ["graph", "u", "first"])
    return closed.where(F.get("path", F.lit(1)) < F.col("u")).select("graph", F.col("path").alias("cycle"))


def perfect_matchings(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, matching): every perfect matching once, as a sorted array of edges; the lowest free vertex is matched next."""
    ns = vertices(edges) if nodes is None else nodes.select("graph", "node").distinct()
    free = ns.groupBy("graph").agg(F.array_sort(F.collect_list("node")).alias("free")).where("size(free) % 2 = 0")
    arcs = materialize(_arcs(edges), "arcs")
    now = materialize(free.select("graph", "free", F.array().cast(f"array<struct<u:{ns.schema['node'].dataType.simpleString()},v:{ns.schema['node'].dataType.simpleString()}>>").alias("matching")), "matching")
    done = now.where("size(free) = 0")
    while not now.where("size(free) > 0").isEmpty():
        grown = now.where("size(free) > 0").withColumn("u", F.get("free", F.lit(0))).join(arcs, ["graph", "u"]).where(F.array_contains("free", F.col("v")))
        now = materialize(grown.select("graph", F.array_except("free", F.array("u", "v")).alias("free"), F.concat("matching", F.array(norm_edge(F.col("u"), F.col("v")))).alias("matching")), "matching")
        done = done.unionByName(now.where("size(free) = 0"))
    return done.select("graph", F.array_sort("matching").alias("matching"))


def cycles_by_matchings(edges: DataFrame) -> DataFrame:
    """(graph, edges): Hamiltonian cycles of cubic graphs by another way: complements of perfect matchings that are connected."""
    e = normalized(edges).select("graph", F.struct("u", "v").alias("e"))
    whole = e.groupBy("graph").agg(F.collect_list("e").alias("every"))
    rest = perfect_matchings(edges).join(whole, "graph").select(F.struct("graph", "matching").alias("graph"), F.array_sort(F.array_except("every", "matching")).alias("edges"))
    loose = materialize(rest, "factors")
    apart = components(loose.select("graph", F.explode("edges").alias("e")).select("graph", "e.u", "e.v")).groupBy("graph").agg(F.countDistinct("component").alias("parts"))
    return loose.join(apart.where("parts = 1"), "graph").select(F.col("graph.graph").alias("graph"), "edges")


def certificate_hash(cycle: Column | str) -> Column:
    """sha256 of the compact JSON of a cycle's least spelling; null for what is no cycle."""
    return F.sha2(F.to_json(open_cycle(cycle)), 256)


def check_cycles(cycles: DataFrame, edges: DataFrame, orders: DataFrame) -> DataFrame:
    """``cycles`` (graph, cycle_id, cycle) with ``valid``: every vertex once and every step an edge.

    ``orders`` has (graph, order). Malformed cycles are invalid, not errors.
    """
    steps = cycles.select("graph", "cycle_id", F.explode(cycle_edges("cycle")).alias("e")).select("graph", "cycle_id", "e.u", "e.v")
    stray = steps.join(normalized(edges).select("graph", "u", "v"), ["graph", "u", "v"], "left_anti").select("graph", "cycle_id").distinct().withColumn("stray", F.lit(True))
    sized = cycles.join(orders, "graph", "left")
    shape = (F.size("cycle") == F.col("order")) & (F.size(F.array_distinct("cycle")) == F.col("order"))
    return sized.join(stray, ["graph", "cycle_id"], "left").select("graph", "cycle_id", "cycle", F.coalesce(shape & F.col("stray").isNull(), F.lit(False)).alias("valid"))


def satisfies(selected: Column, required: Column, forbidden: Column) -> Column:
    """Whether a cycle's edges hold all required and no forbidden edge; null sets are empty."""
    r, f = F.coalesce(required, F.array()), F.coalesce(forbidden, F.array())
    return (F.size(F.array_except(r, selected)) == 0) & ~F.coalesce(F.arrays_overlap(f, selected), F.lit(False))
