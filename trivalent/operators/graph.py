"""Graphs as edge tables (graph, u, v): degrees, components, parity, connectivity, paths, validation.

Every operator works on all graphs of a table at once. Edges are undirected with repeats and loops allowed
unless said otherwise; isolated vertices come from a table of nodes (graph, node).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import norm_edge
from ..session import discard, materialize

#: The findings of ``validate`` in the words that records of them hold.
REASONS = ["graph has self-loops", "graph has parallel edges", "graph is not cubic", "graph is not bipartite", "graph is not 3-vertex-connected"]


def normalized(edges: DataFrame) -> DataFrame:
    """(graph, u, v, multiplicity) with u <= v; an edge with a null end is left out."""
    e = edges.where("u is not null and v is not null").select("graph", norm_edge(F.col("u"), F.col("v")).alias("e"))
    return e.groupBy("graph", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count("*").alias("multiplicity"))


def numbered(edges: DataFrame) -> DataFrame:
    """Dense edge ids from 0 by (u, v) within each graph."""
    from pyspark.sql import Window

    return edges.withColumn("edge_id", F.row_number().over(Window.partitionBy("graph").orderBy("u", "v")) - 1)


def parallel_edges(edges: DataFrame) -> DataFrame:
    return normalized(edges).where("multiplicity > 1")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, node, degree): a loop counts twice, repeats count each, nodes without an edge have 0."""
    ends = edges.select("graph", F.explode(F.array("u", "v")).alias("node")).where("node is not null")
    deg = ends.groupBy("graph", "node").agg(F.count("*").alias("degree"))
    if nodes is None:
        return deg
    return nodes.select("graph", "node").distinct().join(deg, ["graph", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, node, component): the least vertex that each vertex is connected with.

    Alternates large stars and small stars: in turn every vertex links its larger, then its smaller
    neighbours to the least one it knows, so the number of rounds grows with the logarithm of the size. Each round is
    written to the shared folder. Minima are combined before the shuffle, whatever a vertex's degree.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").select("graph", "u", "v")
    now = materialize(pairs.select("graph", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    mark = None
    while True:
        both = now.unionByName(now.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("graph", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, ["graph", "u"]).where(F.col("v") > F.col("u")).select("graph", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lows = large.groupBy("graph", "u").agg(F.min("v").alias("m"))
        small = large.join(lows, ["graph", "u"]).select("graph", F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, materialize(small.select("graph", "e.u", "e.v").where("u <> v").distinct(), "star")
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("graph", "u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    every = vertices(edges) if nodes is None else vertices(edges).unionByName(nodes.select("graph", "node")).distinct()
    roots = now.groupBy("graph", F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return every.join(roots, ["graph", "node"], "left").withColumn("component", F.coalesce("component", "node"))


def odd_cycles(edges: DataFrame) -> DataFrame:
    """(graph) of the graphs that aren't bipartite.

    In the double cover, where every edge joins copy 0 of one end with copy 1 of the other, a vertex
    reaches its own other copy exactly if it lies on an odd closed walk. A loop is one.
    """
    u0, u1, v0, v1 = (F.struct(F.col(c).alias("n"), F.lit(k).alias("copy")) for c in ("u", "v") for k in (0, 1))
    cover = edges.select("graph", F.explode(F.array(F.struct(u0.alias("u"), v1.alias("v")), F.struct(u1.alias("u"), v0.alias("v")))).alias("e")).select("graph", "e.u", "e.v")
    comp = components(cover)
    met = comp.groupBy("graph", "component", F.col("node.n").alias("n")).agg(F.countDistinct("node.copy").alias("copies"))
    return met.where("copies = 2").select("graph").distinct()


def cut_sets(edges: DataFrame, nodes: DataFrame, size: int = 2) -> DataFrame:
    """(graph, removed): vertex sets of at most ``size`` (0 to 2) whose removal leaves more than one component.

    One subgraph per removed set, all in one run of ``components``; meant for graphs of bounded order.
    """
    ns = nodes.select("graph", "node").distinct()
    none = ns.select("graph").distinct().select("graph", F.array().cast("array<bigint>").alias("removed"))
    sets = none
    if size >= 1:
        sets = sets.unionByName(ns.select("graph", F.array(F.col("node").cast("bigint")).alias("removed")))
    if size >= 2:
        other = ns.withColumnRenamed("node", "other")
        sets = sets.unionByName(ns.join(other, "graph").where("node < other").select("graph", F.array(F.col("node").cast("bigint"), F.col("other").cast("bigint")).alias("removed")))
    sets = sets.withColumn("sub", F.struct("graph", "removed"))
    keep = lambda c: ~F.array_contains("removed", F.col(c).cast("bigint"))
    sub_edges = edges.select("graph", "u", "v").join(sets, "graph").where(keep("u") & keep("v")).select(F.col("sub").alias("graph"), "u", "v")
    sub_nodes = ns.join(sets, "graph").where(keep("node")).select(F.col("sub").alias("graph"), "node")
    parts = components(sub_edges, sub_nodes).groupBy("graph").agg(F.countDistinct("component").alias("parts"))
    return parts.where("parts > 1").select(F.col("graph.graph").alias("graph"), F.col("graph.removed").alias("removed"))


def validate(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, vertices, edges, reasons, valid): all checks run, reasons in the order of ``REASONS``.

    Planarity is not among them: it follows from a rotation system by Euler's formula (``embedding``).
    Counts are those of the table as given, with loops and repeats.
    """
    ns = materialize((vertices(edges) if nodes is None else vertices(edges).unionByName(nodes.select("graph", "node"))).distinct(), "nodes")
    size = ns.groupBy("graph").agg(F.count("*").alias("vertices"))
    count = edges.groupBy("graph").agg(F.count("*").alias("edges"))
    flag = lambda df, name: df.select("graph").distinct().withColumn(name, F.lit(True))
    simple = normalized(edges).where("u <> v").select("graph", "u", "v")
    frames = [
        flag(edges.where("u = v"), "r0"), flag(parallel_edges(edges), "r1"), flag(degrees(edges, ns).where("degree <> 3"), "r2"),
        flag(odd_cycles(edges), "r3"), flag(cut_sets(simple, ns).unionByName(size.where("vertices < 4").select("graph", F.array().cast("array<bigint>").alias("removed"))), "r4"),
    ]
    out = size.join(count, "graph", "left")
    for f in frames:
        out = out.join(f, "graph", "left")
    reasons = F.filter(F.array(*[F.when(F.col(f"r{i}"), F.lit(r)) for i, r in enumerate(REASONS)]), lambda r: r.isNotNull())
    return out.select("graph", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("valid"))


def requirement_pairs(edges: DataFrame) -> DataFrame:
    """(graph, required, forbidden): ordered pairs of distinct edge ids of one graph; m(m-1) a graph."""
    a = edges.select("graph", F.col("edge_id").alias("required"))
    return a.join(edges.select("graph", F.col("edge_id").alias("forbidden")), "graph").where("required <> forbidden")


def three_edge_paths(edges: DataFrame) -> DataFrame:
    """(graph, path): vertex paths of three edges, each once, as the lesser of itself and its reverse."""
    e = normalized(edges).where("u <> v").select("graph", "u", "v")
    arcs = e.unionByName(e.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))
    left = arcs.select("graph", F.col("u").alias("b"), F.col("v").alias("a"))
    right = arcs.select("graph", F.col("u").alias("c"), F.col("v").alias("d"))
    walks = e.select("graph", F.col("u").alias("b"), F.col("v").alias("c")).join(left, ["graph", "b"]).join(right, ["graph", "c"]).where("a <> c and d <> b and a <> d")
    path = F.array("a", "b", "c", "d")
    return walks.select("graph", F.least(path, F.reverse(path)).alias("path")).distinct()


def face_adjacency(face_edges: DataFrame) -> DataFrame:
    """(graph, u, v, face, other): faces that share an edge, from (graph, face, u, v)."""
    other = face_edges.select("graph", "u", "v", F.col("face").alias("other"))
    return face_edges.select("graph", "u", "v", "face").join(other, ["graph", "u", "v"]).where("face <> other")


def cofacial_pairs(face_edges: DataFrame) -> DataFrame:
    """(graph, required, forbidden, faces): ordered pairs of edges on one face, with the faces that hold both."""
    e = face_edges.select("graph", "face", F.struct("u", "v").alias("required"))
    pairs = e.join(face_edges.select("graph", "face", F.struct("u", "v").alias("forbidden")), ["graph", "face"]).where("required <> forbidden")
    return pairs.groupBy("graph", "required", "forbidden").agg(F.array_sort(F.collect_set("face")).alias("faces"))


def connected_subsets(edges: DataFrame, subsets: DataFrame) -> DataFrame:
    """(graph, subset, connected): whether the vertices of each subset (graph, subset, node) hang together without the others."""
    part = subsets.select("graph", "subset", "node").distinct()
    e = edges.join(part.withColumnRenamed("node", "u"), ["graph", "u"]).join(part.withColumnRenamed("node", "v"), ["graph", "subset", "v"])
    key = F.struct("graph", "subset").alias("graph")
    found = components(e.select(key, "u", "v"), part.select(key, "node")).groupBy("graph").agg(F.countDistinct("component").alias("parts"))
    return found.select("graph.graph", "graph.subset", (F.col("parts") == 1).alias("connected"))
