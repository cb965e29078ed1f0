"""The double-ladder family D(a, b): two ladders of a and b cells and four connectors, a and b odd.

Frames of (a, b) go in; edges, coordinates, the symbolic separating family and its counts come out,
all by ``sequence`` and expressions, so a whole grid of cases is one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components, face_adjacency

#: The four exceptional cycles: key, ladder that is walked straight, which end its rung lies at, parity of the other ladder's rails.
EXCEPTIONS = [("X0011", "A", 0, 0), ("X1100", "A", 1, 1), ("X0101", "B", 0, 0), ("X1010", "B", 1, 1)]


def cycle_count(a: Column, b: Column) -> Column:
    """Hamiltonian cycles of D(a, b)."""
    return a * b + 5


def separation_number(a: Column, b: Column) -> Column:
    """((a+2)(b+2)-1)/2; null unless both are odd."""
    odd = (F.pmod(a, F.lit(2)) == 1) & (F.pmod(b, F.lit(2)) == 1)
    return F.when(odd, F.floor(((a + 2) * (b + 2) - 1) / 2))


def family_edges(grid: DataFrame) -> DataFrame:
    """(a, b, ladder, kind, cell, side): rails, rungs and connectors of each D(a, b) of (a, b).

    A rail lies in a cell and on a side (0, 1); a rung stands at a boundary; connectors are numbered 0 to 3.
    """
    parts = []
    for name in ("A", "B"):
        length = F.col("a") if name == "A" else F.col("b")
        rails = grid.withColumn("cell", F.explode(F.sequence(F.lit(0), length - 1))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        rungs = grid.withColumn("cell", F.explode(F.sequence(F.lit(0), length))).withColumn("side", F.lit(0))
        parts += [f.select("a", "b", F.lit(name).alias("ladder"), F.lit(kind).alias("kind"), "cell", "side") for f, kind in ((rails, "rail"), (rungs, "rung"))]
    ends = grid.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(3))))
    out = ends.select("a", "b", F.lit("C").alias("ladder"), F.lit("connector").alias("kind"), "cell", F.lit(0).alias("side"))
    for p in parts:
        out = out.unionByName(p)
    return out


def vertex_edges(grid: DataFrame) -> DataFrame:
    """(graph, u, v) of each D(a, b) over vertices 0..2(a+b)+3: ladder A first, two vertices a boundary."""
    return coordinates(grid).select("graph", "u", "v")


def coordinates(grid: DataFrame) -> DataFrame:
    """(graph, u, v, ladder, kind, cell, side): ``vertex_edges`` with each edge's place."""
    a, b, cell, side = F.col("a"), F.col("b"), F.col("cell"), F.col("side")
    base = F.when(F.col("ladder") == "A", F.lit(0)).otherwise(2 * (a + 1))
    at = lambda ladder, boundary, rail: (0 if ladder == "A" else 2 * (a + 1)) + 2 * boundary + rail
    ends = [(at("A", F.lit(0), 0), at("B", F.lit(0), 0)), (at("A", F.lit(0), 1), at("B", b, 0)), (at("A", a, 0), at("B", F.lit(0), 1)), (at("A", a, 1), at("B", b, 1))]
    u = F.when(F.col("kind") == "rung", base + 2 * cell).when(F.col("kind") == "rail", base + 2 * cell + side)
    v = F.when(F.col("kind") == "rung", base + 2 * cell + 1).when(F.col("kind") == "rail", base + 2 * cell + 2 + side)
    for i, (x, y) in enumerate(ends):
        hit = (F.col("kind") == "connector") & (cell == i)
        u, v = F.when(hit, x).otherwise(u), F.when(hit, y).otherwise(v)
    place = [F.struct("a", "b").alias("graph"), F.least(u, v).cast("bigint").alias("u"), F.greatest(u, v).cast("bigint").alias("v")]
    return family_edges(grid).select(*place, "ladder", "kind", "cell", "side")


def classify_cycles(cycle_edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(graph, cycle_id, class): all_rails, paired_cell_turns, two_connector_exception or unclassified.

    ``cycle_edges`` has (graph, cycle_id, u, v). A cycle through all connectors either takes every rail and no
    rung, or leaves out both rails of just one cell of each ladder and takes that cell's rungs.
    """
    place = coordinates(grid)
    own = cycle_edges.join(place, ["graph", "u", "v"])
    rail = lambda name: F.count_if((F.col("kind") == "rail") & (F.col("ladder") == name))
    seen = own.groupBy("graph", "cycle_id").agg(F.count_if(F.col("kind") == "connector").alias("connectors"), F.count_if(F.col("kind") == "rung").alias("rungs"), rail("A").alias("ra"), rail("B").alias("rb"))
    a, b, c = F.col("graph.a"), F.col("graph.b"), F.col("connectors")
    whole = (c == 4) & (F.col("ra") == 2 * a) & (F.col("rb") == 2 * b) & (F.col("rungs") == 0)
    turn = (c == 4) & (F.col("ra") == 2 * a - 2) & (F.col("rb") == 2 * b - 2) & (F.col("rungs") == 4)
    kind = F.when(whole, "all_rails").when(turn, "paired_cell_turns").when(c == 2, "two_connector_exception").otherwise("unclassified")
    return seen.select("graph", "cycle_id", kind.alias("class"))


def symbolic_family(grid: DataFrame) -> DataFrame:
    """(a, b, key, i, j, straight, far, parity): the separating family.

    A turn T(i, j) belongs to it on the boundary of the a x b cells and, inside, where i + j is odd; the four exceptions always do.
    """
    cells = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    rim = F.col("i").isin(0) | F.col("j").isin(0) | (F.col("i") == F.col("a") - 1) | (F.col("j") == F.col("b") - 1)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("straight", "string"), ("far", "int"), ("parity", "int"))]
    turns = cells.where(rim | ((F.col("i") + F.col("j")) % 2 == 1)).select("a", "b", F.format_string("T(%d,%d)", "i", "j").alias("key"), "i", "j", *none)
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("straight"), F.lit(f).alias("far"), F.lit(p).alias("parity")) for k, s, f, p in EXCEPTIONS])).alias("x")
    no = F.lit(None).cast("int")
    rest = grid.select("a", "b", listed).select("a", "b", "x.key", no.alias("i"), no.alias("j"), "x.straight", "x.far", "x.parity")
    return turns.unionByName(rest)


def incidence() -> Column:
    """Whether a cycle of the family holds an edge, over the columns of both.

    A turn holds all connectors, every rail but those of its cell and the two rungs of its cell. An exception
    holds two connectors; it runs along one ladder straight with one end rung, and winds through the other.
    """
    c = F.col
    length = F.when(c("ladder") == "A", c("a")).otherwise(c("b"))
    cell = F.when(c("ladder") == "A", c("i")).otherwise(c("j"))
    turn = F.when(c("kind") == "connector", True).when(c("kind") == "rail", c("cell") != cell).otherwise((c("cell") == cell) | (c("cell") == cell + 1))
    straight = (c("kind") == "rail") | (c("cell") == c("far") * length)
    winding = (c("kind") == "rung") | (c("side") == (c("cell") + c("parity")) % 2)
    bit = F.substring(c("key"), 2, 4).substr(c("cell") + 1, F.lit(1)) == "1"
    other = F.when(c("kind") == "connector", bit).when(c("ladder") == c("straight"), straight).otherwise(winding)
    return F.when(c("i").isNotNull(), turn).otherwise(other)


def family_incidence(grid: DataFrame) -> DataFrame:
    """(graph, cycle_id, u, v): the symbolic family's cycles as edge rows, ready for ``separation``; (u, v) names an edge."""
    edges = family_edges(grid)
    named = F.concat_ws("-", "ladder", "kind", "cell", "side")
    met = symbolic_family(grid).join(edges, ["a", "b"]).where(incidence())
    return met.select(F.struct("a", "b").alias("graph"), F.col("key").alias("cycle_id"), named.alias("u"), F.lit("").alias("v"))


def lifted_key(axis: str) -> Column:
    """Key of a turn after the ladder ``axis`` grew by two cells at its start; exceptions keep theirs."""
    i = F.col("i") + F.when((F.lit(axis) == "A") & (F.col("i") > 0), 2).otherwise(0)
    j = F.col("j") + F.when((F.lit(axis) == "B") & (F.col("j") > 0), 2).otherwise(0)
    return F.when(F.col("i").isNull(), F.col("key")).otherwise(F.format_string("T(%d,%d)", i, j))


def structural_lift(grid: DataFrame, axis: str) -> DataFrame:
    """(a, b, source_size, target_size, missing, new, expected): the family of D(a, b) inside that of the longer one."""
    longer = grid.select((F.col("a") + (2 if axis == "A" else 0)).alias("a"), (F.col("b") + (2 if axis == "B" else 0)).alias("b"))
    back = lambda df: df.select((F.col("a") - (2 if axis == "A" else 0)).alias("a"), (F.col("b") - (2 if axis == "B" else 0)).alias("b"), "key")
    source = symbolic_family(grid).select("a", "b", lifted_key(axis).alias("key")).withColumn("s", F.lit(1))
    target = back(symbolic_family(longer)).withColumn("t", F.lit(1))
    both = source.join(target, ["a", "b", "key"], "full_outer").groupBy("a", "b")
    agg = both.agg(F.count("s").alias("source_size"), F.count("t").alias("target_size"), F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("new"))
    return agg.withColumn("expected", (F.col("a") if axis == "B" else F.col("b")) + 2)


def quadrilateral_components(face_edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(graph, component, faces, kind) of the four-sided faces: isolated, path, cycle or branch, by their adjacency.

    ``face_edges`` has (graph, face, u, v), ``sizes`` (graph, face, size).
    """
    quads = sizes.where("size = 4").select("graph", "face")
    own = face_edges.join(quads, ["graph", "face"], "left_semi")
    near = face_adjacency(own).select("graph", "face", "other").distinct()
    deg = quads.join(near.groupBy("graph", "face").agg(F.count("*").alias("d")), ["graph", "face"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    comp = components(near.select("graph", F.col("face").alias("u"), F.col("other").alias("v")), quads.select("graph", F.col("face").alias("node")))
    grouped = deg.join(comp.withColumnRenamed("node", "face"), ["graph", "face"]).groupBy("graph", "component")
    agg = grouped.agg(F.count("*").alias("faces"), F.count_if(F.col("d") == 1).alias("ends"), F.count_if(F.col("d") == 2).alias("inner"), F.max("d").alias("most"))
    kind = F.when(F.col("faces") == 1, "isolated").when((F.col("inner") == F.col("faces")) & (F.col("faces") >= 3), "cycle").when((F.col("ends") == 2) & (F.col("most") <= 2), "path").otherwise("branch")
    return agg.select("graph", "component", "faces", kind.alias("kind"))


def strips(face_walks: DataFrame) -> DataFrame:
    """(graph, strip, faces, closed): runs of four-sided faces that follow each other through opposite edges.

    ``face_walks`` has (graph, face, u, v, step, size): the darts of each face with their place. A face stands for two
    nodes, one for each pair of opposite edges; a strip is a component of these nodes, closed if none of them is an end.
    """
    e = face_walks.where("size = 4").select("graph", "face", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("step") % 2).alias("slot"))
    node = F.struct("face", "slot")
    other = e.select("graph", "u", "v", F.col("face").alias("f2"), F.struct("face", "slot").alias("n2"))
    link = e.select("graph", "u", "v", "face", node.alias("n1")).join(other, ["graph", "u", "v"]).where("face <> f2").select("graph", "n1", "n2")
    deg = link.groupBy("graph", F.col("n1").alias("node")).agg(F.count("*").alias("d"))
    comp = components(link.select("graph", F.col("n1").alias("u"), F.col("n2").alias("v")))
    grouped = comp.join(deg, ["graph", "node"]).groupBy("graph", F.col("component").alias("strip"))
    return grouped.agg(F.countDistinct("node.face").alias("faces"), (F.min("d") == 2).alias("closed"))


def _links(face_walks: DataFrame) -> DataFrame:
    """(graph, n1, n2): nodes (face, slot) that follow each other across an edge, either way."""
    e = face_walks.where("size = 4").select("graph", F.col("face"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("step") % 2).alias("slot"))
    other = e.select("graph", "u", "v", F.col("face").alias("f2"), F.struct("face", "slot").alias("n2"))
    return e.select("graph", "u", "v", "face", F.struct("face", "slot").alias("n1")).join(other, ["graph", "u", "v"]).where("face <> f2").select("graph", "n1", "n2")


def strip_sequences(face_walks: DataFrame) -> DataFrame:
    """(graph, strip, pos, face): the faces of every open strip in order, from the end of the lesser node.

    Steps to the far end are found by pointer doubling over directed links.
    """
    link = materialize(_links(face_walks), "links")
    deg = link.groupBy("graph", F.col("n1").alias("node")).agg(F.count("*").alias("d"))
    comp = components(link.select("graph", F.col("n1").alias("u"), F.col("n2").alias("v"))).join(deg, ["graph", "node"])
    ends = comp.where("d = 1").groupBy("graph", "component").agg(F.max("node").alias("far"))
    nodes = materialize(comp.join(ends, ["graph", "component"]).select("graph", F.col("component").alias("strip"), "node", "far"), "open")
    arcs = link.join(nodes.select("graph", F.col("node").alias("n1"), "strip", "far"), ["graph", "n1"])
    after = link.select("graph", F.col("n1").alias("n2"), F.col("n2").alias("n3"))
    step = arcs.join(after, ["graph", "n2"], "left").where("n3 is null or n3 <> n1 or n2 = far")
    to = F.when((F.col("n3") != F.col("n1")), F.struct(F.col("n2").alias("a"), F.col("n3").alias("b")))
    now = materialize(step.select("graph", "strip", "far", F.struct(F.col("n1").alias("a"), F.col("n2").alias("b")).alias("arc"), to.alias("to"), F.lit(1).alias("steps"), F.col("n2").alias("last")), "arcs")
    while not now.where("to is not null").isEmpty():
        hop = now.select("graph", F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("s2"), F.col("last").alias("l2"))
        joined = now.join(hop, ["graph", "to"], "left")
        now = materialize(joined.select("graph", "strip", "far", "arc", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.coalesce("l2", "last").alias("last")), "arcs")
    away = now.where("last = far").groupBy("graph", "strip", F.col("arc.a").alias("node")).agg(F.min("steps").alias("steps"))
    placed = nodes.join(away, ["graph", "strip", "node"], "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    longest = F.max("steps").over(Window.partitionBy("graph", "strip"))
    return placed.select("graph", "strip", (longest - F.col("steps")).alias("pos"), F.col("node.face").alias("face"))


def maximal_windows(sequences: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(graph, strip, first, last, faces): inclusion-maximal stretches of at least two places without a repeated face and without a chord.

    ``adjacent`` has (graph, face, other). A stretch ends before the first place that meets an earlier one wrongly.
    """
    later = sequences.select("graph", "strip", F.col("pos").alias("pos2"), F.col("face").alias("other"))
    chords = sequences.join(adjacent, ["graph", "face"]).join(later, ["graph", "strip", "other"]).where("pos2 >= pos + 2").select("graph", "strip", "pos", "pos2")
    again = sequences.join(later.withColumnRenamed("other", "face"), ["graph", "strip", "face"]).where("pos2 > pos").select("graph", "strip", "pos", "pos2")
    stop = chords.unionByName(again).groupBy("graph", "strip", "pos").agg(F.min("pos2").alias("stop"))
    w = Window.partitionBy("graph", "strip").orderBy("pos")
    bounded = sequences.join(stop, ["graph", "strip", "pos"], "left")
    whole = F.max("pos").over(Window.partitionBy("graph", "strip"))
    last = F.least(F.min(F.col("stop") - 1).over(w.rowsBetween(0, Window.unboundedFollowing)), whole)
    reach = bounded.withColumn("last", last)
    fresh = reach.withColumn("before", F.lag("last").over(w)).where("(before is null or before < last) and last > pos")
    inside = fresh.select("graph", "strip", F.col("pos").alias("first"), "last").join(sequences.withColumnRenamed("pos", "at"), ["graph", "strip"]).where("at between first and last")
    return inside.groupBy("graph", "strip", "first", "last").agg(F.array_sort(F.collect_set("face")).alias("faces"))


def ladder_parameters(face_walks: DataFrame) -> DataFrame:
    """Ladder structure of each graph from the darts of its faces (graph, face, u, v, step, size).

    (graph, quadrilaterals, strips, ladder_max, covered, fraction, closed_strips, degenerate_strips, best_a, best_b, score): ladders are the
    maximal windows of open strips; the best pair is that of disjoint ladders with the largest (a+2)(b+2), then a;
    the score is ((a+2)(b+2)-1)/2, null without a pair.
    """
    walks = materialize(face_walks, "walks")
    quads = walks.where("size = 4").groupBy("graph").agg(F.countDistinct("face").alias("quadrilaterals"))
    near = materialize(_links(walks).select("graph", F.col("n1.face").alias("face"), F.col("n2.face").alias("other")).distinct(), "near")
    ladders = materialize(maximal_windows(strip_sequences(walks), near).withColumn("length", F.col("last") - F.col("first") + 1), "ladders")
    size = ladders.groupBy("graph").agg(F.count("*").alias("strips"), F.max("length").alias("ladder_max"))
    cover = ladders.select("graph", F.explode("faces").alias("f")).groupBy("graph").agg(F.countDistinct("f").alias("covered"))
    key = F.struct("strip", "first", "last")
    one = ladders.select("graph", key.alias("k"), "faces", "length")
    two = ladders.select("graph", key.alias("k2"), F.col("faces").alias("faces2"), F.col("length").alias("length2"))
    pairs = one.join(two, "graph").where((F.col("k") < F.col("k2")) & ~F.arrays_overlap("faces", "faces2"))
    a, b = F.greatest("length", "length2"), F.least("length", "length2")
    best = pairs.groupBy("graph").agg(F.max(F.struct(((a + 2) * (b + 2)).alias("p"), a.alias("a"), b.alias("b"))).alias("best"))
    # closed strips: simple if no face comes twice and none touches more than its two neighbours in the strip
    link = _links(walks)
    deg = link.groupBy("graph", F.col("n1").alias("node")).agg(F.count("*").alias("d"))
    comp = components(link.select("graph", F.col("n1").alias("u"), F.col("n2").alias("v"))).join(deg, ["graph", "node"])
    ring = materialize(comp.join(comp.where("d = 1").select("graph", "component").distinct(), ["graph", "component"], "left_anti").select("graph", "component", F.col("node.face").alias("face")), "rings")
    touch = ring.distinct().join(near, ["graph", "face"]).join(ring.select("graph", "component", F.col("face").alias("other")).distinct(), ["graph", "component", "other"]).groupBy("graph", "component", "face").agg(F.count("*").alias("t"))
    shape = ring.groupBy("graph", "component").agg(F.count("*").alias("n"), F.countDistinct("face").alias("m")).join(touch.groupBy("graph", "component").agg(F.max("t").alias("t")), ["graph", "component"])
    simple = (F.col("n") == F.col("m")) & (F.col("t") == 2)
    rings = shape.groupBy("graph").agg(F.count_if(simple).alias("closed_strips"), F.count_if(~simple).alias("degenerate_strips"))
    out = walks.select("graph").distinct()
    for f in (quads, size, cover, rings, best):
        out = out.join(f, "graph", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "graph", zero("quadrilaterals"), zero("strips"), zero("ladder_max"), zero("covered"),
        F.coalesce(F.try_divide(F.col("covered"), F.col("quadrilaterals")), F.lit(0.0)).alias("fraction"), zero("closed_strips"), zero("degenerate_strips"),
        F.col("best.a").alias("best_a"), F.col("best.b").alias("best_b"), ((F.col("best.p") - 1) / 2).alias("score"),
    )


def packing_supports(grid: DataFrame) -> DataFrame:
    """(graph, required, forbidden, support): a packing of D(a, b), a and b odd from 3: pairs of edges that no two cycles separate both of.

    Found from the incidence alone. Of the ordered pairs of edges, which are of the order of the a x b cells that the packing
    covers, those that a single cycle separates come first, one for each such cycle. The turns that no pair has for itself
    are walked row by row, back and forth, and each two that follow each other get a pair that just these two separate; an odd
    one is left over. The cycle along all rails counts among the cycles. Edges are named as in ``family_incidence``.
    """
    cells = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("straight", "string"), ("far", "int"), ("parity", "int"))]
    every = cells.select("a", "b", F.format_string("T(%d,%d)", "i", "j").alias("key"), "i", "j", *none).unionByName(symbolic_family(grid).where("i is null"))
    edges = family_edges(grid).withColumn("edge", F.concat_ws("-", "ladder", "kind", "cell", "side"))
    graph = F.struct("a", "b").alias("graph")
    whole = edges.where("kind <> 'rung'").select(graph, F.lit("rails").alias("key"), "edge")
    held = every.join(edges, ["a", "b"]).where(incidence()).select(graph, "key", "edge").unionByName(whole)
    signs = materialize(held.groupBy("graph", "edge").agg(F.collect_set("key").alias("cycles")), "signs")
    other = signs.select("graph", F.col("edge").alias("forbidden"), F.col("cycles").alias("others"))
    pairs = signs.join(other, "graph").select("graph", F.col("edge").alias("required"), "forbidden", F.array_sort(F.array_except("cycles", "others")).alias("support"))
    few = materialize(pairs.where(F.size("support").between(1, 2)).groupBy("graph", "support").agg(F.min(F.struct("required", "forbidden")).alias("pair")), "few")
    alone = few.where("size(support) = 1")
    turns = cells.select(graph, "i", "j", F.format_string("T(%d,%d)", "i", "j").alias("key"))
    left = turns.join(alone.select("graph", F.get("support", F.lit(0)).alias("key")), ["graph", "key"], "left_anti")
    width = left.groupBy("graph").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    row, column = F.col("i") - F.col("i0"), F.when((F.col("i") - F.col("i0")) % 2 == 0, F.col("j") - F.col("j0")).otherwise(F.col("j1") - F.col("j"))
    walked = left.join(width, "graph").withColumn("domino", F.floor((row * (F.col("j1") - F.col("j0") + 1) + column) / 2))
    twos = walked.groupBy("graph", "domino").agg(F.array_sort(F.collect_list("key")).alias("support")).select("graph", "support")
    out = alone.unionByName(few.join(twos, ["graph", "support"], "left_semi").where("size(support) = 2"))
    return out.select("graph", "pair.required", "pair.forbidden", "support")


def structural_packing(grid: DataFrame) -> DataFrame:
    """(a, b, required, forbidden): the pairs of ``packing_supports``; ((a+2)(b+2)-1)/2 of them, which proves the separation number."""
    return packing_supports(grid).select("graph.a", "graph.b", "required", "forbidden")


def block_overlap(source: DataFrame, target: DataFrame) -> DataFrame:
    """(graph, blocks, found, all_found): how many of a graph's blocks (graph, block array) are blocks of the target too, whatever their order."""
    have = target.select("graph", F.array_sort("block").alias("block")).distinct().withColumn("have", F.lit(True))
    met = source.select("graph", F.array_sort("block").alias("block")).join(have, ["graph", "block"], "left")
    return met.groupBy("graph").agg(F.count("*").alias("blocks"), F.count("have").alias("found")).withColumn("all_found", F.col("blocks") == F.col("found"))
