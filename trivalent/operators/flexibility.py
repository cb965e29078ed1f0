"""Flexibility of graphs under a universe of cycles: which constraints have a cycle, and which have fewest.

A constraint asks for a cycle that holds some edges and misses others: ordered pairs of edges (one held, one missed),
such pairs on one face, or paths of three edges (all held). Each frame of verdicts has a row per graph:
(graph, constraints, satisfied, holds, fewest, hardest): how many constraints there are, how many have a cycle, whether
all have, the fewest cycles that a constraint has, and the first constraint that has so many, as an array of vertices.

``universe`` has (graph, cycle_id, u, v): the edges of each cycle once, u below v; ``edges`` (graph, u, v). A graph
without constraints has no row.

``pairs_of`` and ``paths_of`` give the same verdict on one graph from the list of its cycles, over the edges seen in
them; for graphs whose cycles lie in one row, so that neither edges nor paths of all graphs are joined and shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import three_edge_paths


def _signs(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, edge, cycles): of every edge the cycles that hold it."""
    held = universe.groupBy("graph", "u", "v").agg(F.array_sort(F.collect_set("cycle_id")).alias("cycles"))
    none = F.array().cast(f"array<{universe.schema['cycle_id'].dataType.simpleString()}>")
    every = edges.select("graph", "u", "v").distinct().join(held, ["graph", "u", "v"], "left")
    return every.select("graph", F.array("u", "v").alias("edge"), F.coalesce("cycles", none).alias("cycles"))


def _verdicts(met: DataFrame) -> DataFrame:
    """From (graph, many, cycles, first): so many constraints have so many cycles, ``first`` the first of them."""
    agg = met.groupBy("graph").agg(
        F.sum("many").cast("bigint").alias("constraints"), F.sum(F.when(F.col("cycles") > 0, F.col("many")).otherwise(0)).cast("bigint").alias("satisfied"),
        F.min(F.struct("cycles", "first")).alias("h"),
    )
    return agg.select("graph", "constraints", "satisfied", (F.col("constraints") == F.col("satisfied")).alias("holds"), F.col("h.cycles").alias("fewest"), F.col("h.first").alias("hardest"))


def edge_pairs(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdicts over all ordered pairs of different edges, by classes of edges that lie on the same cycles."""
    classes = _signs(universe, edges).groupBy("graph", "cycles").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    own = classes.select("graph", F.col("cycles").alias("a"), F.col("edges").alias("ea"))
    pairs = own.join(classes.select("graph", F.col("cycles").alias("b"), F.col("edges").alias("eb")), "graph")
    alike, na, nb = F.col("a") == F.col("b"), F.size("ea"), F.size("eb")
    first = F.concat(F.get("ea", F.lit(0)), F.when(alike, F.get("eb", F.lit(1))).otherwise(F.get("eb", F.lit(0))))
    counted = pairs.select("graph", F.when(alike, na * (na - 1)).otherwise(na * nb).alias("many"), F.size(F.array_except("a", "b")).alias("cycles"), first.alias("first"))
    return _verdicts(counted.where("many > 0"))


def cofacial_edge_pairs(universe: DataFrame, face_edges: DataFrame) -> DataFrame:
    """Verdicts over the ordered pairs of different edges on one face, from (graph, face, u, v); a pair on two faces counts once."""
    signs = _signs(universe, face_edges)
    on = face_edges.select("graph", "face", F.array("u", "v").alias("edge")).distinct()
    pairs = on.join(on.select("graph", "face", F.col("edge").alias("other")), ["graph", "face"]).where("edge <> other").select("graph", "edge", "other").distinct()
    both = pairs.join(signs, ["graph", "edge"]).join(signs.select("graph", F.col("edge").alias("other"), F.col("cycles").alias("missed")), ["graph", "other"])
    return _verdicts(both.select("graph", F.lit(1).alias("many"), F.size(F.array_except("cycles", "missed")).alias("cycles"), F.concat("edge", "other").alias("first")))


def edge_paths(universe: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdicts over the paths of three edges."""
    paths = three_edge_paths(edges)
    ends = lambda k: (F.get("path", F.lit(k)), F.get("path", F.lit(k + 1)))
    steps = F.array(*[F.struct(F.least(*ends(k)).alias("u"), F.greatest(*ends(k)).alias("v")) for k in range(3)])
    walked = paths.select("graph", "path", F.explode(steps).alias("e")).select("graph", "path", "e.u", "e.v")
    whole = walked.join(universe, ["graph", "u", "v"]).groupBy("graph", "path", "cycle_id").agg(F.count("*").alias("n")).where("n = 3")
    met = paths.join(whole.groupBy("graph", "path").agg(F.count("*").alias("cycles")), ["graph", "path"], "left")
    return _verdicts(met.select("graph", F.lit(1).alias("many"), F.coalesce("cycles", F.lit(0)).alias("cycles"), F.col("path").alias("first")))


Verdict = tuple[int, int, bool, int, tuple[int, ...]]


def _held(cycles: list[list[int]]) -> dict[tuple[int, int], int]:
    """Of every edge the cycles that hold it, as bits."""
    held: dict[tuple[int, int], int] = {}
    for k, c in enumerate(cycles):
        bit, u = 1 << k, c[-1]
        for v in c:
            e = (u, v) if u < v else (v, u)
            held[e] = held.get(e, 0) | bit
            u = v
    return held


def pairs_of(cycles: list[list[int]]) -> Verdict | None:
    """The verdict over all ordered pairs of different edges, by classes of edges that lie on the same cycles."""
    held = _held(cycles)
    classes: dict[int, list[tuple[int, int]]] = {}
    for e in sorted(held):
        classes.setdefault(held[e], []).append(e)
    unmet, best = 0, None
    for a, ea in classes.items():
        for b, eb in classes.items():
            n = (a & ~b).bit_count()
            alike = a == b
            if n == 0:
                unmet += len(ea) * (len(eb) - alike)
            if len(eb) > alike and (best is None or n <= best[0]):
                first = (n, (*ea[0], *eb[alike]))
                best = first if best is None else min(best, first)
    many = len(held) * (len(held) - 1)
    return (many, many - unmet, unmet == 0, *best) if many else None


def _near(edges: Iterable[tuple[int, int]]) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    return near


def _paths(near: dict[int, set[int]]) -> Iterator[tuple[int, int, int, int]]:
    """The paths of three edges in order, each once, as the lesser of itself and its reverse."""
    for a in sorted(near):
        for b in sorted(near[a]):
            for c in sorted(near[b] - {a}):
                yield from ((a, b, c, d) for d in sorted(near[c] - {b}) if a < d)


def paths_of(cycles: list[list[int]]) -> Verdict | None:
    """The verdict over the paths of three edges.

    The paths that have a cycle are listed cycle by cycle, all paths are counted by degrees, less those that would be
    triangles; only where some path has no cycle, paths are gone through in order as far as the first such one.
    """
    near = _near(_held(cycles))
    many = sum((len(near[b]) - 1) * (len(near[c]) - 1) - len(near[b] & near[c]) for b in near for c in near[b] if b < c)
    if not many:
        return None
    met: Counter[tuple[int, int, int, int]] = Counter()
    for c in cycles:
        if len(set(c)) < len(c):
            met.update(_paths(_near(_held([c]))))
        elif len(c) > 3:
            met.update([p if p[0] < p[3] else p[::-1] for p in zip(c, c[1:] + c[:1], c[2:] + c[:2], c[3:] + c[:3])])
    if len(met) < many:
        return many, len(met), False, 0, next(p for p in _paths(near) if p not in met)
    return many, many, True, *min((n, p) for p, n in met.items())


def recorded(cycles: dict[str, list[list[int]]]) -> list[tuple]:
    """(analysis, constraints, satisfied, holds, fewest, hardest) of the analyses that have constraints, from their cycles; ``hardest`` as text."""
    each = [(name, verdict(cycles[name])) for name, verdict in (("all_edge_pairs", pairs_of), ("three_edge_paths", paths_of)) if name in cycles]
    return [(name, *v[:4], "-".join(map(str, v[4]))) for name, v in each if v is not None]


RECORDED = "analysis string, constraints long, satisfied long, holds boolean, fewest long, hardest string"
