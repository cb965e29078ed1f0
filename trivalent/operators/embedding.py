"""Rotation systems: darts, faces by pointer doubling, Euler checks, canonical codes and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import norm_edge
from ..session import discard, materialize


def darts(graphs: DataFrame) -> DataFrame:
    """(graph, u, v, pos, degree) of rotation ``array<array<int>>``, vertices and places from 0."""
    rows = graphs.select("graph", F.posexplode("rotation").alias("u", "row"))
    return rows.select("graph", "u", F.size("row").alias("degree"), F.posexplode("row").alias("pos", "v"))


def rotation_faults(graphs: DataFrame) -> DataFrame:
    """(graph, fault): repeated neighbours, loops, neighbours out of range, darts without their reverse."""
    d = darts(graphs).join(graphs.select("graph", F.size("rotation").alias("n")), "graph")
    back = d.select("graph", F.col("u").alias("v"), F.col("v").alias("u"))
    parts = [
        (d.groupBy("graph", "u", "v").count().where("count > 1"), "repeated neighbour"), (d.where("u = v"), "loop"),
        (d.where("v < 0 or v >= n"), "neighbour out of range"), (d.join(back, ["graph", "u", "v"], "left_anti"), "asymmetric"),
    ]
    out = None
    for df, fault in parts:
        one = df.select("graph", F.lit(fault).alias("fault")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def dart_faces(graphs: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """(graph, u, v, face_u, face_v, step): each dart with its face's least dart and its place on the walk from there.

    After (u, v) a face goes on with (v, w), w the neighbour before u around v. Orbits of this
    permutation are found by pointer doubling: the number of joins is the logarithm of the longest face.
    """
    d = darts(graphs).select("graph", "u", "v", "pos", "degree")
    at_v = d.select("graph", F.col("u").alias("v"), F.col("v").alias("u"), F.col("pos").alias("back"), F.col("degree").alias("dv"))
    follow = d.select("graph", F.col("u").alias("v"), F.col("v").alias("w"), F.col("pos").alias("want"))
    turn = d.select("graph", "u", "v").join(at_v, ["graph", "u", "v"]).withColumn("want", F.pmod(F.col("back") - 1, F.col("dv")))
    step = turn.join(follow, ["graph", "v", "want"]).select("graph", F.struct("u", "v").alias("dart"), F.struct(F.col("v").alias("u"), F.col("w").alias("v")).alias("to"))
    now = materialize(step.select("graph", "dart", "to", F.least("dart", "to").alias("low")), "orbit")
    reach = 1
    while reach < longest:
        other = now.select("graph", F.col("dart").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        moved = materialize(now.join(other, ["graph", "to"]).select("graph", "dart", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), "orbit")
        still = moved.where("moved").isEmpty()
        discard(now)
        now, reach = moved, reach * 2
        if still:
            break
    else:
        raise ValueError(f"a face of more than {longest} darts")
    now = now.select("graph", "dart", "to", "low")
    # places: walk from each dart towards the least one, counting steps, again by doubling
    start = step.join(now.select("graph", "dart", "low"), ["graph", "dart"])
    ends = F.col("dart") == F.col("low")
    walk = materialize(start.select("graph", "dart", "low", F.when(ends, F.col("dart")).otherwise(F.col("to")).alias("to"), F.when(ends, 0).otherwise(1).alias("left")), "walk")
    while not walk.where("to <> low").isEmpty():
        other = walk.select("graph", F.col("dart").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        last, walk = walk, materialize(walk.join(other, ["graph", "to"]).select("graph", "dart", "low", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left")), "walk")
        discard(last)
    sizes = walk.groupBy("graph", "low").agg(F.count("*").alias("size"))
    placed = walk.join(sizes, ["graph", "low"]).withColumn("step", F.pmod(F.col("size") - F.col("left"), F.col("size")))
    return placed.select("graph", "dart.u", "dart.v", F.col("low.u").alias("face_u"), F.col("low.v").alias("face_v"), "step", "size")


def faces(graphs: DataFrame) -> DataFrame:
    """(graph, face_u, face_v, size, boundary): facial walks, each from its least dart."""
    walked = F.transform(F.array_sort(F.collect_list(F.struct("step", "u"))), lambda s: s["u"])
    return dart_faces(graphs).groupBy("graph", "face_u", "face_v", "size").agg(walked.alias("boundary"))


def face_edges(dart_face: DataFrame) -> DataFrame:
    """(graph, face, u, v): the edges of each face; a face is named by its least dart."""
    e = norm_edge(F.col("u"), F.col("v"))
    return dart_face.select("graph", F.struct("face_u", "face_v").alias("face"), e["u"].alias("u"), e["v"].alias("v")).distinct()


def euler(graphs: DataFrame) -> DataFrame:
    """(graph, n, m, faces, spherical): whether n - m + f = 2 holds for the rotation system of a connected graph."""
    d = dart_faces(graphs)
    counted = d.groupBy("graph").agg((F.count("*") / 2).cast("bigint").alias("m"), F.countDistinct("face_u", "face_v").alias("faces"))
    size = graphs.select("graph", F.size("rotation").cast("bigint").alias("n"))
    return size.join(counted, "graph").withColumn("spherical", F.col("n") - F.col("m") + F.col("faces") == 2)


def _dart_arrays(rotation: list[list[int]]) -> tuple[np.ndarray, ...]:
    """Of darts numbered vertex by vertex: tails, heads, reverses, and the next dart around the tail either way (2 x darts)."""
    degree = np.array([len(row) for row in rotation])
    tail, head = np.repeat(np.arange(len(rotation)), degree), np.concatenate([np.asarray(row, dtype=np.int64) for row in rotation])
    first = np.repeat(np.cumsum(degree) - degree, degree)
    place, size = np.arange(len(tail)) - first, degree[tail]
    there, back = tail * len(rotation) + head, head * len(rotation) + tail
    order = np.argsort(there, kind="stable")
    reverse = order[np.minimum(np.searchsorted(there[order], back), len(there) - 1)]
    if (there[reverse] != back).any():
        raise ValueError("a rotation system has every dart's reverse")
    return tail, head, reverse, first + np.stack([(place + 1) % size, (place - 1) % size]), degree


def least_rooting(rotation: list[list[int]]) -> tuple[list[list[int]], int, list[int], bool]:
    """Least breadth-first code over all rooted darts and both orientations, how many of these give it, and of the first of them each vertex's label and whether it is mirrored.

    A rooting is a row of arrays: labels by vertex, the dart at which each labelled vertex's turn begins,
    vertices by label. All rootings go on by one vertex at a time, dart after dart for all at once, and
    those whose row of the code isn't the least are left out.
    """
    tail, head, reverse, around, degree = _dart_arrays(rotation)
    n, darts_, roots = len(rotation), len(tail), np.tile(np.arange(len(tail)), 2)
    way, each = np.repeat([0, 1], darts_), np.arange(2 * darts_)
    label, begin, by_label = (np.full((2 * darts_, n), -1) for _ in range(3))
    for k, (vertex, dart) in enumerate(((tail[roots], roots), (head[roots], reverse[roots]))):
        label[each, vertex], begin[each, vertex], by_label[:, k] = k, dart, vertex
    count, code = np.full(2 * darts_, 2), []
    for at in range(n):
        if (count <= at).any():
            raise ValueError("a canonical code needs a connected graph")
        every = np.arange(len(count))
        vertex = by_label[:, at]
        dart, size = begin[every, vertex], degree[vertex]
        row = np.full((len(count), int(size.max())), -1)
        for k in range(row.shape[1]):
            seen = head[dart]
            new = np.flatnonzero((k < size) & (label[every, seen] < 0))
            fresh = seen[new]
            label[new, fresh], begin[new, fresh], by_label[new, count[new]] = count[new], reverse[dart[new]], fresh
            count[new] += 1
            row[:, k] = np.where(k < size, label[every, seen], -1)
            dart = around[way, dart]
        least = every
        for k in range(row.shape[1]):
            least = least[row[least, k] == row[least, k].min()]
        code.append([int(v) for v in row[least[0]] if v >= 0])
        label, begin, by_label, count, way = label[least], begin[least], by_label[least], count[least], way[least]
    return code, len(count), label[0].tolist(), bool(way[0])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _codes(rotation: pd.Series) -> pd.Series:
    return rotation.map(lambda rows: None if rows is None else least_rooting([[int(x) for x in r] for r in rows])[0] if any(len(r) for r in rows) else [[] for _ in rows])


def canonical_hashes(graphs: DataFrame) -> DataFrame:
    """(graph, canonical_graph_hash): equal exactly for isomorphic 3-connected plane graphs, mirror images included."""
    return graphs.select("graph", F.sha2(F.to_json(_codes("rotation")), 256).alias("canonical_graph_hash"))


@F.pandas_udf(T.IntegerType())
def automorphism_count(rotation: pd.Series) -> pd.Series:
    """Order of the automorphism group of a 3-connected plane graph, reflections included."""
    return rotation.map(lambda rows: None if rows is None else least_rooting([[int(x) for x in r] for r in rows])[1])


@F.pandas_udf(T.StructType([T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("mirrored", T.BooleanType())]))
def _labelling(rotation: pd.Series) -> pd.DataFrame:
    found = [(None, None) if rows is None else ([0] * len(rows), False) if not any(len(r) for r in rows) else least_rooting([[int(x) for x in r] for r in rows])[2:] for rows in rotation]
    return pd.DataFrame({"labels": [a for a, _ in found], "mirrored": [b for _, b in found]})


def canonical_labellings(graphs: DataFrame) -> DataFrame:
    """(graph, code, labels, mirrored): the canonical code with a labelling of the vertices that gives it, and whether the plane is turned over for it."""
    return graphs.select("graph", _codes("rotation").alias("code"), _labelling("rotation").alias("l")).select("graph", "code", "l.labels", "l.mirrored")
