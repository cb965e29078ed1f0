"""Plane geometry as column expressions: orientation, crossings, convexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c: positive for a left turn."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crossings(segments: DataFrame) -> DataFrame:
    """(graph, crossings): proper crossings of segments (graph, id, u, v, x1, y1, x2, y2) without a common end."""
    s = F.col
    other = segments.select("graph", *[s(c).alias(f"o_{c}") for c in segments.columns if c != "graph"])
    pairs = segments.join(other, "graph").where((s("id") < s("o_id")) & ~s("u").isin(s("o_u"), s("o_v")) & ~s("v").isin(s("o_u"), s("o_v")))
    a, b = (s("x1"), s("y1")), (s("x2"), s("y2"))
    c, d = (s("o_x1"), s("o_y1")), (s("o_x2"), s("o_y2"))
    split = lambda p, q, r, t: orientation(*p, *q, *r) * orientation(*p, *q, *t) < 0
    hit = pairs.where(split(a, b, c, d) & split(c, d, a, b)).groupBy("graph").agg(F.count("*").alias("crossings"))
    return segments.select("graph").distinct().join(hit, "graph", "left").withColumn("crossings", F.coalesce("crossings", F.lit(0)))
