"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c\u00a0"


def norm_hash(col: Column | str) -> Column:
    """A graph hash in its one spelling: lower case, without surrounding blanks."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def norm_edge(u: Column, v: Column) -> Column:
    """An undirected edge as (smaller, larger)."""
    return F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))


def edge_set(col: Column | str) -> Column:
    """A list of undirected edges as a sorted set; null is the empty set, null edges are left out."""
    c = F.col(col) if isinstance(col, str) else col
    sorted_edges = F.transform(F.filter(c, lambda e: e.isNotNull()), lambda e: F.array_sort(e))
    return F.array_sort(F.array_distinct(F.coalesce(sorted_edges, F.array().cast("array<array<int>>"))))


def text_set(col: Column | str) -> Column:
    """A list of texts as a sorted set; null is the empty set, null members are left out."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.array_distinct(F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))))


def multiset(col: Column | str) -> Column:
    """A list of numbers without its order (kept multiplicities); null stays null."""
    return F.array_sort(F.col(col) if isinstance(col, str) else col)


def face_signature(col: Column | str) -> Column:
    """Run-length text of a multiset, for instance ``4^17 6^2 16^1``, sizes rising."""
    c = multiset(col)
    pairs = F.transform(
        F.array_distinct(c),
        lambda v: F.concat_ws("^", v.cast("string"), F.size(F.filter(c, lambda x: x == v)).cast("string")),
    )
    return F.array_join(pairs, " ")


def open_cycle(col: Column | str) -> Column:
    """A cycle without its repeated first vertex, turned and mirrored to its least spelling.

    Null for fewer than three or for repeated vertices.
    """
    c = F.col(col) if isinstance(col, str) else col
    body = F.when((F.size(c) > 1) & (F.element_at(c, 1) == F.element_at(c, -1)), F.slice(c, 1, F.size(c) - 1)).otherwise(c)

    def turned(x: Column) -> Column:
        at = F.array_position(x, F.array_min(x)).cast("int")
        return F.slice(F.concat(x, x), at, F.size(x))

    ok = (F.size(body) >= 3) & (F.size(F.array_distinct(body)) == F.size(body))
    return F.when(ok, F.least(turned(body), turned(F.reverse(body))))


def cycle_edges(col: Column | str) -> Column:
    """The sorted undirected edges of an open cycle."""
    c = F.col(col) if isinstance(col, str) else col
    shifted = F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    return F.array_sort(F.zip_with(c, shifted, lambda a, b: norm_edge(a, b)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, null where den is zero or null (ANSI mode would raise)."""
    return F.try_divide(num, F.nullif(den, F.lit(0).cast("double")))
