"""Problem 3: the N best rows of every group, by partition lower bounds.

Every partition finds, for each group it holds, its own N-th best row. The group's N-th best row
overall can't rank below that one, so the best of these bounds, joined back, lets all worse rows be
dropped before anything is sorted or shuffled by group. What is left of a group is at most N rows a
partition, also where a third of all rows lie in one group or tie on the score, because the bound
holds the tie columns too.

Bounds go to the tasks as a broadcast of checked size. Where there are more groups than fit in it, only
the bounds of hot groups go, those of more than a fixed share of all rows, of which there can't be more
than that; the rows of the others are shuffled as they are, and none of them is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import join_groups
from ..session import materialize

STATE_ROWS = 200_000
BOUND_BYTES = 32_000_000  # of bounds broadcast at most


def _falling(df: DataFrame, score: str) -> Column:
    """A rising key for a falling score; ``~x`` can't overflow as ``-x`` does at the least integer."""
    kind = df.schema[score].dataType
    return F.bitwise_not(F.col(score)) if isinstance(kind, T.IntegralType) else -F.col(score)


def _nth_rows(table: pa.Table, groups: list[str], keys: list[str], n: int, only_nth: bool) -> pa.Table:
    """Of a table: the first n rows of each group in key order, or only each n-th."""
    order = pc.sort_indices(table, [(c, "ascending") for c in groups + keys], null_placement="at_start")
    table = table.take(order)
    size = table.num_rows
    new = np.zeros(size, dtype=bool)
    if size:
        new[0] = True
    for c in groups:
        codes = table[c].combine_chunks()
        codes = codes.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(size) - np.repeat(start, np.diff(np.append(start, size)))
    return table.filter(pa.array(rank == n - 1 if only_nth else rank < n))


def _local_bounds(groups: list[str], keys: list[str], n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < STATE_ROWS:
                continue
            best = _nth_rows(pa.concat_tables(held), groups, keys, n, only_nth=False)
            held, rows = [best], best.num_rows
            if rows > STATE_ROWS // 2:  # very many groups: give what is known and begin anew
                yield from _nth_rows(best, groups, keys, n, only_nth=True).cast(schema).to_batches()
                held, rows = [], 0
        if held:
            yield from _nth_rows(pa.concat_tables(held), groups, keys, n, only_nth=True).cast(schema).to_batches()

    return run


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, place: str = "place") -> DataFrame:
    """The ``n`` rows of the highest ``score`` in each group, with their place from 1.

    ``df`` is read twice (bounds, survivors); where it is costly, hand over a materialized frame.
    Ties on the score go to the rising ``ties``; a null tie value comes first. Rows with a null or
    NaN score are left out. Null is a group of its own. A group of fewer than ``n`` rows is given
    whole, an empty frame gives an empty frame. Rows repeated in full are rows of their own, and take places in any
    order among themselves. A column named like ``place`` is replaced; other columns are kept.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    tag = "tn0_"
    while any(c.startswith(tag) for c in df.columns):
        tag = f"x{tag}"
    usable = F.col(score).isNotNull()
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        usable &= ~F.isnan(score)
    rows = df.where(usable).withColumn(f"{tag}k", _falling(df, score))
    gs, ks = [f"{tag}g{i}" for i in range(len(groups))], [f"{tag}b{i}" for i in range(len(ties) + 1)]
    slim = rows.select(*[F.col(c).alias(a) for c, a in zip(groups, gs)], F.col(f"{tag}k").alias(ks[0]), *[F.col(c).alias(a) for c, a in zip(ties, ks[1:])])
    from pyspark.sql.pandas.types import to_arrow_schema

    local = slim.mapInArrow(_local_bounds(gs, ks, n, to_arrow_schema(slim.schema)), slim.schema)
    bounds = materialize(local.groupBy(*gs).agg(F.min(F.struct(*ks)).alias(f"{tag}bound")), "bounds")
    # a row's size in memory, from its longest texts
    width = F.lit(128)
    for f in slim.schema.fields:
        text = F.col(f.name) if f.name in gs else F.col(f"{tag}bound.{f.name}")
        width += F.coalesce(F.octet_length(text.cast("string")), F.lit(0))
    held = bounds.agg(F.count("*").alias("n"), F.max(width).alias("width")).first()
    most = max(1, BOUND_BYTES // (held.width or 1))
    if held.n > most:
        sizes = slim.groupBy(*gs).agg(F.count("*").alias(f"{tag}n"))
        hot = sizes.where(F.col(f"{tag}n") > slim.count() / most)
        bounds = join_groups(bounds, hot.select(*gs), gs)
    same = F.lit(True)
    for c, a in zip(groups, gs):
        same &= rows[c].eqNullSafe(bounds[a])
    key = F.struct(F.col(f"{tag}k").alias(ks[0]), *[F.col(c).alias(a) for c, a in zip(ties, ks[1:])])
    survivors = rows.join(F.broadcast(bounds), same, "left").where(F.col(f"{tag}bound").isNull() | (key <= F.col(f"{tag}bound")))
    order = Window.partitionBy(*groups).orderBy(F.col(f"{tag}k").asc(), *[F.col(c).asc_nulls_first() for c in ties])
    ranked = survivors.withColumn(f"{tag}p", F.row_number().over(order)).where(F.col(f"{tag}p") <= n)
    kept = [c for c in df.columns if c != place]
    return ranked.select(*kept, F.col(f"{tag}p").alias(place))
