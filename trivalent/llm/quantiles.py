"""Problem 4: percentiles with bounded error from mergeable rank-interval summaries.

A summary of a group's values is a rising list of values, each with the least and the largest rank
(from 1) that it can have among all values summarized so far, after Greenwald and Khanna. Summaries
of separate partitions or days are merged by adding rank bounds, and compressed by dropping values
while the gap between neighbours stays within the permitted uncertainty. Nothing is random. A group
of at most 1/eps values keeps every one, so its percentiles are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLUSH_ROWS = 400_000


def exact_summary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.sort(values)
    rank = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, rank, rank.copy()


def merge_summaries(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank bounds of the union: own bounds plus what the other side has below and not above."""

    def lifted(own: tuple, other: tuple, side: str) -> tuple[np.ndarray, np.ndarray]:
        v, lo, hi = own
        w, wlo, whi = other
        at = np.searchsorted(w, v, side=side)  # other's values counted as before v
        below = np.concatenate(([0], wlo))[at]
        total = whi[-1]
        above = np.concatenate((whi - 1, [total]))[at]
        return lo + below, hi + above

    alo, ahi = lifted(a, b, "left")
    blo, bhi = lifted(b, a, "right")
    v, lo, hi = np.concatenate((a[0], b[0])), np.concatenate((alo, blo)), np.concatenate((ahi, bhi))
    order = np.argsort(v, kind="stable")
    return v[order], lo[order], hi[order]


def compress(s: tuple, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Drop values while max-rank(next) - min-rank(this) <= 2 eps n; first and last are kept."""
    v, lo, hi = s
    allowed = int(2 * eps * hi[-1])
    if allowed < 2 or len(v) < 3:
        return s
    keep, at, last = [0], 0, len(v) - 1
    while at < last:
        at = max(at + 1, int(np.searchsorted(hi, lo[at] + allowed, side="right")) - 1)
        at = min(at, last)
        keep.append(at)
    k = np.array(keep)
    return v[k], lo[k], hi[k]


def rank_error(s: tuple) -> float:
    """Accumulated uncertainty: the largest distance between a rank and the value found for it."""
    v, lo, hi = s
    gaps = np.concatenate((hi - lo, hi[1:] - lo[:-1]))
    return float(gaps.max()) / 2


def value_at_rank(s: tuple, rank: int) -> float:
    v, lo, hi = s
    return float(v[np.argmin(np.maximum(rank - lo, hi - rank))])


def percentile_of(s: tuple, p: float) -> float:
    """Linear interpolation at position (n-1)p."""
    at = (s[2][-1] - 1) * p
    low = int(np.floor(at))
    a = value_at_rank(s, low + 1)
    return a if at == low else a + (value_at_rank(s, low + 2) - a) * (at - low)


def merge_all(parts: list[tuple], eps: float) -> tuple:
    """Balanced tree of merges, so that equal sizes meet; compressed once at the end."""
    while len(parts) > 1:
        parts = [merge_summaries(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return compress(parts[0], eps)


def _sliced(offsets: np.ndarray, flat: tuple, i: int) -> tuple:
    return tuple(x[offsets[i] : offsets[i + 1]] for x in flat)


def _schema(names: list[str], key_types: list[pa.DataType]) -> pa.Schema:
    lists = [pa.field(c, pa.list_(t)) for c, t in (("vals", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64()))]
    return pa.schema([*map(pa.field, names, key_types), pa.field("part", pa.int32()), *lists])


def _packed(keys: list, sums: list[tuple], names: list[str], key_types: list[pa.DataType], salts: list[int]) -> pa.RecordBatch:
    sizes = np.array([len(s[0]) for s in sums], dtype=np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    arrays = [pa.array([k[i] for k in keys], type=t) for i, t in enumerate(key_types)]
    arrays.append(pa.array(salts, type=pa.int32()))
    for j, t in enumerate((pa.float64(), pa.int64(), pa.int64())):
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s[j] for s in sums]), type=t)))
    return pa.RecordBatch.from_arrays(arrays, schema=_schema(names, key_types))


def _builder(names: list[str], key_types: list[pa.DataType], eps: float):
    def summaries(tables: list[pa.Table], part: int) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables)
        values = t["value"].combine_chunks().to_numpy(zero_copy_only=False)
        codes = _codes(t, names)
        order = np.argsort(codes, kind="stable")
        codes, values = codes[order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        ends = np.append(starts[1:], len(codes))
        firsts = t.take(pa.array(order[starts]))
        keys = list(zip(*[firsts[c].to_pylist() for c in names])) if names else [()] * len(starts)
        for i in range(0, len(starts), 2000):
            sums = [compress(exact_summary(values[a:b]), eps) for a, b in zip(starts[i : i + 2000], ends[i : i + 2000])]
            yield _packed(keys[i : i + 2000], sums, names, key_types, [part] * len(sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield from summaries(held, part)
                held, rows = [], 0
        if held:
            yield from summaries(held, part)

    return run


def _codes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Dense group numbers of a table's rows."""
    codes = np.zeros(t.num_rows, dtype=np.int64)
    for c in names:
        d = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        _, codes = np.unique(codes, return_inverse=True)
    return codes


def _merger(names: list[str], eps: float):
    """Merges the summaries of equal names, which follow each other; holds those of one name and a few results at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        now, parts = None, []
        keys: list[tuple] = []
        sums: list[tuple] = []
        size = 0

        def close() -> int:
            if not parts:
                return 0
            keys.append(now)
            sums.append(parts[0] if len(parts) == 1 else merge_all(parts, eps))
            return len(sums[-1][0])

        def packed() -> pa.RecordBatch:
            return _packed(keys, sums, names[:-1], kinds, [k[-1] for k in keys])

        for b in batches:
            if not b.num_rows:
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            kinds = [column(c).type for c in names[:-1]]
            lists = [column(c) for c in ("vals", "lo", "hi")]
            base = lists[0].offsets.to_numpy()
            flat = tuple(x.values.to_numpy(zero_copy_only=False) for x in lists)
            for i, key in enumerate(zip(*[column(c).to_pylist() for c in names])):
                if parts and key != now:
                    size += close()
                    parts = []
                    if size >= FLUSH_ROWS:
                        yield packed()
                        keys, sums, size = [], [], 0
                now = key
                parts.append(_sliced(base, flat, i))
        close()
        if keys:
            yield packed()

    return run


def build_summaries(df: DataFrame, groups: list[str], value: str, eps: float = 0.001) -> DataFrame:
    """One summary per group and partition: (groups, part, vals, lo, hi); no shuffle.

    Null and NaN values are left out. The error is at most eps/2 of the rows summarized.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = df.select(*groups, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    kinds = [to_arrow_schema(slim.schema).field(c).type for c in groups]
    schema = T.StructType([*[slim.schema[c] for c in groups], T.StructField("part", T.IntegerType())])
    for name, t in (("vals", T.DoubleType()), ("lo", T.LongType()), ("hi", T.LongType())):
        schema = schema.add(name, T.ArrayType(t))
    return slim.mapInArrow(_builder(groups, kinds, eps / 2), schema)


def merge_by(summaries: DataFrame, groups: list[str], eps: float = 0.001, fan_in: int = 64, levels: int = 2) -> DataFrame:
    """Merge summaries of the same group in ``levels`` rounds of at most about ``fan_in`` each.

    A group spread over very many partitions is merged in salted parts first, so no task takes more
    than the parts of one salt. Within a partition summaries are sorted by group, by Spark, and merged as they
    come, so a task holds one group's at a time. The permitted error grows from eps/2 to eps over the rounds and is
    never added up beyond that: every summary carries its own rank bounds.
    """
    out = summaries
    for level in range(levels):
        last = level == levels - 1
        allowed = eps * (0.5 + 0.5 * (level + 1) / levels)
        salted = out.withColumn("part", F.lit(0) if last else F.pmod(F.hash("part"), F.lit(fan_in ** (levels - 1 - level))))
        ordered = salted.repartition(*groups, "part").sortWithinPartitions(*groups, "part")
        out = ordered.mapInArrow(_merger([*groups, "part"], allowed), salted.schema)
    return out


def percentiles(summaries: DataFrame, groups: list[str], probabilities: dict[str, float]) -> DataFrame:
    """(groups, n, rank_error, one column per named probability) of merged summaries.

    Position (n-1)p with linear interpolation. An empty group doesn't occur; an empty frame gives
    an empty frame.
    """
    names = list(probabilities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batches:
            lists = [chunk.column(chunk.schema.get_field_index(c)) for c in ("vals", "lo", "hi")]
            base = lists[0].offsets.to_numpy()
            flat = tuple(x.values.to_numpy(zero_copy_only=False) for x in lists)
            sums = [_sliced(base, flat, i) for i in range(chunk.num_rows)]
            cols = [chunk.column(chunk.schema.get_field_index(c)) for c in groups]
            cols.append(pa.array([int(s[2][-1]) for s in sums], type=pa.int64()))
            cols.append(pa.array([rank_error(s) for s in sums], type=pa.float64()))
            cols += [pa.array([percentile_of(s, probabilities[p]) for s in sums], type=pa.float64()) for p in names]
            yield pa.RecordBatch.from_arrays(cols, names=[*groups, "n", "rank_error", *names])

    schema = T.StructType([*[summaries.schema[c] for c in groups], T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())])
    for p in names:
        schema = schema.add(p, T.DoubleType())
    return summaries.select(*groups, "vals", "lo", "hi").mapInArrow(run, schema)


def grouped_percentiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float], eps: float = 0.001) -> DataFrame:
    """Percentiles per group with a rank error of at most ``eps`` times the group's rows.

    Null and NaN values don't count; infinities do, at the ends. Null is a group of its own; groups
    without values give no row. Extra columns, also ones named as the result's, are ignored: only
    ``groups`` and ``value`` are read. Equal values are single observations each.
    """
    clash = {"part", "vals", "lo", "hi", "value", "n", "rank_error", *probabilities} & set(groups)
    names = {c: f"q_{c}" for c in clash}
    safe = df.select(*[F.col(c).alias(names.get(c, c)) for c in groups], F.col(value).alias("q_value"))
    keys = [names.get(c, c) for c in groups]
    out = percentiles(merge_by(build_summaries(safe, keys, "q_value", eps), keys, eps), keys, probabilities)
    for c, a in names.items():
        if c not in ("n", "rank_error", *probabilities):
            out = out.withColumnRenamed(a, c)
    return out
