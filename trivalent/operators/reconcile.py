"""Problem 1: differences between two copies of a dataset, by set reconciliation.

Each copy becomes a set of row hashes in GF(2^61-1), parted into buckets by key. Per bucket and copy
only the value of the characteristic polynomial prod(z - x) at a few points is kept; the quotient of
the two copies' values is a rational function whose numerator and denominator hold exactly the row
hashes that one copy has and the other hasn't. It is interpolated under a bound on its degree, and
checked at points that weren't used; buckets that fail go on with the bound doubled. Only rows whose
hash is a root are fetched and compared, field by field.

What is shuffled of unchanged rows are key and content hashes with the row's time, to find each key's
latest row, and a few field elements per bucket. Contents are read again for the found keys alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, small

P61 = (1 << 61) - 1
_P = np.uint64(P61)
_M31, _M30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S31, _S30, _S61, _ONE = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)
CHECKS = 2  # points beyond the degree bound; a wrong answer passes with a chance below 2^-100
BUCKET_ROWS = 64
SYSTEM_CELLS = 1_000_000  # of linear systems solved at once


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a*b mod 2^61-1 of uint64 arrays below 2^61."""
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = a1 * b0 + a0 * b1
    s = ((a1 * b1) << _ONE) + (mid >> _S30) + ((mid & _M30) << _S31) + a0 * b0
    s = (s & _P) + (s >> _S61)
    return np.where(s >= _P, s - _P, s)


def points(count: int) -> list[int]:
    """Evaluation points; row hashes stay below 2^60, so no point is ever a root."""
    return [(1 << 60) + 977 * (i + 1) for i in range(count)]


def _segment_products(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Product of each run of columns of ``values`` (points x rows), by halving."""
    sizes = np.diff(np.append(starts, values.shape[1]))
    seg = np.repeat(np.arange(len(starts)), sizes)
    while values.shape[1] > len(starts):
        pos = np.arange(values.shape[1]) - np.repeat(np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))), np.bincount(seg))
        even = np.flatnonzero(pos % 2 == 0)
        paired = even[(even + 1 < len(seg)) & (seg[np.minimum(even + 1, len(seg) - 1)] == seg[even])]
        values[:, paired] = mulmod(values[:, paired], values[:, paired + 1])
        values, seg = values[:, even], seg[even]
    return values


def _sketcher(m: int):
    """(bucket, side, x) -> (bucket, side, n, evals) per batch."""
    zs = np.array(points(m), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(0).to_numpy(zero_copy_only=False)
            side = b.column(1).to_numpy(zero_copy_only=False)
            x = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            order = np.lexsort((side, bucket))
            bucket, side, x = bucket[order], side[order], x[order]
            starts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (side[1:] != side[:-1]))))
            evals = _segment_products(starts, zs[:, None] - x[None, :])
            n = np.diff(np.append(starts, len(x)))
            flat = np.ascontiguousarray(evals.T).astype(np.int64).ravel()
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.array(side[starts]), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["bucket", "side", "n", "evals"],
            )

    return run


def _poly_at(coefs: list[int], z: int) -> int:
    v = 0
    for c in reversed(coefs):
        v = (v * z + c) % P61
    return v


def _poly_rem(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, q = a[:], [0] * max(1, len(a) - len(b) + 1)
    inv = pow(b[-1], -1, P61)
    while len(a) >= len(b) and any(a):
        if not a[-1]:
            a.pop()
            continue
        f, k = a[-1] * inv % P61, len(a) - len(b)
        q[k] = f
        for i, c in enumerate(b):
            a[k + i] = (a[k + i] - f * c) % P61
        a.pop()
    while len(a) > 1 and not a[-1]:
        a.pop()
    return q, a or [0]


def _poly_gcd(a: list[int], b: list[int]) -> list[int]:
    while any(b):
        a, b = b, _poly_rem(a, b)[1]
    inv = pow(a[-1], -1, P61)
    return [c * inv % P61 for c in a]


def inverse(a: np.ndarray) -> np.ndarray:
    """1/a mod 2^61-1, element by element (0 gives 0), by Fermat."""
    out, base, e = np.ones_like(a), a, P61 - 2
    while e:
        if e & 1:
            out = mulmod(out, base)
        base, e = mulmod(base, base), e >> 1
    return out


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def _solved(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many linear systems (systems x rows x columns and right side): whether each has a solution, and one with its free unknowns 0."""
    count, n, _ = m.shape
    every, rows = np.arange(count), np.arange(n)
    rank, pivot = np.zeros(count, np.int64), np.full((count, n), -1)
    for c in range(n):
        fit = (m[:, :, c] != 0) & (rows[None, :] >= rank[:, None])
        has = np.flatnonzero(fit.any(axis=1))
        if not len(has):
            continue
        at, to = fit[has].argmax(axis=1), rank[has]
        m[has, at], m[has, to] = m[has, to], m[has, at]
        lead = mulmod(m[has, to], inverse(m[has, to, c])[:, None])
        m[has, to] = lead
        factor = m[has, :, c]
        factor[np.arange(len(has)), to] = 0
        m[has] = _minus(m[has], mulmod(factor[:, :, None], lead[:, None, :]))
        pivot[has, c] = to
        rank[has] += 1
    bad = ((m[:, :, n] != 0) & (rows[None, :] >= rank[:, None])).any(axis=1)
    return ~bad, np.where(pivot >= 0, m[every[:, None], np.maximum(pivot, 0), n], np.uint64(0))


def _values(coefs: np.ndarray, zs: np.ndarray) -> np.ndarray:
    """Polynomials (polynomials x coefficients, lowest first) at the points."""
    v = np.zeros((len(coefs), len(zs)), np.uint64)
    for j in range(coefs.shape[1] - 1, -1, -1):
        v = mulmod(v, np.broadcast_to(zs, v.shape)) + coefs[:, j : j + 1]
        v = np.where(v >= _P, v - _P, v)
    return v


def interpolate(ratios: np.ndarray, zs: np.ndarray, delta: int, bound: int) -> list[tuple[list[int], list[int]] | None]:
    """For each row of values the monic (numerator, denominator) whose quotient has them; None if unverified.

    ``delta`` is the difference of their degrees, the same for all rows; ``bound`` limits the sum, and the values beyond
    that many verify the result.
    """
    if abs(delta) > bound:
        return [None] * len(ratios)
    bound -= (bound - delta) % 2
    m1, m2 = (bound + delta) // 2, (bound - delta) // 2
    up = np.ones((len(zs), max(m1, m2) + 1), np.uint64)
    for k in range(1, up.shape[1]):
        up[:, k] = mulmod(up[:, k - 1], zs)
    f = ratios[:, :bound, None]
    right = _minus(mulmod(f, np.broadcast_to(up[None, :bound, m2 : m2 + 1], f.shape)), np.broadcast_to(up[None, :bound, m1 : m1 + 1], f.shape))
    left = np.broadcast_to(up[None, :bound, :m1], (len(ratios), bound, m1))
    ok, sol = _solved(np.concatenate((left, mulmod(_minus(np.zeros_like(f), f), np.broadcast_to(up[None, :bound, :m2], (len(ratios), bound, m2))), right), axis=2))
    one = np.ones((len(ratios), 1), np.uint64)
    num, den = np.concatenate((sol[:, :m1], one), axis=1), np.concatenate((sol[:, m1:], one), axis=1)
    ok &= (_values(num, zs) == mulmod(ratios, _values(den, zs))).all(axis=1)
    out: list[tuple[list[int], list[int]] | None] = []
    for good, a, b in zip(ok, num.tolist(), den.tolist()):
        if not good:
            out.append(None)
            continue
        g = _poly_gcd(a, b)  # the bound may leave room for a common factor
        out.append((_poly_rem(a, g)[0], _poly_rem(b, g)[0]) if len(g) > 1 else (a, b))
    return out


def _solver(bound: int):
    """Sketches in the order of their buckets -> one row per bucket that isn't equal."""
    zs = np.array(points(bound + CHECKS), dtype=np.uint64)
    most = max(1, SYSTEM_CELLS // (bound * bound))

    def solve(keys: list[int], delta: list[int], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        ratio = mulmod(np.stack(a), inverse(np.stack(b)))
        deltas, found = np.array(delta), [None] * len(keys)
        for d in np.unique(deltas):
            own = np.flatnonzero(deltas == d)
            for k, f in zip(own, interpolate(ratio[own], zs, int(d), bound)):
                found[k] = f
        polys = [f or ([1], [1]) for f in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([f is not None for f in found]), pa.array([p for p, _ in polys], pa.list_(pa.int64())), pa.array([q for _, q in polys], pa.list_(pa.int64()))],
            names=["bucket", "solved", "num", "den"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.ones(len(zs), dtype=np.uint64)
        todo: tuple[list, list, list, list] = ([], [], [], [])
        now, n, v = None, [0, 0], [one, one]

        def close() -> None:
            if now is not None and not (n[0] == n[1] and np.array_equal(*v)):
                for where, what in zip(todo, (now, n[0] - n[1], *v)):
                    where.append(what)

        for b in batches:
            evals = b.column(3)
            base, flat = evals.offsets.to_numpy(), evals.values.to_numpy(zero_copy_only=False).astype(np.uint64)
            for i, (k, side, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                if k != now:
                    close()
                    now, n, v = k, [0, 0], [one, one]
                n[side] += size
                v[side] = mulmod(v[side], flat[base[i] : base[i + 1]])
                if len(todo[0]) >= most:
                    yield solve(*todo)
                    todo = ([], [], [], [])
        close()
        if todo[0]:
            yield solve(*todo)

    return run


@F.pandas_udf(T.BooleanType())
def _is_root(x: pd.Series, coefs: pd.Series) -> pd.Series:
    xs = x.to_numpy().astype(np.uint64)
    width = np.array([len(c) for c in coefs], dtype=np.int64)
    padded = np.zeros((len(xs), width.max() if len(xs) else 1), dtype=np.uint64)
    for i, c in enumerate(coefs):
        padded[i, : len(c)] = np.asarray(c).astype(np.uint64)
    v = np.zeros(len(xs), dtype=np.uint64)
    for j in range(padded.shape[1] - 1, -1, -1):
        v = mulmod(v, xs) + padded[:, j]
        v = np.where(v >= _P, v - _P, v)
    return pd.Series(v == 0)


def differing_rows(rows: DataFrame, first_bound: int = 16) -> DataFrame:
    """The rows whose hash one side has and the other hasn't.

    ``rows`` is a written frame of (bucket bigint, side int 0/1, x bigint in [0, 2^60), what else), each x at
    most once a side.
    """
    pending, bound, parts = rows, first_bound, []
    while True:
        sketches = pending.select("bucket", "side", "x").mapInArrow(_sketcher(bound + CHECKS), "bucket long, side int, n long, evals array<long>")
        ordered = sketches.repartition("bucket").sortWithinPartitions("bucket")
        solved = materialize(ordered.mapInArrow(_solver(bound), "bucket long, solved boolean, num array<long>, den array<long>"), "solved")
        sides = solved.where("solved").select("bucket", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("num").alias("coefs")), F.struct(F.lit(1).alias("side"), F.col("den").alias("coefs")))).alias("s"))
        polys = sides.select("bucket", "s.side", "s.coefs").where(F.size("coefs") > 1)
        done, failed = solved.agg(F.count_if("solved"), F.count_if(~F.col("solved"))).first()
        parts.append(pending.join(small(polys, 8 * bound + 64, 2 * done), ["bucket", "side"]).where(_is_root("x", "coefs")).select(*rows.columns))
        if not failed:
            break
        pending = pending.join(small(solved.where("not solved").select("bucket"), 32, failed), "bucket", "left_semi")
        bound *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile(primary: DataFrame, mirror: DataFrame, keys: list[str], canon: Column, at: str | None = None, label: str = "copies", first_bound: int = 16) -> DataFrame:
    """Keys that only one copy holds or whose rows differ, with both copies' rows.

    Of a copy's rows of one key that with the largest ``at`` counts, null being the earliest; of equal times the one
    with the larger hash of its content. Without ``at`` keys must be unique in either copy. Null is a value of a key.
    ``canon`` is the row's content as one value or text, equal only for rows without a difference to report (contents that
    differ for equal rows are sorted out by the comparison of fields that follows). Both frames have the same columns.
    Result: the key columns, ``p`` and ``m`` (structs of the other columns but ``at``, null where the copy has
    no such key). Empty copies and equal copies work alike; the latter give no row.
    """
    rest = [c for c in primary.columns if c not in keys and c != at]
    ident = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    k1, k2 = F.xxhash64(F.lit("key"), ident), F.xxhash64(ident, F.lit("again"))  # 128 bits
    x = F.shiftrightunsigned(F.xxhash64("rc_1", "rc_2", canon), 4)
    keyed = [df.select(*keys, *rest, (F.col(at) if at else F.lit(0)).alias("rc_at"), k1.alias("rc_1"), k2.alias("rc_2")) for df in (primary, mirror)]

    def latest(df: DataFrame, side: int) -> DataFrame:
        top = df.select("rc_1", "rc_2", "rc_at", x.alias("x")).groupBy("rc_1", "rc_2").agg(F.max(F.struct("rc_at", "x")).alias("r"))
        return top.select("rc_1", "rc_2", "r.rc_at", "r.x", F.lit(side).alias("side"))

    both = materialize(latest(keyed[0], 0).unionByName(latest(keyed[1], 1)), f"{label}-rows")
    # a bucket lies within one partition of the aggregation above, which hashed the same columns; were it
    # parted, it would only have more than one sketch
    parts = int(primary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, both.count() // (2 * BUCKET_ROWS * parts))
    bucket = F.pmod(F.hash("rc_1", "rc_2"), F.lit(parts)).cast("long") * each + F.pmod("rc_1", F.lit(each))
    found = materialize(differing_rows(both.withColumn("bucket", bucket), first_bound).drop("bucket"), f"{label}-found")

    count = found.count()

    def fetched(df: DataFrame, side: int) -> DataFrame:
        own = found.where(F.col("side") == side).select(F.col("rc_1").alias("f_1"), F.col("rc_2").alias("f_2"), F.col("rc_at").alias("f_at"))
        met = df.join(small(own, 64, count), (F.col("rc_1") == F.col("f_1")) & (F.col("rc_2") == F.col("f_2")) & F.col("rc_at").eqNullSafe(F.col("f_at")))
        row = F.struct(*rest) if rest else F.struct(F.lit(True).alias("held"))
        # of several rows of the found time the one with the larger hash, as above; the hash is taken of these few rows alone
        return met.select(*keys, F.lit(side).alias("rc_side"), row.alias("rc_row"), F.struct(x.alias("x"), F.xxhash64(row)).alias("rc_order"))

    rows = fetched(keyed[0], 0).unionByName(fetched(keyed[1], 1))
    one = lambda side: F.max_by(F.when(F.col("rc_side") == side, F.col("rc_row")), F.when(F.col("rc_side") == side, F.col("rc_order")))
    return rows.groupBy(*keys).agg(one(0).alias("p"), one(1).alias("m"))


def latest_per_key(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the row with the largest ``at``; equal times go to the largest row content.

    A null time is the earliest. Repeated rows count once.
    """
    rest = [c for c in df.columns if c not in keys and c != at]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, F.hash(*rest), F.xxhash64(*rest))).alias("r")).select(*keys, "r.*")
