"""Problem 5: varied subsets of given sizes, by tournament-pivoted rank-revealing QR.

Graphs of one face multiset have the same feature row, so a family counts through one member at a
time: first the members that are alone, then one of every larger family, then second members, and so
on; no family gets a further member before every other one had its turn. Within such a tier the
rows to take are found by rounds of a tournament:

* every leaf (a bounded share of the rows of a bracket) nominates linearly independent rows by QR with
  pivoting on the largest residual, pairs of leaves are joined and pivoted again, up to the bracket's root;
  each bracket has its quota of the rows wanted, in pivot order;
* the next round works on features from which the leading directions of all rows chosen so far are
  projected out (deflation), until the wanted number is reached.

Features are random cosines of the face-size histogram, so a small residual means that a like record
is already in. All selections go through the same rounds side by side; members are numbered by range
partitions, so no family and no tier comes into one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import multiset, norm_hash
from ..operators.stats import tie_ranks
from ..session import materialize

FEATURES = 128  # cosines
PICKS = 64  # rows that a node of the tournament passes on
LEAF_ROWS = 512
DEFLATED = 48  # directions projected out
BINS = 40
TINY = 1e-9


def histogram(sigs: list[list[int]]) -> np.ndarray:
    """log(1 + count) of each face size; sizes share bins beyond the range."""
    out = np.zeros((len(sigs), BINS))
    for i, s in enumerate(sigs):
        for v in s:
            out[i, abs(v) // 2 % BINS] += 1
    return np.log1p(out)


def cosines(hist: np.ndarray, seed: int, removed: np.ndarray | None) -> np.ndarray:
    rng = np.random.RandomState(seed)
    w, shift = rng.normal(scale=0.7, size=(BINS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.cos(hist @ w + shift) * np.sqrt(2 / FEATURES)
    return x if removed is None else x - (x @ removed) @ removed.T


def pivoted_rows(x: np.ndarray, most: int) -> tuple[list[int], list[float]]:
    """Row numbers in pivot order and their residual norms; stops where the rank is revealed."""
    x = x.copy()
    norm = (x * x).sum(axis=1)
    picks, sizes = [], []
    for _ in range(min(most, len(x))):
        k = int(norm.argmax())
        size = float(np.sqrt(max(norm[k], 0)))
        if size < TINY:
            break
        v = x[k] / size
        along = x @ v
        x -= np.outer(along, v)
        norm = (x * x).sum(axis=1)
        norm[picks + [k]] = -1
        picks.append(k)
        sizes.append(size)
    return picks, sizes


@dataclass(frozen=True)
class Wish:
    """A selection: how many graphs (None: one of every family) of the orders from ``lowest`` to ``highest`` (None: unbounded)."""

    selection: int
    size: int | None
    lowest: int | None = None
    highest: int | None = None


COLUMNS = ["selection", "graph", "sig", "family_size", "member"]


def _by(values: dict[int, int], default: int = 0) -> Column:
    """A number of each row's selection."""
    known = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, int(v))])
    return F.coalesce(F.try_element_at(known, F.col("selection").cast("int")), F.lit(default)) if values else F.lit(default)


def _node(seed: int, removed: dict[int, np.ndarray]):
    """One node of the tournament: its rows in, its nominees with their place in pivot order out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("graph").combine_chunks()
        own = removed.get(table["selection"][0].as_py())
        picks, _ = pivoted_rows(cosines(histogram(table["sig"].to_pylist()), seed, own), PICKS)
        kept = table.take(pa.array(picks, pa.int64()))
        return kept.set_column(kept.schema.get_field_index("pick"), "pick", pa.array(np.arange(len(picks)), pa.int32()))

    return run


def moments(rows: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """For each selection the sum of x x' over its rows' features; tasks send one small matrix a selection."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x, own = cosines(histogram(b.column(1).to_pylist()), seed, None), b.column(0).to_numpy()
                for k in np.unique(own):
                    part = x[own == k]
                    total[int(k)] = total.get(int(k), 0) + part.T @ part
        for k, g in total.items():
            at = np.arange(FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(FEATURES**2, k), pa.int64()), pa.array(np.repeat(at, FEATURES), pa.int32()), pa.array(np.tile(at, FEATURES), pa.int32()), pa.array(g.ravel())], names=["selection", "i", "j", "v"])

    summed = rows.select("selection", "sig").mapInArrow(run, "selection long, i int, j int, v double").groupBy("selection", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, own in summed.groupby("selection"):
        out[int(k)] = np.zeros((FEATURES, FEATURES))
        out[int(k)][own["i"], own["j"]] = own["v"]
    return out


def _leading_directions(rows: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Leading eigenvectors of the features of each selection's rows chosen so far."""
    out = {}
    for k, g in moments(rows, seed).items():
        values, vectors = np.linalg.eigh(g)
        out[k] = vectors[:, [i for i in range(FEATURES - 1, -1, -1) if values[i] > 1e-6 * values[-1]][:DEFLATED]]
    return out


def log_volume(rows: DataFrame, seed: int = 0) -> dict[int, float]:
    """For each selection the logarithm of the volume that its rows' features span: log det of their mean square and a thousandth. Larger is more varied."""
    counts = {r[0]: r[1] for r in rows.groupBy("selection").count().collect()}
    return {k: float(np.linalg.slogdet(g / counts[k] + 1e-3 * np.eye(FEATURES))[1]) for k, g in moments(rows, seed).items()}


def tournament(rows: DataFrame, count: dict[int, int], wanted: dict[int, int], seed: int, chosen: DataFrame | None) -> DataFrame:
    """One round: of each selection's ``count`` rows up to ``wanted``, the first of every bracket's pivot order."""
    brackets = {k: -(-w // PICKS) for k, w in wanted.items()}
    leaves = {k: max(1, -(-count[k] // (brackets[k] * LEAF_ROWS))) for k in wanted}
    removed = _leading_directions(chosen, seed) if chosen is not None else {}
    out = rows.where(_by(brackets) > 0).select(
        *COLUMNS, F.pmod(F.xxhash64("graph", F.lit(seed)), _by(brackets, 1)).alias("bracket"),
        F.pmod(F.xxhash64(F.lit(seed), "graph"), _by(leaves, 1)).alias("leaf"), F.lit(0).alias("pick"),
    )
    deepest = max(leaves.values())
    while True:
        out = out.groupBy("selection", "bracket", "leaf").applyInArrow(_node(seed, removed), out.schema)
        if deepest == 1:
            break
        deepest = -(-deepest // 2)
        out = out.withColumn("leaf", F.floor(F.col("leaf") / 2))
    # the quotas of a selection's brackets add up to what is wanted
    quota = F.floor(_by(wanted) / _by(brackets, 1)) + F.when(F.col("bracket") < _by(wanted) % _by(brackets, 1), 1).otherwise(0)
    return out.where(F.col("pick") < quota).select(*COLUMNS)


def take_from_tier(tier: DataFrame, count: dict[int, int], wanted: dict[int, int], seed: int, chosen: DataFrame | None) -> DataFrame | None:
    """Of each selection ``min(count, wanted)`` rows of a tier (a written frame): halves of what is wanted, then the rest."""
    left = {k: n for k, n in count.items() if n > 0}
    need = {k: min(left[k], wanted.get(k, 0)) for k in left}
    got: list[DataFrame] = []
    fresh, begun = dict.fromkeys(need, True), set()
    while any(need.values()):
        ask = {k: n if n <= PICKS or k in begun else -(-n // 2) for k, n in need.items() if n > 0}
        taken = reduce(DataFrame.unionByName, got) if got else None
        rest = tier.join(taken.select("selection", "graph"), ["selection", "graph"], "left_anti") if taken is not None else tier
        basis = [f for f in (taken, chosen) if f is not None]
        deflated = reduce(DataFrame.unionByName, basis).where(_by({k: fresh[k] for k in ask}) > 0) if basis else None
        won = materialize(tournament(rest, left, ask, seed + len(got), deflated), "won")
        n = {r[0]: r[1] for r in won.groupBy("selection").count().collect()}
        if not n and (deflated is None or not any(fresh[k] for k in ask)):
            raise RuntimeError("a tournament without deflation must give a row")
        for k in ask:
            # nothing new beyond the directions taken: a cycle is over, begin anew
            fresh[k] = k in n
            left[k], need[k] = left[k] - n.get(k, 0), need[k] - n.get(k, 0)
        begun |= n.keys()
        got.append(won)
    return reduce(DataFrame.unionByName, got) if got else None


def face_graphs(records: DataFrame) -> DataFrame:
    """(graph, graph_order, sig): each graph once; a listed multiset wins over a missing one."""
    sig = F.when(F.size("face_size_multiset") > 0, multiset(F.filter("face_size_multiset", lambda v: v.isNotNull())))
    rows = records.select(norm_hash("canonical_graph_hash").alias("graph"), F.col("requested_vertex_count").alias("graph_order"), sig.alias("sig")).where("graph is not null")
    return rows.groupBy("graph").agg(F.max("graph_order").alias("graph_order"), F.max("sig").alias("sig"))


def whole_turns(sizes: dict[int, int], size: int) -> tuple[int, int]:
    """The largest T such that T members of every family (all of smaller ones) are no more than ``size``, and how many these are."""
    low, high = 0, max(sizes, default=0)
    covered = lambda t: sum(n * min(s, t) for s, n in sizes.items())
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if covered(mid) <= size else (low, mid - 1)
    return low, covered(low)


def varied_subsets(graphs: DataFrame, wishes: list[Wish], seed: int = 1, by_hash: bool = False) -> DataFrame:
    """(selection, graph, sig, family_size, member): for every wish its number of ``face_graphs``, all if there are fewer.

    Members of a family are numbered by rising hash; families are those within the orders of the wish.
    Graphs without a multiset come last, by rising hash, and have family size 0. An empty frame or size 0 gives no row.
    Selections must have different numbers, which fit an int; there are as many as a driver can list. With ``by_hash`` the rows of a tier
    that isn't taken whole are those of the least hash instead: what a choice without pivoting comes to.
    """
    kind = "selection long, graph string, sig array<int>, family_size long, member int"
    if not wishes:
        return graphs.sparkSession.createDataFrame([], kind)

    def within(w: Wish) -> Column:
        ok = F.lit(True)
        for bound, fits in ((w.lowest, F.col("graph_order") >= F.lit(w.lowest)), (w.highest, F.col("graph_order") <= F.lit(w.highest))):
            ok &= fits if bound is not None else F.lit(True)
        return F.when(ok, F.lit(w.selection).cast("long"))

    every = graphs.withColumn("selection", F.explode(F.filter(F.array(*map(within, wishes)), lambda x: x.isNotNull())))
    held = every.where("size(sig) > 0")
    families = materialize(held.groupBy("selection", "sig").agg(F.count("*").alias("family_size"), F.min("graph").alias("graph")), "families")
    sizes: dict[int, dict[int, int]] = {w.selection: {} for w in wishes}
    for r in families.groupBy("selection", "family_size").count().collect():  # distinct sizes only: at most sqrt(2 graphs) a wish
        sizes[r[0]][r[1]] = r[2]
    size = {w.selection: sum(sizes[w.selection].values()) if w.size is None else w.size for w in wishes}
    single = {k: s.get(1, 0) for k, s in sizes.items()}
    first = {k: sum(s.values()) for k, s in sizes.items()}
    turns = {k: whole_turns(s, size[k]) for k, s in sizes.items()}
    pool = families.select("selection", "graph", "sig", "family_size", F.lit(1).alias("member"))
    # members are numbered only where a wish goes beyond the first of every family
    more = {k: t + (size[k] > c) for k, (t, c) in turns.items() if t >= 1 and size[k] > first[k]}
    if more:
        key = F.xxhash64("sig").alias("family")
        ranked = tie_ranks(held.where(_by(more) > 1).select("selection", key, "graph"), ["selection", "family"], "graph").where((F.col("less") >= 1) & (F.col("less") < _by(more)))
        later = ranked.select("selection", "family", "graph", (F.col("less") + 1).cast("int").alias("member"))
        pool = pool.unionByName(later.join(families.select("selection", key, "sig", "family_size"), ["selection", "family"]).select(*pool.columns))
        pool = materialize(pool, "members")
    tiers = [
        (F.col("family_size") == 1, single, {k: min(size[k], n) for k, n in single.items()}),
        ((F.col("family_size") > 1) & (F.col("member") == 1), {k: first[k] - single[k] for k in first}, {k: max(0, min(size[k], first[k]) - single[k]) for k in first}),
        # later turns repeat feature rows that are in already: those that fit are taken whole, and the last one is chosen from
        (F.col("member") == _by({k: t + 1 for k, (t, _) in turns.items()}), {k: sum(n for s, n in sizes[k].items() if s > t) for k, (t, _) in turns.items()}, {k: size[k] - c if t else 0 for k, (t, c) in turns.items()}),
    ]
    chosen: DataFrame | None = None
    for number, (which, count, wanted) in enumerate(tiers):
        tier = pool.where(which)
        if number == 2:
            tier = tier.where("member > 1")
            whole = pool.where((F.col("member") > 1) & (F.col("member") <= _by({k: t for k, (t, _) in turns.items()})))
        if by_hash:
            hashed = tier.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), "graph"), 256))
            order = tie_ranks(hashed, ["selection"], "hash").where(F.col("less") < _by(wanted)).select("selection", "hash")
            won = hashed.join(order, ["selection", "hash"], "left_semi").select(*COLUMNS)
        else:
            won = take_from_tier(tier, count, wanted, seed + 100 * number, chosen if number < 2 else None)
        for part in (won, whole if number == 2 else None):
            if part is not None:
                chosen = part if chosen is None else chosen.unionByName(part)
    known = {k: sum(s * n for s, n in own.items()) for k, own in sizes.items()}
    lacking = {k: size[k] - known[k] for k in size if size[k] > known[k]}
    if lacking:
        bare = tie_ranks(every.where("sig is null or size(sig) = 0").select("selection", "graph"), ["selection"], "graph").where(F.col("less") < _by(lacking))
        chosen = chosen.unionByName(bare.select("selection", "graph", F.lit(None).cast("array<int>").alias("sig"), F.lit(0).cast("long").alias("family_size"), F.lit(1).alias("member")))
    return chosen.select(*COLUMNS)


def varied_subset(graphs: DataFrame, size: int | None, seed: int = 1) -> DataFrame:
    """(graph, sig, family_size, member) of one wish over all orders."""
    return varied_subsets(graphs, [Wish(0, size)], seed).drop("selection")
