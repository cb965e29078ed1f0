import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.operators import quality, ranking, stats


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [("a", i, float(rng.randrange(50))) for i in range(400)] + [("hot", i, rng.lognormvariate(0, 2)) for i in range(30_000)]
    rows += [("one", 0, 3.5), ("same", 0, 2.0), ("same", 1, 2.0), (None, 1, 1.0), (None, 2, 4.0), ("a", 900, None), ("a", 901, float("nan")), ("gone", 1, None)]
    return rows, spark.createDataFrame(rows, "g string, i long, x double").repartition(6).cache()


def by_group(rows):
    out = {}
    for g, _, x in rows:
        if x is not None and x == x:
            out.setdefault(g, []).append(x)
    return out


def test_exact_percentiles(spark, values):
    rows, df = values
    got = {r.g: r for r in stats.exact_percentiles(df, ["g"], "x", {"lo": 0.0, "mid": 0.5, "q": 0.95, "hi": 1.0}).collect()}
    want = by_group(rows)
    assert set(got) == set(want)
    for g, v in want.items():
        assert got[g].n == len(v)
        assert [got[g].lo, got[g].mid, got[g].q, got[g].hi] == pytest.approx([np.percentile(v, p) for p in (0, 50, 95, 100)], rel=1e-12)
    none = df.limit(0)
    assert stats.exact_percentiles(none, ["g"], "x", {"m": 0.5}).count() == 0
    assert stats.distribution(df, [], "x").first().value_count == sum(map(len, want.values()))


def test_robust_profile_ladder(spark):
    rows = [("mad", x) for x in (1.0, 2, 3, 4, 9)] + [("iqr", x) for x in (0.0, 0, 0, 0, 0, 5, 6)] + [("dec", x) for x in [0.0] * 17 + [1, 1, 1]] + [("half", x) for x in [0.0] * 30 + [4.0]] + [("flat", 1.0)] * 3
    rows = [(g, float(x)) for g, x in rows]
    got = {r.g: r for r in stats.robust_profile(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert {g: r.robust_scale_method for g, r in got.items()} == {"mad": "mad_normal", "iqr": "iqr_normal", "dec": "decile_normal", "half": "half_range", "flat": "constant"}
    assert got["mad"].robust_scale == pytest.approx(1.4826) and got["half"].robust_scale == 2.0 and got["flat"].robust_scale == 0.0
    z = stats.robust_z(spark.createDataFrame([("flat", 9.0), ("mad", 3.0)], "g string, x double"), ["g"], "x", stats.robust_profile(spark.createDataFrame(rows, "g string, x double"), ["g"], "x"))
    assert {r.z for r in z.collect()} == {0.0}


def test_ranks_with_ties(spark, values):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 2), ("g", 3, 2), ("g", 4, 4), ("g", 5, None)], "g string, i int, v int")
    got = {r.i: (r.competition_rank, r.mid_percentile, r.average_rank) for r in stats.with_ranks(df, ["g"], "v").collect()}
    assert got == {1: (4, 0.125, 1.0), 2: (2, 0.5, 2.5), 3: (2, 0.5, 2.5), 4: (1, 0.875, 4.0)}
    rows, big = values
    ranked = stats.with_ranks(big, [], "x").select("x", "competition_rank").collect()
    v = sorted((x for xs in by_group(rows).values() for x in xs), reverse=True)
    assert all(v[r.competition_rank - 1] == r.x and (r.competition_rank == 1 or v[r.competition_rank - 2] > r.x) for r in ranked) and len(ranked) == len(v)


def test_correlation_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 4.0, 5.0), ("a", 3.0, 6.0, 5.0), ("b", 1.0, 1.0, 1.0)], "s string, y double, m double, c double")
    got = {(r.pooled, r.s, r.metric): (r.n, r.pearson, r.spearman) for r in stats.correlations(df, "s", "y", ["m", "c"]).collect()}
    assert got[False, "a", "m"] == (3, pytest.approx(1.0), pytest.approx(1.0)) and got[False, "a", "c"] == (3, None, None) and got[False, "b", "m"][1] is None
    assert got[True, None, "m"][0] == 4


def test_selections(spark):
    df = spark.createDataFrame([("h1", 3.0, 1.0), ("h2", 3.0, None), ("h3", 1.0, float("nan"))], "h string, a double, b double")
    assert [(r.metric, r.place, r.h) for r in ranking.leaderboards(df, "h", ["a", "b"], 2).orderBy("metric", "place").collect()] == [("a", 1, "h1"), ("a", 2, "h2"), ("b", 1, "h1")]
    s = lambda *k: spark.createDataFrame([(x, i) for i, x in enumerate(k)], "h string, position int")
    got = {r.h: (r.best_priority, r.best_position, r.reasons) for r in ranking.stratified([("one", 1, s("x", "y")), ("two", 2, s("y", "z"))], "h").collect()}
    assert got == {"x": (1, 0, "one"), "y": (1, 1, "one,two"), "z": (2, 1, "two")}
    many = spark.createDataFrame([("g", i) for i in range(100)] + [("s", i) for i in range(5)], "g string, i int")
    picked = ranking.audit_sample(many, ["g"], "i", "seed", 10, 24)
    assert 10 <= picked.where("g = 'g'").count() <= 12 and picked.where("g = 's'").count() == 5
    assert picked.exceptAll(ranking.audit_sample(many.repartition(7), ["g"], "i", "seed", 10, 24)).count() == 0
    assert {r.i for r in ranking.pruned(spark.createDataFrame([("a", 1, 9.0), ("a", 2, 1.0), ("b", 3, 5.0)], "c string, i int, x double"), "c", "x", "i", 1, 1).collect()} == {2, 3}


def test_audits(spark):
    df = spark.createDataFrame([("g", 0), ("g", 1), ("g", 4), ("h", 5), (None, None)], "g string, i int")
    assert {r.g: r.contiguous for r in quality.contiguity(df, ["g"], "i").collect()} == {"g": False, "h": True, None: False}
    assert [tuple(r) for r in quality.gaps(df, ["g"], "i").collect()] == [("g", 2, 3)]
    assert {tuple(r) for r in quality.violations(df, ["g"], {"small": F.col("i") < 3}).collect()} == {("g", "small"), ("h", "small"), (None, "small")}
    assert {tuple(r) for r in quality.set_difference(df, df.where("g = 'g'"), "g").collect()} == {("h", "left"), (None, "left")}
    faces = spark.createDataFrame([(1, [4] * 6, 8, 12), (2, [4, 6, 4], 8, 12), (3, None, 8, 12), (4, [3] * 8, 8, 12)], "i int, f array<int>, n int, m int")
    bad = {}
    for r in quality.violations(faces, ["i"], quality.face_multiset_rules("f", "n", "m")).collect():
        bad.setdefault(r.i, set()).add(r.rule)
    assert 1 not in bad and bad[3] == {"faces_sorted", "face_count", "face_sizes", "face_sum"} and bad[2] >= {"faces_sorted", "face_sum"} and "face_sizes" in bad[4]


def test_adjacent_pairs_across_partitions(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", i, rng.choice("abc")) for i in range(3000)] + [(None, 1, "x"), (None, 2, None), ("lone", 1, "y")]
    df = spark.createDataFrame(rows, "g string, i int, v string").repartition(7)
    want = {}
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(g, []).append(v)
    pairs = sorted((str(g), str(a), str(b)) for g, vs in want.items() for a, b in zip(vs, vs[1:]))
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = sorted((str(r.g), str(r.v), str(r.nxt)) for r in stats.adjacent_pairs(df, ["g"], ["i"], "v", "nxt").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == pairs
    assert stats.adjacent_pairs(df.limit(0), ["g"], ["i"], "v").count() == 0


def test_percentiles_survive_a_sketch_that_errs(spark, monkeypatch):
    """With a coarse sketch and a margin of nothing brackets miss their ranks; such groups are sorted whole."""
    import numpy as np

    rng = np.random.RandomState(7)
    rows = [(g, float(v)) for g, n in (("a", 4000), (None, 3000), ("c", 30)) for v in rng.exponential(size=n)]
    df = spark.createDataFrame(rows, "g string, v double")
    plain = F.percentile_approx
    monkeypatch.setattr(stats, "ACCURACY", 50)
    monkeypatch.setattr(stats.F, "percentile_approx", lambda c, p, a: plain(c, F.array(*map(F.lit, (0.6, 0.99, 0.7, 0.995))), a))
    got = {r.g: (r.n, r.m, r.q) for r in stats.exact_percentiles(df, ["g"], "v", {"m": 0.5, "q": 0.99}).collect()}
    for g in ("a", None, "c"):
        own = [v for k, v in rows if k == g]
        assert got[g][0] == len(own) and np.allclose(got[g][1:], np.quantile(own, [0.5, 0.99]))
