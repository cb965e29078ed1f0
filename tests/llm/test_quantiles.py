import random

import numpy as np
import pytest

from trivalent.llm import quantiles as q


def test_merged_summaries_keep_their_bounds():
    rng = np.random.RandomState(3)
    for eps in (0.05, 0.01):
        for kind in range(3):
            parts = [rng.lognormal(size=rng.randint(1, 900)) if kind == 0 else rng.randint(0, 6, rng.randint(1, 900)).astype(float) if kind == 1 else np.arange(rng.randint(1, 900)) * 1.0 for _ in range(37)]
            every = np.sort(np.concatenate(parts))
            s = q.merge_all([q.compress(q.exact_summary(p), eps / 2) for p in parts], eps)
            lows, highs = np.searchsorted(every, s[0], "left") + 1, np.searchsorted(every, s[0], "right")
            assert (s[1] <= highs).all() and (s[2] >= lows).all() and (s[1] <= s[2]).all()
            assert q.rank_error(s) <= eps * len(every) + 1 and s[2][-1] == len(every)
            for r in (1, len(every) // 3, len(every)):
                v = q.value_at_rank(s, r)
                a, b = np.searchsorted(every, v, "left") + 1, np.searchsorted(every, v, "right")
                assert max(a - r, r - b, 0) <= eps * len(every) + 1
            if kind == 0:
                assert len(s[0]) < 3 / eps + 3


def test_grouped_percentiles(spark):
    rng = random.Random(4)
    rows = [("hot", rng.lognormvariate(0, 1)) for _ in range(20_000)] + [(f"g{i % 50}", float(rng.randrange(30))) for i in range(2000)]
    rows += [(None, 1.0), (None, 2.0), ("g0", None), ("g0", float("nan")), ("none", None), ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    df = spark.createDataFrame(rows, "part string, x double").repartition(11)
    got = {r.part: r for r in q.grouped_percentiles(df, ["part"], "x", {"m": 0.5, "p": 0.99}, eps=0.001).collect()}
    groups = {}
    for g, x in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g].n == len(v)
        if len(v) <= 500:
            assert got[g].rank_error <= 0.5 and got[g].m == pytest.approx(2.0 if g == "inf" else np.percentile(v, 50))
    v = np.sort(groups["hot"])
    for name, p in (("m", 0.5), ("p", 0.99)):
        at = np.searchsorted(v, getattr(got["hot"], name))
        assert abs(at - p * len(v)) <= 0.001 * len(v) + 2
    assert q.grouped_percentiles(df.limit(0), ["part"], "x", {"m": 0.5}).count() == 0


def test_days_merge_to_the_whole(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(f"d{i % 7}", rng.random()) for i in range(9000)], "day string, x double").repartition(5)
    days = q.merge_by(q.build_summaries(df, ["day"], "x", 0.005), ["day"], 0.005)
    assert days.count() == 7
    whole = q.percentiles(q.merge_by(days.withColumn("part", days.part * 0).select("part", "vals", "lo", "hi"), [], 0.01), [], {"m": 0.5}).first()
    assert whole.n == 9000 and abs(whole.m - 0.5) < 0.03 and whole.rank_error <= 0.01 * 9000
