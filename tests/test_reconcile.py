import json
import random

import numpy as np
from pyspark.sql import functions as F

from trivalent.functions import records
from trivalent.operators import bundles, reconcile

P = reconcile.P61


def test_mulmod_and_segment_products():
    rng = random.Random(1)
    a = [rng.randrange(P) for _ in range(500)] + [0, 1, P - 1]
    b = [rng.randrange(P) for _ in range(500)] + [P - 1, P - 1, P - 1]
    got = reconcile.mulmod(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
    assert [int(x) for x in got] == [x * y % P for x, y in zip(a, b)]
    starts = np.array([0, 1, 4, 9])
    vals = np.array([[rng.randrange(P) for _ in range(20)] for _ in range(3)], dtype=np.uint64)
    out = reconcile._segment_products(starts, vals.copy())
    for i, (s, e) in enumerate(zip(starts, [1, 4, 9, 20])):
        for j in range(3):
            want = 1
            for v in vals[j, s:e]:
                want = want * int(v) % P
            assert int(out[j, i]) == want


def test_interpolation_recovers_the_difference_or_says_so():
    rng = random.Random(2)
    for only_a, only_b, bound in ((0, 0, 4), (3, 2, 8), (8, 0, 8), (0, 7, 8), (4, 4, 8), (6, 5, 8), (20, 1, 16)):
        common = [rng.randrange(1 << 60) for _ in range(30)]
        a, b = [rng.randrange(1 << 60) for _ in range(only_a)], [rng.randrange(1 << 60) for _ in range(only_b)]
        zs = reconcile.points(bound + reconcile.CHECKS)

        def at(s, z):
            v = 1
            for x in s:
                v = v * (z - x) % P
            return v

        ratio = [at(common + a, z) * pow(at(common + b, z), -1, P) % P for z in zs]
        both = np.array([ratio, ratio], dtype=np.uint64)
        found, again = reconcile.interpolate(both, np.array(zs, dtype=np.uint64), only_a - only_b, bound)
        assert found == again
        if only_a + only_b > bound:
            assert found is None
        else:
            num, den = found
            assert len(num) == only_a + 1 and len(den) == only_b + 1
            assert all(reconcile._poly_at(num, x) == 0 for x in a) and all(reconcile._poly_at(den, x) == 0 for x in b)


def test_reconcile_against_sets(spark):
    rng = random.Random(3)
    left = {i: f"v{i}" for i in range(900)}
    right = {i: (f"w{i}" if rng.random() < 0.2 else v) for i, v in left.items() if rng.random() > 0.05} | {5000 + i: "x" for i in range(300)}  # one side has many more
    make = lambda d: spark.createDataFrame(list(d.items()), "k long, v string")
    got = {r.k: (r.p and r.p.v, r.m and r.m.v) for r in reconcile.reconcile(make(left), make(right), ["k"], F.col("v"), first_bound=4).collect()}
    assert got == {k: (left.get(k), right.get(k)) for k in left.keys() | right.keys() if left.get(k) != right.get(k)}
    none = spark.createDataFrame([], "k long, v string")
    assert reconcile.reconcile(none, none, ["k"], F.col("v")).count() == 0
    assert reconcile.reconcile(make(left), make(left), ["k"], F.col("v")).count() == 0
    assert {r.k for r in reconcile.reconcile(make({1: "a"}), none, ["k"], F.col("v")).collect()} == {1}


def test_latest_rows_of_a_key_and_ties(spark):
    """Of several rows of a key the latest counts; of equal times the same one whichever copy and partition it lies in."""
    schema = "k long, v string, t int"
    tied = [(2, "x", 5), (2, "y", 5), (2, "x", 5)]
    left = [(1, "old", 1), (1, "new", 2), *tied, (3, "only", None), (None, "null key", 1), (4, "a", None), (4, "b", 0)]
    right = [(1, "new", 1), *tied[::-1], (None, "other", 1), (4, "b", 9)]
    make = lambda rows, n: spark.createDataFrame(rows, schema).repartition(n)
    for n in (1, 3):
        got = reconcile.reconcile(make(left, n), make(right, 2), ["k"], F.col("v"), "t", first_bound=2).collect()
        assert {(r.k, r.p and r.p.v, r.m and r.m.v) for r in got} == {(3, "only", None), (None, "null key", "other")}


def test_record_paths():
    a = {"n": 3, "x": {"t": 0.1, "u": None, "l": [1, 2]}, "face_size_multiset": [4, 6, 4], "hardest_ordered_pair": [[2, 1], [3, 4]], "f": True}
    b = {"hardest_ordered_pair": [[1, 2], [4, 3]], "face_size_multiset": [6, 4, 4], "x": {"t": 0.1 * (1 + 1e-11), "l": [2, 1], "new": "y"}, "n": 3.0, "f": 1}
    assert records.differing_paths(json.dumps(a), json.dumps(b), "r") == ["r.f", "r.x.l", "r.x.new"]
    assert records.differing_paths(None, "", "r") == [] and records.differing_paths("broken{", "{}", "r") == ["r"]
    assert records.differing_paths('{"hardest_ordered_pair": [[1,2],[3,4]]}', '{"hardest_ordered_pair": [[3,4],[1,2]]}', "r") == ["r.hardest_ordered_pair"]
    # equal canonical text implies equality; near values on a rounding edge may differ in text only
    assert records.canonical('{"a": 1.0, "b": null}', "r") == records.canonical('{ "a" : 1 }', "r")
    assert not records.same(1.0, 1.0 + 1e-8) and records.same(1.0, 1.0 + 1e-10)


BUNDLE = "graph_hash string, planar_code_paths array<string>, embedding_paths array<string>, report_paths array<string>, leaderboard_categories array<string>, original_record string, copied_at timestamp, extra int"


def test_bundle_differences(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    a = [("AB ", ["x", "y"], None, [], ["c"], '{"n": 1}', t(1), 0), ("ab", ["y", "x", "x"], [], None, ["c"], '{"n": 2}', t(2), 0), ("only", None, None, None, None, None, t(1), 0), ("same", None, None, None, None, "{}", None, 1)]
    a += a[:2]
    b = [("ab", ["x", "y"], [], [], ["d"], '{"n": 2, "m": null, "o": {"p": 5}}', t(1), 9), ("mir", [], [], [], [], "{}", t(3), 9), ("same", [None], [], [], [], None, t(2), 9)]
    got = {tuple(r)[1:] for r in bundles.bundle_differences(spark.createDataFrame(a, BUNDLE), spark.createDataFrame(b, BUNDLE)).collect()}
    assert got == {
        ("ab", -1, "leaderboard_categories", "differs"), ("ab", -1, "original_record.o.p", "differs"), ("only", -1, "", "only_primary"), ("mir", -1, "", "only_mirror"),
    }
    none = spark.createDataFrame([], BUNDLE)
    assert bundles.bundle_differences(none, none).count() == 0


def test_constraint_differences(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    schema = "held_by string, graph_hash string, analysis string, constraint_index int, required_edges array<array<int>>, forbidden_edges array<array<int>>, copied_at timestamp"
    rows = [
        ("primary", "A", "x", 1, [[1, 2], [3, 4]], None, t), ("mirror", "a", "x", 1, [[4, 3], [2, 1], [1, 2]], [], t),
        ("primary", "a", "x", 2, [[1, 2]], [[5, 6]], t), ("mirror", "a", "y", 2, [[1, 3]], [[6, 5]], t), ("primary", "a", "x", 3, None, None, t), ("other", "a", "x", 4, None, None, t),
    ]
    got = {tuple(r) for r in bundles.constraint_differences(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("constraint", "a", 2, "analysis", "differs"), ("constraint", "a", 2, "required_edges", "differs"), ("constraint", "a", 3, "", "only_primary")}
