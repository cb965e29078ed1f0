from test_graphs import CUBE, CUBE_EDGES, K33, cycle_rows, edge_frame

from pyspark.sql import functions as F

from trivalent.functions import geometry
from trivalent.operators import cycles, embedding, ladder, merging, ranking, separation


def test_ladders_of_the_cube_and_a_prism(spark):
    prism = [[1, 2, 3], [2, 0, 4], [0, 1, 5], [5, 4, 0], [3, 5, 1], [4, 3, 2]]
    # a ladder of three cells closed by two larger faces: 8 vertices 0..3 above 4..7, ends joined outside
    strip = [[1, 4], [2, 5, 0], [3, 6, 1], [7, 2], [0, 5], [4, 1, 6], [5, 2, 7], [6, 3]]
    df = spark.createDataFrame([("cube", CUBE), ("prism", prism), ("strip", strip)], "graph string, rotation array<array<int>>")
    walks = embedding.dart_faces(df).withColumn("face", F.struct("face_u", "face_v"))
    got = {r.graph: r for r in ladder.ladder_parameters(walks).collect()}
    assert (got["cube"].quadrilaterals, got["cube"].strips, got["cube"].closed_strips, got["cube"].score) == (6, 0, 3, None)
    assert (got["prism"].quadrilaterals, got["prism"].closed_strips, got["prism"].ladder_max) == (3, 1, 0)
    assert (got["strip"].quadrilaterals, got["strip"].strips, got["strip"].ladder_max, got["strip"].covered) == (3, 1, 3, 3)


def test_windows_against_brute_force(spark):
    import random

    rng = random.Random(6)
    seqs, near = [], set()
    for k in range(12):
        faces = [rng.randrange(14) for _ in range(rng.randrange(2, 16))]
        seqs += [("g", k, i, f) for i, f in enumerate(faces)]
    for _ in range(25):
        x, y = rng.sample(range(14), 2)
        near |= {(x, y), (y, x)}
    want = set()
    for k in range(12):
        f = [x for g, s, i, x in seqs if s == k]
        ok = lambda a, b: len(set(f[a : b + 1])) == b - a + 1 and not any((f[x], f[y]) in near for x in range(a, b + 1) for y in range(x + 2, b + 1))
        valid = [(a, b) for a in range(len(f)) for b in range(a, len(f)) if ok(a, b)]
        want |= {(k, a, b) for a, b in valid if b > a and not any(c <= a and b <= d and (c, d) != (a, b) for c, d in valid)}
    got = ladder.maximal_windows(spark.createDataFrame(seqs, "graph string, strip int, pos int, face int"), spark.createDataFrame([("g", *p) for p in near], "graph string, face int, other int"))
    assert {(r.strip, r.first, r.last) for r in got.collect()} == want


def test_merges_and_comparisons(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (2, 6, None), (3, 7, 2.0), (3, 7, 2.0)], "k int, n int, x double")
    b = spark.createDataFrame([(1, 5, 1.5), (2, 9, 1.0), (4, 1, 1.0)], "k int, n int, x double")
    assert {tuple(r) for r in merging.merge_faults(a, b, ["k"], ["n"]).collect()} == {(2, "unequal"), (3, "missing right"), (4, "missing left"), (3, "twice left")}
    got = {tuple(r) for r in merging.compare_fields(a, b, ["k"], ["n", "x"], F.abs(F.col("left") - F.col("right")) > 0.1).collect()}
    assert got == {(1, "x", 1.0, 1.5), (2, "n", 6.0, 9.0), (2, "x", None, 1.0)}
    assert merging.config_signature({"b": 1, "a": 2}) == merging.config_signature({"a": 2, "b": 1})


def test_verdicts_and_extremal_graphs(spark):
    edges = edge_frame(spark, {"cube": [tuple(sorted(e)) for e in CUBE_EDGES], "k33": K33})
    found = cycles.hamiltonian_cycles(edges)
    universe = found.select("graph", cycles.cycle_edges("cycle").alias("selected"))
    e = edges.select("graph", F.struct("u", "v").alias("e"))
    cons = e.join(e.withColumnRenamed("e", "f"), "graph").where("e <> f").select("graph", F.concat_ws("-", F.to_json("e"), F.to_json("f")).alias("constraint_id"), F.array("e").alias("required"), F.array("f").alias("forbidden"))
    got = {r.graph: (r.constraints, r.satisfied, r.holds) for r in merging.verdicts(cons, universe).collect()}
    assert got == {"cube": (132, 132, True), "k33": (72, 72, True)}
    pairs = separation.class_pairs(separation.signature_classes(cycle_rows(spark, found), edges)).cache()
    top = {r.graph: (r.upper, r.exact) for r in merging.extremal(pairs).collect()}
    assert top["cube"] == (6, 6) and top["k33"][0] >= (top["k33"][1] or 0)


def test_splice_of_two_k4_gives_the_prism(spark):
    edge = "struct<u:int,v:int>"
    # K4 without vertex 3: triangle 0,1,2; the cycle that leaves port i out goes through the two edges at the other ports
    tri = {0: [(0, 1), (0, 2)], 1: [(0, 1), (1, 2)], 2: [(0, 2), (1, 2)]}
    side = lambda off: spark.createDataFrame([("p", i, [(u + off, v + off) for u, v in es]) for i, es in tri.items()], f"graph string, state int, edges array<{edge}>")
    cut = spark.createDataFrame([("p", i, i, i + 3) for i in range(3)], "graph string, port int, u int, v int")
    got = merging.splice(side(0), side(3), cut).collect()
    assert len(got) == 3 and all(len(r.edges) == 6 for r in got)
    states = spark.createDataFrame([("g", [0, 1], [0, 1], 2), ("g", [0, 1, 2, 3], [0, 1], 3), ("g", [0, 1, 2, 3], [0, 2], 1)], "graph string, used array<int>, pairing array<int>, forests int")
    assert sorted(r.cycles for r in merging.compatible_states(states, states).collect()) == [3, 3, 4]


def test_sequences_controls_and_crossings(spark):
    cand = spark.createDataFrame([("g", 0, "a", 1.0), ("g", 0, "b", 0.0), ("g", 1, "c", 0.0), ("g", 1, "d", 5.0)], "group string, stage int, name string, cost double")
    moves = spark.createDataFrame([("g", 0, "a", "c", 1.0), ("g", 0, "b", "c", 2.0), ("g", 0, "b", "d", 0.0)], "group string, stage int, name string, next string, cost double")
    assert [tuple(r) for r in ranking.best_sequence(cand, moves).collect()] == [("g", 2.0, ["a", "c"])]
    df = spark.createDataFrame([("x", 1, 9), ("y", 2, 1), ("z", 3, 5)], "k string, a int, b int")
    picked = ranking.controls(df, "k", [("least_a", F.col("a")), ("most_b", -F.col("b"))])
    assert {tuple(r) for r in picked.collect()} == {("least_a", "x"), ("most_b", "z")}
    seg = spark.createDataFrame([("g", 1, 0, 1, 0.0, 0.0, 2.0, 2.0), ("g", 2, 2, 3, 0.0, 2.0, 2.0, 0.0), ("g", 3, 0, 4, 0.0, 0.0, 0.0, 9.0)], "graph string, id int, u int, v int, x1 double, y1 double, x2 double, y2 double")
    assert geometry.crossings(seg).first().crossings == 1


def test_witness_cover_and_packing_summary(spark):
    rows = [("g", 1, [3, 2]), ("g", 2, [3]), ("g", 3, [2, 9]), ("g", 4, []), ("h", 1, [])]
    df = spark.createDataFrame(rows, "graph string, item int, support array<int>")
    got = [tuple(r) for r in separation.witness_cover(df).orderBy("step").collect()]
    assert got == [("g", 1, 1, 2, 2), ("g", 2, 2, 3, 1)]
    assert separation.witness_cover(df.where("graph = 'h'")).count() == 0
    s = {r.graph: (r.supports, r.members, r.distinct_members, r.disjoint) for r in separation.packing_summary(spark.createDataFrame([("a", [1, 2]), ("a", [3]), ("b", [1, 2]), ("b", [2])], "graph string, support array<int>")).collect()}
    assert s == {"a": (2, 3, 3, True), "b": (2, 3, 2, False)}


def test_structural_packings_prove_the_separation_number(spark):
    grid = spark.createDataFrame([(a, b) for a in (3, 5, 7) for b in (3, 5, 7, 9)], "a int, b int")
    sizes = {(r.a, r.b): r["count"] for r in ladder.structural_packing(grid).groupBy("a", "b").count().collect()}
    assert all(n == ((a + 2) * (b + 2) - 1) // 2 for (a, b), n in sizes.items()) and len(sizes) == 12
    for r in separation.packing_summary(ladder.packing_supports(grid)).collect():
        assert r.disjoint and r.supports == sizes[r.graph.a, r.graph.b] and r.largest == 2 if r.graph.a > 3 or r.graph.b > 3 else r.disjoint
