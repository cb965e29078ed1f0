from pyspark.sql import functions as F

from trivalent.operators import cycles, embedding, graph, ladder, separation

# rotation of the cube: vertices differ in one bit; around even vertices the bits run 0,1,2, around odd ones 2,1,0
CUBE = [[v ^ 1, v ^ 2, v ^ 4] if bin(v).count("1") % 2 == 0 else [v ^ 4, v ^ 2, v ^ 1] for v in range(8)]


def edge_frame(spark, graphs):
    rows = [(g, int(u), int(v)) for g, es in graphs.items() for u, v in es]
    return spark.createDataFrame(rows, "graph string, u long, v long")


CUBE_EDGES = [(u, v) for u in range(8) for v in range(u) if bin(u ^ v).count("1") == 1]
K4 = [(u, v) for u in range(4) for v in range(u)]
C6 = [(i, (i + 1) % 6) for i in range(6)]
K33 = [(u, v) for u in range(3) for v in range(3, 6)]
PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
TWO_CUBES = CUBE_EDGES + [(u + 8, v + 8) for u, v in CUBE_EDGES]
ALL = {"cube": CUBE_EDGES, "k4": K4, "c6": C6, "k33": K33, "petersen": PETERSEN, "two": TWO_CUBES, "loop": [(0, 0), (0, 1)], "double": [(0, 1), (1, 0), (1, 2)]}


def test_validation_gives_all_reasons_in_order(spark):
    got = {r.graph: (r.vertices, r.edges, r.reasons, r.valid) for r in graph.validate(edge_frame(spark, ALL)).collect()}
    assert got["cube"] == (8, 12, [], True)
    assert got["k4"][2] == ["graph is not bipartite"]
    assert got["c6"][2] == ["graph is not cubic", "graph is not 3-vertex-connected"]
    assert got["two"][2] == ["graph is not 3-vertex-connected"]
    assert got["petersen"][2] == ["graph is not bipartite"]
    assert got["loop"][2][0] == "graph has self-loops" and "graph is not bipartite" in got["loop"][2]
    assert "graph has parallel edges" in got["double"][2]


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    graphs = {f"g{k}": [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 70))] for k in range(6)}
    graphs["path"] = [(i, i + 1) for i in range(200)]
    graphs["star"] = [(0, i) for i in range(1, 300)]
    got = {(r.graph, r.node): r.component for r in graph.components(edge_frame(spark, graphs)).collect()}
    for g, es in graphs.items():
        root = {x: x for e in es for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in es:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        assert {x: got[g, x] for x in root} == {x: find(x) for x in root}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "graph string, u long, v long")
    assert graph.components(none).count() == 0 and graph.validate(none).count() == 0
    assert cycles.hamiltonian_cycles(none).count() == 0 and graph.three_edge_paths(none).count() == 0


def test_faces_euler_and_canonical_hash(spark):
    mirrored = [row[::-1] for row in CUBE]
    names = [3, 1, 0, 6, 5, 7, 2, 4]
    moved = [None] * 8
    for v, row in enumerate(CUBE):
        moved[names[v]] = [names[w] for w in row]
    df = spark.createDataFrame([("cube", CUBE), ("mirror", mirrored), ("moved", moved)], "graph string, rotation array<array<int>>")
    assert sorted(r.size for r in embedding.faces(df).where("graph = 'cube'").collect()) == [4] * 6
    for r in embedding.faces(df).collect():
        assert len(r.boundary) == 4 and r.boundary[0] == r.face_u and r.boundary[1] == r.face_v
        assert all(bin(a ^ b).count("1") == 1 for a, b in zip(r.boundary, r.boundary[1:] + r.boundary[:1])) or r.graph == "moved"
    assert all((r.n, r.m, r.faces, r.spherical) == (8, 12, 6, True) for r in embedding.euler(df).collect())
    # the cube's hash as published
    assert {r.canonical_graph_hash for r in embedding.canonical_hashes(df).collect()} == {"204b8679f3d0425a4964c1b6574ada41a4aecc186316477cf33fa20be1b301ee"}
    assert [r[0] for r in df.where("graph = 'cube'").select(embedding.automorphism_count("rotation")).collect()] == [48]
    bad = spark.createDataFrame([("x", [[1, 1], [0, 7]])], "graph string, rotation array<array<int>>")
    assert {r.fault for r in embedding.rotation_faults(bad).collect()} == {"repeated neighbour", "neighbour out of range", "asymmetric"}


def test_strips_and_quadrilateral_components_of_the_cube(spark):
    prism = [[1, 2, 3], [2, 0, 4], [0, 1, 5], [5, 4, 0], [3, 5, 1], [4, 3, 2]]
    df = spark.createDataFrame([("cube", CUBE), ("prism", prism)], "graph string, rotation array<array<int>>")
    walks = embedding.dart_faces(df).withColumn("face", F.struct("face_u", "face_v"))
    assert sorted((r.graph, r.faces, r.closed) for r in ladder.strips(walks).collect()) == [("cube", 4, True)] * 3 + [("prism", 3, True)]
    comp = ladder.quadrilateral_components(embedding.face_edges(walks), walks.select("graph", "face", "size").distinct())
    assert sorted((r.graph, r.faces, r.kind) for r in comp.collect()) == [("cube", 6, "branch"), ("prism", 3, "cycle")]


def hamiltonian_by_permutation(edges):
    import itertools

    es, ns = {frozenset(e) for e in edges}, sorted({x for e in edges for x in e})
    out = set()
    for p in itertools.permutations(ns[1:]):
        c = (ns[0], *p)
        if p[0] < p[-1] and all(frozenset((a, b)) in es for a, b in zip(c, c[1:] + c[:1])):
            out.add(c)
    return out


def test_hamiltonian_cycles_two_ways(spark):
    small = {g: ALL[g] for g in ("cube", "k4", "c6", "k33", "petersen")}
    df = edge_frame(spark, small)
    got = {}
    for r in cycles.hamiltonian_cycles(df).collect():
        got.setdefault(r.graph, set()).add(tuple(r.cycle))
    for g in ("cube", "k4", "c6", "k33"):
        assert got.get(g, set()) == hamiltonian_by_permutation(small[g])
    assert "petersen" not in got and len(got["cube"]) == 6
    other = cycles.cycles_by_matchings(edge_frame(spark, {"cube": CUBE_EDGES, "k33": K33}))
    one = cycles.hamiltonian_cycles(edge_frame(spark, {"cube": CUBE_EDGES, "k33": K33})).select("graph", F.expr("1"), cycles.cycle_edges("cycle").alias("edges")).select("graph", "edges")
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0
    assert cycles.perfect_matchings(edge_frame(spark, {"cube": CUBE_EDGES})).count() == 9


def cycle_rows(spark, df):
    from pyspark.sql import Window

    ids = df.withColumn("cycle_id", F.row_number().over(Window.partitionBy("graph").orderBy("cycle")) - 1)
    return ids.select("graph", "cycle_id", F.explode(cycles.cycle_edges("cycle")).alias("e")).select("graph", "cycle_id", "e.u", "e.v")


def test_cube_needs_six_cycles(spark):
    edges = edge_frame(spark, {"cube": [tuple(sorted(e)) for e in CUBE_EDGES]})
    rows = cycle_rows(spark, cycles.hamiltonian_cycles(edges))
    classes = separation.signature_classes(rows, edges)
    pairs = separation.class_pairs(classes).cache()
    cov = separation.coverage(pairs).first()
    assert (cov.required_pairs, cov.separated_pairs, cov.separating) == (132, 132, True)
    assert separation.antichain(classes).first().antichain
    assert separation.greedy_cover(pairs).count() == 6
    assert separation.minimum_cover(pairs).first().cover_size == 6
    packing = [set(r.support) for r in separation.greedy_packing(pairs).collect()]
    assert sum(map(len, packing)) == len(set().union(*packing)) and len(packing) <= 6
    assert separation.sperner_bound(12) == 6


def test_double_ladder_of_three(spark):
    grid = spark.createDataFrame([(3, 3)], "a int, b int")
    edges = ladder.vertex_edges(grid)
    assert edges.count() == 24 and graph.validate(edges).first().valid
    found = cycles.hamiltonian_cycles(edges)
    assert found.count() == 14 == grid.select(ladder.cycle_count(F.col("a"), F.col("b"))).first()[0]
    rows = cycle_rows(spark, found)
    classes = {r["class"]: r["count"] for r in ladder.classify_cycles(rows, grid).groupBy("class").count().collect()}
    assert classes == {"all_rails": 1, "paired_cell_turns": 9, "two_connector_exception": 4}
    pairs = separation.class_pairs(separation.signature_classes(rows, edges)).cache()
    assert separation.coverage(pairs).first().separated_pairs == 552
    assert separation.minimum_cover(pairs).first().cover_size == 12


def test_symbolic_family_over_a_grid(spark):
    grid = spark.createDataFrame([(a, b) for a in (3, 5, 7, 9) for b in (3, 5, 7)], "a int, b int")
    sizes = {(r.a, r.b): r["count"] for r in ladder.symbolic_family(grid).groupBy("a", "b").count().collect()}
    assert all(n == ((a + 2) * (b + 2) - 1) // 2 for (a, b), n in sizes.items()) and sizes[9, 7] == 49
    rows = ladder.family_incidence(grid)
    edges = ladder.family_edges(grid).select(F.struct("a", "b").alias("graph"), F.concat_ws("-", "ladder", "kind", "cell", "side").alias("u"), F.lit("").alias("v"))
    checked = separation.antichain(separation.signature_classes(rows, edges)).collect()
    assert len(checked) == 12 and all(r.antichain and r.edges == 3 * (r.graph.a + r.graph.b + 2) for r in checked)
    for axis in "AB":
        for r in ladder.structural_lift(grid, axis).collect():
            assert r.missing == 0 and r.new == r.expected


def test_paths_degrees_and_audits(spark):
    edges = edge_frame(spark, {"cube": CUBE_EDGES})
    assert graph.three_edge_paths(edges).count() == 4 * 12
    assert {r.degree for r in graph.degrees(edges).collect()} == {3}
    loops = edge_frame(spark, {"l": [(1, 1), (1, 2), (2, 1)]})
    assert {r.node: r.degree for r in graph.degrees(loops).collect()} == {1: 4, 2: 2}
    ids = graph.numbered(graph.normalized(edges))
    assert graph.requirement_pairs(ids).count() == 132
    cyc = spark.createDataFrame([("cube", 1, [0, 1, 3, 2, 6, 7, 5, 4]), ("cube", 2, [0, 1, 3, 2, 6, 7, 5, 5]), ("cube", 3, [0, 3, 1, 2, 6, 7, 5, 4]), ("cube", 4, None)], "graph string, cycle_id int, cycle array<long>")
    orders = spark.createDataFrame([("cube", 8)], "graph string, order int")
    assert {r.cycle_id: r.valid for r in cycles.check_cycles(cyc, edges, orders).collect()} == {1: True, 2: False, 3: False, 4: False}
    same = spark.createDataFrame([([0, 1, 2, 3],), ([2, 1, 0, 3, 2],), ([3, 0, 1, 2],)], "c array<int>").select(cycles.certificate_hash("c").alias("h")).distinct()
    assert same.count() == 1


def test_irredundant_family(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 2, "a"), ("g", 3, "b"), ("g", 3, "c")], "graph string, cycle_id int, item string")
    assert sorted(r.cycle_id for r in separation.irredundant(rows).collect()) == [2, 3]


def test_constraints_of_graphs_without_a_witness(spark, monkeypatch):
    """Every constraint counts, by its latest row; without a kept witness none is satisfied."""
    from datetime import datetime

    from trivalent.plans import graphs

    at = lambda d: datetime(2025, 1, d)
    rows = [
        ("primary", "AA ", "x", 1, [[1, 0]], None, at(2)), ("primary", "aa", "x", 1, [[0, 2]], None, at(1)),  # replaced
        ("primary", "aa", "x", 2, [[0, 2]], [], at(3)), ("primary", "aa", "x", 2, [[0, 1]], [], at(1)), ("primary", "aa", "y", 3, None, [[0, 1]], at(1)),
        ("primary", "bb", "x", 1, [[0, 1]], None, at(1)), ("primary", "bb", "x", 2, None, None, at(1)), ("mirror", "cc", "x", 1, [[0, 1]], None, at(1)),
    ]
    cons = spark.createDataFrame(rows, "held_by string, graph_hash string, analysis string, constraint_index int, required_edges array<array<int>>, forbidden_edges array<array<int>>, copied_at timestamp")
    held = spark.createDataFrame([("r", 0, [0, 1, 2, 3], "aa"), ("r", 1, [0, 1, 3, 2], "zz")], "graph string, cycle_id int, cycle array<int>, graph_hash string")
    monkeypatch.setattr(graphs, "table", lambda *_: cons)
    monkeypatch.setattr(graphs, "witness_cycles", lambda *_: held)
    for parts in (1, 7):
        monkeypatch.setattr(graphs, "table", lambda *_, n=parts: cons.repartition(n))
        got = {tuple(r) for r in graphs.constraints_met_by_witnesses(spark, "").collect()}
        assert got == {("primary", "aa", "x", 2, 1), ("primary", "aa", "y", 1, 0), ("primary", "bb", "x", 2, 0), ("mirror", "cc", "x", 1, 0)}
