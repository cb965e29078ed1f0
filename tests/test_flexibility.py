import os
from itertools import permutations

import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_graphs import CUBE, CUBE_EDGES

from trivalent.operators import embedding, flexibility, graph, ladder, merging, ranking, stats
from trivalent.sources import readers

EDGES = [tuple(sorted(e)) for e in CUBE_EDGES]


def cube_cycles():
    found = set()
    for p in permutations(range(1, 8)):
        walk = (0, *p)
        edges = frozenset(tuple(sorted((walk[i], walk[(i + 1) % 8]))) for i in range(8))
        if edges <= set(EDGES):
            found.add(edges)
    return sorted(map(sorted, found))


@pytest.fixture(scope="module")
def cube(spark):
    cycles = cube_cycles()
    assert len(cycles) == 6
    # "few" knows two of the cycles, "none" has edges but no cycle
    rows = [(g, k, *e) for g, known in (("all", cycles), ("few", cycles[:2])) for k, c in enumerate(known) for e in c]
    universe = spark.createDataFrame(rows, "graph string, cycle_id int, u int, v int")
    edges = spark.createDataFrame([(g, *e) for g in ("all", "few", "none") for e in EDGES], "graph string, u int, v int")
    return cycles, universe, edges


def brute(cycles, constraints):
    met = [(sum(set(held) <= set(c) and not set(missed) & set(c) for c in cycles), list(name)) for held, missed, name in constraints]
    n, name = min(met)
    return len(met), sum(k > 0 for k, _ in met), all(k > 0 for k, _ in met), n, name


def verdicts(df):
    return {r.graph: (r.constraints, r.satisfied, r.holds, r.fewest, list(r.hardest)) for r in df.collect()}


def test_edge_pairs(cube):
    cycles, universe, edges = cube
    want = [([e], [f], (*e, *f)) for e in EDGES for f in EDGES if e != f]
    got = verdicts(flexibility.edge_pairs(universe, edges))
    assert got == {"all": brute(cycles, want), "few": brute(cycles[:2], want), "none": brute([], want)}
    assert got["all"][0] == 132 and flexibility.edge_pairs(universe.limit(0), edges.limit(0)).count() == 0


def test_paths_of_three_edges(cube):
    cycles, universe, edges = cube
    near = {v: [w for e in EDGES for w in e if v in e and w != v] for v in range(8)}
    paths = {min(p, p[::-1]) for b in near for c in near[b] for a in near[b] for d in near[c] for p in [(a, b, c, d)] if len({a, b, c, d}) == 4}
    want = [([tuple(sorted(p[k : k + 2])) for k in range(3)], [], p) for p in paths]
    got = verdicts(flexibility.edge_paths(universe, edges))
    assert got == {"all": brute(cycles, want), "few": brute(cycles[:2], want), "none": brute([], want)}


def test_verdicts_on_the_cycles_of_one_row():
    import random

    step = random.Random(5)
    cases = [[], [[3]], [[1, 2]], [[1, 2, 3]], [[4, 4, 1, 2]], [[0, 1, 2, 3]], [[0, 1, 2, 3], [3, 2, 1, 0]], [[0, 1, 2, 0, 3, 4]], [[-5, 2, 7, 1, 9], [2, 7, 2, 8, -5, 3]]]
    cases += [[step.choices(range(n), k=step.randrange(1, 9)) for _ in range(step.randrange(1, 6))] for n in (3, 5, 9) for _ in range(60)]
    cases += [[step.sample(range(8), 8) for _ in range(k)] for k in (1, 2, 5, 40, 300)]  # 300: every pair has its cycle
    for walks in cases:
        cycles = [{tuple(sorted(e)) for e in zip(c, c[1:] + c[:1])} for c in walks]
        edges = sorted(set().union(*cycles))
        pairs = [([e], [f], (*e, *f)) for e in edges for f in edges if e != f]
        near = {v: {w for e in edges if v in e for w in e if w != v} for e in edges for v in e}
        paths = {min(p, p[::-1]) for b in near for c in near[b] for a in near[b] for d in near[c] for p in [(a, b, c, d)] if len({*p}) == 4}
        steps = [([tuple(sorted(p[k : k + 2])) for k in range(3)], [], p) for p in paths]
        for got, want in ((flexibility.pairs_of(walks), pairs), (flexibility.paths_of(walks), steps)):
            assert (got and (*got[:4], list(got[4]))) == (brute(cycles, want) if want else None), walks


def test_recorded_flexibility_on_odd_lines(spark, tmp_path):
    """The line that counts decides, also one without cycles; equal to the query's SQL."""
    import json

    import duckdb
    from oracle import rows_of

    from trivalent.plans import catalogue

    def text(analyses):
        return json.dumps({"canonical_graph_hash": "h", "requested_vertex_count": 8} | {a: {"witnesses": [{"witness_index": k, "cycle": c} for k, c in enumerate(cs)]} for a, cs in analyses.items()})

    a, b = [0, 1, 2, 3, 4, 5, 6, 7], [0, 3, 2, 1, 6, 5, 4, 7, 0]
    both = {"all_edge_pairs": [a, b], "three_edge_paths": [b]}
    lines = [
        (1, 1, text(both)), (1, 2, text({})),  # the latest has no cycles
        (2, 1, text(both)), (2, 2, text(both)[:-5]), (2, 0, text({"all_edge_pairs": [b]})),  # the latest is broken
        (3, 1, text({"all_edge_pairs": [a]})), (3, 2, text(both)), (3, 3, None), (3, 4, " "),
        (4, 1, json.dumps({"record": json.loads(text({"three_edge_paths": [[2, 5, 3], a]}))})),
        (5, 1, text({"all_edge_pairs": [[]], "three_edge_paths": [[4, 6, 9]]})), (6, 1, "[1]"), (None, 1, text(both)),
    ]
    df = spark.createDataFrame(lines, "record_id long, line_no long, record_json string")
    df.repartition(3).write.parquet(str(tmp_path / "census_records.parquet"))
    got = catalogue.QUERIES["recorded_flexibility"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW census_records AS SELECT * FROM '{tmp_path}/census_records.parquet/*.parquet'")
    cur = con.execute(catalogue.SQL["recorded_flexibility"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want and len(want) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_recorded_flexibility_writes_little(spark):
    """What the query shuffles and writes is less than its input."""
    from pathlib import Path

    from trivalent import session
    from trivalent.plans import catalogue

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    session.release(spark)
    before = shuffled()
    assert catalogue.QUERIES["recorded_flexibility"](spark, SF).collect()
    kept = sum(p.stat().st_size for path in session._WRITTEN for p in Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert shuffled() - before + kept < os.path.getsize(f"{SF}/census_records.parquet")


def test_pairs_on_one_face(spark, cube):
    cycles, universe, _ = cube
    darts = embedding.dart_faces(spark.createDataFrame([("all", CUBE)], "graph string, rotation array<array<int>>"))
    faces = embedding.face_edges(darts).cache()
    own = {}
    for r in faces.collect():
        own.setdefault(r.face, []).append((r.u, r.v))
    want = [([e], [f], (*e, *f)) for e, f in {(e, f) for es in own.values() for e in es for f in es if e != f}]
    assert verdicts(flexibility.cofacial_edge_pairs(universe.where("graph = 'all'"), faces)) == {"all": brute(cycles, want)}
    assert graph.cofacial_pairs(faces).count() == len(want)


def test_labellings_give_the_code(spark):
    turned = [[(w * 3) % 8 if w else 0 for w in CUBE[(v * 3) % 8]] for v in range(8)]  # vertex 3v is named v: 3 * 3 = 1 mod 8
    rows = spark.createDataFrame([("a", CUBE), ("b", turned), ("none", None), ("bare", [[], []])], "graph string, rotation array<array<int>>")
    got = {r.graph: r for r in embedding.canonical_labellings(rows).collect()}
    assert got["a"].code == got["b"].code and got["none"].labels is None and got["bare"].code == [[], []]
    for name, rotation in (("a", CUBE), ("b", turned)):
        labels = got[name].labels
        assert sorted(labels) == list(range(8))
        for v, row in enumerate(rotation):
            assert sorted(labels[w] for w in row) == sorted(got[name].code[labels[v]])


def test_connected_subsets_and_blocks(spark, cube):
    edges = cube[2].where("graph = 'all'")
    subsets = spark.createDataFrame([("all", s, n) for s, ns in (("face", [0, 1, 2, 3]), ("ends", [0, 7]), ("one", [5])) for n in ns], "graph string, subset string, node int")
    assert {r.subset: r.connected for r in graph.connected_subsets(edges, subsets).collect()} == {"face": True, "ends": False, "one": True}
    block = lambda rows: spark.createDataFrame(rows, "graph string, block array<int>")
    got = ladder.block_overlap(block([("g", [2, 1]), ("g", [3]), ("h", [4])]), block([("g", [1, 2]), ("g", [1, 2]), ("h", [4, 5])]))
    assert {tuple(r) for r in got.collect()} == {("g", 2, 1, False), ("h", 1, 0, False)}


def test_evidence_and_gaps(spark):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    got = merging.evidence(keys("a", "a", "b", "c"), {"originals": keys("a", "b", "b"), "files": keys("b", "b", "c")}, "k", ("originals",))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 0, "no files"), ("b", 2, 2, "several originals"), ("c", 0, 1, "no originals")}
    df = spark.createDataFrame([(1, 5, 2), (2, 5, 1), (3, None, 0), (4, 7, 9)], "id int, gap int, size int")
    assert [r.id for r in ranking.largest_gaps(df, "gap", ["size"], 2).collect()] == [4, 2]


def test_summary_by_kind(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "a", 4), (2, "b", 1), (2, None, 9)], "g int, kind string, n int")
    got = stats.summary_by_kind(df, ["g"], "kind", {"rows": F.count(F.lit(1)), "total": F.sum("n")}).orderBy("g").collect()
    assert [r.asDict() for r in got] == [{"g": 1, "a_rows": 2, "a_total": 6, "b_rows": 1, "b_total": 3}, {"g": 2, "a_rows": None, "a_total": None, "b_rows": 1, "b_total": 1}]


def test_look_up_and_loader(spark, tmp_path):
    df = spark.createDataFrame([(" AB ", 1), ("c", 2), ("C", 3)], "h string, n int")
    assert readers.find_one(df, "h", "ab").first().n == 1
    for wrong in ("c", "none"):
        with pytest.raises(Exception, match="rows of"):
            readers.find_one(df, "h", wrong).collect()
    assert {(r.u, r.v) for r in readers.load_graphs(spark, "Bw").collect()} == {(0, 1), (0, 2), (1, 2)}
    path = tmp_path / "x.g6"
    path.write_text("Bw\nA_\n")
    assert readers.load_graphs(spark, path).groupBy("graph").count().count() == 2
    spark.range(3).write.parquet(str(tmp_path / "y.parquet"))
    assert readers.load_graphs(spark, tmp_path / "y.parquet").count() == 3


def test_intermediates_are_released(spark):
    import os

    from trivalent import session

    df = session.materialize(spark.range(5), "kept")
    assert df.count() == 5 and os.path.isdir(df.written_at) and df.written_at in session._WRITTEN
    session.release(spark)
    assert not os.path.exists(df.written_at) and not session._WRITTEN
