import numpy as np

from trivalent.llm import varied


def test_pivots_are_independent_and_stop_at_the_rank():
    rng = np.random.RandomState(1)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 20))
    picks, sizes = varied.pivoted_rows(x, 10)
    assert len(picks) == 3 and np.linalg.matrix_rank(x[picks]) == 3 and sizes == sorted(sizes, reverse=True)
    assert varied.pivoted_rows(np.zeros((4, 3)), 2) == ([], [])


ROWS = "canonical_graph_hash string, requested_vertex_count int, face_size_multiset array<int>, graph int, residual int"


def records(spark):
    rows = [(f"s{i:03d}", 20, [4, 4, 6 + 2 * i], 0, 0) for i in range(90)]
    rows += [(f"b{i:04d}", 20, [8, 4, 4][:: 1 if i % 2 else -1], 0, 0) for i in range(400)] + [(f"t{i}", 20, [10, 10], 0, 0) for i in range(2)]
    rows += [(" S001 ", 20, [8 - 0, 4, 4], 0, 0)][:0] + [("S003", 20, [12, 4, 4], 0, 0), ("nul", 20, None, 0, 0), ("emp", 20, [], 0, 0), (None, 20, [4], 0, 0), ("s000", 20, None, 0, 0)]
    return varied.face_graphs(spark.createDataFrame(rows, ROWS)).cache()


def test_singles_first_then_families_in_turns(spark):
    g = records(spark)
    # s001 has the multiset of the big family; so 89 graphs are alone
    alone = {f"s{i:03d}" for i in range(90)} - {"s001"}
    few = varied.varied_subset(g, 70).collect()
    assert len(few) == 70 and {r.graph for r in few} <= alone
    some = varied.varied_subset(g, 92).collect()
    assert len(some) == 92 and alone < {r.graph for r in some}
    assert len({tuple(r.sig) for r in some}) == 91  # one second member at most, of either family
    every = varied.varied_subset(g, None).collect()
    assert len(every) == 91 and len({tuple(r.sig) for r in every}) == 91 and {r.graph for r in every if r.family_size == 1} == alone
    more = varied.varied_subset(g, 120).collect()
    assert len({r.graph for r in more}) == 120 and sum(r.sig == [10, 10] for r in more) == 2
    total = g.count()
    rest = varied.varied_subset(g, 10_000).collect()
    assert len(rest) == total and {r.graph for r in rest if r.family_size == 0} == {"nul", "emp"}


def test_turns_are_counted_without_walking_them():
    sizes = {1: 4, 3: 2, 10**9: 1}
    assert varied.whole_turns(sizes, 0) == (0, 0) and varied.whole_turns(sizes, 7) == (1, 7) and varied.whole_turns(sizes, 9) == (1, 7)
    assert varied.whole_turns(sizes, 10) == (2, 10) and varied.whole_turns(sizes, 5 * 10**8) == (5 * 10**8 - 10, 5 * 10**8)
    assert varied.whole_turns({}, 5) == (0, 0)


def test_many_selections_side_by_side(spark):
    g = records(spark)
    wishes = [varied.Wish(1, 70), varied.Wish(2, 92), varied.Wish(3, None), varied.Wish(4, 10, 21, None), varied.Wish(5, 0), varied.Wish(6, 10_000, 20, 20)]
    got = varied.varied_subsets(g, wishes).collect()
    size = {k: len({r.graph for r in got if r.selection == k}) for k in range(1, 7)}
    assert size == {1: 70, 2: 92, 3: 91, 4: 0, 5: 0, 6: g.where("graph_order = 20").count()} and len(got) == sum(size.values())
    assert {r.graph for r in got if r.selection == 1} == {r.graph for r in varied.varied_subset(g, 70).collect()}


def test_pivoting_spans_more_than_a_choice_by_hash(spark):
    # most records are much alike; pivoting must look for the others, which a choice by hash rarely meets
    rng = np.random.RandomState(3)
    rows = [(f"a{i:04d}", 20, [4] * 20 + [6] * int(rng.randint(1, 4)) + [30 + 2 * int(rng.randint(0, 3)), 200 + 2 * i], 0, 0) for i in range(900)]
    rows += [(f"z{i:02d}", 20, sorted(int(x) for x in 4 + 2 * rng.randint(0, 30, 25)), 0, 0) for i in range(40)]
    g = varied.face_graphs(spark.createDataFrame(rows, ROWS)).cache()
    wish = [varied.Wish(1, 40)]
    ours, plain = (varied.varied_subsets(g, wish, by_hash=b).cache() for b in (False, True))
    assert ours.count() == plain.count() == 40
    assert varied.log_volume(ours)[1] > varied.log_volume(plain)[1] + 20
    assert sum(r.graph[0] == "z" for r in ours.collect()) > 4 * sum(r.graph[0] == "z" for r in plain.collect())


def test_nothing_to_choose_from(spark):
    g = records(spark)
    assert varied.varied_subset(g, 0).count() == 0
    assert varied.varied_subset(g.limit(0), 5).count() == 0
    assert {r.graph for r in varied.varied_subset(g.where("sig is null"), 1).collect()} == {"emp"}


def test_a_subset_is_spread(spark):
    # two clouds of like records: a few picks take from both
    rows = [(f"a{i:03d}", 20, [4] * (30 + i % 3) + [100 + 2 * i], 0, 0) for i in range(60)] + [("z1", 20, [50] * 40 + [60], 0, 0)]
    got = {r.graph for r in varied.varied_subset(varied.face_graphs(spark.createDataFrame(rows, ROWS)), 8).collect()}
    assert "z1" in got and len(got) == 8
