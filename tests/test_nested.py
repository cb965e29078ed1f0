import json

from trivalent.operators import nested

BASE = {"generation_index": 1, "requested_vertex_count": 8, "canonical_graph_hash": " AB ", "edge_count": 12}


def rows_of(spark, lines):
    df = spark.createDataFrame([(i, r, t, "x") for i, (r, t) in enumerate(lines)], "line_no long, record_id long, record_json string, payload string")
    return {tuple(r) for r in nested.hardest_and_witness_rows(df).collect()}


def test_shapes_that_writers_use(spark):
    plain = BASE | {
        "all_edge_pairs": {"hardest_ordered_pair": [[2, 33], [24, 20]], "witnesses": [{"cycle": [0, 1, 2, 0], "newly_certified_constraints": 5}, {"cycle": None}, {"cycle": []}]},
        "three_edge_paths": {"hardest_path": [6, 26, 19, 29], "witnesses": None},
    }
    want = {
        (1, "all_edge_pairs", "hardest_ordered_pair", 0, 0, 2), (1, "all_edge_pairs", "hardest_ordered_pair", 0, 1, 33), (1, "all_edge_pairs", "hardest_ordered_pair", 1, 0, 24),
        (1, "all_edge_pairs", "hardest_ordered_pair", 1, 1, 20), (1, "all_edge_pairs", "witness", 0, -1, 5), (1, "all_edge_pairs", "witness", 1, -1, -1), (1, "all_edge_pairs", "witness", 2, -1, -1),
        (1, "all_edge_pairs", "cycle", 0, 0, 0), (1, "all_edge_pairs", "cycle", 0, 1, 1), (1, "all_edge_pairs", "cycle", 0, 2, 2),
        *{(1, "three_edge_paths", "hardest_path", 0, i, v) for i, v in enumerate((6, 26, 19, 29))},
    }
    assert rows_of(spark, [(1, json.dumps(plain))]) == want
    other = BASE | {
        "all_edge_pairs": json.dumps({"hardest_ordered_pair": {"forbidden": [24, "20"], "required": {"v": 33, "u": 2}}, "witnesses": {"1": {"cycle": None}, "0": json.dumps({"newly_certified_constraints": "5", "cycle": {"order": 3, "vertices": ["0", 1, 2]}}), "2": {"trigger_key": [1, 2]}}}),
        "three_edge_paths": [{"hardest_path": "6-26-19-29"}],
    }
    wrapped = "﻿ " + json.dumps({"schema": "v2", "record": other}) + "\n"
    assert rows_of(spark, [(1, wrapped)]) == want
    third = BASE | {
        "all_edge_pairs": [{"hardest_ordered_pair": ["2-33", "24-20"], "witnesses": [{"witness_index": 2, "cycle": None}, {"witness_index": 0, "cycle": "0 1 2", "newly_certified_constraints": 5.0}, {"witness_index": 1, "cycle": []}]}],
        "three_edge_paths": {"hardest_path": ["6", "26", 19, 29], "witnesses": []},
    }
    assert rows_of(spark, [(1, json.dumps(third))]) == want
    lone = BASE | {"all_edge_pairs": {"witnesses": {"cycle": "7 8 9", "newly_certified_constraints": None}}}
    assert {r[2:] for r in rows_of(spark, [(1, json.dumps(lone))])} == {("witness", 0, -1, -1), ("cycle", 0, 0, 7), ("cycle", 0, 1, 8), ("cycle", 0, 2, 9)}


def test_the_last_complete_line_counts(spark):
    line = lambda v: json.dumps(BASE | {"three_edge_paths": {"hardest_path": [v, 1, 2, 3]}})
    lines = [(1, line(10)), (1, line(11)), (1, line(12)[:-9]), (2, line(20)), (2, None), (2, ""), (2, "[]"), (3, "broken"), (None, line(40)), (4, json.dumps(BASE)), (1, None)]
    got = rows_of(spark, lines)
    assert {(r[0], r[5]) for r in got if r[4] == 0} == {(1, 11), (2, 20)}
    assert rows_of(spark, []) == set()
    unnumbered = spark.createDataFrame([(None, 1, line(10)), (-5, 1, line(11)), (None, 2, line(12))], "line_no long, record_id long, record_json string")
    assert {(r.record_id, r.leaf_value) for r in nested.hardest_and_witness_rows(unnumbered).where("inner_pos = 0").collect()} == {(1, 11), (2, 12)}


def test_repeated_lines_and_parents(spark):
    text = json.dumps(BASE | {"all_edge_pairs": {"witnesses": [{"cycle": [1, 2, 3], "newly_certified_constraints": 4}] * 2}, "big": "x" * 200_000})
    df = spark.createDataFrame([(7, 1, text)] * 3, "line_no long, record_id long, record_json string")
    t = nested.shred(df)
    assert t["witness"].count() == 2 and t["cycle"].count() == 2
    record, analysis = t["record"].first(), t["analysis"].first()
    assert record.payload.canonical_graph_hash == "ab" and json.loads(record.payload.others["big"]) == "x" * 200_000
    assert (record.pk, record.parent_pk, analysis.pk, analysis.parent_pk) == (0, None, 1, 0)
    assert {r.parent_pk for r in t["witness"].collect()} == {1}
    assert {r.parent_pk for r in t["cycle"].collect()} == {r.pk for r in t["witness"].collect()}


def test_witnesses_of_one_place_are_all_kept(spark):
    same = {"witness_index": 0, "cycle": [1, 2, 3], "newly_certified_constraints": 4}
    text = json.dumps(BASE | {"all_edge_pairs": {"witnesses": [same, same | {"cycle": [3, 4, 5]}, same, {"witness_index": 3, "trigger_key": [[1, 2], [3, 4]], "certificate_hash": " AA ", "seconds": 0.5}]}})
    t = nested.shred(spark.createDataFrame([(7, 1, text)], "line_no long, record_id long, record_json string"))
    assert sorted((r.place, r.payload.newly_certified_constraints) for r in t["witness"].collect() if r.place == 0) == [(0, 4), (0, 4)]
    assert sorted((r.place, r.payload.v) for r in t["cycle"].collect()) == [(0, [1, 2, 3]), (0, [3, 4, 5])]
    last = t["witness"].where("place = 3").first().payload
    assert (last.trigger_key, last.certificate_hash, last.newly_certified_constraints, dict(last.others)) == ("[[1,2],[3,4]]", "aa", None, {"seconds": "0.5", "witness_index": "3"})
    keys = [r.pk for tag in t for r in t[tag].collect()]
    assert len(keys) == len(set(keys))


def test_wrappers_of_any_depth_and_members_of_any_kind(spark):
    deep = BASE | {"all_edge_pairs": {"graph_order": "8", "property_satisfied": "true", "median_query_time_seconds": "0.25", "hardest_ordered_pair": [[1, None, 7], {"v": 5}], "witnesses": [{"cycle": {"2": 9, "0": 8}}], "extra": {"a": 1}}}
    for i in range(30):
        deep = {"schema": f"v{i}", "record": deep} if i % 2 else {"wrapped": [deep] if i % 4 else json.dumps(deep)}
    text = json.dumps(deep)
    t = nested.shred(spark.createDataFrame([(1, 1, text), (2, 1, "[" * 200_000), (3, 1, '{"a":' * 200_000)], "line_no long, record_id long, record_json string"))
    a = t["analysis"].first().payload
    assert (a.graph_order, a.property_satisfied, a.median_query_time_seconds, a.candidate_report_path, dict(a.others)) == (8, True, 0.25, None, {"extra": '{"a":1}'})
    assert json.loads(t["record"].first().payload.others["schema"]) == "v1"
    assert {tuple(r)[2:] for r in nested.hardest_and_witness_rows(spark.createDataFrame([(1, 1, text)], "line_no long, record_id long, record_json string")).collect()} == {
        ("hardest_ordered_pair", 0, 0, 1), ("hardest_ordered_pair", 0, 2, 7), ("hardest_ordered_pair", 1, 1, 5), ("witness", 0, -1, -1), ("cycle", 0, 0, 8), ("cycle", 0, 2, 9)
    }
