"""Queries of the two general data problems: p1 (copies) and p2 (nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bundles import copy_differences
from ..operators.nested import hardest_and_witness_rows, shred
from ..operators.stats import summary_by_kind
from ..session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return copy_differences(table(spark, sf, "artifact_bundles"), table(spark, sf, "artifact_bundles_mirror"), table(spark, sf, "review_constraints"))


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Differences by dataset, kind and field."""
    return p1_found(spark, sf).groupBy("dataset", "diff_kind", "field_name").agg(F.count("*").alias("differences"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hardest_and_witness_rows(table(spark, sf, "census_records"))


P1_FOUND = """
WITH sides AS (SELECT 'p' AS s, * FROM artifact_bundles UNION ALL SELECT 'm', * FROM artifact_bundles_mirror),
b AS (SELECT * EXCLUDE k FROM (SELECT *, lower(trim(graph_hash)) AS h, row_number() OVER (PARTITION BY s, lower(trim(graph_hash)) ORDER BY copied_at DESC) AS k FROM sides) WHERE k = 1),
p AS (SELECT * FROM b WHERE s = 'p'), m AS (SELECT * FROM b WHERE s = 'm'),
sets AS (SELECT s, h, unnest(['planar_code_paths', 'embedding_paths', 'report_paths', 'leaderboard_categories']) AS f,
  unnest([planar_code_paths, embedding_paths, report_paths, leaderboard_categories]) AS l FROM b),
norm AS (SELECT s, h, f, list_sort(list_distinct(coalesce(l, []))) AS l FROM sets),
leaf AS (SELECT s, h, 'original_record' || substr(t.fullkey, 2) AS f, t.key AS key, t.type AS type, t.value AS v
  FROM b, json_tree(CASE WHEN coalesce(trim(original_record), '') = '' THEN '{}' ELSE original_record END) t WHERE t.type <> 'OBJECT' AND t.type <> 'NULL' AND t.fullkey NOT LIKE '%[%'),
shaped AS (SELECT s, h, f, CASE
    WHEN key = 'face_size_multiset' AND type = 'ARRAY' THEN CAST(list_sort(CAST(v AS DOUBLE[])) AS VARCHAR)
    WHEN key = 'hardest_ordered_pair' AND type = 'ARRAY' THEN CAST(list_transform(CAST(v AS DOUBLE[][]), lambda e: list_sort(e)) AS VARCHAR)
    WHEN key = 'canonical_graph_hash' THEN lower(trim(v->>'$'))
    WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN NULL ELSE type || CAST(v AS VARCHAR) END AS t,
    CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(v AS DOUBLE) END AS d FROM leaf),
shared AS (SELECT h FROM p INTERSECT SELECT h FROM m),
members AS (SELECT coalesce(x.h, y.h) AS h, coalesce(x.f, y.f) AS f FROM (SELECT * FROM shaped WHERE s = 'p') x FULL JOIN (SELECT * FROM shaped WHERE s = 'm') y ON x.h = y.h AND x.f = y.f
  WHERE x.h IS NULL OR y.h IS NULL OR NOT coalesce(x.t = y.t, abs(x.d - y.d) <= 1e-9 * greatest(abs(x.d), abs(y.d)), false)),
held AS (SELECT lower(trim(held_by)) AS s, lower(trim(graph_hash)) AS h, constraint_index AS i, analysis, copied_at,
  list_sort(list_distinct(list_transform(coalesce(required_edges, []), lambda e: list_sort(e)))) AS r, list_sort(list_distinct(list_transform(coalesce(forbidden_edges, []), lambda e: list_sort(e)))) AS f FROM review_constraints),
c AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY s, h, i ORDER BY copied_at DESC) AS k FROM held) WHERE k = 1),
pairs AS (SELECT x.s AS a, y.s AS b, coalesce(x.h, y.h) AS h, coalesce(x.i, y.i) AS i, x.analysis AS a1, y.analysis AS a2, x.r AS r1, y.r AS r2, x.f AS f1, y.f AS f2
  FROM (SELECT * FROM c WHERE s = 'primary') x FULL JOIN (SELECT * FROM c WHERE s = 'mirror') y ON x.h = y.h AND x.i = y.i),
found AS (
  SELECT 'bundle' AS dataset, coalesce(p.h, m.h) AS graph_hash, -1 AS constraint_index, '' AS field_name, CASE WHEN m.h IS NULL THEN 'only_primary' ELSE 'only_mirror' END AS diff_kind
    FROM p FULL JOIN m ON p.h = m.h WHERE p.h IS NULL OR m.h IS NULL
  UNION ALL SELECT 'bundle', x.h, -1, x.f, 'differs' FROM norm x JOIN norm y ON x.h = y.h AND x.f = y.f AND x.s = 'p' AND y.s = 'm' WHERE x.l <> y.l
  UNION ALL SELECT 'bundle', h, -1, f, 'differs' FROM members WHERE h IN (SELECT h FROM shared)
  UNION ALL SELECT 'constraint', h, i, '', CASE WHEN b IS NULL THEN 'only_primary' ELSE 'only_mirror' END FROM pairs WHERE a IS NULL OR b IS NULL
  UNION ALL SELECT 'constraint', h, i, 'analysis', 'differs' FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND a1 IS DISTINCT FROM a2
  UNION ALL SELECT 'constraint', h, i, 'required_edges', 'differs' FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND r1 <> r2
  UNION ALL SELECT 'constraint', h, i, 'forbidden_edges', 'differs' FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL AND f1 <> f2)"""
#: An object or list that is written as text, or stands alone in a list, as the object it is.
_open = lambda x: f"(CASE json_type({x}) WHEN 'VARCHAR' THEN CASE WHEN json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) END WHEN 'ARRAY' THEN CASE WHEN json_array_length({x}) = 1 THEN {x}->'$[0]' END ELSE {x} END)"
P2_LAST = f"""
texts AS (SELECT record_id, line_no, trim(record_json, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) AS t FROM census_records WHERE record_id IS NOT NULL),
lines AS (SELECT record_id, line_no, CAST(t AS JSON) AS j FROM texts WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END),
last AS (SELECT record_id, arg_max(j, line_no) AS j FROM lines GROUP BY 1),
bare AS (SELECT record_id, CASE WHEN (j->'$.canonical_graph_hash') IS NULL AND (j->'$.record') IS NOT NULL THEN j->'$.record' ELSE j END AS r FROM last),
each AS ({' UNION ALL '.join(f"SELECT record_id, '{a}' AS analysis, r, r->'$.{a}' AS a FROM bare" for a in ("all_edge_pairs", "three_edge_paths"))}),
once AS (SELECT record_id, analysis, r, {_open("a")} AS a FROM each),
twice AS (SELECT record_id, analysis, r, {_open("a")} AS a FROM once),
known AS (SELECT * FROM twice WHERE json_type(a) = 'OBJECT')"""
P2_ANALYSES_SQL = f"""
WITH {P2_LAST}
SELECT record_id, analysis, lower(trim(r->>'$.canonical_graph_hash')) AS graph_hash, CAST(r->>'$.requested_vertex_count' AS INTEGER) AS requested_vertex_count,
  CAST(a->>'$.graph_order' AS INTEGER) AS graph_order, CAST(a->>'$.edge_count' AS INTEGER) AS edge_count, CAST(a->>'$.number_of_witness_cycles' AS INTEGER) AS number_of_witness_cycles,
  CAST(a->>'$.total_subtour_constraints' AS INTEGER) AS total_subtour_constraints, CAST(a->>'$.property_satisfied' AS BOOLEAN) AS property_satisfied,
  CAST(a->>'$.maximum_query_time_seconds' AS DOUBLE) AS maximum_query_time_seconds, len(CAST(a->'$.face_size_multiset' AS INTEGER[])) AS faces FROM known"""
#: The numbers in whatever a writer made of a list.
_ints = lambda x: f"CAST(regexp_extract_all(CAST({x} AS VARCHAR), '[0-9]+') AS INTEGER[])"
#: Witnesses with their places and open cycles.
P2_WITNESSES = f"""{P2_LAST},
listed AS (SELECT record_id, analysis, r, CASE WHEN json_type(w) = 'OBJECT' AND ((w->'$.certificate_hash') IS NOT NULL OR (w->'$.cycle') IS NOT NULL OR (w->'$.trigger_key') IS NOT NULL) THEN json_array(w) ELSE w END AS w
  FROM (SELECT *, a->'$.witnesses' AS w FROM known) WHERE json_type(w) IN ('ARRAY', 'OBJECT')),
single AS (SELECT record_id, analysis, r, CAST(e.key AS INTEGER) AS k, e.value AS x FROM listed, json_each(w) e WHERE json_type(e.value) = 'OBJECT'),
walks AS (SELECT record_id, analysis, r, coalesce(CAST(x->>'$.witness_index' AS INTEGER), k) AS place, CAST(x->>'$.newly_certified_constraints' AS INTEGER) AS certified,
  {_ints("CASE WHEN json_type(x->'$.cycle') = 'OBJECT' THEN x->'$.cycle.vertices' ELSE x->'$.cycle' END")} AS c FROM single),
witnesses AS (SELECT record_id, analysis, r, place, certified, CASE WHEN len(c) > 1 AND c[1] = c[-1] THEN c[:-2] ELSE c END AS cycle FROM walks)"""
#: Edges written as a list, as u and v, or as text.
_edge = lambda e: f"CASE WHEN json_type({e}) = 'OBJECT' THEN [CAST({e}->>'$.u' AS INTEGER), CAST({e}->>'$.v' AS INTEGER)] ELSE {_ints(e)} END"
P2_FOUND_SQL = f"""
WITH {P2_WITNESSES},
hard AS (SELECT record_id, analysis, unnest([0, 1]) AS role, unnest(CASE WHEN json_type(h) = 'OBJECT' THEN [h->'$.required', h->'$.forbidden'] ELSE [h->'$[0]', h->'$[1]'] END) AS e
  FROM (SELECT *, a->'$.hardest_ordered_pair' AS h FROM known) WHERE json_type(h) IN ('ARRAY', 'OBJECT')),
lists AS (
  SELECT record_id, analysis, 'hardest_ordered_pair' AS child_name, role AS outer_pos, {_edge("e")} AS l FROM hard
  UNION ALL SELECT record_id, analysis, 'hardest_path', 0, {_ints("a->'$.hardest_path'")} FROM known
  UNION ALL SELECT record_id, analysis, 'cycle', place, cycle FROM witnesses)
SELECT record_id, analysis, child_name, outer_pos, CAST(unnest(range(len(l))) AS INTEGER) AS inner_pos, unnest(l) AS leaf_value FROM lists
UNION ALL SELECT record_id, analysis, 'witness', place, -1, coalesce(certified, -1) FROM witnesses"""


def p2_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """The parent tables: one row per record and analysis, joined on the parent key."""
    t = shred(table(spark, sf, "census_records"), tags=["record", "analysis"])
    record = t["record"].select("record_id", F.col("pk").alias("parent_pk"), F.col("payload.canonical_graph_hash").alias("graph_hash"), "payload.requested_vertex_count")
    own = [f"payload.{c}" for c in ("graph_order", "edge_count", "number_of_witness_cycles", "total_subtour_constraints", "property_satisfied", "maximum_query_time_seconds")]
    analysis = t["analysis"].select("record_id", "parent_pk", "analysis", *own, F.size("payload.face_size_multiset").alias("faces"))
    return analysis.join(record, ["record_id", "parent_pk"]).drop("parent_pk")


SUMMED = ["number_of_constrained_sat_calls", "number_of_witness_cycles", "total_subtour_iterations", "total_subtour_constraints", "backtracking_queries", "backtracking_agreements"]
_per = lambda a: ", ".join(
    [f"count(*) FILTER (analysis = '{a}') AS {a}_graphs", f"count(*) FILTER (analysis = '{a}' AND CAST(a->>'$.property_satisfied' AS BOOLEAN)) AS {a}_satisfied"]
    + [f"CAST(sum(CAST(a->>'$.{c}' AS BIGINT)) FILTER (analysis = '{a}') AS BIGINT) AS {a}_{c}" for c in SUMMED]
    + [f"round(max(CAST(a->>'$.maximum_query_time_seconds' AS DOUBLE)) FILTER (analysis = '{a}'), 9) AS {a}_slowest_seconds"]
)
ANALYSIS_SUMMARY_SQL = f"""WITH {P2_LAST}
SELECT CAST(r->>'$.requested_vertex_count' AS INTEGER) AS graph_order, {_per("all_edge_pairs")}, {_per("three_edge_paths")} FROM known GROUP BY 1"""


def analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of every order over its records, side by side for each analysis that occurs."""
    t = shred(table(spark, sf, "census_records"), tags=["record", "analysis"])
    order = t["record"].select("record_id", F.col("payload.requested_vertex_count").alias("graph_order"))
    rows = t["analysis"].select("record_id", "analysis", "payload.*").drop("graph_order").join(order, "record_id")
    sums = {"graphs": F.count(F.lit(1)), "satisfied": F.count_if("property_satisfied"), **{c: F.sum(c) for c in SUMMED}, "slowest_seconds": F.round(F.max("maximum_query_time_seconds"), 9)}
    out = summary_by_kind(rows, ["graph_order"], "analysis", sums)
    counts = [c for c in out.columns if c.endswith(("_graphs", "_satisfied"))]
    return out.fillna(0, counts)


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p2_found": p2_found, "p2_analyses": p2_analyses, "analysis_summary": analysis_summary}
SQL: dict[str, str] = {
    "p1_found": f"{P1_FOUND} SELECT * FROM found", "p1_summary": f"{P1_FOUND} SELECT dataset, diff_kind, field_name, count(*) AS differences FROM found GROUP BY ALL",
    "p2_found": P2_FOUND_SQL, "p2_analyses": P2_ANALYSES_SQL, "analysis_summary": ANALYSIS_SUMMARY_SQL,
}
