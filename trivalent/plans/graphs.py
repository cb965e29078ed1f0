"""Graph queries: over the review constraints' edges and over the witness cycles of the census records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cycle_edges, norm_hash
from ..operators import cycles, flexibility, graph, separation
from ..operators.nested import of_cycles, shred
from ..operators.reconcile import latest_per_key
from ..session import materialize, table
from .problems import P2_WITNESSES

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def constraint_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(graph, u, v): every edge that a review constraint of either copy names, repeats included."""
    none = F.array().cast("array<array<int>>")
    rows = table(spark, sf, "review_constraints").select(
        norm_hash("graph_hash").alias("graph"), F.explode(F.concat(F.coalesce("required_edges", none), F.coalesce("forbidden_edges", none))).alias("e")
    )
    u, v = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    return rows.select("graph", F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u is not null and v is not null")


EDGES = """
named AS (SELECT lower(trim(graph_hash)) AS g, unnest(list_concat(coalesce(required_edges, []), coalesce(forbidden_edges, []))) AS e FROM review_constraints),
edges AS (SELECT g, least(e[1], e[2]) AS u, greatest(e[1], e[2]) AS v FROM named WHERE e[1] IS NOT NULL AND e[2] IS NOT NULL),
arcs AS (SELECT DISTINCT g, u, v FROM edges UNION SELECT DISTINCT g, v, u FROM edges)"""


@query(f"WITH {EDGES} SELECT g AS graph, u, v, count(*) AS multiplicity FROM edges GROUP BY ALL HAVING count(*) > 1")
def constraint_parallel_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.parallel_edges(constraint_edges(spark, sf))


@query(f"""
WITH {EDGES}, ends AS (SELECT g, u AS node FROM edges UNION ALL SELECT g, v FROM edges), d AS (SELECT g, node, count(*) AS degree FROM ends GROUP BY ALL)
SELECT degree, count(*) AS nodes, count(DISTINCT g) AS graphs FROM d GROUP BY 1""")
def constraint_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """How many vertices have which degree, repeats counted."""
    return graph.degrees(constraint_edges(spark, sf)).groupBy("degree").agg(F.count("*").alias("nodes"), F.countDistinct("graph").alias("graphs"))


@query(f"""
WITH RECURSIVE {EDGES},
reach(g, a, b) AS (SELECT g, u, u FROM arcs UNION SELECT r.g, r.a, arcs.v FROM reach r JOIN arcs ON r.g = arcs.g AND r.b = arcs.u)
SELECT g AS graph, a AS node, min(b) AS component FROM reach GROUP BY ALL""")
def constraint_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of every graph's constrained edges."""
    return graph.components(constraint_edges(spark, sf))


@query(f"""
WITH RECURSIVE {EDGES},
walk(g, a, b, p) AS (SELECT g, u, u, 0 FROM arcs UNION SELECT w.g, w.a, arcs.v, 1 - w.p FROM walk w JOIN arcs ON w.g = arcs.g AND w.b = arcs.u)
SELECT DISTINCT g AS graph FROM walk WHERE a = b AND p = 1""")
def constraint_odd_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs whose constrained edges aren't bipartite, which no census graph's should be."""
    return graph.odd_cycles(constraint_edges(spark, sf))


@query(f"""
WITH {EDGES}, w AS (SELECT DISTINCT m.g, CASE WHEN [l.v, m.u, m.v, r.v] < [r.v, m.v, m.u, l.v] THEN [l.v, m.u, m.v, r.v] ELSE [r.v, m.v, m.u, l.v] END AS p
  FROM arcs m JOIN arcs l ON l.g = m.g AND l.u = m.u JOIN arcs r ON r.g = m.g AND r.u = m.v WHERE m.u < m.v AND l.v <> m.v AND r.v <> m.u AND l.v <> r.v)
SELECT g AS graph, count(*) AS paths FROM w GROUP BY 1""")
def constraint_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Three-edge paths among each graph's constrained edges."""
    return graph.three_edge_paths(constraint_edges(spark, sf)).groupBy("graph").agg(F.count("*").alias("paths"))


def witness_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """(graph, cycle_id, analysis, place, cycle, graph_hash, order): the witness cycles kept in the census records; graph is the record, cycle_id the cycle's key in it."""
    t = shred(table(spark, sf, "census_records"), tags=["record", "cycle"])
    head = t["record"].select("record_id", F.col("payload.canonical_graph_hash").alias("graph_hash"), F.col("payload.requested_vertex_count").alias("order"))
    kept = t["cycle"].select("record_id", F.col("pk").alias("cycle_id"), "analysis", "place", F.col("payload.v").alias("cycle"))
    return materialize(kept.join(head, "record_id").withColumnRenamed("record_id", "graph"), "witness")


CYCLES = f"""{P2_WITNESSES},
cycles AS (SELECT record_id, analysis, place, row_number() OVER () AS id, lower(trim(r->>'$.canonical_graph_hash')) AS graph_hash, CAST(r->>'$.requested_vertex_count' AS INTEGER) AS n, cycle FROM witnesses WHERE len(cycle) > 0),
turned AS (SELECT *, cycle[list_position(cycle, list_min(cycle)):] || cycle[:list_position(cycle, list_min(cycle)) - 1] AS f FROM cycles),
spelt AS (SELECT *, CASE WHEN f <= [f[1]] || list_reverse(f[2:]) THEN f ELSE [f[1]] || list_reverse(f[2:]) END AS least FROM turned),
steps AS (SELECT DISTINCT record_id, graph_hash, id, least(x, y) AS u, greatest(x, y) AS v FROM (SELECT record_id, graph_hash, id, unnest(cycle) AS x, unnest(cycle[2:] || [cycle[1]]) AS y FROM cycles))"""


@query(f"""WITH {CYCLES}
SELECT record_id, analysis, place, len(cycle) AS length, coalesce(len(cycle) = n AND len(list_distinct(cycle)) = n AND list_max(cycle) < n, false) AS valid,
  CASE WHEN len(cycle) >= 3 AND len(list_distinct(cycle)) = len(cycle) THEN sha256(replace(CAST(least AS VARCHAR), ' ', '')) END AS certificate_hash FROM spelt""")
def witness_cycle_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each witness goes through every vertex of its graph once, and its certificate hash."""
    w = witness_cycles(spark, sf)
    whole = (F.size("cycle") == F.col("order")) & (F.size(F.array_distinct("cycle")) == F.col("order")) & (F.array_max("cycle") < F.col("order"))
    return w.select(F.col("graph").alias("record_id"), "analysis", "place", F.size("cycle").alias("length"), F.coalesce(whole, F.lit(False)).alias("valid"), cycles.certificate_hash("cycle").alias("certificate_hash"))


def witness_rows(w: DataFrame) -> DataFrame:
    return w.select("graph", "cycle_id", F.explode(cycle_edges("cycle")).alias("e")).select("graph", "cycle_id", "e.u", "e.v").distinct()


@query(f"""WITH {CYCLES},
signs AS (SELECT record_id, u, v, list_sort(list(id)) AS s FROM steps GROUP BY ALL),
pairs AS (SELECT x.record_id, len(list_filter(x.s, lambda c: NOT list_contains(y.s, c))) > 0 AS apart, x.s = y.s AS equal FROM signs x JOIN signs y ON x.record_id = y.record_id AND (x.u, x.v) <> (y.u, y.v)),
tally AS (SELECT record_id, count(*) AS required_pairs, count(*) FILTER (apart) AS separated_pairs, count(*) FILTER (equal) // 2 AS equal_pairs, count(*) FILTER (NOT apart AND NOT equal) AS nested_pairs FROM pairs GROUP BY 1),
sized AS (SELECT record_id, count(*) AS edges, count(DISTINCT s) AS distinct_signatures FROM signs GROUP BY 1)
SELECT record_id, required_pairs, separated_pairs, required_pairs = separated_pairs AS separating, edges, distinct_signatures, equal_pairs, nested_pairs, equal_pairs = 0 AND nested_pairs = 0 AS antichain FROM tally JOIN sized USING (record_id)""")
def witness_separation(spark: SparkSession, sf: str) -> DataFrame:
    """Of the edges seen in a record's witnesses: ordered pairs, those separated, and the state of the signatures."""
    rows = materialize(witness_rows(witness_cycles(spark, sf)), "rows")
    classes = materialize(separation.signature_classes(rows, rows), "classes")
    pairs = materialize(separation.class_pairs(classes), "pairs")
    cov, anti = separation.coverage(pairs), separation.antichain(classes, pairs)
    return cov.join(anti, "graph").withColumnRenamed("graph", "record_id")


@query(f"""WITH {CYCLES},
held AS (SELECT DISTINCT c.record_id, analysis, c.id, u, v FROM steps s JOIN cycles c USING (id)),
signs AS (SELECT record_id, analysis, u, v, list(id) AS s FROM held GROUP BY ALL),
pairs AS (SELECT x.record_id, x.analysis, len(list_filter(x.s, lambda c: NOT list_contains(y.s, c))) AS n, [x.u, x.v, y.u, y.v] AS first
  FROM signs x JOIN signs y ON x.record_id = y.record_id AND x.analysis = y.analysis AND (x.u, x.v) <> (y.u, y.v) WHERE x.analysis = 'all_edge_pairs'),
arcs AS (SELECT record_id, u, v FROM signs WHERE analysis = 'three_edge_paths' UNION ALL SELECT record_id, v, u FROM signs WHERE analysis = 'three_edge_paths'),
paths AS (SELECT DISTINCT m.record_id, CASE WHEN [l.v, m.u, m.v, r.v] < [r.v, m.v, m.u, l.v] THEN [l.v, m.u, m.v, r.v] ELSE [r.v, m.v, m.u, l.v] END AS p
  FROM arcs m JOIN arcs l ON l.record_id = m.record_id AND l.u = m.u JOIN arcs r ON r.record_id = m.record_id AND r.u = m.v WHERE m.u < m.v AND l.v <> m.v AND r.v <> m.u AND l.v <> r.v),
steps3 AS (SELECT record_id, p, least(p[k], p[k + 1]) AS u, greatest(p[k], p[k + 1]) AS v FROM paths, (SELECT unnest([1, 2, 3]) AS k)),
whole AS (SELECT record_id, p, count(*) AS n FROM (SELECT t.record_id, t.p, h.id FROM steps3 t JOIN held h ON h.record_id = t.record_id AND h.analysis = 'three_edge_paths' AND h.u = t.u AND h.v = t.v GROUP BY ALL HAVING count(*) = 3) GROUP BY ALL),
met AS (SELECT * FROM pairs UNION ALL SELECT paths.record_id, 'three_edge_paths', coalesce(n, 0), paths.p FROM paths LEFT JOIN whole ON whole.record_id = paths.record_id AND whole.p = paths.p)
SELECT record_id, analysis, count(*) AS constraints, count(*) FILTER (n > 0) AS satisfied, count(*) = count(*) FILTER (n > 0) AS holds, CAST(min(n) AS INTEGER) AS fewest,
  array_to_string(arg_min(first, {{'n': n, 'f': first}}), '-') AS hardest FROM met GROUP BY ALL""")
def recorded_flexibility(spark: SparkSession, sf: str) -> DataFrame:
    """Of the edges seen in a record's witnesses: how many constraints of either analysis they satisfy, and the hardest one."""
    return of_cycles(table(spark, sf, "census_records"), flexibility.recorded, flexibility.RECORDED)


@query()
def witness_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a greedy cover, of an exact minimum cover and of a packing of the pairs that a record's witnesses separate."""
    rows = materialize(witness_rows(witness_cycles(spark, sf)), "rows")
    pairs = materialize(separation.class_pairs(separation.signature_classes(rows, rows)).where("size(support) > 0"), "pairs")
    greedy = separation.greedy_cover(pairs).groupBy("graph").agg(F.count("*").alias("greedy_size"), F.sum("gain").alias("separated_pairs"))
    least = separation.minimum_cover(pairs).select("graph", F.col("cover_size").alias("minimum_size"))
    packing = separation.greedy_packing(pairs).groupBy("graph").agg(F.count("*").alias("packing_size"))
    return greedy.join(least, "graph").join(packing, "graph").withColumnRenamed("graph", "record_id")


_pairs = lambda c: f"list_transform(coalesce({c}, []), lambda e: [least(e[1], e[2]), greatest(e[1], e[2])])"


@query(f"""WITH {CYCLES},
named AS (SELECT lower(trim(held_by)) AS held_by, lower(trim(graph_hash)) AS graph_hash, constraint_index, analysis, copied_at, {_pairs("required_edges")} AS q, {_pairs("forbidden_edges")} AS f FROM review_constraints),
held AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY held_by, graph_hash, constraint_index ORDER BY copied_at DESC) AS k FROM named) WHERE k = 1),
chosen AS (SELECT graph_hash, id, list([u, v]) AS e FROM steps GROUP BY ALL),
met AS (SELECT held_by, h.graph_hash, analysis, constraint_index, coalesce(bool_or(list_has_all(e, q) AND NOT list_has_any(e, f)), false) AS met FROM held h LEFT JOIN chosen c ON c.graph_hash = h.graph_hash GROUP BY ALL)
SELECT held_by, graph_hash, analysis, count(*) AS constraints, count(*) FILTER (met) AS satisfied FROM met GROUP BY ALL""")
def constraints_met_by_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    """Per copy, graph and analysis: review constraints, each in its latest row, and how many of them some kept witness satisfies."""
    pair = lambda c: F.transform(F.coalesce(c, F.array().cast("array<array<int>>")), lambda e: F.struct(F.least(F.get(e, F.lit(0)), F.get(e, F.lit(1))).alias("u"), F.greatest(F.get(e, F.lit(0)), F.get(e, F.lit(1))).alias("v")))
    named = table(spark, sf, "review_constraints").select(F.lower(F.trim("held_by")).alias("held_by"), norm_hash("graph_hash").alias("graph_hash"), "constraint_index", "copied_at", "analysis", "required_edges", "forbidden_edges")
    cons = latest_per_key(named, ["held_by", "graph_hash", "constraint_index"], "copied_at").select("held_by", "graph_hash", "analysis", "constraint_index", pair(F.col("required_edges")).alias("required"), pair(F.col("forbidden_edges")).alias("forbidden"))
    held = witness_cycles(spark, sf).select(norm_hash("graph_hash").alias("graph_hash"), cycle_edges("cycle").alias("selected"))
    fits = F.coalesce(cycles.satisfies(F.col("selected"), F.col("required"), F.col("forbidden")), F.lit(False))
    met = cons.join(held, "graph_hash", "left").groupBy("held_by", "graph_hash", "analysis", "constraint_index").agg(F.bool_or(F.col("selected").isNotNull() & fits).alias("met"))
    return met.groupBy("held_by", "graph_hash", "analysis").agg(F.count("*").alias("constraints"), F.count_if("met").alias("satisfied"))


@query("""
WITH o AS (SELECT graph_order AS n, max(number_of_witness_cycles) AS most FROM all_edge_pair_results GROUP BY 1),
g AS (SELECT n, most, a, (n - 4) / 2 - a AS b FROM o, LATERAL (SELECT unnest(range(1, CAST((n - 4) / 2 AS BIGINT), 2)) AS a))
SELECT n AS graph_order, a, CAST(b AS BIGINT) AS b, CAST(a * b + 5 AS BIGINT) AS predicted_cycles, CAST(floor(((a + 2) * (b + 2) - 1) / 2) AS BIGINT) AS predicted_separation, most AS most_witness_cycles
FROM g WHERE b >= 1 AND b % 2 = 1 AND a >= b""")
def double_ladder_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """For each order of the census the double ladders D(a, b) it allows, their predicted counts beside the most witness cycles seen."""
    from ..operators.ladder import cycle_count, separation_number

    orders = table(spark, sf, "all_edge_pair_results").groupBy("graph_order").agg(F.max("number_of_witness_cycles").alias("most_witness_cycles"))
    half = F.floor((F.col("graph_order") - 4) / 2)
    grid = orders.where("graph_order >= 8 and graph_order % 2 = 0").withColumn("a", F.explode(F.sequence(F.lit(1).cast("bigint"), half - 1, F.lit(2).cast("bigint")))).withColumn("b", half - F.col("a"))
    ok = grid.where("b >= 1 and b % 2 = 1 and a >= b")
    return ok.select("graph_order", "a", "b", cycle_count(F.col("a"), F.col("b")).alias("predicted_cycles"), separation_number(F.col("a"), F.col("b")).alias("predicted_separation"), "most_witness_cycles")
