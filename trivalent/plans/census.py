"""Queries over the census of all-edge-pair runs and its side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import face_signature, norm_hash
from ..operators import quality, ranking, stats
from ..session import materialize, table

METRICS = ["number_of_witness_cycles", "total_subtour_iterations", "total_subtour_constraints", "maximum_pairs_certified_by_one_witness"]
TIMES = ["total_sat_wall_time_seconds", "median_query_time_seconds", "p95_query_time_seconds", "p99_query_time_seconds", "maximum_query_time_seconds"]
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def runs_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every result once, its hash in its one spelling."""
    runs = table(spark, sf, "all_edge_pair_results").dropDuplicates(["result_id"])
    return runs.withColumn("canonical_graph_hash", norm_hash("canonical_graph_hash"))


ONCE = """
once AS (SELECT * EXCLUDE (rn, canonical_graph_hash), lower(trim(canonical_graph_hash)) AS canonical_graph_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at) AS rn FROM all_edge_pair_results) WHERE rn = 1)"""
LAST = f"""{ONCE},
latest AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY canonical_graph_hash ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS k FROM once) WHERE k = 1)"""


def latest_runs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Of every graph its latest run."""
    runs = table(spark, sf, "all_edge_pair_results").withColumn("canonical_graph_hash", norm_hash("canonical_graph_hash"))
    picked = F.max_by(F.struct(*columns), F.struct("finished_at", "result_id")).alias("r")
    return runs.groupBy("canonical_graph_hash").agg(picked).select("canonical_graph_hash", "r.*")


@query(f"""
WITH {ONCE}
SELECT graph_order, count(*) AS runs, count(DISTINCT canonical_graph_hash) AS graphs, count(*) FILTER (property_satisfied) AS satisfied,
  CAST(sum(number_of_witness_cycles) AS BIGINT) AS witness_cycles, CAST(sum(total_subtour_iterations) AS BIGINT) AS subtour_iterations,
  CAST(sum(backtracking_queries) AS BIGINT) AS audited, CAST(sum(backtracking_agreements) AS BIGINT) AS agreements
FROM once GROUP BY 1""")
def order_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return (
        runs_once(spark, sf)
        .groupBy("graph_order")
        .agg(
            F.count("*").alias("runs"), F.countDistinct("canonical_graph_hash").alias("graphs"), F.count_if("property_satisfied").alias("satisfied"),
            F.sum("number_of_witness_cycles").alias("witness_cycles"), F.sum("total_subtour_iterations").alias("subtour_iterations"),
            F.sum(c("backtracking_queries")).alias("audited"), F.sum("backtracking_agreements").alias("agreements"),
        )
    )


@query(f"""
WITH {ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_order ORDER BY maximum_query_time_seconds DESC, result_id) AS k
  FROM once WHERE maximum_query_time_seconds IS NOT NULL AND NOT isnan(maximum_query_time_seconds) AND NOT isinf(maximum_query_time_seconds))
SELECT graph_order, result_id, canonical_graph_hash, maximum_query_time_seconds AS slowest_seconds, CAST(hardest_ordered_pair AS VARCHAR) IS NOT NULL AS has_pair FROM r WHERE k = 1""")
def slowest_run_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """The run of the slowest query of each order; the first id wins among equal times."""
    runs = runs_once(spark, sf).where(stats.finite("maximum_query_time_seconds"))
    picked = F.max_by(
        F.struct("result_id", "canonical_graph_hash", F.col("maximum_query_time_seconds").alias("slowest_seconds"), F.col("hardest_ordered_pair").isNotNull().alias("has_pair")),
        F.struct("maximum_query_time_seconds", -F.col("result_id")),
    )
    return runs.groupBy("graph_order").agg(picked.alias("r")).select("graph_order", "r.*")


@query(f"""
WITH {ONCE}, l AS (
  UNPIVOT (SELECT graph_order, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in TIMES)} FROM once) ON {', '.join(TIMES)} INTO NAME metric VALUE value),
v AS (SELECT * FROM l WHERE NOT isnan(value) AND NOT isinf(value))
SELECT graph_order, metric, count(*) AS value_count, min(value) AS minimum, round(quantile_cont(value, 0.5), 9) AS median, round(avg(value), 9) AS mean,
  round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, max(value) AS maximum FROM v GROUP BY ALL""")
def time_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of each time over each order."""
    long = stats.to_long(runs_once(spark, sf), ["graph_order"], TIMES)
    out = stats.distribution(long, ["graph_order", "metric"], "value")
    return out.select("graph_order", "metric", "value_count", "minimum", F.round("median", 9).alias("median"), F.round("mean", 9).alias("mean"), F.round("p95", 9).alias("p95"), F.round("p99", 9).alias("p99"), "maximum")


PROFILE_SQL = f"""
WITH {LAST}, l AS (
  UNPIVOT (SELECT {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM latest) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
q AS (SELECT metric, count(*) AS value_count, min(value) AS minimum, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS maximum, avg(value) AS mean FROM l GROUP BY metric),
m AS (SELECT l.metric, quantile_cont(abs(l.value - q.median), 0.5) AS mad FROM l JOIN q USING (metric) GROUP BY 1),
p AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN q3 > q1 THEN (q3 - q1) / 1.349 WHEN p90 > p10 THEN (p90 - p10) / 2.563 WHEN maximum > minimum THEN (maximum - minimum) / 2 ELSE 0 END AS robust_scale,
  CASE WHEN mad > 0 THEN 'mad_normal' WHEN q3 > q1 THEN 'iqr_normal' WHEN p90 > p10 THEN 'decile_normal' WHEN maximum > minimum THEN 'half_range' ELSE 'constant' END AS robust_scale_method
  FROM q JOIN m USING (metric))"""


@query(f"""{PROFILE_SQL}
SELECT metric, value_count, minimum, round(p10, 6) AS p10, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(p90, 6) AS p90, round(p95, 6) AS p95,
  round(p99, 6) AS p99, maximum, round(mean, 6) AS mean, round(mad, 6) AS mad, round(robust_scale, 6) AS robust_scale, robust_scale_method FROM p""")
def metric_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Robust profile of every counted metric over the latest run of each graph."""
    long = stats.to_long(latest_runs(spark, sf, *METRICS), [], METRICS)
    out = stats.robust_profile(long, ["metric"], "value")
    exact = {"metric", "value_count", "minimum", "maximum", "robust_scale_method"}
    return out.select(*[c if c in exact else F.round(c, 6).alias(c) for c in out.columns])


@query(f"""{PROFILE_SQL},
s AS (SELECT l2.canonical_graph_hash, sum(greatest(0, least(8, CASE WHEN p.robust_scale = 0 THEN 0 ELSE (l2.value - p.median) / p.robust_scale END))) AS score FROM (
  UNPIVOT (SELECT canonical_graph_hash, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM latest) ON {', '.join(METRICS)} INTO NAME metric VALUE value) l2 JOIN p USING (metric) GROUP BY 1)
SELECT canonical_graph_hash, round(score, 6) AS score FROM s WHERE score > 12""")
def outlier_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs whose clipped robust z-scores over four metrics add up to more than twelve."""
    runs = materialize(latest_runs(spark, sf, *METRICS), "latest")
    long = stats.to_long(runs, ["canonical_graph_hash"], METRICS).where(F.col("value").isNotNull())
    profile = stats.robust_profile(long, ["metric"], "value")
    scores = stats.outlier_scores(stats.robust_z(long, ["metric"], "value", profile), ["canonical_graph_hash"])
    return scores.where("score > 12").select("canonical_graph_hash", F.round("score", 6).alias("score"))


@query(f"""
WITH {LAST}, l AS (
  UNPIVOT (SELECT graph_order, canonical_graph_hash, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM latest) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph_order, metric ORDER BY value DESC, canonical_graph_hash) AS INTEGER) AS place FROM l)
SELECT graph_order, metric, place, canonical_graph_hash, value FROM r WHERE place <= 10""")
def leaderboards(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest values of each metric in each order."""
    runs = latest_runs(spark, sf, "graph_order", *METRICS)
    return ranking.leaderboards(runs, "canonical_graph_hash", METRICS, 10, ["graph_order"]).select("graph_order", "metric", "place", "canonical_graph_hash", "value")


@query(f"""
WITH {LAST}, l AS (
  UNPIVOT (SELECT graph_order, canonical_graph_hash, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM latest) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
r AS (SELECT *, row_number() OVER (PARTITION BY graph_order, metric ORDER BY value DESC, canonical_graph_hash) AS place FROM l)
SELECT canonical_graph_hash, string_agg(metric, ',' ORDER BY metric) AS metrics, count(*) AS boards FROM r WHERE place <= 3 GROUP BY 1""")
def leaders_across_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs among the first three of any metric, with the metrics they lead in."""
    top = ranking.leaderboards(latest_runs(spark, sf, "graph_order", *METRICS), "canonical_graph_hash", METRICS, 3, ["graph_order"])
    return top.groupBy("canonical_graph_hash").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metrics"), F.count("*").alias("boards"))


@query(f"""
WITH {LAST}, v AS (SELECT canonical_graph_hash, number_of_witness_cycles AS w FROM latest WHERE number_of_witness_cycles IS NOT NULL)
SELECT canonical_graph_hash, w AS number_of_witness_cycles, rank() OVER (ORDER BY w DESC) AS competition_rank,
  round((rank() OVER (ORDER BY w) - 1 + 0.5 * count(*) OVER (PARTITION BY w)) / count(*) OVER (), 9) AS mid_percentile,
  CAST(rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS DOUBLE) AS average_rank FROM v""")
def witness_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Tie-aware ranks of every graph by witness cycles over the whole census."""
    runs = latest_runs(spark, sf, "number_of_witness_cycles")
    return stats.with_ranks(runs, [], "number_of_witness_cycles").withColumn("mid_percentile", F.round("mid_percentile", 9))


@query(f"""
WITH {LAST}, b AS (SELECT graph_order AS scope, CAST(number_of_witness_cycles AS DOUBLE) AS y, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS[1:])} FROM latest WHERE number_of_witness_cycles IS NOT NULL),
l AS (UNPIVOT b ON {', '.join(METRICS[1:])} INTO NAME metric VALUE x),
s AS (SELECT false AS pooled, scope, metric, y, x FROM l UNION ALL SELECT true, NULL, metric, y, x FROM l),
k AS (SELECT *, rank() OVER (PARTITION BY pooled, scope, metric ORDER BY x) + (count(*) OVER (PARTITION BY pooled, scope, metric, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY pooled, scope, metric ORDER BY y) + (count(*) OVER (PARTITION BY pooled, scope, metric, y) - 1) / 2.0 AS ry FROM s)
SELECT pooled, coalesce(scope, -1) AS graph_order, metric, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson,
  round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman FROM k GROUP BY pooled, scope, metric HAVING count(*) >= 2""")
def witness_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman of witness cycles with the other counts, per order and pooled."""
    runs = latest_runs(spark, sf, "graph_order", *METRICS)
    out = stats.correlations(runs, "graph_order", METRICS[0], METRICS[1:]).where("n >= 2")
    return out.withColumn("graph_order", F.coalesce("graph_order", F.lit(-1))).withColumn("pearson", F.round("pearson", 6)).withColumn("spearman", F.round("spearman", 6))


@query("""
WITH g AS (SELECT lower(trim(canonical_graph_hash)) AS h, max(list_sort(face_size_multiset)) AS f FROM source_records WHERE len(face_size_multiset) > 0 GROUP BY 1),
c AS (SELECT f, count(*) AS frequency FROM g GROUP BY 1)
SELECT array_to_string(list_transform(list_sort(list_distinct(f)), lambda v: CAST(v AS VARCHAR) || '^' || CAST(len(list_filter(f, lambda x: x = v)) AS VARCHAR)), ' ') AS face_signature,
  frequency, round(frequency / (SELECT sum(frequency) FROM c), 9) AS prevalence, round(-log2(frequency / (SELECT sum(frequency) FROM c)), 6) AS surprisal FROM c""")
def face_pattern_surprisal(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency, prevalence and surprisal of every face pattern among the source graphs."""
    rows = table(spark, sf, "source_records").where("size(face_size_multiset) > 0")
    graphs = rows.groupBy(norm_hash("canonical_graph_hash").alias("h")).agg(F.max(F.array_sort("face_size_multiset")).alias("f"))
    out = stats.prevalence(graphs, face_signature("f"), "face_signature")
    return out.withColumn("prevalence", F.round("prevalence", 9)).withColumn("surprisal", F.round("surprisal", 6))


@query(f"""
WITH {LAST}, t AS (SELECT graph_order, max(number_of_witness_cycles) AS maximum FROM latest GROUP BY 1)
SELECT t.graph_order, maximum, count(*) AS attained, min(canonical_graph_hash) AS first_key, max(canonical_graph_hash) AS last_key
FROM latest JOIN t ON latest.graph_order = t.graph_order AND number_of_witness_cycles = maximum GROUP BY 1, 2""")
def maximizers_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """The largest number of witness cycles of each order and how many graphs attain it."""
    runs = latest_runs(spark, sf, "graph_order", "number_of_witness_cycles")
    return stats.maximizers(runs, ["graph_order"], "number_of_witness_cycles", "canonical_graph_hash")


VALID_TIMES = "median_query_time_seconds <= p95_query_time_seconds AND p95_query_time_seconds <= p99_query_time_seconds AND p99_query_time_seconds <= maximum_query_time_seconds AND median_query_time_seconds >= 0"
_close = lambda a, b: f"abs({a} - {b}) <= 1e-9 * greatest(abs({a}), abs({b}))"
RULES_SQL = {
    "cubic_edges": "2 * edge_count = 3 * graph_order",
    "pair_count": "total_ordered_edge_pairs = edge_count * (edge_count - 1)",
    "witness_count": "number_of_witness_cycles BETWEEN 1 AND number_of_constrained_sat_calls",
    "cover_ratio": _close("witness_cover_ratio", "(number_of_witness_cycles / nullif(total_ordered_edge_pairs, 0))"),
    "average_pairs": _close("average_pairs_certified_per_witness", "(total_ordered_edge_pairs / nullif(number_of_witness_cycles, 0))"),
    "maximum_pairs": "maximum_pairs_certified_by_one_witness BETWEEN 1 AND total_ordered_edge_pairs",
    "times_rise": VALID_TIMES,
    "agreements": "backtracking_agreements <= backtracking_queries",
    "hash_shape": "regexp_full_match(lower(trim(canonical_graph_hash)), '[0-9a-f]{64}')",
    "hardest_pair": "len(hardest_ordered_pair) = 2 AND len(list_filter(hardest_ordered_pair, lambda e: len(e) <> 2 OR e IS NULL)) = 0",
    "faces_sorted": "list_sort(face_size_multiset) = face_size_multiset",
    "face_count": "len(face_size_multiset) = edge_count - graph_order + 2",
    "face_sizes": "len(list_filter(face_size_multiset, lambda x: x < 4 OR x % 2 <> 0)) = 0 AND face_size_multiset IS NOT NULL",
    "face_sum": "list_sum(face_size_multiset) = 2 * edge_count",
}


@query(f"WITH {ONCE} " + " UNION ALL ".join(f"SELECT result_id, '{n}' AS rule FROM once WHERE NOT coalesce({c}, false)" for n, c in RULES_SQL.items()))
def run_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule that a run of the census breaks."""
    rules = quality.analysis_rules() | quality.face_multiset_rules("face_size_multiset", "graph_order", "edge_count")
    return quality.violations(runs_once(spark, sf), ["result_id"], rules)


@query(f"""
WITH {ONCE} SELECT graph_order, count(*) AS rows, count(DISTINCT generation_index) AS distinct_values, min(generation_index) AS lowest, max(generation_index) AS highest,
  coalesce(count(*) = count(DISTINCT generation_index) AND max(generation_index) - min(generation_index) + 1 = count(*), false) AS contiguous FROM once GROUP BY 1""")
def generation_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    return quality.contiguity(runs_once(spark, sf), ["graph_order"], "generation_index")


@query("""
WITH d AS (SELECT DISTINCT generation_index AS i FROM source_records WHERE generation_index IS NOT NULL), n AS (SELECT i, lead(i) OVER (ORDER BY i) AS j FROM d)
SELECT 'source' AS holder, i + 1 AS gap_from, j - 1 AS gap_to FROM n WHERE j > i + 1""")
def generation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of generation indexes that no source record has; neighbours are found across range partitions."""
    once = table(spark, sf, "source_records").select("generation_index").where("generation_index is not null").distinct()
    pairs = stats.adjacent_pairs(once, [], ["generation_index"], "generation_index", "after").where(F.col("after") > F.col("generation_index") + 1)
    return pairs.select(F.lit("source").alias("holder"), (F.col("generation_index") + 1).alias("gap_from"), (F.col("after") - 1).alias("gap_to"))


@query("""
WITH a AS (SELECT DISTINCT lower(trim(canonical_graph_hash)) AS h FROM all_edge_pair_results), b AS (SELECT DISTINCT lower(trim(graph_hash)) AS h FROM artifact_bundles)
SELECT h AS graph_hash, 'left' AS held_by FROM b WHERE h NOT IN (SELECT h FROM a) UNION ALL SELECT h, 'right' FROM a WHERE h NOT IN (SELECT h FROM b)""")
def bundle_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs of bundles that were never run, and runs without a bundle."""
    bundles = table(spark, sf, "artifact_bundles").select(norm_hash("graph_hash").alias("graph_hash"))
    runs = table(spark, sf, "all_edge_pair_results").select(norm_hash("canonical_graph_hash").alias("graph_hash"))
    return quality.set_difference(bundles, runs, "graph_hash")


@query("""
WITH x AS (SELECT DISTINCT lower(trim(canonical_graph_hash)) AS h FROM all_edge_pair_results)
SELECT DISTINCT lower(trim(canonical_graph_hash)) AS canonical_graph_hash, requested_vertex_count FROM source_records WHERE lower(trim(canonical_graph_hash)) NOT IN (SELECT h FROM x)""")
def graphs_to_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Source graphs that no run has done yet."""
    todo = table(spark, sf, "source_records").select(norm_hash("canonical_graph_hash").alias("canonical_graph_hash"), "requested_vertex_count").distinct()
    done = table(spark, sf, "all_edge_pair_results").select(norm_hash("canonical_graph_hash").alias("canonical_graph_hash"))
    return quality.remaining(todo, done, ["canonical_graph_hash"])


@query("""SELECT lower(trim(canonical_graph_hash)) AS graph_hash, count(*) AS copies FROM source_records GROUP BY 1 HAVING count(*) > 1""")
def duplicate_sources(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicates(table(spark, sf, "source_records"), norm_hash("canonical_graph_hash"), "graph_hash")


@query("""
WITH a AS (SELECT requested_vertex_count AS o, count(DISTINCT lower(trim(canonical_graph_hash))) AS n FROM source_records GROUP BY 1),
b AS (SELECT graph_order AS o, count(DISTINCT lower(trim(canonical_graph_hash))) AS n FROM all_edge_pair_results GROUP BY 1)
SELECT coalesce(a.o, b.o) AS graph_order, coalesce(a.n, 0) AS actual, coalesce(b.n, 0) AS expected FROM a FULL JOIN b ON a.o = b.o WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def census_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in which the numbers of source graphs and of graphs run differ."""
    actual = table(spark, sf, "source_records").groupBy(F.col("requested_vertex_count").alias("graph_order")).agg(F.countDistinct(norm_hash("canonical_graph_hash")).alias("actual"))
    expected = table(spark, sf, "all_edge_pair_results").groupBy("graph_order").agg(F.countDistinct(norm_hash("canonical_graph_hash")).alias("expected"))
    return quality.completeness(actual, expected, "graph_order")


@query("""
SELECT 'machine_dependent_timing' AS "column", count(DISTINCT coalesce(CAST(machine_dependent_timing AS VARCHAR), '#')) AS "values", count(DISTINCT coalesce(CAST(machine_dependent_timing AS VARCHAR), '#')) <= 1 AS constant FROM metric_profiles
UNION ALL SELECT 'robust_scale_method', count(DISTINCT coalesce(robust_scale_method, '#')), count(DISTINCT coalesce(robust_scale_method, '#')) <= 1 FROM metric_profiles""")
def provenance_constancy(spark: SparkSession, sf: str) -> DataFrame:
    return quality.constant_columns(table(spark, sf, "metric_profiles"), ["machine_dependent_timing", "robust_scale_method"])


@query(f"""
WITH {LAST}, p AS (SELECT canonical_graph_hash, graph_order, number_of_witness_cycles AS w, total_subtour_iterations AS i, total_subtour_constraints AS c, maximum_pairs_certified_by_one_witness AS m FROM latest),
g AS (SELECT graph_order, i, c, m, count(*) AS graphs, count(DISTINCT w) AS outcomes, min(w) AS lowest, max(w) AS highest FROM p GROUP BY ALL)
SELECT graph_order, i AS total_subtour_iterations, c AS total_subtour_constraints, m AS maximum_pairs_certified_by_one_witness, graphs, outcomes, lowest, highest FROM g WHERE outcomes > 1""")
def profile_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Metric profiles (nulls equal) shared by graphs of different witness counts: one row per class, not per pair."""
    p = ["graph_order", *METRICS[1:]]
    w = "number_of_witness_cycles"
    grouped = latest_runs(spark, sf, "graph_order", *METRICS).groupBy(*p).agg(F.count("*").alias("graphs"), F.countDistinct(w).alias("outcomes"), F.min(w).alias("lowest"), F.max(w).alias("highest"))
    return grouped.where("outcomes > 1")


@query(f"""
WITH {LAST}, r AS (SELECT canonical_graph_hash, graph_order, number_of_witness_cycles AS w, row_number() OVER (PARTITION BY graph_order, number_of_witness_cycles ORDER BY canonical_graph_hash) AS k,
  count(*) OVER (PARTITION BY graph_order, number_of_witness_cycles) AS n FROM latest WHERE number_of_witness_cycles IS NOT NULL)
SELECT canonical_graph_hash, graph_order, w AS number_of_witness_cycles, round(CAST((k - 1 - (n - 1) / 2.0) AS DOUBLE) * 0.06, 6) AS "offset" FROM r""")
def plot_jitter(spark: SparkSession, sf: str) -> DataFrame:
    """Centred offsets of graphs that fall on one plotted point."""
    runs = latest_runs(spark, sf, "graph_order", "number_of_witness_cycles").where("number_of_witness_cycles is not null")
    return ranking.jitter(runs, ["graph_order", "number_of_witness_cycles"], "canonical_graph_hash", 0.06).withColumn("offset", F.round("offset", 6))


@query(f"""
WITH {ONCE}, s AS (SELECT graph_order, result_id, row_number() OVER (PARTITION BY graph_order ORDER BY sha256('audit' || ':' || graph_order || ':' || result_id), result_id) AS k,
  count(*) OVER (PARTITION BY graph_order) AS n, min(result_id) OVER (PARTITION BY graph_order) AS a, max(result_id) OVER (PARTITION BY graph_order) AS z FROM once)
SELECT graph_order, result_id FROM s WHERE n <= 24 OR k <= 10 OR result_id = a OR result_id = z""")
def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable audit sample of every order."""
    return ranking.audit_sample(runs_once(spark, sf).select("graph_order", "result_id"), ["graph_order"], "result_id", "audit", 10, 24)


@query(f"""
WITH {LAST}, b AS (SELECT canonical_graph_hash AS h, row_number() OVER (PARTITION BY graph_order ORDER BY number_of_witness_cycles DESC, canonical_graph_hash) AS k FROM latest WHERE number_of_witness_cycles IS NOT NULL),
c AS (SELECT canonical_graph_hash AS h, row_number() OVER (PARTITION BY graph_order ORDER BY total_subtour_constraints DESC, canonical_graph_hash) AS k FROM latest WHERE total_subtour_constraints IS NOT NULL),
s AS (SELECT h, 1 AS p, k, 'witness' AS code FROM b WHERE k <= 10 UNION ALL SELECT h, 2, k, 'subtour' FROM c WHERE k <= 5)
SELECT h AS canonical_graph_hash, CAST(min(p) AS INTEGER) AS best_priority, arg_min(k, p * 1000 + k) AS best_position, string_agg(code, ',' ORDER BY p, k) AS reasons FROM s GROUP BY 1""")
def selection_with_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs among the first of two strata of their order, with every reason kept."""
    runs = materialize(latest_runs(spark, sf, "graph_order", *METRICS), "latest")
    place = lambda m, k: ranking.leaderboards(runs, "canonical_graph_hash", [m], k, ["graph_order"]).select("canonical_graph_hash", F.col("place").alias("position"))
    return ranking.stratified([("witness", 1, place("number_of_witness_cycles", 10)), ("subtour", 2, place("total_subtour_constraints", 5))], "canonical_graph_hash")


@query(f"""
WITH {ONCE}, a AS (SELECT lower(trim(canonical_graph_hash)) AS h, max(greedy_size) AS greedy_size FROM source_records GROUP BY 1)
SELECT result_id, canonical_graph_hash, greedy_size, number_of_witness_cycles, number_of_witness_cycles - greedy_size AS residual FROM once JOIN a ON h = canonical_graph_hash
WHERE number_of_witness_cycles - greedy_size > 0""")
def residuals_over_source(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that needed more witness cycles than the source's greedy size; the hash join of run and source."""
    sizes = table(spark, sf, "source_records").groupBy(norm_hash("canonical_graph_hash").alias("canonical_graph_hash")).agg(F.max("greedy_size").alias("greedy_size"))
    joined = runs_once(spark, sf).select("result_id", "canonical_graph_hash", "number_of_witness_cycles").join(sizes, "canonical_graph_hash")
    return joined.withColumn("residual", F.col("number_of_witness_cycles") - F.col("greedy_size")).where("residual > 0")


@query(f"""
WITH {ONCE} SELECT strftime(finished_at, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (property_satisfied) AS satisfied, count(*) FILTER (candidate_requires_review) AS to_review,
 count(*) FILTER (ingested_at > finished_at + INTERVAL 1 DAY) AS late FROM once GROUP BY 1""")
def daily_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status counts of each day."""
    late = F.col("ingested_at") > F.col("finished_at") + F.expr("INTERVAL 1 DAY")
    return runs_once(spark, sf).groupBy(F.date_format("finished_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("runs"), F.count_if("property_satisfied").alias("satisfied"), F.count_if("candidate_requires_review").alias("to_review"), F.count_if(late).alias("late")
    )


@query(f"""
WITH {ONCE}, t AS (SELECT census_slice, property_satisfied AS state, lead(property_satisfied) OVER (PARTITION BY census_slice ORDER BY generation_index, result_id) AS next_state FROM once)
SELECT state, next_state, count(*) AS transitions FROM t WHERE next_state IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2""")
def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """How often one verdict follows another along the generation order of a slice."""
    pairs = stats.adjacent_pairs(runs_once(spark, sf), ["census_slice"], ["generation_index", "result_id"], "property_satisfied", "next_state")
    rows = pairs.withColumnRenamed("property_satisfied", "state").where("state is not null and next_state is not null")
    return rows.groupBy("state", "next_state").agg(F.count("*").alias("transitions"))


REPORTED = ["minimum", "p10", "q1", "median", "q3", "p90", "p95", "p99", "maximum", "mean"]


@query(f"""
WITH {ONCE}, l AS (SELECT census_slice, 'median_query_time_seconds' AS metric, median_query_time_seconds AS v FROM once UNION ALL SELECT census_slice, 'p95_query_time_seconds', p95_query_time_seconds FROM once),
v AS (SELECT * FROM l WHERE v >= 0 AND NOT isnan(v) AND NOT isinf(v)),
t AS (SELECT census_slice, metric, min(v) AS minimum, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3,
  quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99, max(v) AS maximum, avg(v) AS mean FROM v GROUP BY ALL),
j AS ({' UNION ALL '.join(f"SELECT profile_id, '{c}' AS field, m.{c} AS r, t.{c} AS x FROM metric_profiles m JOIN t USING (census_slice, metric)" for c in REPORTED)})
SELECT profile_id, field, round(r, 9) AS reported, round(x, 9) AS recomputed FROM j WHERE abs(r - x) > 0.05 * abs(x)""")
def profile_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every statistic of a reported profile that is off by more than 5 % of the exact one."""
    from ..operators.merging import compare_fields

    runs = runs_once(spark, sf).select("census_slice", "median_query_time_seconds", "p95_query_time_seconds")
    long = materialize(stats.to_long(runs, ["census_slice"], ["median_query_time_seconds", "p95_query_time_seconds"]).where("value >= 0").where(stats.finite("value")), "times")
    g = ["census_slice", "metric"]
    ranks = stats.exact_percentiles(long, g, "value", {k: stats.PROFILE[k] for k in stats.PROFILE})
    plain = long.groupBy(*g).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"))
    true = stats.join_groups(ranks, plain, g)
    told = table(spark, sf, "metric_profiles").select("profile_id", *g, *REPORTED)
    keyed = told.select("profile_id", *g).join(true, g)
    off = F.abs(F.col("left") - F.col("right")) > 0.05 * F.abs(F.col("right"))
    out = compare_fields(told, keyed, ["profile_id"], REPORTED, F.coalesce(off, F.lit(False)))
    return out.select("profile_id", "field", F.round("left", 9).alias("reported"), F.round("right", 9).alias("recomputed"))


@query(f"""
WITH {LAST}, a AS (SELECT canonical_graph_hash AS h FROM latest WHERE number_of_witness_cycles IS NOT NULL ORDER BY number_of_witness_cycles, h LIMIT 1),
b AS (SELECT canonical_graph_hash AS h FROM latest WHERE total_subtour_iterations IS NOT NULL AND canonical_graph_hash NOT IN (SELECT h FROM a) ORDER BY total_subtour_iterations DESC, h LIMIT 1),
c AS (SELECT canonical_graph_hash AS h FROM latest WHERE total_subtour_constraints IS NOT NULL AND canonical_graph_hash NOT IN (SELECT h FROM a UNION SELECT h FROM b) ORDER BY total_subtour_constraints DESC, h LIMIT 1)
SELECT 'fewest witnesses' AS code, h AS canonical_graph_hash FROM a UNION ALL SELECT 'most iterations', h FROM b UNION ALL SELECT 'most constraints', h FROM c""")
def control_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Three controls, each picked among the graphs not yet taken."""
    runs = materialize(latest_runs(spark, sf, *METRICS).dropna(subset=METRICS[:3]), "latest")
    picks = [("fewest witnesses", F.col(METRICS[0])), ("most iterations", -F.col(METRICS[1])), ("most constraints", -F.col(METRICS[2]))]
    return ranking.controls(runs, "canonical_graph_hash", picks)


@query("""
WITH RECURSIVE c(k, b) AS (SELECT 0, 1::BIGINT UNION ALL SELECT k + 1, CASE WHEN k % 2 = 1 THEN 2 * b ELSE b * (k + 1) // ((k + 2) // 2) END FROM c WHERE k < 40),
o AS (SELECT graph_order, max(edge_count) AS edges, count(*) AS runs FROM all_edge_pair_results GROUP BY 1)
SELECT graph_order, edges, runs, (SELECT min(k) FROM c WHERE b >= edges) AS least_cycles FROM o""")
def antichain_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """For each order the fewest cycles whose signatures could tell all edges apart."""
    from ..operators.separation import sperner_bound

    orders = table(spark, sf, "all_edge_pair_results").groupBy("graph_order").agg(F.max("edge_count").alias("edges"), F.count("*").alias("runs"))
    import math

    sizes = F.array(*[F.lit(math.comb(k, k // 2)) for k in range(sperner_bound(10**9) + 1)])
    return orders.withColumn("least_cycles", F.size(F.filter(sizes, lambda b: b < F.col("edges"))))


@query(f"""
WITH {LAST}, s AS (SELECT lower(trim(canonical_graph_hash)) AS h, requested_vertex_count AS n FROM source_records),
d AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1), r AS (SELECT canonical_graph_hash AS h, graph_order AS n FROM latest)
SELECT h AS canonical_graph_hash, 'twice left' AS fault FROM d
UNION ALL SELECT coalesce(s.h, r.h), CASE WHEN r.h IS NULL THEN 'missing right' WHEN s.h IS NULL THEN 'missing left' ELSE 'unequal' END FROM s FULL JOIN r ON s.h = r.h WHERE r.h IS NULL OR s.h IS NULL OR s.n <> r.n""")
def source_merge_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Where sources and latest runs don't go together one to one."""
    from ..operators.merging import merge_faults

    s = table(spark, sf, "source_records").select(norm_hash("canonical_graph_hash").alias("canonical_graph_hash"), F.col("requested_vertex_count").alias("n"))
    r = latest_runs(spark, sf, "graph_order").withColumnRenamed("graph_order", "n")
    return merge_faults(s, r, ["canonical_graph_hash"], ["n"])


@query(f"""
WITH {ONCE}, a AS (SELECT lower(trim(canonical_graph_hash)) AS h, max(greedy_size) AS greedy_size FROM source_records GROUP BY 1)
SELECT result_id, canonical_graph_hash, number_of_witness_cycles - greedy_size AS gap, number_of_witness_cycles FROM once JOIN a ON h = canonical_graph_hash
WHERE number_of_witness_cycles - greedy_size IS NOT NULL ORDER BY gap DESC, number_of_witness_cycles, result_id LIMIT 25""")
def largest_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 runs whose witness cycles exceed the source's greedy size most; equal ones by fewer cycles, then by id."""
    sizes = table(spark, sf, "source_records").groupBy(norm_hash("canonical_graph_hash").alias("canonical_graph_hash")).agg(F.max("greedy_size").alias("greedy_size"))
    joined = runs_once(spark, sf).select("result_id", "canonical_graph_hash", "number_of_witness_cycles").join(sizes, "canonical_graph_hash")
    gaps = joined.select("result_id", "canonical_graph_hash", (F.col("number_of_witness_cycles") - F.col("greedy_size")).alias("gap"), "number_of_witness_cycles")
    return ranking.largest_gaps(gaps, "gap", ["number_of_witness_cycles", "result_id"], 25)


@query(f"""
WITH {LAST}, l AS (
  UNPIVOT (SELECT graph_order, canonical_graph_hash, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM latest) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
r AS (SELECT canonical_graph_hash AS h, row_number() OVER (PARTITION BY graph_order, metric ORDER BY value DESC, canonical_graph_hash) AS place FROM l),
leaders AS (SELECT DISTINCT h FROM r WHERE place <= 3),
s AS (SELECT lower(trim(canonical_graph_hash)) AS h, count(*) AS sources FROM source_records GROUP BY 1), b AS (SELECT lower(trim(graph_hash)) AS h, count(*) AS bundles FROM artifact_bundles GROUP BY 1)
SELECT h AS canonical_graph_hash, coalesce(sources, 0) AS sources, coalesce(bundles, 0) AS bundles,
  concat_ws(', ', CASE WHEN sources IS NULL THEN 'no sources' WHEN sources > 1 THEN 'several sources' END, CASE WHEN bundles IS NULL THEN 'no bundles' END) AS faults FROM leaders LEFT JOIN s USING (h) LEFT JOIN b USING (h)""")
def leader_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Leaders of any metric beside their source records and artifact bundles, and what they lack of them."""
    from ..operators.merging import evidence

    leaders = ranking.leaderboards(latest_runs(spark, sf, "graph_order", *METRICS), "canonical_graph_hash", METRICS, 3, ["graph_order"])
    h = "canonical_graph_hash"
    held = {"sources": table(spark, sf, "source_records").select(norm_hash(h).alias(h)), "bundles": table(spark, sf, "artifact_bundles").select(norm_hash("graph_hash").alias(h))}
    return evidence(leaders, held, h, ("sources",))


STRATA = [("witness", METRICS[0], 10), ("iterations", METRICS[1], 5), ("constraints", METRICS[2], 5), ("certified", METRICS[3], 5)]


@query(f"""{PROFILE_SQL},
l3 AS (UNPIVOT (SELECT canonical_graph_hash AS h, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)} FROM latest) ON {', '.join(METRICS)} INTO NAME metric VALUE value),
boards AS (SELECT h, metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, h) AS k FROM l3),
scores AS (SELECT h, round(sum(greatest(0, least(8, CASE WHEN p.robust_scale = 0 THEN 0 ELSE (l3.value - p.median) / p.robust_scale END))), 6) AS score FROM l3 JOIN p USING (metric) GROUP BY 1),
sigs AS (SELECT canonical_graph_hash AS h, list_sort(face_size_multiset) AS f FROM latest WHERE len(face_size_multiset) > 0),
alone AS (SELECT min(h) AS h FROM sigs GROUP BY f HAVING count(*) = 1),
full_rows AS (SELECT canonical_graph_hash AS h, number_of_witness_cycles AS w, total_subtour_iterations AS i, total_subtour_constraints AS c FROM latest WHERE number_of_witness_cycles IS NOT NULL AND total_subtour_iterations IS NOT NULL AND total_subtour_constraints IS NOT NULL),
c1 AS (SELECT h FROM full_rows ORDER BY w, h LIMIT 1), c2 AS (SELECT h FROM full_rows WHERE h NOT IN (SELECT h FROM c1) ORDER BY i DESC, h LIMIT 1),
c3 AS (SELECT h FROM full_rows WHERE h NOT IN (SELECT h FROM c1 UNION SELECT h FROM c2) ORDER BY c DESC, h LIMIT 1),
strata AS ({' UNION ALL '.join(f"SELECT h, {i + 1} AS p, k, '{code}' AS code FROM boards WHERE metric = '{m}' AND k <= {n}" for i, (code, m, n) in enumerate(STRATA))}
  UNION ALL SELECT h, 5, 0, 'unique faces' FROM alone
  UNION ALL SELECT h, 6, k, 'outlier' FROM (SELECT h, row_number() OVER (ORDER BY score DESC, h) AS k FROM scores) WHERE k <= 5
  UNION ALL SELECT h, 7, 1, 'fewest witnesses' FROM c1 UNION ALL SELECT h, 7, 2, 'most iterations' FROM c2 UNION ALL SELECT h, 7, 3, 'most constraints' FROM c3)
SELECT h AS canonical_graph_hash, CAST(min(p) AS INTEGER) AS best_priority, arg_min(k, p * 1000 + k) AS best_position, string_agg(code, ',' ORDER BY p, k) AS reasons FROM strata GROUP BY 1""")
def stratified_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of seven strata with every reason: leaders of four metrics, graphs alone with their faces, outliers by robust scores, and controls."""
    h = "canonical_graph_hash"
    runs = materialize(latest_runs(spark, sf, "face_size_multiset", *METRICS), "latest")
    strata = [(code, i + 1, ranking.leaderboards(runs, h, [m], n).select(h, F.col("place").alias("position"))) for i, (code, m, n) in enumerate(STRATA)]
    faces = runs.where("size(face_size_multiset) > 0").groupBy(F.array_sort("face_size_multiset").alias("f")).agg(F.min(h).alias(h), F.count("*").alias("n")).where("n = 1")
    strata.append(("unique faces", 5, faces.select(h, F.lit(0).alias("position"))))
    long = stats.to_long(runs, [h], METRICS).where(F.col("value").isNotNull())
    scores = stats.outlier_scores(stats.robust_z(long, ["metric"], "value", stats.robust_profile(long, ["metric"], "value")), [h]).withColumn("score", F.round("score", 6))
    strata.append(("outlier", 6, ranking.leaderboards(scores, h, ["score"], 5).select(h, F.col("place").alias("position"))))
    whole = runs.dropna(subset=METRICS[:3])
    picks = materialize(ranking.controls(whole, h, [("fewest witnesses", F.col(METRICS[0])), ("most iterations", -F.col(METRICS[1])), ("most constraints", -F.col(METRICS[2]))]), "controls")
    strata += [(code, 7, picks.where(F.col("code") == code).select(h, F.lit(i + 1).alias("position"))) for i, code in enumerate(("fewest witnesses", "most iterations", "most constraints"))]
    return ranking.stratified(strata, h)


@query("""
WITH b AS (SELECT lower(trim(graph_hash)) AS h, original_record AS r, copied_at FROM artifact_bundles WHERE json_valid(original_record)),
named AS (SELECT h, copied_at, lower(trim(r->>'$.canonical_graph_hash')) AS own, CAST(r->>'$.edge_count' AS INTEGER) AS m, CAST(r->>'$.requested_vertex_count' AS INTEGER) AS n,
  CAST(r->>'$.all_edge_pairs.graph_order' AS INTEGER) AS n2, CAST(r->'$.face_size_multiset' AS INTEGER[]) AS f FROM b),
rules AS (SELECT h, unnest([CASE WHEN own IS DISTINCT FROM h THEN 'another graph' END, CASE WHEN NOT coalesce(2 * m = 3 * n, false) THEN 'edges of no cubic graph' END,
  CASE WHEN NOT coalesce(n = n2, false) THEN 'analysis of another order' END, CASE WHEN NOT coalesce(list_sum(f) = 2 * m, false) THEN 'faces of other edges' END]) AS fault FROM named),
again AS (SELECT h FROM (SELECT DISTINCT h, copied_at, n, m FROM named) GROUP BY h, copied_at HAVING count(*) > 1)
SELECT h AS graph_hash, fault, count(*) AS rows FROM rules WHERE fault IS NOT NULL GROUP BY ALL UNION ALL SELECT h, 'copies of one time differ', count(*) FROM again GROUP BY 1""")
def bundle_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles whose record doesn't go with its graph or with itself, and copies of one time that differ."""
    get = lambda path: F.get_json_object("original_record", path)
    rows = table(spark, sf, "artifact_bundles").where(F.try_parse_json("original_record").isNotNull()).select(
        norm_hash("graph_hash").alias("graph_hash"), "copied_at", norm_hash(get("$.canonical_graph_hash")).alias("own"), get("$.edge_count").cast("int").alias("m"),
        get("$.requested_vertex_count").cast("int").alias("n"), get("$.all_edge_pairs.graph_order").cast("int").alias("n2"), F.from_json(get("$.face_size_multiset"), "array<int>").alias("f"),
    )
    c = F.col
    rules = {
        "another graph": c("own").eqNullSafe(c("graph_hash")), "edges of no cubic graph": 2 * c("m") == 3 * c("n"), "analysis of another order": c("n") == c("n2"),
        "faces of other edges": F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + x) == 2 * c("m"),
    }
    broken = quality.violations(rows, ["graph_hash"], rules).groupBy("graph_hash", F.col("rule").alias("fault")).agg(F.count("*").alias("rows"))
    again = rows.select("graph_hash", "copied_at", "n", "m").distinct().groupBy("graph_hash", "copied_at").agg(F.count("*").alias("k")).where("k > 1")
    return broken.unionByName(again.groupBy("graph_hash").agg(F.lit("copies of one time differ").alias("fault"), F.count("*").alias("rows")).select("graph_hash", "fault", "rows"))
