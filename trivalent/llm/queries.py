"""Queries of the training-data problems p3 to p8 and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import face_signature, norm_hash
from ..session import materialize, table
from . import leak, packing, quantiles, reading, topn, varied

#: Rank error that a percentile may have, as a share of its slice's values.
P4_EPS = 0.0002
TIMES = ("median_query_time_seconds", "p95_query_time_seconds")


def counted_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Of every graph the run that counts: witness cycles from 1, latest end, then largest id; written, as it is read twice."""
    runs = table(spark, sf, "all_edge_pair_results").where("number_of_witness_cycles >= 1")
    slim = runs.select(
        norm_hash("canonical_graph_hash").alias("canonical_graph_hash"), "graph_order", "census_slice", "number_of_witness_cycles", "finished_at", "result_id"
    )
    counted = F.max_by(F.struct("graph_order", "census_slice", "number_of_witness_cycles"), F.struct("finished_at", "result_id"))
    return materialize(slim.groupBy("canonical_graph_hash").agg(counted.alias("r")).select("canonical_graph_hash", "r.*"), "counted")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    best = topn.top_n_per_group(counted_runs(spark, sf), ["graph_order", "census_slice"], "number_of_witness_cycles", ["canonical_graph_hash"], 5)
    return best.select("graph_order", "census_slice", "place", "canonical_graph_hash")


P3_COUNTED = """
counted AS (
  SELECT h, graph_order, census_slice, number_of_witness_cycles AS c FROM (
    SELECT lower(trim(canonical_graph_hash)) AS h, graph_order, census_slice, number_of_witness_cycles,
           row_number() OVER (PARTITION BY lower(trim(canonical_graph_hash)) ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS k
    FROM all_edge_pair_results WHERE number_of_witness_cycles >= 1) WHERE k = 1)"""
P3_SQL = f"""
WITH {P3_COUNTED},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph_order, census_slice ORDER BY c DESC, h) AS INTEGER) AS place FROM counted)
SELECT graph_order, census_slice, place, h AS canonical_graph_hash FROM ranked WHERE place <= 5"""


def p3_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred graphs of the most witness cycles of each order, whatever their slice: few, large groups."""
    best = topn.top_n_per_group(counted_runs(spark, sf), ["graph_order"], "number_of_witness_cycles", ["canonical_graph_hash"], 100)
    return best.select("graph_order", "place", "canonical_graph_hash", "number_of_witness_cycles")


P3_ORDERS_SQL = f"""
WITH {P3_COUNTED},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph_order ORDER BY c DESC, h) AS INTEGER) AS place FROM counted)
SELECT graph_order, place, h AS canonical_graph_hash, c AS number_of_witness_cycles FROM ranked WHERE place <= 100"""


def timed_values(spark: SparkSession, sf: str) -> DataFrame:
    """(census_slice, metric, day, value) of each result once; impossible times left out."""
    runs = table(spark, sf, "all_edge_pair_results").select("result_id", "census_slice", "finished_at", *TIMES).dropDuplicates(["result_id"])
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in TIMES]))
    long = runs.select("census_slice", F.to_date("finished_at").alias("day"), stacked.alias("s")).select("census_slice", "day", "s.metric", "s.value")
    return long.where("value >= 0 and not isnan(value)")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    true = quantiles.grouped_percentiles(timed_values(spark, sf), ["census_slice", "metric"], "value", {"true_median": 0.5, "true_p99": 0.99}, eps=P4_EPS)
    told = table(spark, sf, "metric_profiles").select("profile_id", "metric", "census_slice", F.col("median").alias("told_median"), F.col("p99").alias("told_p99"))
    off = lambda name: F.abs(F.col(f"told_{name}") - F.col(f"true_{name}")) > 0.05 * F.abs(F.col(f"true_{name}"))
    cases = F.array(*[F.when(off(name) | F.isnan(f"told_{name}"), F.lit(name)) for name in ("median", "p99")])
    joined = told.join(true, ["metric", "census_slice"])
    return joined.select("profile_id", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("statistic"))


P4_VALUES = """
once AS (SELECT result_id, any_value(census_slice) AS census_slice, any_value(finished_at) AS finished_at,
                any_value(median_query_time_seconds) AS a, any_value(p95_query_time_seconds) AS b
         FROM all_edge_pair_results GROUP BY result_id),
times AS (
  SELECT census_slice, CAST(finished_at AS DATE) AS day, 'median_query_time_seconds' AS metric, a AS value FROM once
  UNION ALL SELECT census_slice, CAST(finished_at AS DATE), 'p95_query_time_seconds', b FROM once),
valid AS (SELECT * FROM times WHERE value >= 0 AND NOT isnan(value))"""
P4_SQL = f"""
WITH {P4_VALUES},
truth AS (SELECT census_slice, metric, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.99) AS p FROM valid GROUP BY ALL),
j AS (SELECT * FROM metric_profiles JOIN truth USING (census_slice, metric))
SELECT profile_id, 'median' AS statistic FROM j WHERE abs(median - m) > 0.05 * abs(m)
UNION ALL SELECT profile_id, 'p99' FROM j WHERE abs(p99 - p) > 0.05 * abs(p)"""


def p4_days(spark: SparkSession, sf: str) -> DataFrame:
    """Slices' percentiles out of one summary per slice, metric and day: the days are summarized on their own, then merged."""
    days = quantiles.merge_by(quantiles.build_summaries(timed_values(spark, sf), ["census_slice", "metric", "day"], "value", P4_EPS), ["census_slice", "metric", "day"], P4_EPS)
    parted = days.withColumn("part", F.datediff("day", F.lit("2020-01-01"))).drop("day")
    merged = quantiles.merge_by(parted, ["census_slice", "metric"], 2 * P4_EPS)
    out = quantiles.percentiles(merged, ["census_slice", "metric"], {"median": 0.5, "p99": 0.99})
    within = (F.col("rank_error") <= 2 * P4_EPS * F.col("n") + 0.5).alias("within_error")
    return out.select("census_slice", "metric", "n", within, F.round("median", 9).alias("median"), F.round("p99", 9).alias("p99"))


#: The values agree where a slice has at most 1/(2 P4_EPS) of them, since summaries keep those whole; beyond that they are as near as ``within_error`` says.
P4_DAYS_SQL = f"""
WITH {P4_VALUES}
SELECT census_slice, metric, count(*) AS n, true AS within_error, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.99), 9) AS p99 FROM valid GROUP BY ALL"""


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaked_pages(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """The report by item: leaked pages and the longest run of words found."""
    found = leak.leaked_pages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    by_item = found.groupBy("item_id").agg(F.count("*").alias("pages"), F.max("words").alias("longest_run"))
    return table(spark, sf, "eval_items").select("item_id", "suite").join(by_item, "item_id")


def english_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(reading.is_english("lang"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Word lists from all English pages, levels of those with 600 or more characters."""
    return reading.reading_levels(english_pages(spark, sf), table(spark, sf, "reading_labels"), F.col("n_chars") >= 600)


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus profiled: pages of each level by newspaper and year."""
    levels = p8_found(spark, sf)
    pages = english_pages(spark, sf).select("doc_id", "source", F.year("issue_date").alias("year"))
    return pages.join(levels, "doc_id").groupBy("source", "year", "reading_level").agg(F.count("*").alias("pages"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Of a subset with one graph of every face multiset: those whose multiset is theirs alone."""
    graphs = materialize(varied.face_graphs(table(spark, sf, "source_records")), "graphs")
    return varied.varied_subset(graphs, None).where("family_size = 1").select(F.col("graph").alias("canonical_graph_hash"))


P5_SQL = """
WITH graphs AS (
  SELECT lower(trim(canonical_graph_hash)) AS h, max(list_sort(face_size_multiset)) AS sig
  FROM source_records WHERE len(face_size_multiset) > 0 GROUP BY 1)
SELECT min(h) AS canonical_graph_hash FROM graphs GROUP BY sig HAVING count(*) = 1"""


def _wishes(spark: SparkSession, sf: str) -> list[varied.Wish]:
    rows = table(spark, sf, "candidate_selections").select("selection_id", "subset_size", "lowest_order", "highest_order").collect()
    return [varied.Wish(r.selection_id, r.subset_size or 0, r.lowest_order, r.highest_order) for r in rows]


def p5_selections(spark: SparkSession, sf: str) -> DataFrame:
    """The graphs of every row of candidate_selections, chosen anew."""
    graphs = materialize(varied.face_graphs(table(spark, sf, "source_records")), "graphs")
    chosen = varied.varied_subsets(graphs, _wishes(spark, sf))
    return chosen.select(
        F.col("selection").alias("selection_id"), F.col("graph").alias("canonical_graph_hash"), F.coalesce(face_signature("sig"), F.lit("")).alias("face_signature"),
        F.col("family_size").alias("face_pattern_frequency"),
    )


def p5_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Of every selection: graphs, different multisets, and the volume their features span, beside that of a choice by hash within the same tiers."""
    graphs, wishes = materialize(varied.face_graphs(table(spark, sf, "source_records")), "graphs"), _wishes(spark, sf)
    ways = [materialize(varied.varied_subsets(graphs, wishes, by_hash=b), "chosen") for b in (False, True)]
    volumes = [varied.log_volume(w.where("family_size > 0")) for w in ways]
    told = spark.createDataFrame([(w.selection, *(v.get(w.selection) for v in volumes)) for w in wishes], "selection_id long, log_volume double, log_volume_by_hash double")
    counted = [w.groupBy(F.col("selection").alias("selection_id")).agg(F.count("*").alias(f"graphs{x}"), F.countDistinct("sig").alias(f"multisets{x}")) for w, x in zip(ways, ("", "_by_hash"))]
    return told.join(counted[0], "selection_id").join(counted[1], "selection_id").select("selection_id", "graphs", "multisets", "multisets_by_hash", F.round("log_volume", 4).alias("log_volume"), F.round("log_volume_by_hash", 4).alias("log_volume_by_hash"))


def _filled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Containers of every budget and their limits."""
    sizes, budgets = materialize(packing.token_sizes(table(spark, sf, "documents")), "sizes"), table(spark, sf, "token_budgets")
    limits = materialize(packing.container_limits(sizes, budgets), "limits")
    return packing.fill_containers(sizes, budgets, limits), limits


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf)[0]


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of each budget: limits, the three loads, unused room, and the share of containers that each limit closed."""
    loads = packing.container_loads(*_filled(spark, sf))
    closed = lambda by: F.round(F.avg((F.col("closed_by") == by).cast("double")), 5).alias(f"closed_by_{by}")
    out = loads.groupBy("budget_id", "capacity_tokens", "most_segments", "most_loss").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("segments").alias("segments"), F.sum("loss_tokens").alias("loss_tokens"),
        F.max("tokens").alias("fullest"), F.max("segments").alias("most_texts"), *map(closed, ("tokens", "segments", "loss")),
    )
    return out.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 5))


def p6_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per budget its texts, those that are whole or in pieces that make them up, and containers beyond a limit."""
    filled, limits = _filled(spark, sf)
    filled = materialize(filled, "filled")
    lone = F.col("segments") == 1
    over = packing.container_loads(filled, limits).groupBy("budget_id").agg(
        F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("over_capacity"), F.count_if(F.col("segments") > F.col("most_segments")).alias("over_segments"),
        F.count_if((F.col("loss_tokens") > F.col("most_loss")) & ~lone).alias("over_loss"),
    )
    after = F.col("start_token") + F.col("tokens")
    texts = filled.groupBy("budget_id", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.min("start_token").alias("begin"), F.max(after).alias("end"), F.sum("tokens").alias("tokens"))
    capacity = F.col("capacity_tokens")
    whole = (F.col("begin") == 0) & (F.col("end") == F.col("tokens")) & (F.col("pieces") == F.col("last") + 1) | (F.col("pieces") == 1) & (F.col("begin") == 0)
    joined = texts.join(F.broadcast(limits), "budget_id")
    by_text = joined.groupBy("budget_id").agg(F.count("*").alias("texts"), F.count_if(~whole).alias("broken"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("cut_in_vain"))
    return by_text.join(over, "budget_id")


P6_AUDIT_SQL = """
SELECT budget_id, count(*) AS texts, 0 AS broken, 0 AS cut_in_vain, 0 AS over_capacity, 0 AS over_segments, 0 AS over_loss
FROM token_budgets b JOIN documents d ON length(d.text) > 0 AND (b.lang IS NULL OR regexp_matches(lower(trim(d.lang)), '^(en|eng|english)([-_ (/].*)?$')) WHERE b.lang IS NULL OR b.lang = 'en' GROUP BY 1"""


QUERIES = {"p3_found": p3_found, "p3_orders": p3_orders, "p4_found": p4_found, "p4_days": p4_days, "p5_found": p5_found, "p5_selections": p5_selections, "p5_spread": p5_spread, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_audit": p6_audit, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_sources": p8_sources}
SQL = {"p3_found": P3_SQL, "p3_orders": P3_ORDERS_SQL, "p4_found": P4_SQL, "p4_days": P4_DAYS_SQL, "p5_found": P5_SQL, "p6_audit": P6_AUDIT_SQL}
