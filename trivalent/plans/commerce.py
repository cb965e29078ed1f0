"""The same operators over the order, part, event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, quality, ranking, separation, stats
from ..session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS value_count, min(o_totalprice) AS minimum, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(avg(o_totalprice), 4) AS mean,
 round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, max(o_totalprice) AS maximum FROM orders GROUP BY ALL""")
def price_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.distribution(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.select("o_orderstatus", "o_orderpriority", "value_count", "minimum", *[F.round(c, 4).alias(c) for c in ("median", "mean", "p95", "p99")], "maximum")


@query("""
SELECT p_partkey, p_brand, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS competition_rank,
 round((rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 + 0.5 * count(*) OVER (PARTITION BY p_brand, p_retailprice)) / count(*) OVER (PARTITION BY p_brand), 9) AS mid_percentile,
 CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS DOUBLE) AS average_rank FROM part""")
def part_ranks(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return stats.with_ranks(parts, ["p_brand"], "p_retailprice").withColumn("mid_percentile", F.round("mid_percentile", 9))


@query("""
WITH b AS (SELECT l_returnflag AS s, l_extendedprice AS y, l_quantity, l_discount, l_tax FROM lineitem), l AS (UNPIVOT b ON l_quantity, l_discount, l_tax INTO NAME metric VALUE x),
s2 AS (SELECT false AS pooled, s, metric, y, x FROM l UNION ALL SELECT true, 'all', metric, y, x FROM l),
k AS (SELECT *, rank() OVER (PARTITION BY pooled, s, metric ORDER BY x) + (count(*) OVER (PARTITION BY pooled, s, metric, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY pooled, s, metric ORDER BY y) + (count(*) OVER (PARTITION BY pooled, s, metric, y) - 1) / 2.0 AS ry FROM s2)
SELECT s AS l_returnflag, metric, count(*) AS n, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS pearson, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS spearman FROM k GROUP BY pooled, s, metric""")
def line_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity, discount and tax against the extended price, by return flag and pooled."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    out = stats.correlations(lines, "l_returnflag", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    flag = F.when(F.col("pooled"), "all").otherwise(F.col("l_returnflag"))
    return out.select(flag.alias("l_returnflag"), "metric", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""
WITH c AS (SELECT o_orderstatus || '/' || o_orderpriority AS pattern, count(*) AS frequency FROM orders GROUP BY 1)
SELECT pattern, frequency, round(frequency / (SELECT sum(frequency) FROM c), 9) AS prevalence, round(-log2(frequency / (SELECT sum(frequency) FROM c)), 6) AS surprisal FROM c""")
def order_surprisal(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.prevalence(table(spark, sf, "orders"), F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    return out.withColumn("prevalence", F.round("prevalence", 9)).withColumn("surprisal", F.round("surprisal", 6))


@query("""
WITH t AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events)
SELECT event_type, next_type, count(*) AS transitions FROM t WHERE next_type IS NOT NULL GROUP BY ALL""")
def event_transitions(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stats.adjacent_pairs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", "next_type")
    return pairs.groupBy("event_type", "next_type").agg(F.count("*").alias("transitions"))


@query("SELECT sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that occur more than once, by digest."""
    return quality.duplicates(table(spark, sf, "documents"), F.sha2("text", 256), "digest")


@query("""
SELECT doc_id, 'left' AS held_by FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM reading_labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM reading_labels WHERE doc_id IS NOT NULL EXCEPT SELECT doc_id FROM documents)""")
def unlabelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "reading_labels").where("doc_id is not null")
    return quality.set_difference(table(spark, sf, "documents"), labels, "doc_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_to_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return quality.remaining(table(spark, sf, "customer"), done, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("""
WITH a AS (SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS n, count(*) AS c FROM customer GROUP BY 1)
SELECT coalesce(a.n, b.n) AS nationkey, coalesce(a.c, 0) AS actual, coalesce(b.c, 0) AS expected FROM a FULL JOIN b ON a.n = b.n WHERE coalesce(a.c, 0) <> coalesce(b.c, 0)""")
def nation_completeness(spark: SparkSession, sf: str) -> DataFrame:
    actual = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("actual"))
    expected = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("expected"))
    return quality.completeness(actual, expected, "nationkey")


def part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """The part-supplier graph: one edge a line; parts have even numbers, suppliers odd ones."""
    return table(spark, sf, "lineitem").select(F.lit("lines").alias("graph"), (F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"))


@query("""
WITH d AS (SELECT l_partkey * 2 AS node, count(*) AS degree FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey * 2 + 1, count(*) FROM lineitem GROUP BY 1)
SELECT degree, count(*) AS nodes FROM d GROUP BY 1""")
def part_supplier_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(part_supplier(spark, sf)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query("SELECT least(l_partkey * 2, l_suppkey * 2 + 1) AS u, greatest(l_partkey * 2, l_suppkey * 2 + 1) AS v, count(*) AS multiplicity FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def part_supplier_parallel(spark: SparkSession, sf: str) -> DataFrame:
    return graph.parallel_edges(part_supplier(spark, sf)).select("u", "v", "multiplicity")


@query("""
SELECT least(s_nationkey, c_nationkey) AS u, greatest(s_nationkey, c_nationkey) AS v, count(*) AS multiplicity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected trade between the nations of customers and suppliers, with the number of lines."""
    t = lambda n: table(spark, sf, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.normalized(both.select(F.lit("trade").alias("graph"), F.col("s_nationkey").alias("u"), F.col("c_nationkey").alias("v"))).select("u", "v", "multiplicity")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id * 2 AS u, (epoch(ts)::BIGINT // 86400) * 2 + 1 AS v FROM events WHERE event_type = 'purchase'),
a AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(x, y) AS (SELECT u, u FROM a UNION SELECT r.x, a.v FROM r JOIN a ON r.y = a.u)
SELECT x AS node, min(y) AS component FROM r GROUP BY 1""")
def purchase_components(spark: SparkSession, sf: str) -> DataFrame:
    """Users and days linked by purchases: connected components of one large graph."""
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    return graph.components(e.select(F.lit("events").alias("graph"), (F.col("user_id") * 2).alias("u"), (day * 2 + 1).alias("v"))).select("node", "component")


@query("""
WITH r AS (SELECT n_name, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name, s_suppkey, s_acctbal AS value, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def supplier_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return ranking.leaderboards(s, "s_suppkey", ["s_acctbal"], 5, ["n_name"]).select("n_name", "s_suppkey", "value", "place")


@query("""
WITH h AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem), m AS (SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus))
SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus, q AS quantity FROM m""")
def quantity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))
    return rolled.select(F.coalesce("l_returnflag", F.lit("all")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("all")).alias("l_linestatus"), "quantity")


@query("""
WITH RECURSIVE owned AS (SELECT DISTINCT s_nationkey AS n, s_suppkey AS s, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
o AS (SELECT n, s, list(b) AS bs FROM owned GROUP BY ALL),
g(n, step, s, gain, held) AS (
  SELECT n, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM o GROUP BY n
  UNION ALL
  SELECT n, step + 1, best.s, best.gain, list_concat(held, best.fresh) FROM (
    SELECT g.n, g.step, any_value(g.held) AS held, arg_max({'s': o.s, 'gain': len(list_filter(o.bs, lambda b: NOT list_contains(g.held, b))), 'fresh': list_filter(o.bs, lambda b: NOT list_contains(g.held, b))},
      {'gain': len(list_filter(o.bs, lambda b: NOT list_contains(g.held, b))), 'first': -o.s}) AS best FROM g JOIN o ON g.n = o.n GROUP BY g.n, g.step) WHERE best.gain > 0)
SELECT n AS nationkey, CAST(step AS INTEGER) AS step, s AS s_suppkey, gain AS new_brands FROM g WHERE step > 0""")
def brand_covers(spark: SparkSession, sf: str) -> DataFrame:
    """For each nation a greedy choice of suppliers that together supply every brand its suppliers have."""
    t = lambda n: table(spark, sf, n)
    lines = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    owned = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "p_brand", "s_suppkey").distinct()
    items = owned.groupBy(F.col("s_nationkey").alias("graph"), "p_brand").agg(F.collect_set("s_suppkey").alias("support")).select("graph", F.lit(1).alias("pairs"), "support")
    return separation.greedy_cover(items).select(F.col("graph").alias("nationkey"), "step", F.col("cycle_id").alias("s_suppkey"), F.col("gain").alias("new_brands"))
