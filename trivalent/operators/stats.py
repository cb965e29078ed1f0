"""Distributions, robust scales, ranks and correlations over long metric frames.

Long form is (group columns, metric, value). Nothing here holds a group in one task: exact percentiles
come from a bracket of bounded-memory sketches and one spillable sort of the rows inside it; ranks of
whole tables come from counts per value and offsets per range partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..session import materialize

ACCURACY = 10_000
#: Normal-consistency factors of the scale ladder.
MAD_FACTOR, IQR_FACTOR, DECILE_FACTOR = 1.4826, 1.349, 2.563
PROFILE = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def to_long(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Unpivot numeric and boolean columns to doubles (booleans 0/1); nulls are kept."""
    cols = [F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value)) for m in metrics]
    return df.select(*ids, F.explode(F.array(*cols)).alias("l__")).select(*ids, f"l__.{name}", f"l__.{value}")


def finite(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != F.lit(float("inf")))


def join_groups(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Inner join on group columns, null being a group; the right side's copies of them are dropped."""
    named = right.select(*[F.col(c).alias(f"j__{i}") for i, c in enumerate(groups)], *[c for c in right.columns if c not in groups])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"j__{i}")) for i, c in enumerate(groups)], F.lit(True))
    return left.join(named, on).drop(*[f"j__{i}" for i in range(len(groups))])


def exact_percentiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(groups, n, one column per percentile), exact, interpolated linearly at (n-1)p.

    Non-finite values and nulls don't count; a group without values gives no row; null is a group.
    A sketch brackets each percentile; only rows inside the brackets are sorted.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("x__")).where(finite("x__"))
    margin = 2.0 / ACCURACY
    bounds = [max(0.0, p - margin) for p in wanted.values()] + [min(1.0, p + margin) for p in wanted.values()]
    k = len(wanted)
    # a group of at most 2 ACCURACY rows is sorted whole; above, the margin exceeds the sketch's error by a rank or more
    sketch = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx("x__", F.array(*map(F.lit, bounds)), ACCURACY).alias("b__"))
    far = F.lit(float("inf"))

    def ranked(bounds: DataFrame, whole: Column) -> DataFrame:
        """(groups, n, p, v, missed): each percentile from the rows inside its bracket, and whether the bracket missed it."""
        lo, hi = (lambda i: F.when(whole, -far).otherwise(F.get("b__", i))), (lambda i: F.when(whole, far).otherwise(F.get("b__", i + k)))
        brackets = bounds.select(*groups, "n", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(lo(i).alias("lo"), hi(i).alias("hi"))).alias("b__"))
        joined = join_groups(rows, brackets, groups)
        pieces = []
        for i, (name, p) in enumerate(wanted.items()):
            at = (F.col("n") - 1) * F.lit(p)
            pieces.append(F.struct(F.lit(name).alias("p"), F.get("b__", F.lit(i)).alias("b"), F.floor(at).alias("low"), (at - F.floor(at)).alias("part")))
        # below each bracket only a number is needed, inside it the values with their counts
        inside = joined.withColumn("q__", F.explode(F.filter(F.array(*pieces), lambda q: F.col("x__") <= q["b"]["hi"])))
        keyed = inside.select(*groups, "n", "q__.p", "q__.low", "q__.part", F.when(F.col("x__") >= F.col("q__.b.lo"), F.col("x__")).alias("x__"))
        counts = keyed.groupBy(*groups, "n", "p", "low", "part", "x__").agg(F.count("*").alias("c"))  # null: all below
        upto = F.sum("c").over(Window.partitionBy(*groups, "p").orderBy(F.col("x__").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        run = counts.withColumn("u", upto)
        next_ = F.least(F.col("low") + 1, F.col("n") - 1)
        low, high = F.min(F.when(F.col("u") > F.col("low"), F.col("x__"))), F.min(F.when(F.col("u") > next_, F.col("x__")))
        missed = F.coalesce(F.max(F.when(F.col("x__").isNull(), F.col("c") > F.col("low"))), F.lit(False)) | (F.max("u") <= F.max(next_))
        each = run.groupBy(*groups, "n", "p").agg(low.alias("a"), high.alias("z"), F.first("part").alias("part"), missed.alias("missed"))
        return each.select(*groups, "n", "p", (F.col("a") + (F.col("z") - F.col("a")) * F.col("part")).alias("v"), "missed")

    def flat(each: DataFrame) -> DataFrame:
        return each.groupBy(*groups, "n").agg(*[F.max(F.when(F.col("p") == name, F.col("v"))).alias(name) for name in wanted], F.bool_or("missed").alias("missed__"))

    bounds_ = materialize(sketch, "brackets")
    out = materialize(flat(ranked(bounds_, F.col("n") <= 2 * ACCURACY)), "percentiles")
    missed = out.where("missed__")
    if not missed.isEmpty():  # the sketch erred: these groups are sorted whole
        again = join_groups(bounds_, missed.select(*groups), groups) if groups else bounds_
        out = out.where("not missed__").unionByName(flat(ranked(again, F.lit(True))))
    return out.drop("missed__")


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, minimum, median, mean, p95, p99, maximum of each group; exact."""
    rows = df.where(finite(value))
    plain = rows.groupBy(*groups).agg(F.min(value).alias("minimum"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))
    ranks = exact_percentiles(df, groups, value, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return join_groups(ranks, plain, groups).select(*groups, F.col("n").alias("value_count"), "minimum", "median", "mean", "p95", "p99", "maximum")


def robust_profile(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quantiles, mean, median absolute deviation and a robust scale of each group.

    The scale is the first that isn't zero of 1.4826 MAD, IQR/1.349, (p90-p10)/2.563, half the range;
    else 0. ``robust_scale_method`` names it: mad_normal, iqr_normal, decile_normal, half_range, constant.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("value")).where(finite("value"))
    # one table of counts per value serves all percentiles, and that of the distances from the median
    ranks = materialize(tie_ranks(rows, groups, "value"), "ranks")
    plain = ranks.groupBy(*groups).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), (F.sum(F.col("value") * F.col("equal")) / F.sum("equal")).alias("mean"))
    middle = materialize(join_groups(rank_percentiles(ranks, groups, "value", PROFILE), plain, groups), "middle")
    away = join_groups(ranks, middle.select(*groups, F.col("median").alias("m__")), groups).select(*groups, F.abs(F.col("value") - F.col("m__")).alias("away"), "equal")
    mad = rank_percentiles(tie_ranks(away, groups, "away", weight="equal"), groups, "away", {"mad": 0.5}).drop("n")
    flat = join_groups(middle, mad, groups).select(*groups, F.col("n").alias("value_count"), "minimum", *PROFILE, "maximum", "mean", "mad")
    rungs = [
        ("mad_normal", F.col("mad") * MAD_FACTOR), ("iqr_normal", (F.col("q3") - F.col("q1")) / IQR_FACTOR),
        ("decile_normal", (F.col("p90") - F.col("p10")) / DECILE_FACTOR), ("half_range", (F.col("maximum") - F.col("minimum")) / 2),
    ]
    scale = F.coalesce(*[F.when(c > 0, c) for _, c in rungs], F.lit(0.0))
    method = F.coalesce(*[F.when(c > 0, F.lit(n)) for n, c in rungs], F.lit("constant"))
    return flat.withColumn("robust_scale", scale).withColumn("robust_scale_method", method)


def robust_z(df: DataFrame, groups: list[str], value: str, profile: DataFrame) -> DataFrame:
    """``df`` with z = (value - median) / robust scale of its group, 0 where the scale is 0."""
    own = profile.select(*groups, F.col("median").alias("z__m"), F.col("robust_scale").alias("z__s"))
    z = F.coalesce(safe_ratio(F.col(value) - F.col("z__m"), F.col("z__s")), F.lit(0.0))
    return join_groups(df, own, groups).select(*df.columns, z.alias("z"))


def outlier_scores(zs: DataFrame, ids: list[str], clip: float = 8.0) -> DataFrame:
    """Sum over metrics of z, each clipped to [0, clip]."""
    return zs.groupBy(*ids).agg(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(clip), F.col("z")))).alias("score"))


def tie_ranks(df: DataFrame, groups: list[str], value: str, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """(groups, value, equal, less, n): how many rows of the group are equal to, and below, each value.

    From counts per value, range-partitioned; partition totals give offsets, so no sort of a whole
    group in one task. Null values aren't ranked. With ``weight`` a row stands for so many.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count("*")).alias("equal"))
    args = [*groups, value]
    spread = counts.repartitionByRange(partitions, *args) if partitions else counts.repartitionByRange(*args)
    parted = materialize(spread.withColumn("part__", F.spark_partition_id()), "ranges")
    totals = parted.groupBy(*groups, "part__").agg(F.sum("equal").alias("t__"))
    over = Window.partitionBy(*groups)
    offsets = totals.select(
        *groups, "part__", F.sum("t__").over(over).alias("n"),
        (F.sum("t__").over(over.orderBy("part__").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t__")).alias("before__"),
    )
    within = F.sum("equal").over(Window.partitionBy(*groups, "part__").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("equal")
    local = parted.withColumn("local__", within)
    return join_groups(local, offsets, [*groups, "part__"]).select(*groups, value, "equal", (F.col("before__") + F.col("local__")).alias("less"), "n")


def rank_percentiles(ranks: DataFrame, groups: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(groups, n, one column per percentile) from a frame of ``tie_ranks``, interpolated linearly at (n-1)p."""
    n = F.max("n")
    at = lambda rank: F.max(F.when(F.col("less") <= rank, F.col(value)))
    ends = {name: (F.floor((F.col("n") - 1) * F.lit(p)), (F.col("n") - 1) * F.lit(p)) for name, p in wanted.items()}
    agg = ranks.groupBy(*groups).agg(
        n.alias("n"), *[at(low).alias(f"a__{k}") for k, (low, _) in ends.items()], *[at(F.least(low + 1, F.col("n") - 1)).alias(f"z__{k}") for k, (low, _) in ends.items()]
    )
    return agg.select(*groups, "n", *[(F.col(f"a__{k}") + (F.col(f"z__{k}") - F.col(f"a__{k}")) * (p - low)).alias(k) for k, (low, p) in ends.items()])


def with_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``df`` with competition_rank (1 + number greater), mid_percentile and average_rank (rising, ties share the mean).

    Null and NaN values are left out.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranks = tie_ranks(rows, groups, value)
    named = ranks.select(*groups, value, F.col("equal").alias("k__e"), F.col("less").alias("k__l"), F.col("n").alias("k__n"))
    less, equal, n = F.col("k__l"), F.col("k__e"), F.col("k__n")
    return join_groups(rows, named, [*groups, value]).select(
        *df.columns,
        (n - less - equal + 1).alias("competition_rank"),
        ((less + 0.5 * equal) / n).alias("mid_percentile"),
        (less + (equal + 1) / 2.0).alias("average_rank"),
    )


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null for fewer than two pairs or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    r = safe_ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(a) >= 2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlations(df: DataFrame, scope: str, outcome: str, metrics: list[str]) -> DataFrame:
    """(scope, metric, n, pearson, spearman) of each metric with ``outcome``, per scope and pooled (scope null)."""
    long = to_long(df, [scope, outcome], metrics).where(F.col(outcome).isNotNull() & F.col("value").isNotNull())
    both = long.select(F.explode(F.array(F.struct(F.lit(True).alias("pooled"), F.lit(None).cast(df.schema[scope].dataType).alias(scope)), F.struct(F.lit(False).alias("pooled"), F.col(scope).alias(scope)))).alias("s"), "metric", F.col(outcome).cast("double").alias("y"), F.col("value").alias("x"))
    flat = materialize(both.select("s.pooled", f"s.{scope}", "metric", "y", "x"), "pairs")
    g = ["pooled", scope, "metric"]
    ranked = with_ranks(flat, g, "x").withColumnRenamed("average_rank", "rx").drop("competition_rank", "mid_percentile")
    ranked = with_ranks(ranked, g, "y").withColumnRenamed("average_rank", "ry")
    return ranked.groupBy(*g).agg(F.count("*").alias("n"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))


def summary_by_kind(df: DataFrame, groups: list[str], kind: str, sums: dict[str, Column]) -> DataFrame:
    """One row a group with ``<kind>_<name>`` for every aggregate and every kind that occurs in ``df``; kinds are few, as they are columns."""
    kinds = sorted(r[0] for r in df.select(kind).where(F.col(kind).isNotNull()).distinct().collect())
    return df.groupBy(*groups).pivot(kind, kinds).agg(*[c.alias(name) for name, c in sums.items()])


def prevalence(df: DataFrame, pattern: Column, name: str = "pattern") -> DataFrame:
    """(pattern, frequency, prevalence, surprisal in bits) of each pattern; a null pattern isn't counted."""
    counts = df.select(pattern.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("frequency"))
    total = counts.agg(F.sum("frequency").alias("total"))
    share = F.col("frequency") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).select(name, "frequency", share.alias("prevalence"), (-F.log2(share)).alias("surprisal"))  # total: one row


def maximizers(df: DataFrame, groups: list[str], value: str, key: str) -> DataFrame:
    """Per group the largest value, how many rows attain it, and the first and last key among them."""
    top = df.groupBy(*groups).agg(F.max(value).alias("maximum"), F.max(F.struct(value, key))[key].alias("last_key"))
    keyed = top.withColumnRenamed("maximum", "t__m")
    return join_groups(df, keyed, groups).where(F.col(value) == F.col("t__m")).groupBy(*groups, F.col("t__m").alias("maximum"), "last_key").agg(F.count("*").alias("attained"), F.min(key).alias("first_key"))


def adjacent_pairs(df: DataFrame, groups: list[str], order: list[str], value: str, after: str = "next_value") -> DataFrame:
    """(groups, value, after): each row's value with that of the row that follows it in its group.

    Rows are range-partitioned by group and order; within a part the next row is at hand, and the last
    row of a part is matched with the first one of the group's next part. So a group of any size is spread over many tasks.
    The last row of a group has no pair. ``order`` should be total; null groups and null order values are kept, nulls first.
    """
    keys = [*groups, *order]
    rows = df.select(*dict.fromkeys([*keys, value]))
    parted = materialize(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("part__", F.spark_partition_id()), "ordered")
    by = [F.col(c).asc_nulls_first() for c in order]
    inner = Window.partitionBy(*groups, "part__").orderBy(*by)
    marked = parted.withColumn("n__", F.lead(F.struct(F.col(value).alias("v"))).over(inner))
    pairs = marked.where("n__ is not null").select(*groups, value, F.col("n__.v").alias(after))
    place = F.struct(*order)
    edges = parted.groupBy(*groups, "part__").agg(F.min_by(F.struct(F.col(value).alias("v")), place).alias("first__"), F.max_by(F.struct(F.col(value).alias("v")), place).alias("last__"))
    across = edges.withColumn("n__", F.lead("first__").over(Window.partitionBy(*groups).orderBy("part__"))).where("n__ is not null")  # a row a part
    return pairs.unionByName(across.select(*groups, F.col("last__.v").alias(value), F.col("n__.v").alias(after)))
