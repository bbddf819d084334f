"""Aggregates over strata, workloads, quantiles and effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators.prefix import value_ranks


def quantile(value: Column | str, q: float | list[float]) -> Column:
    """Exact quantiles with linear interpolation."""
    return F.percentile(value, F.array(*[F.lit(x) for x in q]) if isinstance(q, list) else F.lit(q))


def stability_summary(frame: DataFrame, value: str, flag: str, *keys: str) -> DataFrame:
    """Statistics of all rows and of the changed and unchanged ones, by grouping sets."""
    x = F.col(value)
    grouped = frame.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col(flag)]], *keys, flag)
    out = grouped.agg(
        F.grouping(flag).alias("g"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), quantile(x, 0.5).alias("median"),
        (quantile(x, 0.75) - quantile(x, 0.25)).alias("iqr"), F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("n_missing"),
    )
    return out.withColumn("stratum", F.when(F.col("g") == 1, "all").when(F.col(flag), "changed").otherwise("unchanged"))


def long_strata(frame: DataFrame, strata: list[str | tuple[str, ...]]) -> DataFrame:
    """Each row once for every stratification: columns stratum_kind and stratum; 'all' comes first."""
    cells = [F.struct(F.lit("all").alias("stratum_kind"), F.lit("all").alias("stratum"))]
    for s in strata:
        names = (s,) if isinstance(s, str) else s
        cells.append(F.struct(F.lit("x".join(names)).alias("stratum_kind"), F.concat_ws("/", *[F.col(n).cast("string") for n in names]).alias("stratum")))
    return frame.select("*", F.inline(F.array(*cells)))


def table_summary(frame: DataFrame, label: str) -> DataFrame:
    """One row: rows, columns, classes."""
    return frame.agg(F.count("*").alias("n_rows"), F.lit(len(frame.columns)).alias("n_columns"), F.countDistinct(label).alias("n_classes"))


def class_distribution(frame: DataFrame, label: str, *keys: str) -> DataFrame:
    """Counts and shares of each class within the keys."""
    from pyspark.sql import Window

    counts = frame.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def numeric_summary(frame: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Mean, sd, least and largest of each column, named column_statistic."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return frame.groupBy(*keys).agg(*parts)


def common_support(frame: DataFrame, value: str, arm: str, left: str, right: str, *keys: str) -> DataFrame:
    """The interval that both arms cover, and how many rows of each lie in it."""
    of = lambda f, a: f(F.when(F.col(arm) == a, F.col(value)))
    bounds = frame.groupBy(*keys).agg(F.greatest(of(F.min, left), of(F.min, right)).alias("low"), F.least(of(F.max, left), of(F.max, right)).alias("high"))
    inside = F.col(value).between(F.col("low"), F.col("high"))
    joined = frame.join(F.broadcast(bounds) if not keys else bounds, list(keys)) if keys else frame.crossJoin(F.broadcast(bounds))
    counts = [F.count_if((F.col(arm) == a) & inside).alias(n) for a, n in ((left, "left_retained"), (right, "right_retained"))]
    return joined.groupBy(*keys, "low", "high").agg(*counts)


def spearman(frame: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Rank correlation within the keys; null where a side is constant (W3, A24). Ranks are those of distinct values."""
    ranked = frame.select(*keys, x, y)
    for c, name in ((x, "rx"), (y, "ry")):
        ranked = ranked.join(value_ranks(ranked.filter(F.col(c).isNotNull()), c, *keys).withColumnRenamed("average_rank", name), [*keys, c], "left")
    constant = (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
    return ranked.groupBy(*keys).agg(F.when(~constant, F.corr("rx", "ry")).alias("spearman"), F.count("*").alias("n"))


def latency_summary(frame: DataFrame, seconds: str, repetition: str, *keys: str) -> DataFrame:
    """Median, 95th percentile and range in milliseconds without the first repetition."""
    ms = F.col(seconds) * 1000
    return frame.filter(F.col(repetition) > 0).groupBy(*keys).agg(quantile(ms, 0.5).alias("median_ms"), quantile(ms, 0.95).alias("p95_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count("*").alias("n"))


def workload(frame: DataFrame, cost: Column, *keys: str) -> DataFrame:
    """Sums of a cost for each cell and in all, by rollup."""
    return frame.rollup(*keys).agg(F.sum(cost).alias("evaluations"), F.count("*").alias("n_units"), F.grouping_id().alias("level"))


def class_row_matrix(frame: DataFrame, component: str, label: str, classes: list) -> DataFrame:
    """Rows of each class in each component, as columns."""
    return frame.groupBy(component).pivot(label, classes).count().na.fill(0)


def residual_summary(frame: DataFrame, residual: str, tolerance: float, *keys: str) -> DataFrame:
    """Records, median, 95th percentile, maximum and number above the tolerance."""
    return frame.groupBy(*keys).agg(F.count("*").alias("records"), quantile(residual, 0.5).alias("median"), quantile(residual, 0.95).alias("p95"), F.max(residual).alias("maximum"), F.count_if(F.col(residual) > tolerance).alias("above_tolerance"))


def effect_counts(summary: DataFrame, estimate: str, low: str, *keys: str) -> DataFrame:
    """Conditions, those with a positive effect and a positive lower bound, mean effect and bounds."""
    return summary.groupBy(*keys).agg(F.count("*").alias("n_conditions"), F.count_if(F.col(low) > 0).alias("n_positive"), F.avg(estimate).alias("mean_effect"), F.min(low).alias("min_ci_low"), F.avg(low).alias("mean_ci_low"), F.avg((F.col(low) > 0).cast("double")).alias("positive_fraction"))


def convergence(frame: DataFrame, value: str, budget: str, *keys: str) -> DataFrame:
    """Mean by budget and keys, and by budget over all keys."""
    sets = [[F.col(budget), *map(F.col, keys)], [F.col(budget)]]
    return frame.groupingSets(sets, budget, *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("level"))


def non_evaluable(detail: DataFrame, identified: str, left: str, right: str, gap: str, least: float, *keys: str) -> DataFrame:
    """Why cells can't be judged: coverage, its shortfall, one- and two-sided failures, and boundary gaps."""
    share = lambda c: F.avg(c.cast("double"))
    finite_gap = F.when(F.abs(gap) != float("inf"), F.col(gap))
    one_sided = F.col(left) != F.col(right)
    return detail.groupBy(*keys).agg(share(F.col(identified)).alias("coverage"), F.greatest(least - share(F.col(identified)), F.lit(0.0)).alias("shortfall"), share(one_sided).alias("one_sided"), share(~F.col(left) & ~F.col(right)).alias("both_sided"), quantile(finite_gap, 0.5).alias("gap_median"), quantile(finite_gap, 0.05).alias("gap_p05"))
