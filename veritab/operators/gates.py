"""Gates: verdicts of summary rows against bounds, and inventories of expected cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published bounds; metric, side of the interval, bound.
REPEATABILITY = (("spearman", "lower", 0.90), ("jaccard_10", "lower", 0.80))
EQUIVALENCE = (("spearman", "lower", 0.80), ("weighted_jaccard", "lower", 0.70), ("jaccard_10", "lower", 0.60), ("normalized_mass_l1", "upper", 0.20))
PARAMETER_CHANGE = (("normalized_mass_l1", "lower", 0.20),)


def gate_value(gates, metric: Column, what: int) -> Column:
    out = F.lit(None).cast("string" if what == 1 else "double")
    for row in gates:
        out = F.when(metric == row[0], F.lit(row[what])).otherwise(out)
    return out


def apply_gates(summary: DataFrame, gates=EQUIVALENCE, metric: str = "metric", low: str = "ci_low", high: str = "ci_high", seeds_covered: str = "coverage_sufficient", accounts_covered: str = "identification_coverage_sufficient") -> DataFrame:
    """Adds gate_bound, gate_direction, gate_status and gate_pass. Uncovered cells are not evaluable, not failed."""
    side, bound = gate_value(gates, F.col(metric), 1), gate_value(gates, F.col(metric), 2)
    value = F.when(side == "lower", F.col(low)).otherwise(F.col(high))
    met = F.when(side == "lower", F.col(low) >= bound).otherwise(F.col(high) <= bound)
    status = (
        F.when(side.isNull(), "not_predeclared")
        .when(~F.col(seeds_covered), "not_evaluable_seed_coverage")
        .when(~F.col(accounts_covered) | value.isNull() | F.isnan(value), "not_evaluable_account_coverage")
        .when(met, "pass")
        .otherwise("fail")
    )
    return summary.withColumn("gate_bound", bound).withColumn("gate_direction", F.coalesce(side, F.lit("not_predeclared"))).withColumn("gate_status", status).withColumn("gate_pass", status == "pass")


def regate(summary: DataFrame, fraction: str, threshold: float, gates=EQUIVALENCE, **names) -> DataFrame:
    """Decides evaluability again at another coverage threshold, without new resampling (V8)."""
    return apply_gates(summary.withColumn("identification_coverage_sufficient", F.col(fraction) >= threshold), gates, **names)


def gate_counts(summary: DataFrame, *keys: str) -> DataFrame:
    """Numbers of passed, failed and not evaluable cells."""
    status = F.col("gate_status")
    counts = [F.count_if(status == s).alias(n) for n, s in (("n_pass", "pass"), ("n_fail", "fail"), ("n_no_seeds", "not_evaluable_seed_coverage"), ("n_no_accounts", "not_evaluable_account_coverage"), ("n_undeclared", "not_predeclared"))]
    return summary.groupBy(*keys).agg(*counts, F.count("*").alias("n_cells"))


def any_pass(summary: DataFrame, *keys: str) -> DataFrame:
    """Adds established: whether any cell of the keys passes (V4)."""
    from pyspark.sql import Window

    return summary.withColumn("established", F.max(F.col("gate_pass").cast("int")).over(Window.partitionBy(*keys)) == 1)


def all_pass(summary: DataFrame, expected: int, *keys: str) -> DataFrame:
    """Per keys: whether all expected cells are there and pass (V6, V7)."""
    return summary.groupBy(*keys).agg(((F.count("*") == expected) & F.bool_and("gate_pass")).alias("all_pass"), F.count("*").alias("n_cells"))


def flips(baseline: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose verdict changes between two settings."""
    a = baseline.select(*keys, F.col("gate_status").alias("baseline_status"))
    b = variant.select(*keys, F.col("gate_status").alias("variant_status"))
    return a.join(b, keys).filter("baseline_status <> variant_status")


def expected_cells(*dimensions: DataFrame) -> DataFrame:
    """Every combination of small dimension frames."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def inventory(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per expected or observed cell: status complete, missing, unexpected or duplicate."""
    counted = observed.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    joined = expected.select(*keys, F.lit(True).alias("wanted")).join(counted, keys, "full_outer")
    status = F.when(F.col("n_rows").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n_rows") > 1, "duplicate").otherwise("complete")
    return joined.select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))
