"""Panels of rows that conditions agree on, and comparisons of accounts between conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions.hashing import unit
from veritab.operators.joins import unordered_pairs
from veritab.operators.sampling import capped, nested_sample


def correct_everywhere(predictions: DataFrame, flow: str, correct: str, conditions: int, *carry: str) -> DataFrame:
    """Flows that every one of the conditions predicts correctly (N1 central rule, N3, N4)."""
    grouped = predictions.groupBy(flow, *carry).agg(F.bool_and(correct).alias("all_correct"), F.count("*").alias("n_conditions"))
    return grouped.filter(F.col("all_correct") & (F.col("n_conditions") == conditions)).drop("all_correct")


def central_panel(predictions: DataFrame, flow: str, correct: str, conditions: int, label: str, cap: int = 128, inner: int = 8, salt: str = "central") -> DataFrame:
    """At most ``cap`` such flows of each class, ``inner`` of them flagged for the stochastic subset."""
    return nested_sample(correct_everywhere(predictions, flow, correct, conditions, label), cap, inner, salt, F.col(flow), label)


def outcome_panel(predictions: DataFrame, flow: str, correct: str, cap_correct: int, cap_error: int, *by: str, salt: str = "outcome") -> DataFrame:
    """Capped samples of correct and of wrong rows within each condition and class (N1 outcome rule)."""
    right = capped(predictions.filter(F.col(correct)), cap_correct, unit(f"{salt}-correct", F.col(flow)), *by, ties=[F.col(flow)])
    wrong = capped(predictions.filter(~F.col(correct)), cap_error, unit(f"{salt}-error", F.col(flow)), *by, ties=[F.col(flow)])
    return right.unionByName(wrong)


def panel_support(panel: DataFrame, label: str, flag: str) -> DataFrame:
    """Rows of each class, those flagged, and whether any and all are."""
    return panel.groupBy(label).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), F.bool_or(flag).alias("any_flagged"), F.bool_and(flag).alias("all_flagged"))


def mean_account(runs: DataFrame, account: str, *keys: str) -> DataFrame:
    """Element-wise mean over the runs of a condition (Q4-Q7): coordinates are rows, averaged before the shuffle."""
    each = runs.select(*keys, F.posexplode(account).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(account))


def condition_pairs(accounts: DataFrame, on: list[str], condition: str, account: str, architecture: str | None = None, seed: str | None = None, k: int = A.TOP_K, **tolerances) -> DataFrame:
    """Similarity of a flow's accounts under all pairs of conditions.

    With architecture and seed, kind tells whether a pair shares one of them. The join key is the flow, of which
    there is one account for each condition, so a key's pairs are bounded by the number of conditions.
    """
    carry = [account, *[c for c in (architecture, seed) if c]]
    pairs = unordered_pairs(accounts.withColumn(account, A.absolute(F.col(account))), on, condition, carry)
    made = pairs.withColumn("s", A.similarity(F.col(f"left_{account}"), F.col(f"right_{account}"), k, **tolerances))
    kind = F.lit("pair")
    if architecture and seed:
        kind = F.when(F.col(f"left_{architecture}") == F.col(f"right_{architecture}"), "same_architecture").when(F.col(f"left_{seed}") == F.col(f"right_{seed}"), "same_seed").otherwise("neither")
    return made.select(*on, f"left_{condition}", f"right_{condition}", kind.alias("kind"), "s.*")


def with_reference_run(accounts: DataFrame, on: list[str], run: str, reference, account: str, k: int = A.TOP_K) -> DataFrame:
    """Similarity of every run's account with the reference run's (D3, Q9)."""
    base = accounts.filter(F.col(run) == reference).select(*on, A.absolute(F.col(account)).alias("_y"))
    other = accounts.filter(F.col(run) != reference).select(*on, run, A.absolute(F.col(account)).alias("_x"))
    return other.join(base, on).withColumn("s", A.similarity(F.col("_x"), F.col("_y"), k)).select(*on, run, "s.*")


def violations(frame: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Counts of broken rules: each check's false rows, rows with a null key, and repeated keys."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    one = frame.agg(F.count("*").alias("rows"), F.count_if(null_key).alias("null_keys"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    repeated = frame.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_keys"))
    return one.crossJoin(repeated)


def differences(new: DataFrame, old: DataFrame, keys: list[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """Cells whose recomputed value differs from the stored one, or that only one side has."""
    a, b = new.select(*keys, F.col(value).alias("new_value")), old.select(*keys, F.col(value).alias("old_value"))
    joined = a.join(b, keys, "full_outer")
    return joined.filter(F.col("new_value").isNull() | F.col("old_value").isNull() | (F.abs(F.col("new_value") - F.col("old_value")) > tolerance))


def unlike_identity(units: DataFrame, test: DataFrame, at: list[str], identity: list[str]) -> DataFrame:
    """Units whose identity columns aren't those of the test row at their place."""
    joined = units.join(test.select(*at, F.struct(*identity).alias("_t")), at, "left")
    return joined.filter(~F.struct(*identity).eqNullSafe(F.col("_t"))).drop("_t")
