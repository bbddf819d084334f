"""Row filters of the audit as expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(**allowed: list) -> Column:
    """Rows whose columns hold one of the allowed values; on partition columns this prunes folders."""
    out = F.lit(True)
    for name, values in allowed.items():
        out = out & F.col(name).isin(list(values))
    return out


def top_k_of(path: Column) -> Column:
    """The k in a file name that holds top<k> or top_<k>, else null."""
    return F.nullif(F.regexp_extract(path, r"top_?(\d+)", 1), F.lit("")).cast("int")


def valid_top_k(artifacts: DataFrame, path: str, features: DataFrame, dataset: str, count: str) -> DataFrame:
    """Artifacts whose k is below their dataset's number of features; names without a k stay (F8)."""
    joined = artifacts.join(F.broadcast(features.select(dataset, F.col(count).alias("_n"))), dataset, "left")  # one row a dataset
    k = top_k_of(F.col(path))
    return joined.filter(k.isNull() | (k < F.coalesce("_n", F.lit(2**31 - 1)))).drop("_n")


def condition_units(units: DataFrame, condition: dict, central: str, stochastic: str | None = None) -> DataFrame:
    """The central units of one condition, on request those of the stochastic subset only."""
    out = units.filter(F.col(central))
    for name, value in condition.items():
        out = out.filter(F.col(name) == value)
    return out.filter(F.col(stochastic)) if stochastic else out


def feasible(tasks: DataFrame, policy: str, value, flag: str = "feasible") -> DataFrame:
    """Tasks of a policy that are feasible."""
    return tasks.filter((F.col(policy) == value) & F.coalesce(F.col(flag), F.lit(False)))


def probability_columns(frame: DataFrame, prefix: str = "prob_") -> list[str]:
    """Columns of class probabilities; fewer than two are an error."""
    found = [c for c in frame.columns if c.startswith(prefix)]
    if len(found) < 2:
        raise ValueError(f"no two columns named {prefix}*")
    return found


def in_pairs(frame: DataFrame, scope: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are in scope."""
    return frame.join(scope.select(*on).distinct(), on, "left_semi")
