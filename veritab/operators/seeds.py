"""Aggregates with equal weight for each fitted seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flow_means(frame: DataFrame, value: str, *keys: str, seed: str = "seed", flow: str = "flow") -> DataFrame:
    return frame.groupBy(*keys, seed, flow).agg(F.avg(value).alias("value"))


def seed_means(frame: DataFrame, value: str, *keys: str, seed: str = "seed", flow: str = "flow") -> DataFrame:
    """Mean of each flow, then of each seed (A1)."""
    return flow_means(frame, value, *keys, seed=seed, flow=flow).groupBy(*keys, seed).agg(F.avg("value").alias("estimate"), F.count("*").alias("n_flows"))


def equal_seed_mean(frame: DataFrame, value: str, *keys: str, seed: str = "seed", flow: str = "flow") -> DataFrame:
    """The unweighted mean of the seeds' means (A2)."""
    return seed_means(frame, value, *keys, seed=seed, flow=flow).groupBy(*keys).agg(F.avg("estimate").alias("estimate"), F.count("*").alias("n_seeds"))


def leave_one_seed_out(frame: DataFrame, value: str, *keys: str, seed: str = "seed", flow: str = "flow") -> DataFrame:
    """Each seed's mean, and the mean of the other seeds' means (A3, A5)."""
    per = seed_means(frame, value, *keys, seed=seed, flow=flow)
    all_seeds = Window.partitionBy(*keys)
    rest = F.try_divide(F.sum("estimate").over(all_seeds) - F.col("estimate"), F.count("*").over(all_seeds) - 1)
    return per.withColumn("without_seed", rest)


def support(*, seed: str = "seed", flow: str = "flow") -> list[Column]:
    """Aggregates of how much data a cell rests on (A4)."""
    return [F.countDistinct(flow).alias("n_sources"), F.countDistinct(seed, flow).alias("n_seed_flow_cells"), F.countDistinct(seed).alias("n_seeds"), F.count("*").alias("n_rows")]


def coverage(frame: DataFrame, flag: str, *keys: str, seed: str = "seed", threshold: float = 0.95, seeds: int = 5) -> DataFrame:
    """Identifiable share overall and its minimum over seeds; sufficient if all seeds are there and reach the threshold."""
    per = frame.groupBy(*keys, seed).agg(F.avg(F.col(flag).cast("double")).alias("share"), F.sum(F.col(flag).cast("double")).alias("hits"), F.count("*").alias("n"))
    out = per.groupBy(*keys).agg((F.sum("hits") / F.sum("n")).alias("coverage_fraction"), F.min("share").alias("minimum_seed_fraction"), F.count("*").alias("n_seeds"))
    return out.withColumn("coverage_sufficient", F.col("n_seeds") == seeds).withColumn("identification_coverage_sufficient", (F.col("n_seeds") == seeds) & (F.col("minimum_seed_fraction") >= threshold))


def mean_and_coverage(frame: DataFrame, value: str, flag: str, *keys: str, seed: str = "seed", flow: str = "flow", threshold: float = 0.95, seeds: int = 5) -> DataFrame:
    """equal_seed_mean and coverage of the same rows from one chain of aggregates."""
    each = frame.groupBy(*keys, seed, flow).agg(F.avg(value).alias("v"), F.sum(F.col(flag).cast("double")).alias("hits"), F.count("*").alias("n"))
    per = each.groupBy(*keys, seed).agg(F.avg("v").alias("v"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    out = per.groupBy(*keys).agg(F.avg("v").alias("estimate"), (F.sum("hits") / F.sum("n")).alias("coverage_fraction"), F.min(F.col("hits") / F.col("n")).alias("minimum_seed_fraction"), F.count("*").alias("n_seeds"))
    return out.withColumn("coverage_sufficient", F.col("n_seeds") == seeds).withColumn("identification_coverage_sufficient", (F.col("n_seeds") == seeds) & (F.col("minimum_seed_fraction") >= threshold))


def mean_and_sd(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and sample standard deviation over seeds."""
    return frame.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_seeds"))
