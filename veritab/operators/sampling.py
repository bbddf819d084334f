"""Deterministic samples, caps, bins and orders by hash priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.hashing import unit
from veritab.operators.prefix import running_totals, value_ranks


def capped(frame: DataFrame, cap: int, priority: Column, *keys: str, ties: list[Column] = ()) -> DataFrame:
    """The ``cap`` rows of each key with the smallest priority: WindowGroupLimit drops most before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(priority, *ties))
    return frame.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def nested_sample(frame: DataFrame, cap: int, inner: int, salt: str, key: Column, *by: str) -> DataFrame:
    """At most ``cap`` rows of each group, of which ``inner`` are flagged in_subset."""
    chosen = capped(frame, cap, unit(f"{salt}-panel", key), *by, ties=[key])
    place = F.row_number().over(Window.partitionBy(*by).orderBy(unit(f"{salt}-subset", key), key))
    return chosen.withColumn("in_subset", place <= inner)


def stratified(frame: DataFrame, most: int, classes: int, salt: str, key: Column, label: str) -> DataFrame:
    """ceil(most / classes) rows of each class, topped up or trimmed to exactly ``most`` by one common order.

    The common order is limited, not windowed, so no task sees all rows.
    """
    quota = -(-most // classes)
    place = F.row_number().over(Window.partitionBy(label).orderBy(unit(f"{salt}-class", key), key))
    ranked = frame.withColumn("_place", place).filter(F.col("_place") <= most)
    first = (F.col("_place") > quota).cast("int")
    return ranked.orderBy(first, unit(f"{salt}-all", key), key).limit(most).drop("_place")


def stratified_split(frame: DataFrame, sizes: tuple[float, float], salt: str, key: Column, label: str) -> DataFrame:
    """train, validation or test by the hash rank within the class (G2). Ranks are running totals: a class has many tasks."""
    hashed = frame.withColumn("_u", unit(salt, key)).withColumn("_k", key).withColumn("_one", F.lit(1))
    ranked = running_totals(hashed, "_u", ["_one"], label, ties=("_k",))
    totals = frame.groupBy(label).agg(F.count("*").alias("_n"))
    share = (F.col("cum__one") - 1) / F.col("_n")
    split = F.when(share < sizes[0], "train").when(share < sizes[0] + sizes[1], "validation").otherwise("test")
    return ranked.join(totals, label).select(*frame.columns, split.alias("split"))


def quantile_bins(frame: DataFrame, value: str, bins: int, labels: list[str], *keys: str) -> DataFrame:
    """Adds bin, from the average rank's share: tied values share a bin, non-finite ones have none.

    Ranks are those of distinct values, so no task holds the rows of a key.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    kept = frame.filter(finite)
    totals = kept.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranks = value_ranks(kept, value, *keys)
    ranks = ranks.join(totals, list(keys)) if keys else ranks.crossJoin(F.broadcast(totals))
    place = F.least(F.greatest(F.ceil(F.round(F.col("average_rank") / F.col("_n") * bins, 9)), F.lit(1)), F.lit(len(labels))).cast("int")
    # a bin is a range of values, so its highest one is all that rows have to know: they aren't dealt out by value
    tops = ranks.select(*keys, value, place.alias("_place")).groupBy(*keys, "_place").agg(F.max(value).alias("_top"))
    tops = tops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_top", "_place"))).alias("_tops"))
    placed = frame.join(tops, list(keys), "left") if keys else frame.crossJoin(F.broadcast(tops))
    own = F.get(F.filter("_tops", lambda t: F.col(value) <= t["_top"]), F.lit(0))["_place"]
    found = F.when(finite & F.col("_tops").isNotNull(), F.element_at(F.array(*map(F.lit, labels)), own))
    return placed.select(*frame.columns, F.coalesce(found, F.lit("")).alias("bin"))


def temporal_split(groups: DataFrame, order: str, size: str, cuts: tuple[float, float], *keys: str) -> DataFrame:
    """Whole groups in time order, cut at shares of all rows (W11). groups: one row each, far fewer than rows."""
    total = groups.groupBy(*keys).agg(F.sum(size).alias("_total"))
    ties = tuple(c for c in groups.columns if c not in (order, size, *keys))
    run = running_totals(groups, order, [size], *keys, ties=ties)
    run = run.join(total, list(keys)) if keys else run.crossJoin(F.broadcast(total))
    share = F.col(f"cum_{size}") / F.col("_total")
    return run.withColumn("split", F.when(share <= cuts[0], "train").when(share <= cuts[1], "validation").otherwise("test")).select(*groups.columns, "split")


def tie_order(features: DataFrame, policy: str, key: list[str], value: str = "value", feature: str = "feature", salt: str = "ties") -> DataFrame:
    """Positions by falling value; within blocks of values that differ by no more than the tolerance, by policy.

    policy: stable (rising feature), reverse, or shuffle (by a hash of key and feature).
    """
    falling = Window.partitionBy(*key).orderBy(F.desc(value), feature)
    tolerance = F.greatest(F.lit(1e-12), F.max(value).over(Window.partitionBy(*key)) * 1e-8)
    gap = F.lag(value).over(falling) - F.col(value)
    block = F.sum(F.coalesce((gap > tolerance).cast("int"), F.lit(0))).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    inner = {"stable": F.col(feature), "reverse": -F.col(feature), "shuffle": unit(salt, *map(F.col, key), F.col(feature))}[policy]
    blocked = features.withColumn("block", block).withColumn("inner", inner)
    return blocked.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy("block", "inner", feature))).drop("inner")


def bin_matched_controls(features: DataFrame, key: list[str], selected: str, displacement: str, bins: int, salt: str, feature: str = "feature") -> DataFrame:
    """For each selected coordinate, one drawn from the same displacement bin (W18): flags control."""
    by = Window.partitionBy(*key)
    place = F.row_number().over(by.orderBy(displacement, feature))
    binned = features.withColumn("bin", F.floor((place - 1) * bins / F.count("*").over(by)).cast("int"))
    wanted = F.sum(F.col(selected).cast("int")).over(Window.partitionBy(*key, "bin"))
    drawn = F.row_number().over(Window.partitionBy(*key, "bin").orderBy(unit(salt, *map(F.col, key), F.col(feature)), feature))
    return binned.withColumn("control", drawn <= wanted)


def uniform_controls(features: DataFrame, key: list[str], k: int, salt: str, feature: str = "feature") -> DataFrame:
    """k coordinates of each key at random."""
    drawn = F.row_number().over(Window.partitionBy(*key).orderBy(unit(salt, *map(F.col, key), F.col(feature)), feature))
    return features.withColumn("control", drawn <= k)
