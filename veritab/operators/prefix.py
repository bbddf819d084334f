"""Running totals and ranks in one order of all rows, without a task that sees all rows.

A sample of the order column cuts it into buckets, one set of cuts for each key. Totals within a bucket are a
window of that bucket; what lies before a bucket is a window over bucket sums, of which there are at most ``buckets``
for each key. Results are exact: the cuts decide only who computes what. Both sides must cut alike, though Spark may
compute the cuts for each of them, so the sample is told by hashes and doesn't depend on the order in which rows arrive
(as that of percentile_approx does beyond some 50,000 rows).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Rows of a key from which its cuts are taken, one for each remainder of the hash.
SAMPLES = 4_096


def cut_points(frame: DataFrame, order: str, keys: list[str], ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """keys, _cuts: buckets - 1 rising values of a sample, whatever the order and partitions of the rows."""
    hashed = frame.select(*keys, F.col(order).alias("_v"), F.xxhash64(*keys, order, *ties).alias("_h"))
    sample = hashed.groupBy(*keys, F.pmod("_h", F.lit(SAMPLES)).alias("_k")).agg(F.min_by("_v", "_h").alias("_v"))
    places = F.sequence(F.lit(1), F.lit(buckets - 1))
    at = lambda i: F.get("_s", F.floor(i * F.size("_s") / buckets).cast("int"))
    return sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s")).select(*keys, F.transform(places, at).alias("_cuts"))


def bucket_of(value: Column, cuts: Column, buckets: int = BUCKETS) -> Column:
    """How many of the rising cuts are less than the value: first among every ``step``-th, then among those between two."""
    step = math.isqrt(buckets - 1) + 1
    less = lambda some: F.size(F.filter(some, lambda c: c < value))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(max(1, (buckets - 1) // step))), lambda i: F.get(cuts, i * step - 1))
    return F.element_at(F.transform(F.array(less(coarse) * step), lambda at: at + less(F.slice(cuts, at + 1, F.lit(step - 1)))), 1)


def running_totals(frame: DataFrame, order: str, sums: list[str], *keys: str, descending: bool = False, ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """Adds cum_<sum>, the total of all rows up to and with this one. ``order`` and ``ties`` must tell rows apart."""
    cuts = cut_points(frame, order, list(keys), ties, buckets)
    placed = frame.join(F.broadcast(cuts) if not keys else cuts, list(keys)) if keys else frame.crossJoin(F.broadcast(cuts))
    placed = placed.withColumn("_b", F.coalesce(bucket_of(F.col(order), F.col("_cuts"), buckets), F.lit(0))).drop("_cuts")
    per = placed.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    line = Window.partitionBy(*keys).orderBy(F.desc("_b") if descending else "_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{s}").over(line), F.lit(0)).alias(f"_o_{s}") for s in sums])
    first = F.desc(order) if descending else F.col(order)
    inner = Window.partitionBy(*keys, "_b").orderBy(first, *ties).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", *[F.sum(s).over(inner).alias(f"_w_{s}") for s in sums])
    joined = within.join(per, [*keys, "_b"])
    return joined.select(*frame.columns, *[(F.col(f"_w_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])


def value_ranks(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, value, average_rank: one row for each distinct value; ties share their mean rank."""
    counts = frame.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return running_totals(counts, value, ["_n"], *keys).select(*keys, value, (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias("average_rank"))


def quantiles(frame: DataFrame, value: str, points: dict[str, float], *keys: str) -> DataFrame:
    """keys and, for each name, the exact quantile of that share, interpolated between its two neighbours.

    Values are counted first; running totals of the counts tell between which values a quantile lies, so no task holds
    all values of a key. Nulls don't count.
    """
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    run = running_totals(counts, "_v", ["_n"], *keys)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    run = run.join(totals, list(keys)) if keys else run.crossJoin(F.broadcast(totals))
    parts = []
    for name, share in points.items():
        place = (F.col("_total") - 1) * F.lit(float(share))
        low, high = F.floor(place), F.ceil(place)
        parts += [F.min(F.when(F.col("cum__n") > low, F.col("_v"))).alias(f"_{name}_a"), F.min(F.when(F.col("cum__n") > high, F.col("_v"))).alias(f"_{name}_b"), F.max(place - low).alias(f"_{name}_f")]
    out = run.groupBy(*keys).agg(*parts)
    return out.select(*keys, *[(F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * F.col(f"_{n}_f")).alias(n) for n in points])
