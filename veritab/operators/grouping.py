"""Group-safe splits, connected components and feature groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.hashing import unit
from veritab.operators.graph import connected_components as connected_components
from veritab.operators.prefix import value_ranks

SPLITS = ("train", "validation", "test")


#: Groups that one task assigns.
BUCKET_GROUPS = 100_000


def balanced_split(groups: DataFrame, group: str, label: str, size: str, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15), salt: str = "balanced", buckets: int | None = None) -> DataFrame:
    """Largest groups first, each to the split that lacks most rows, every split non-empty (G1).

    groups: one row for each group and label. Groups of one size come in hash order. A class is cut into hash buckets of
    about BUCKET_GROUPS groups that are split each for itself to the same proportions, so no task holds a whole class.
    """
    if buckets is None:
        most = groups.groupBy(label).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
        buckets = max(1, -(-most // BUCKET_GROUPS))

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "u", "g"], ascending=[False, True, True])
        sizes = part["n"].to_numpy()
        lacking, taken, out = np.array(proportions) * sizes.sum(), np.zeros(3, bool), []
        for left, n in zip(range(len(sizes), 0, -1), sizes, strict=True):
            bare = np.flatnonzero(~taken)
            # the last groups go to splits that have none yet
            best = bare[np.argmax(lacking[bare])] if len(bare) >= left else int(np.argmax(lacking))
            lacking[best] -= n
            taken[best] = True
            out.append(SPLITS[best])
        return pd.DataFrame({"g": part["g"], "l": part["l"], "split": out})

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    rows = groups.select(F.col(group).alias("g"), F.col(label).alias("l"), F.col(size).cast("long").alias("n"), unit(salt, F.col(group)).alias("u"), F.pmod(F.xxhash64(group), F.lit(buckets)).alias("b"))
    made = rows.groupBy("l", "b").applyInPandas(assign, f"g {kinds[group]}, l {kinds[label]}, split string")
    return made.select(F.col("g").alias(group), F.col("l").alias(label), "split")


def split_diagnostics(rows: DataFrame, split: str, time: str, group: str, label: str) -> DataFrame:
    """Share, groups, classes and time range of each split."""
    n = rows.count()
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return rows.groupBy(split).agg((F.count("*") / F.lit(max(n, 1))).alias("share"), F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.countDistinct(label).alias("n_classes"), F.percentile(seconds, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("t"))


def split_violations(rows: DataFrame, split: str, group: str) -> DataFrame:
    """Groups that lie in more than one split: none, if the split is safe."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def feature_distance(frame: DataFrame, features: list[str]) -> DataFrame:
    """1 - |Spearman| of all feature pairs (G11). Ranks are those of distinct values, joined to the rows; one row for each pair."""
    ranked = frame.select(*features)
    for c in features:
        ranked = ranked.join(value_ranks(frame, c).withColumnRenamed("average_rank", f"{c}~"), c)
    ranked = ranked.select(*[F.col(f"{c}~").alias(c) for c in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = ranked.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left_feature"), F.lit(b).alias("right_feature"), (1 - F.abs(F.col(f"{a}~{b}"))).alias("distance")) for a, b in pairs])))


def average_linkage(distance: np.ndarray, threshold: float, most: int, depth: int = 0) -> np.ndarray:
    """Group of each feature: clusters merged by mean distance up to the threshold; too large ones at half of it."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        means = [(distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        d, i, j = min(means)
        if d > threshold:
            break
        groups[i] += groups.pop(j)
    out, label = np.zeros(len(distance), int), 0
    for g in groups:
        inner = average_linkage(distance[np.ix_(g, g)], threshold / 2, most, depth + 1) if len(g) > max(most, 1) and depth < 8 else np.zeros(len(g), int)
        out[g] = inner + label
        label += int(inner.max()) + 1
    return out


def feature_groups(distances: DataFrame, features: list[str], threshold: float = 0.3, most_share: float = 0.25) -> DataFrame:
    """feature, group (G13). distances: one row for each pair of a bounded number of features."""
    place = {f: i for i, f in enumerate(features)}
    d = np.zeros((len(features), len(features)))
    for r in distances.collect():
        i, j = place[r["left_feature"]], place[r["right_feature"]]
        d[i, j] = d[j, i] = r["distance"]
    found = average_linkage(d, threshold, max(1, int(most_share * len(features))))
    return distances.sparkSession.createDataFrame([(f, int(g)) for f, g in zip(features, found, strict=True)], "feature string, group int")
