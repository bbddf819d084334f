"""Preparation of a task as one plan: checked files, finite capped rows, group-safe split, train-only scaling, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.hashing import row_fingerprint, unit
from veritab.operators import identity, policies, transforms
from veritab.operators.sampling import capped


def same_schema(frames: dict[str, DataFrame]) -> None:
    """Files of one task must have the same columns in the same order."""
    first = None
    for name, f in frames.items():
        first = first or (name, f.columns)
        if f.columns != first[1]:
            raise ValueError(f"columns of {name} are not those of {first[0]}")


def finite_capped(frame: DataFrame, features: list[str], label: str, source: str, key: str, cap: int, salt: str = "reservoir", clip: float = transforms.CLIP) -> DataFrame:
    """At most ``cap`` rows of each class by hash priority, of those whose features are all finite numbers."""
    clean = transforms.finite(frame, features, clip).dropna(subset=features)
    return capped(clean, cap, unit(salt, F.col(key)), label, ties=[F.col(key)])


def inventory(frame: DataFrame, kept: DataFrame, features: list[str], label: str, source: str) -> DataFrame:
    """By file and class: rows read, rows with a feature that is no finite number, rows kept (the audit tables of S6)."""
    broken = transforms.finite(frame, features)
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull()
    read = broken.groupBy(source, label).agg(F.count("*").alias("n_read"), F.count_if(bad).alias("n_dropped"))
    held = kept.groupBy(source, label).agg(F.count("*").alias("n_kept"))
    return read.join(held, [source, label], "left").select(source, label, "n_read", "n_dropped", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def flow_metadata(frame: DataFrame, time: Column, numbers: dict[str, Column], texts: dict[str, Column]) -> DataFrame:
    """The frame's time, numbers and texts, leniently parsed: what can't be read is null."""
    return frame.select(F.try_to_timestamp(time.cast("string")).alias("timestamp"), *[F.try_to_number(c.cast("string"), F.lit("S999999999999999")).cast("long").alias(n) for n, c in numbers.items()], *[F.trim(c.cast("string")).alias(n) for n, c in texts.items()])


def prepared(frame: DataFrame, features: list[str], label: str, key: str, classes: list, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """Rows with split and features scaled by the training rows.

    Rows are grouped by the fingerprint of their features, so equal rows lie in one split; fingerprints with two labels
    go; of equal rows the first by key stays; features without variance on the training rows are not scaled away but 0.
    """
    named = frame.withColumn("fingerprint", row_fingerprint(*[F.col(c) for c in features]))
    one = identity.keep_first(policies.without_conflicts(named, "fingerprint", label), [F.col(key)], "fingerprint").withColumn("component", F.col("fingerprint"))
    counts = policies.class_counts(one, label)
    splits = policies.repaired(policies.balanced(counts, classes, proportions), counts, classes)
    rows = one.join(splits, "component").drop("component")
    return transforms.standardised(rows, features, F.col("split") == "train")


def invariants(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """One row of broken rules, all 0 if the preparation is sound (G16): shared fingerprints, missing classes, null features."""
    shared = rows.groupBy("fingerprint").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n_shared"))
    seen = rows.groupBy("split").agg(F.countDistinct(label).alias("c")).agg((3 * len(classes) - F.coalesce(F.sum("c"), F.lit(0))).alias("n_missing_classes"))
    return shared.crossJoin(seen)
