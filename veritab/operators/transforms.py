"""Train-only preparation, masking, permutation and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.hashing import unit
from veritab.operators.prefix import quantiles, running_totals

CLIP = 1e12


def finite(frame: DataFrame, columns: list[str], clip: float = CLIP) -> DataFrame:
    """Numbers where a text is one; infinite and NaN become null, the rest is clipped."""
    out = frame
    for c in columns:
        x = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        out = out.withColumn(c, F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))
    return out


def reference_row(frame: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """One row with each column's exact median, mean or zero."""
    if strategy == "median":
        return one_row([quantiles(frame.select(c), c, {f"{c}_ref": 0.5}) for c in columns])
    f = {"mean": F.avg, "zero": lambda c: F.max(F.lit(0.0))}[strategy]
    return frame.agg(*[f(c).alias(f"{c}_ref") for c in columns])


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Frames of one row each side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def impute(frame: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """Nulls become the column's reference; drop removes such rows (F1)."""
    if strategy == "drop":
        return frame.dropna(subset=columns)
    joined = frame.crossJoin(F.broadcast(reference_row(frame, columns, strategy)))  # one row
    return joined.select(*[F.coalesce(c, f"{c}_ref", F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in frame.columns])


def clip_quantiles(frame: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Values within each column's quantiles (F2)."""
    bounds = one_row([quantiles(frame.select(c), c, {f"{c}_low": low, f"{c}_high": high}) for c in columns])
    joined = frame.crossJoin(F.broadcast(bounds))
    return joined.select(*[F.greatest(F.least(F.col(c), F.col(f"{c}_high")), F.col(f"{c}_low")).alias(c) if c in columns else F.col(c) for c in frame.columns])


def standardised(frame: DataFrame, columns: list[str], train, kind: str = "standard") -> DataFrame:
    """Scaled by statistics of the training rows only; the population deviation, and constant columns by 1."""
    parts = []
    for c in columns:
        if kind == "standard":
            parts += [F.avg(F.when(train, F.col(c))).alias(f"{c}_a"), F.stddev_pop(F.when(train, F.col(c))).alias(f"{c}_b")]
        else:
            parts += [F.min(F.when(train, F.col(c))).alias(f"{c}_a"), (F.max(F.when(train, F.col(c))) - F.min(F.when(train, F.col(c)))).alias(f"{c}_b")]
    joined = frame.crossJoin(F.broadcast(frame.agg(*parts)))
    scaled = lambda c: (F.col(c) - F.col(f"{c}_a")) / F.when(F.col(f"{c}_b") == 0, 1.0).otherwise(F.col(f"{c}_b"))
    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in frame.columns])


def varying(frame: DataFrame, columns: list[str], train, least: float = 0.0) -> DataFrame:
    """Per column, the training variance and whether it exceeds the least."""
    one = frame.agg(*[F.var_pop(F.when(train, F.col(c))).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance"), (F.col(c) > least).alias("kept")) for c in columns])))


def permuted(frame: DataFrame, column: str, key: str, salt: str) -> DataFrame:
    """The column's values dealt out anew over all rows: the n-th row by key gets the value of the n-th by hash.

    key: a number that tells rows apart. Both ranks are running totals, so no task sorts the whole table.
    """
    hashed = frame.select(F.col(key).alias("_k"), F.col(column).alias("_v"), unit(salt, F.col(key)).alias("_u"), F.lit(1).alias("_one"))
    own = running_totals(hashed.select("_k", "_one"), "_k", ["_one"]).select("_k", "cum__one")
    other = running_totals(hashed, "_u", ["_one"], ties=("_k",)).select("_v", "cum__one")
    dealt = own.join(other, "cum__one").select("_k", "_v")
    return frame.join(dealt, F.col(key) == F.col("_k")).withColumn(column, F.col("_v")).select(*frame.columns)


def noisy(frame: DataFrame, column: str, key: str, level: float, salt: str) -> DataFrame:
    """Plus normal noise of level times the column's deviation (1 where that is 0), from two hashes."""
    u = (unit(f"{salt}-u", F.col(key)) + 0.5) / 4294967296.0
    v = unit(f"{salt}-v", F.col(key)) / 4294967296.0
    sd = F.broadcast(frame.agg(F.stddev_pop(column).alias("_sd")))
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)
    return frame.crossJoin(sd).withColumn(column, F.col(column) + z * level * F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))).drop("_sd")
