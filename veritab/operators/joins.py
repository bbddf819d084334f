"""Joins with contracts: pairings, enrichments, lineage and nearest rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.nearest import nearest_rows


def check_pairing(frame: DataFrame, variant: str, variants: list, *keys: str) -> DataFrame:
    """Keys that don't occur exactly once in each variant; a contract holds if there are none."""
    counts = [F.count_if(F.col(variant) == v).alias(f"n_{v}") for v in variants]
    bad = " or ".join(f"`n_{v}` <> 1" for v in variants)
    return frame.filter(F.col(variant).isin(variants)).groupBy(*keys).agg(*counts).filter(bad)


def paired_contrast(frame: DataFrame, variant: str, left, right, value: str, *keys: str) -> DataFrame:
    """value(left) - value(right) for each key; both sides are aggregated in one shuffle."""
    of = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    wide = frame.filter(F.col(variant).isin([left, right])).groupBy(*keys).agg(of(left).alias("left_value"), of(right).alias("right_value"), F.count("*").alias("n"))
    return wide.withColumn("difference", F.col("left_value") - F.col("right_value"))


def second_difference(frame: DataFrame, method: str, operator: str, value: str, reference_method, reference_operator, *keys: str) -> DataFrame:
    """(method - reference method) at an operator, less the same at the reference operator."""
    m, o, v = F.col(method), F.col(operator), F.col(value)
    base = frame.groupBy(*keys).agg(F.max(F.when((m == reference_method) & (o == reference_operator), v)).alias("r00"))
    by_operator = frame.groupBy(*keys, operator).agg(F.max(F.when(m == reference_method, v)).alias("r0"))
    by_method = frame.groupBy(*keys, method).agg(F.max(F.when(o == reference_operator, v)).alias("m0"))
    rest = frame.filter((m != reference_method) & (o != reference_operator))
    joined = rest.join(base, list(keys)).join(by_operator, [*keys, operator]).join(by_method, [*keys, method])
    return joined.withColumn("second_difference", (v - F.col("r0")) - (F.col("m0") - F.col("r00"))).dropna(subset=["second_difference"])


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join of sides that hold each key once; a key that one side holds twice is an error."""
    n = F.count("*").over(Window.partitionBy(*on))
    single = F.when(n == 1, True).otherwise(F.raise_error(F.lit("a key occurs more than once")))
    return left.join(right, on).withColumn("_once", single).filter("_once").drop("_once")


def aligned(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row for each key of all tables with their values in columns named after them; a key that one of them lacks, or holds twice, is an error."""
    each = None
    for name, t in tables.items():
        part = t.select(F.col(key), F.lit(name).alias("_t"), F.col(value).alias("_v"))
        each = part if each is None else each.unionByName(part)
    columns = [F.first(F.when(F.col("_t") == n, F.col("_v")), ignorenulls=True).alias(n) for n in tables]
    wide = each.groupBy(key).agg(F.count("*").alias("_n"), F.countDistinct("_t").alias("_d"), *columns)
    whole = (F.col("_n") == len(tables)) & (F.col("_d") == len(tables))
    return wide.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("tables do not hold the same keys")))).drop("_n", "_d")


def unordered_pairs(frame: DataFrame, on: list[str], member: str, carry: list[str]) -> DataFrame:
    """All pairs of members with the same key, each once: left_* and right_* columns."""
    left = frame.select(*on, *[F.col(c).alias(f"left_{c}") for c in (member, *carry)])
    right = frame.select(*on, *[F.col(c).alias(f"right_{c}") for c in (member, *carry)])
    return left.join(right, on).filter(F.col(f"left_{member}") < F.col(f"right_{member}"))


def enrich(frame: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """A left join that tells unmatched rows by matched = false."""
    return frame.join(dimension.withColumn("_found", F.lit(True)), on, "left").withColumn("matched", F.coalesce("_found", F.lit(False))).drop("_found")


def match_status(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of either side: both, left_only or right_only."""
    joined = left.select(*on).distinct().withColumn("l", F.lit(True)).join(right.select(*on).distinct().withColumn("r", F.lit(True)), on, "full_outer")
    return joined.select(*on, F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both").alias("status"))


def replace_matching_rows(frame: DataFrame, new: DataFrame, match: dict[str, object]) -> DataFrame:
    """Without the rows equal to ``match``, and with the new ones (K3). Nulls equal nulls."""
    same = F.lit(True)
    for name, value in match.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return frame.filter(~same).unionByName(new)


def nearest_donor(flows: DataFrame, donors: DataFrame, key: str, donor_key: str, x: str, d: str, block: int = 4_096) -> DataFrame:
    """The nearest row of a donor pool for each flow by squared distance of arrays x and d, the smaller donor key among equals.

    Rows without a vector are left out, and no flow is its own donor. A pool of at most ``block`` rows is compared whole
    with blocks of flows; larger ones go through the metric index. Within a block, distances from a matrix product name
    the candidates and are then taken again by differences.
    """
    nf, nd = flows.count(), donors.count()
    if nd > block:
        return nearest_rows(flows, donors, key, donor_key, x, d, block).select(key, donor_key, "distance")
    flows, donors = flows.select(F.col(key).alias("f"), F.col(x).alias("v")).dropna(), donors.select(F.col(donor_key).alias("f"), F.col(d).alias("v")).dropna()
    blocks = max(1, -(-nf // block))
    left = flows.withColumn("b", F.pmod(F.xxhash64("f"), F.lit(blocks)))
    right = donors.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    kinds = [t.schema["f"].dataType.simpleString() for t in (flows, donors)]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["f", "donor", "distance"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values("f", kind="stable")
        fk, dk = a["f"].to_numpy(), b["f"].to_numpy()
        va, vb = (np.stack(t["v"].to_numpy()).astype(float) for t in (a, b))
        sa, sb = (va * va).sum(1), (vb * vb).sum(1)
        rows = []
        for at in range(0, len(va), 512):
            part = va[at : at + 512]
            rough = sa[at : at + 512, None] + sb[None] - 2 * part @ vb.T
            rough[fk[at : at + 512, None] == dk[None]] = np.inf
            least = rough.min(1)
            slack = 1e-9 * (sa[at : at + 512] + sb.max()) + 1e-300
            for i in np.flatnonzero(np.isfinite(least)):
                near = np.flatnonzero(rough[i] <= least[i] + slack[i])
                exact = ((vb[near] - part[i]) ** 2).cumsum(1)[:, -1]
                k = int(np.argmin(exact))
                rows.append((fk[at + i], dk[near[k]], float(exact[k])))
        return pd.DataFrame(rows, columns=names)

    each = left.groupBy("b").cogroup(right.groupBy("b")).applyInPandas(run, f"f {kinds[0]}, donor {kinds[1]}, distance double")
    return each.select(F.col("f").alias(key), F.col("donor").alias(donor_key), "distance")


def set_sizes(frame: DataFrame, split: str, member: str) -> DataFrame:
    """For each pair of splits, how many members they share and how many either has."""
    cells = frame.select(split, member).distinct()
    pairs = unordered_pairs(cells, [member], split, []).groupBy(f"left_{split}", f"right_{split}").agg(F.count("*").alias("n_shared"))
    sizes = cells.groupBy(split).agg(F.count("*").alias("n"))
    left, right = sizes.toDF(f"left_{split}", "nl"), sizes.toDF(f"right_{split}", "nr")
    every = left.join(right, F.col(f"left_{split}") < F.col(f"right_{split}"))  # splits are a handful
    joined = every.join(pairs, [f"left_{split}", f"right_{split}"], "left")
    shared = F.coalesce("n_shared", F.lit(0))
    return joined.select(f"left_{split}", f"right_{split}", shared.alias("n_shared"), (F.col("nl") + F.col("nr") - shared).alias("n_union"))


def union_tagged(frames: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    """Union by name of unlike frames, each row with the name of its frame."""
    out = None
    for name, f in frames.items():
        f = f.withColumn(tag, F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
