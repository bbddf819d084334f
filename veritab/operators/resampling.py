"""Crossed source by seed resampling and run-pair statistics."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.replicates import generator, hashed_sums, multinomial_sums, vectors
from veritab.operators.staging import released, staged


def interval(draws: np.ndarray, confidence: float) -> tuple[float, float]:
    if not len(draws):
        return float("nan"), float("nan")
    low, high = np.quantile(draws, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(low), float(high)


def _by_cell(sums: DataFrame, keys: tuple[str, ...], run, columns: str) -> DataFrame:
    """run(rows of one cell, one for each column, in order) gives the columns of that cell's row."""
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("column", kind="stable")
        return pd.DataFrame([[*[rows[k].iloc[0] for k in keys], *run(rows)]], columns=[*keys, *[c.split()[0] for c in columns.split(", ")]])

    return sums.groupBy(*keys).applyInPandas(one, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], columns]))


def _means(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By replicate, column and component: means (NaN where no source was drawn), and which were; means of the whole data."""
    parts = [vectors(s, w) for s, w in zip(rows["sums"], rows["weights"], strict=True)]
    sums, weights = np.stack([s for s, _ in parts], 1), np.stack([w for _, w in parts], 1)
    means = np.divide(sums, weights[..., None], out=np.full_like(sums, np.nan), where=weights[..., None] > 0)
    return means[:-1], weights[:-1] > 0, means[-1]


def seed_cells(frame: DataFrame, value: str, *keys: str, seed_column: str = "seed", flow_column: str = "flow") -> DataFrame:
    """A row for each source and seed of a cell: the mean of its values, NaN and null left out."""
    cells = frame.groupBy(*keys, F.col(flow_column).alias("source"), F.col(seed_column).alias("column")).agg(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).alias("v"))
    return cells.filter("v is not null").select(*keys, "source", "column", F.array("v").alias("x"), F.lit(1.0).alias("n"))


def _enough(cells: DataFrame, keys: tuple[str, ...], resamples: int, seed: int, usable, most: int = 64) -> DataFrame:
    """Replicate sums with as many replicates as leave ``resamples`` usable ones in each cell. usable(rows) counts them."""
    wanted = resamples
    while True:
        sums = staged(multinomial_sums(cells, *keys, replicates=wanted, seed=seed), "replicates")
        least = _by_cell(sums, keys, lambda rows: [usable(rows)], "usable long").agg(F.min("usable")).first()[0]
        if least is None or least >= resamples or wanted >= most * resamples:
            return sums
        released(sums)
        wanted = min(most * resamples, int(wanted * max(2, 1.2 * resamples / max(least, 1))))


def crossed_bootstrap(frame: DataFrame, value: str, *keys: str, seed_column: str = "seed", flow_column: str = "flow", resamples: int = 5_000, confidence: float = 0.95, seed: int = 42, empty: str = "reject") -> DataFrame:
    """Equal-seed mean and percentile interval of each cell (U1, U2, U4); one draw of sources per replicate is shared by
    all seeds, then seeds are drawn anew.

    empty: what a replicate without sources in some seed does: reject (drawn again) or skip (left out of its mean).
    """
    if empty not in ("reject", "skip"):
        raise ValueError(f"empty must be reject or skip, not {empty!r}")
    cells = seed_cells(frame, value, *keys, seed_column=seed_column, flow_column=flow_column)

    def usable(rows: pd.DataFrame) -> int:
        seen = _means(rows)[1]
        return int((seen.all(1) if empty == "reject" else seen.any(1)).sum())

    def run(rows: pd.DataFrame) -> list:
        means, seen, whole = _means(rows)
        ok = np.flatnonzero(seen.all(1) if empty == "reject" else seen.any(1))
        per = means[ok, :, 0]
        picks = generator(seed, "seeds", *[rows[k].iloc[0] for k in keys]).integers(0, per.shape[1], per.shape)
        drawn = np.take_along_axis(per, picks, 1)
        filled = np.isfinite(drawn).any(1)
        draws = np.nanmean(drawn[filled], axis=1)[:resamples]
        return [float(whole[:, 0].mean()), *interval(draws, confidence), len(rows)]

    made = _by_cell(_enough(cells, keys, resamples, seed, usable), keys, run, "estimate double, ci_low double, ci_high double, n_seeds long")
    sources = cells.groupBy(*keys).agg(F.countDistinct("source").alias("n_sources"))
    if not keys:
        return made.crossJoin(F.broadcast(sources)).select("estimate", "ci_low", "ci_high", "n_sources", "n_seeds")  # one row each
    matched = [made[k].eqNullSafe(sources[k]) for k in keys]
    return made.join(sources, matched).select(*[made[k] for k in keys], "estimate", "ci_low", "ci_high", "n_sources", "n_seeds")


def _hashed_means(frame: DataFrame, value: str, keys: tuple[str, ...], seed_column: str, flow_column: str, replicates: int, salt: str) -> DataFrame:
    return hashed_sums(seed_cells(frame, value, *keys, seed_column=seed_column, flow_column=flow_column), *keys, replicates=replicates, salt=salt)


def hash_bootstrap(frame: DataFrame, value: str, *keys: str, seed_column: str = "seed", flow_column: str = "flow", replicates: int = 200, salt: str = "boot") -> DataFrame:
    """Equal-seed mean of each replicate, in SQL (another law than U1): a source's weight is a hash-drawn 0, 1, 2 or 3,
    shared by seeds. Rows (keys, replicate, estimate)."""
    sums = _hashed_means(frame, value, keys, seed_column, flow_column, replicates, salt)

    def run(rows: pd.DataFrame) -> list:
        means, seen, _ = _means(rows)
        return [[float(np.nanmean(m)) if s.any() else None for m, s in zip(means[..., 0], seen, strict=True)]]

    made = _by_cell(sums, keys, run, "estimates array<double>")
    return made.select(*keys, F.posexplode("estimates").alias("replicate", "estimate"))


def hash_interval(frame: DataFrame, value: str, *keys: str, confidence: float = 0.95, seed_column: str = "seed", flow_column: str = "flow", replicates: int = 200, salt: str = "boot") -> DataFrame:
    sums = _hashed_means(frame, value, keys, seed_column, flow_column, replicates, salt)

    def run(rows: pd.DataFrame) -> list:
        means, seen, _ = _means(rows)
        draws = np.nanmean(means[seen.any(1), :, 0], axis=1)
        return [*interval(draws, confidence), len(draws)]

    return _by_cell(sums, keys, run, "ci_low double, ci_high double, n_replicates long")


def cluster_bootstrap(frame: DataFrame, value: str, cluster: str, *keys: str, resamples: int = 2_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean and interval resampling whole clusters (U3; of a paired difference, U6). Clusters are summed before they meet."""
    sums = frame.groupBy(*keys, F.col(cluster).alias("source")).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("n")).filter("n > 0")
    # how often clusters were drawn is a second component
    cells = sums.select(*keys, "source", F.lit(0).alias("column"), F.array("s", F.lit(1.0)).alias("x"), "n")

    def run(rows: pd.DataFrame) -> list:
        means, seen, whole = _means(rows)
        totals, n = vectors(rows["sums"].iloc[0], rows["weights"].iloc[0])
        return [float(whole[0, 0]), *interval(means[seen[:, 0], 0, 0], confidence), round(totals[-1, 1])]

    return _by_cell(multinomial_sums(cells, *keys, replicates=resamples, seed=seed), keys, run, "estimate double, ci_low double, ci_high double, n_clusters long")


def run_projections(pairs: DataFrame, value: str, *keys: str, seed_column: str = "seed", flow_column: str = "flow", left: str = "left_run", right: str = "right_run") -> DataFrame:
    """A row for each source and seed of a cell: x, the mean over each run's pairs, runs in order.

    Fails where a source lacks a pair of its runs, where sources of one seed differ in their runs or seeds in their
    number, and where there are fewer than three runs.
    """
    known = pairs.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    names = [*keys, F.col(flow_column).alias("source"), F.col(seed_column).alias("column")]
    runs = known.select(*names, F.col(value).cast("double").alias("v"), F.explode(F.array(left, right)).alias("run"))
    each = runs.groupBy(*keys, "source", "column", "run").agg(F.avg("v").alias("p"), F.count("*").alias("n"))
    cells = each.groupBy(*keys, "source", "column").agg(F.array_sort(F.collect_list(F.struct("run", "p"))).alias("r"), F.sum("n").alias("ends"))
    size = F.size("r")
    whole = (F.col("ends") == size * (size - 1)) & (size >= 3)
    checked = F.when(whole, F.transform("r", lambda x: x["p"])).otherwise(F.raise_error(F.lit("a source lacks pairs of its runs, or has fewer than three runs")).cast("array<double>"))
    runs_of = F.transform("r", lambda x: x["run"].cast("string"))
    same = cells.groupBy(*keys, "column").agg(F.min(runs_of).alias("a"), F.max(runs_of).alias("b")).groupBy(*keys).agg(F.bool_and(F.col("a") == F.col("b")).alias("one"), F.min(F.size("a")).alias("least"), F.max(F.size("a")).alias("most"))
    bad = same.filter(~F.col("one") | (F.col("least") != F.col("most")))
    if not bad.isEmpty():
        raise ValueError("sources of one seed differ in their runs, or seeds in the number of theirs")
    return cells.select(*keys, "source", "column", checked.alias("x"), F.lit(1.0).alias("n"))


def pseudovalues(projection: np.ndarray) -> np.ndarray:
    """Jackknife pseudovalues of an order-2 U-statistic, by run (last axis): their mean is the statistic."""
    n = projection.shape[-1]
    return (2 * (n - 1) * projection - n * projection.mean(-1, keepdims=True)) / (n - 2)


def run_pair_bootstrap(pairs: DataFrame, value: str, *keys: str, resamples: int = 5_000, confidence: float = 0.95, seed: int = 42, **names) -> DataFrame:
    """Equal-seed U-statistic over run pairs and its interval (U5, A20): each replicate draws seeds, sources (shared by
    seeds), and for each drawn seed as many runs, shared by all sources, as it has."""
    cells = staged(run_projections(pairs, value, *keys, **names), "projections")

    def drawn(rows: pd.DataFrame) -> np.ndarray:
        means, seen, _ = _means(rows)
        rng = generator(seed, "seeds", *[rows[k].iloc[0] for k in keys])
        values, draws, at = pseudovalues(means), [], 0
        n_seeds, n_runs = means.shape[1:]
        picks, runs = rng.integers(0, n_seeds, (resamples, n_seeds)), rng.integers(0, n_runs, (resamples, n_seeds, n_runs))
        for pick, run in zip(picks, runs, strict=True):
            while at < len(means) and not seen[at, pick].all():  # sources are drawn again for these seeds
                at += 1
            if at == len(means):
                break
            draws.append(np.take_along_axis(values[at, pick], run, 1).mean())
            at += 1
        return np.array(draws)

    def run(rows: pd.DataFrame) -> list:
        whole, draws = _means(rows)[2], drawn(rows)
        tail = 2 * min((draws <= 0).mean(), (draws >= 0).mean())
        return [float(whole.mean()), *interval(draws, confidence), float(draws.std(ddof=1)) if len(draws) > 1 else 0.0, float(min(1.0, tail)), len(rows), whole.shape[1], len(draws)]

    sums = _enough(cells, keys, resamples, seed, lambda rows: len(drawn(rows)))
    return _by_cell(sums, keys, run, "estimate double, ci_low double, ci_high double, bootstrap_sd double, p_two_sided double, n_seeds long, n_runs long, n_replicates long")


def run_pair_hash_interval(pairs: DataFrame, value: str, *keys: str, confidence: float = 0.95, replicates: int = 1_000, salt: str = "boot", **names) -> DataFrame:
    """The interval under a law that SQL can repeat: hashed weights of sources, hashed draws of runs in every seed."""
    sums = hashed_sums(run_projections(pairs, value, *keys, **names), *keys, replicates=replicates, salt=salt)

    def run(rows: pd.DataFrame) -> list:
        means, seen, whole = _means(rows)
        n = means.shape[2]
        draw = lambda r, s, j: int.from_bytes(hashlib.md5(f"{salt} run|{r}|{s}|{j}".encode()).digest()[:4], "big") * n >> 32
        picks = np.array([[[draw(r, s, j) for j in range(n)] for s in rows["column"]] for r in range(len(means))])
        per = np.take_along_axis(pseudovalues(means), picks, 2).mean(2)
        draws = np.nanmean(per[seen.any(1)], axis=1)
        return [float(whole.mean()), *interval(draws, confidence), len(rows), n, len(draws)]

    return _by_cell(sums, keys, run, "estimate double, ci_low double, ci_high double, n_seeds long, n_runs long, n_replicates long")


def run_pair_statistic(pairs: DataFrame, value: str, *keys: str, left: str = "left_run", right: str = "right_run") -> DataFrame:
    """Order-2 U-statistic over run pairs, with the jackknife error from each run's leave-one-out projection."""
    runs = pairs.select(*keys, value, F.explode(F.array(left, right)).alias("run"))
    whole = pairs.groupBy(*keys).agg(F.avg(value).alias("u"), F.count(value).alias("n_pairs"))
    projected = runs.groupBy(*keys, "run").agg(F.avg(value).alias("p"))
    joined = projected.join(whole, list(keys))
    n = F.count("*").over(Window.partitionBy(*keys))
    pseudo = (2 * (n - 1) * F.col("p") - n * F.col("u")) / F.nullif(n - 2, F.lit(0))
    return joined.withColumn("v", pseudo).groupBy(*keys).agg(F.first("u").alias("estimate"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("jackknife_se"), F.count("*").alias("n_runs"), F.first("n_pairs").alias("n_pairs"))
