"""Nearest rows through the metric index, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import joins, nearest


def frame(spark, keys, vectors, names=("k", "x")):
    kind = "string" if isinstance(keys[0], str) else "long"
    return spark.createDataFrame([(k, None if v is None else [float(y) for y in v]) for k, v in zip(keys, vectors, strict=True)], f"{names[0]} {kind}, {names[1]} array<double>")


def brute(flows, donors):
    """flows, donors: (key, vector) pairs -> sorted (key, donor, distance)."""
    made = []
    for k, v in flows:
        near = [(float(((np.asarray(w, float) - v) ** 2).cumsum()[-1]), j) for j, w in donors if w is not None and j != k] if v is not None else []
        if near:
            made.append((k, min(near)[1], min(near)[0]))
    return sorted(made)


def got(found):
    return sorted((r["k"], r["donor"], r["distance"]) for r in found.collect())


def clustered(n, clusters, width, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)] * 10 + rng.normal(size=(n, width)) * 0.1


@pytest.mark.parametrize("block,pivots", [(4_096, None), (50, 20), (7, 3), (100, 1)])
def test_equals_all_pairs(spark, block, pivots):
    x = np.round(clustered(400, 12, 3), 2)  # rounded, so that there are ties
    f, d = frame(spark, range(400), x), frame(spark, range(400), x, ("donor", "d"))
    found = nearest.nearest_rows(f, d, "k", "donor", "x", "d", block, pivots)
    assert got(found) == brute(list(enumerate(x)), list(enumerate(x)))


def test_clusters_are_not_compared_with_each_other(spark):
    n = 6_000
    x = clustered(n, 60, 6)
    f, d = frame(spark, range(n), x), frame(spark, range(n), x, ("donor", "d"))
    found = nearest.nearest_rows(f, d, "k", "donor", "x", "d", pivots=120).collect()
    assert len(found) == n
    assert sum(r["n_compared"] for r in found) < 0.1 * n * n
    rough = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    np.fill_diagonal(rough, np.inf)
    assert all(r["donor"] == rough[r["k"]].argmin() for r in found)


def test_copies_cost_one_vector(spark):
    x = np.concatenate([np.zeros((900, 2)), clustered(60, 3, 2)])
    f, d = frame(spark, range(len(x)), x), frame(spark, range(len(x)), x, ("donor", "d"))
    found = nearest.nearest_rows(f, d, "k", "donor", "x", "d", 20, 5)
    rows = {r["k"]: r for r in found.collect()}
    assert got(found) == brute(list(enumerate(x)), list(enumerate(x)))
    assert rows[0]["donor"] == 1 and rows[899]["donor"] == 0 and rows[1]["n_compared"] <= 62


def test_nulls_repeats_other_keys_and_empty_tables(spark):
    flows = [("a", [0, 0]), ("b", None), ("c", [5, 5]), ("c", [5, 5]), ("z", [-0.0, 0.0])]
    donors = [("a", [0, 0]), ("a", [5, 5]), ("c", [5, 5]), ("d", None), ("e", [5, 6]), ("c", [5, 5])]
    f, d = frame(spark, *zip(*flows, strict=True)), frame(spark, *zip(*donors, strict=True), ("donor", "d"))
    for pivots in (1, 9):
        assert got(nearest.nearest_rows(f, d, "k", "donor", "x", "d", 2, pivots)) == brute(flows, donors)
    none = lambda t: t.filter(F.lit(False))
    for left, right in ((none(f), d), (f, d.filter("donor = 'd'"))):
        assert got(nearest.nearest_rows(left, right, "k", "donor", "x", "d")) == []
    # a pool that holds nothing but the flow itself
    assert got(nearest.nearest_rows(f.filter("k = 'a'"), d.filter("donor = 'a'"), "k", "donor", "x", "d")) == []


def test_both_routes_agree(spark):
    x = np.round(clustered(300, 5, 4), 1)
    f, d = frame(spark, range(300), x), frame(spark, range(100, 400), x, ("donor", "d"))
    assert got(joins.nearest_donor(f, d, "k", "donor", "x", "d", 300)) == got(joins.nearest_donor(f, d, "k", "donor", "x", "d", 64))


def test_visits_are_told_in_blocks(spark):
    class Watched(nearest.Index):
        def open(self, distances, bound):
            assert distances.size <= 1 << 20
            return distances >= 0

    index = Watched(np.arange(600, dtype=float).reshape(300, 2))
    q = spark.range(0, 5_000, 1, 1).select(F.col("id").alias("q"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"), F.lit(float("inf")).alias("bound"))
    visits = nearest._visits(q, index, True)
    assert visits.columns == ["q", "v", "bound", "cell", "d"]
    n, cells, far = visits.agg(F.count("*"), F.sum("cell"), F.count_if(F.abs(F.col("d") - F.sqrt(F.pow(F.col("q") - 2 * F.col("cell"), 2) + F.pow(2 * F.col("cell") + 1, 2))) > 1e-6)).first()
    assert (n, cells, far) == (5_000 * 300, 5_000 * 299 * 150, 0)


def test_a_query_goes_once_to_each_group_of_cells(spark):
    """Where every cell is open, copies of the queries are those of groups, which hold many cells."""
    rng = np.random.default_rng(3)
    index = nearest.Index(rng.normal(size=(100, 16)))
    index.rows, index.most = np.full(100, 20), np.full(100, 50.0)
    index.rows[[0, 40]] = 0, 170
    place, parts = nearest._places(index.rows, 80)
    dealt = [(p + i, rows / k) for p, k, rows in zip(place, parts, index.rows, strict=True) for i in range(k)]
    sizes = np.bincount([g for g, _ in dealt], [rows for _, rows in dealt])
    assert sizes.max() <= 80 and parts.sum() == 102 and (np.diff(place) >= 0).all() and place[41] == place[40] + parts[40]
    n = 300
    q = frame(spark, range(n), rng.normal(size=(n, 16)), ("q", "v")).withColumn("bound", F.lit(1e3))
    visits = nearest._group_visits(q, index, place, parts)
    groups = len(sizes)
    assert groups < 30 and visits.count() == visits.select("q", "group").distinct().count() <= groups * n
    # each open cell once, in every group that it is dealt to; the nearest one was looked into before
    opened = visits.agg(F.sum(F.size("cells")), F.countDistinct("group")).first()
    nearest_cells = nearest.from_pivots(np.array([r["v"] for r in q.collect()]), index.pivots)
    first = np.flatnonzero(index.first(nearest_cells).ravel()) % 100
    assert tuple(opened) == (n * (98 + 3) - parts[first].sum(), groups)
    assert nearest._group_visits(q, index, place, parts, False).groupBy("group").count().collect() == visits.groupBy("group").count().collect()


def test_shuffled_copies_are_few_without_clusters(spark):
    n = 1_200
    x = np.random.default_rng(5).normal(size=(n, 32))
    f, d = frame(spark, range(n), x), frame(spark, range(n), x, ("donor", "d"))
    made = []

    class Watched:
        def __call__(self, visits, asked, *rest):
            made.append(sum(asked.values()))
            return compared(visits, asked, *rest)

    compared, nearest._compared = nearest._compared, Watched()
    try:
        assert got(nearest.nearest_rows(f, d, "k", "donor", "x", "d", 512, 150)) == brute(list(enumerate(x)), list(enumerate(x)))
    finally:
        nearest._compared = compared
    assert sum(made) < 10 * n
