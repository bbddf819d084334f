"""Queries and operators over all rows of their tables, against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab import catalog
from veritab.operators import joins, resampling

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def read(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@tables
@pytest.mark.parametrize("name", ["lime_ridge", "kernel_shap_logit"])
def test_every_account_is_explained(spark, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    assert sorted(r["flow"] for r in got.collect()) == sorted(r["vec_id"] for r in read(spark, "embeddings").collect())


def test_donor_pools_of_any_size(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(6_100, 2)), 2)
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    flows, donors = f.filter("k < 100").withColumnRenamed("v", "x"), f.filter("k >= 50").toDF("donor", "d")
    for block in (4_096, 700):
        got = {r["k"]: (r["donor"], r["distance"]) for r in joins.nearest_donor(flows, donors, "k", "donor", "x", "d", block).collect()}
        for i in range(100):
            d = ((x[50:] - x[i]) ** 2).cumsum(1)[:, -1]
            if i >= 50:
                d[i - 50] = np.inf
            assert got[i] == (50 + int(np.argmin(d)), d.min())


@tables
def test_every_vector_has_a_donor(spark):
    rows = read(spark, "embeddings").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows]
    got = {r["vec_id"]: (r["donor"], r["distance"]) for r in catalog.QUERIES["nearest_donor"](spark, SF_DIR).collect()}
    assert sorted(got) == ids
    for i, k in enumerate(ids):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[k][0] == ids[int(np.argmin(d))] and np.isclose(got[k][1], d.min(), atol=1e-5)


@tables
def test_queries_of_whole_tables_leave_nothing_out(spark):
    run = lambda name: catalog.QUERIES[name](spark, SF_DIR).collect()
    orders, customers, suppliers = (read(spark, t).collect() for t in ("orders", "customer", "supplier"))
    nodes = {2 * o["o_custkey"] for o in orders} | {2 * o["o_orderkey"] + 1 for o in orders}
    assert {r["node"] for r in run("connected_components")} == nodes
    keys = {c["c_nationkey"] for c in customers} | {s["s_nationkey"] for s in suppliers}
    assert {r["k"] for r in run("full_outer_match_status")} == keys
    assert sum(r["n_rows"] for r in run("inventory_completeness")) == len(customers)
    known = {c["c_custkey"] for c in customers}
    assert sum(r["n_matched"] for r in run("left_enrichment")) == sum(o["o_custkey"] in known for o in orders)


@tables
def test_conditional_gaussian_uses_all_coordinates(spark):
    rows = read(spark, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], float)
    mean, sigma = x.mean(0), np.cov(x.T) + 1e-6 * np.eye(x.shape[1])
    got = {r["flow"]: r["values"] for r in catalog.QUERIES["conditional_gaussian"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for r, v in list(zip(rows, x, strict=True))[:40]:
        cols = np.sort(np.argsort(-np.abs(v), kind="stable")[:3])
        rest = np.setdiff1d(np.arange(len(v)), cols)
        assert np.allclose(got[r["vec_id"]], mean[cols] + sigma[np.ix_(cols, rest)] @ np.linalg.solve(sigma[np.ix_(rest, rest)], v[rest] - mean[rest]), atol=1e-7)


@tables
def test_bootstraps_draw_as_often_as_the_reference(spark, monkeypatch):
    assert catalog.QUERIES["bootstrap_crossed_hash"](spark, SF_DIR).first()["n_replicates"] == 5_000
    drawn = []
    monkeypatch.setattr(resampling, "crossed_bootstrap", lambda *a, resamples=5_000, **b: drawn.append(resamples))
    catalog.QUERIES["bootstrap_crossed_numpy"](spark, SF_DIR)
    assert drawn == [5_000]


@tables
def test_gaussian_operators_with_empty_partitions(spark):
    small = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        assert read(spark, "embeddings").rdd.glom().filter(lambda p: not p).count()
        assert catalog.QUERIES["gaussian_operator_effects"](spark, SF_DIR).count() == 2 * read(spark, "embeddings").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
