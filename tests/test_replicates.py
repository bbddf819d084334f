"""Replicate sums against the laws they follow, and intervals against direct draws in NumPy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import replicates, resampling


def one_hot(spark, n, cell="a"):
    rows = [(cell, i, s, [float(k == i) for k in range(n)], 1.0) for i in range(n) for s in (1, 2) if s == 1 or i % 3]
    return spark.createDataFrame(rows, "cell string, source long, column int, x array<double>, n double")


@pytest.mark.parametrize("leaf_sources", [4_096, 3])
def test_weights_are_multinomial(spark, leaf_sources):
    """Each source's own weight in every replicate, whether one task holds all sources or the tree has many leaves."""
    n, draws = 24, 3_000
    cells = one_hot(spark, n).unionByName(one_hot(spark, n, None).filter("source < 7"))
    got = {(r["cell"], r["column"]): replicates.vectors(r["sums"], r["weights"]) for r in replicates.multinomial_sums(cells, "cell", replicates=draws, seed=3, leaf_sources=leaf_sources).collect()}
    assert set(got) == {(c, s) for c in ("a", None) for s in (1, 2)}
    for cell, m in (("a", n), (None, 7)):
        w, total = got[cell, 1]
        w = w[:, :m]
        assert (w[-1] == 1).all() and (total == m).all() and (w.sum(1) == m).all() and (w == np.round(w)).all() and (w >= 0).all()
        second, seen = got[cell, 2]
        assert np.array_equal(second[:, :m], w * (np.arange(m) % 3 > 0)) and np.array_equal(seen, second.sum(1))
        w = w[:-1]
        assert np.allclose(w.mean(0), 1, atol=0.1) and np.allclose(w.var(0), 1 - 1 / m, atol=0.15)
        off = np.cov(w.T)[~np.eye(m, dtype=bool)]
        assert abs(off + 1 / m).max() < 0.1


def test_hashed_weights_repeat(spark):
    n = 11
    cells = one_hot(spark, n).repartition(5)
    w, total = replicates.vectors(*replicates.hashed_sums(cells, replicates=40, salt="s").filter("column = 1").first()[1:])
    assert np.array_equal(w[:-1].T, [replicates.hashed_weights(i, 40, "s") for i in range(n)]) and np.array_equal(total, w.sum(1))
    assert np.isclose(np.mean([replicates.hashed_weights(i, 500, "t") for i in range(40)]), 0.98, atol=0.03)


def panel(rng, n=40, gaps=True):
    return [("c", s, f, float(rng.normal(s / 10, 1) + f / 50)) for s in range(5) for f in range(n) if not gaps or (f + s) % 7]


def direct_crossed(rows, resamples, rng):
    seeds, flows = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    x = np.full((len(flows), len(seeds)), np.nan)
    for _, s, f, v in rows:
        x[flows.index(f), seeds.index(s)] = v
    seen, out = np.isfinite(x), []
    while len(out) < resamples:
        w = rng.multinomial(len(flows), [1 / len(flows)] * len(flows))
        if (w @ seen > 0).all():
            per = (w @ np.nan_to_num(x)) / (w @ seen)
            out.append(per[rng.integers(0, len(seeds), len(seeds))].mean())
    return np.nanmean(x, 0).mean(), np.array(out)


@pytest.mark.parametrize("leaf_sources", [4_096, 5])
def test_crossed_intervals(spark, monkeypatch, leaf_sources):
    monkeypatch.setattr(replicates.multinomial_sums, "__kwdefaults__", {**replicates.multinomial_sums.__kwdefaults__, "leaf_sources": leaf_sources})
    rng = np.random.default_rng(2)
    rows = panel(rng)
    f = spark.createDataFrame([*rows, ("c", 1, 1, None), ("few", 0, 0, 1.0), ("few", 1, 1, 3.0)], "k string, seed int, flow int, v double")
    got = {r["k"]: r for r in resampling.crossed_bootstrap(f, "v", "k", resamples=3_000).collect()}
    estimate, draws = direct_crossed(rows, 3_000, rng)
    r = got["c"]
    assert np.isclose(r["estimate"], estimate) and r["n_sources"] == 40 and r["n_seeds"] == 5
    assert np.allclose([r["ci_low"], r["ci_high"]], np.quantile(draws, [0.025, 0.975]), atol=0.06)
    # half of the replicates of two sources leave a seed empty and are drawn again
    assert (got["few"]["estimate"], got["few"]["ci_low"], got["few"]["ci_high"]) == (2, 1, 3)
    with pytest.raises(ValueError):
        resampling.crossed_bootstrap(f, "v", "k", empty="keep")


def test_no_rows(spark):
    f = spark.createDataFrame([], "k string, seed int, flow int, v double, left_run int, right_run int")
    assert resampling.crossed_bootstrap(f, "v", "k").count() == resampling.hash_interval(f, "v", "k").count() == resampling.run_pair_bootstrap(f, "v", "k").count() == 0


def run_rows(rng, n_flows=12, n_seeds=4, n_runs=4):
    base = {(s, a, b): rng.normal(0.3, 0.2) for s in range(n_seeds) for a in range(n_runs) for b in range(a + 1, n_runs)}
    return [("c", s, f, a, b, float(v + rng.normal(0, 0.1))) for (s, a, b), v in base.items() for f in range(n_flows) if (f + s) % 5]


def direct_run_pairs(rows, resamples, rng):
    """The law draw by draw."""
    seeds, flows = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    p = {}
    for s in seeds:
        for f in flows:
            own = [(a, b, v) for _, s2, f2, a, b, v in rows if (s2, f2) == (s, f)]
            if own:
                runs = sorted({x for a, b, _ in own for x in (a, b)})
                p[s, f] = np.array([np.mean([v for a, b, v in own if run in (a, b)]) for run in runs])
    n, draws = len(next(iter(p.values()))), []
    estimate = np.mean([np.mean([p[s, f] for f in flows if (s, f) in p]) for s in seeds])
    for _ in range(resamples):
        picked = rng.choice(seeds, len(seeds))
        while True:
            w = dict(zip(flows, rng.multinomial(len(flows), [1 / len(flows)] * len(flows)), strict=True))
            if all(any(w[f] for f in flows if (s, f) in p) for s in picked):
                break
        each = []
        for s in picked:
            q = sum(w[f] * p[s, f] for f in flows if (s, f) in p) / sum(w[f] for f in flows if (s, f) in p)
            pseudo = (2 * (n - 1) * q - n * q.mean()) / (n - 2)
            each.append(pseudo[rng.integers(0, n, n)].mean())
        draws.append(np.mean(each))
    return estimate, np.array(draws)


SCHEMA = "k string, seed int, flow int, left_run int, right_run int, v double"


def test_run_pair_intervals(spark):
    rng = np.random.default_rng(5)
    rows = run_rows(rng)
    r = resampling.run_pair_bootstrap(spark.createDataFrame(rows, SCHEMA), "v", "k", resamples=3_000).first()
    estimate, draws = direct_run_pairs(rows, 3_000, rng)
    assert np.isclose(r["estimate"], estimate) and (r["n_seeds"], r["n_runs"], r["n_replicates"]) == (4, 4, 3_000)
    assert np.allclose([r["ci_low"], r["ci_high"]], np.quantile(draws, [0.025, 0.975]), atol=0.03) and np.isclose(r["bootstrap_sd"], draws.std(ddof=1), rtol=0.12)
    statistic = resampling.run_pair_statistic(spark.createDataFrame([x for x in rows if x[1] == 0 and x[2] == 1], SCHEMA), "v", "k").first()
    p = np.array([[np.mean([v for _, s, f, a, b, v in rows if s == 0 and f == 1 and run in (a, b)]) for run in range(4)]])
    assert np.isclose(resampling.pseudovalues(p).mean(), statistic["estimate"]) and np.isclose(resampling.pseudovalues(p)[0].std(ddof=1) / 2, statistic["jackknife_se"])


@pytest.mark.parametrize("fault", ["a pair is missing", "another run", "two runs"])
def test_run_inventories_are_checked(spark, fault):
    rows = run_rows(np.random.default_rng(5))
    if fault == "a pair is missing":
        rows = rows[1:]
    elif fault == "another run":
        rows = [(k, s, f, a, 9 if (s, f, b) == (0, 1, 3) else b, v) for k, s, f, a, b, v in rows]
    else:
        rows = [r for r in rows if r[3] == 0 and r[4] == 1]
    with pytest.raises(Exception, match="runs"):
        resampling.run_pair_bootstrap(spark.createDataFrame(rows, SCHEMA), "v", "k").collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_inventories_share_the_weights_of_a_source(spark, monkeypatch):
    from veritab import catalog

    calls, of = [], resampling.hash_interval
    monkeypatch.setattr(resampling, "hash_interval", lambda *a, **k: calls.append(a) or of(*a, **k))
    assert catalog.QUERIES["audit_rollup"](spark, "/root/testdata/sf0.001").columns[:2] == ["inventory", "metric"]
    assert len(calls) == 1
