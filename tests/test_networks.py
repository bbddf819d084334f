"""Explanations of layered scorers against sequential rules and full enumeration; fingerprints against hashlib."""

import hashlib
import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions import hashing
from veritab.operators import networks, shapley
from veritab.operators.networks import Layer, Network


def network(kind="tanh", last="softmax", width=5, outputs=3, seed=3):
    rng = np.random.default_rng(seed)
    return Network(Layer(rng.normal(size=(width, 4)), rng.normal(size=4), kind), Layer(rng.normal(size=(4, 6)), rng.normal(size=6), "sigmoid"), Layer(rng.normal(size=(6, outputs)), rng.normal(size=outputs), last))


def rows(spark, n=7, width=5, classes=3, seed=4):
    rng = np.random.default_rng(seed)
    x, r = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    t = np.arange(n) % classes
    frame = spark.createDataFrame([(i, int(t[i]), x[i].tolist(), r[i].tolist()) for i in range(n)], "k long, t int, x array<double>, r array<double>")
    return frame, x, r, t


def gathered(frame, column):
    return np.array([v[0] for v in frame.orderBy("k").select(column).collect()])


def p_target(net, x, t):
    out = net(x[None])[0]
    return out[t] if len(out) > 1 else (out[0] if t == 1 else 1 - out[0])


@pytest.mark.parametrize("kind,last,outputs", [("tanh", "softmax", 3), ("sigmoid", "sigmoid", 1), ("tanh", "linear", 1), ("relu", "softmax", 2)])
def test_gradients_are_those_of_small_differences(kind, last, outputs):
    net, rng = network(kind, last, outputs=outputs), np.random.default_rng(0)
    for t in range(max(outputs, 2)):
        x = rng.normal(size=5)
        slope = [(p_target(net, x + d, t) - p_target(net, x - d, t)) / 2e-6 for d in 1e-6 * np.eye(5)]
        assert np.allclose(net.gradient(x[None], np.array([t]))[0], slope, atol=1e-7)


def test_paths_in_first_sums_equal_the_sequential_rule_and_are_complete(spark):
    net = network()
    f, x, r, t = rows(spark)
    column = lambda **o: networks.integrated_gradients(net, F.col("x"), F.col("t"), F.col("r"), **o)
    expected = np.zeros_like(x)
    for i in range(len(x)):
        slopes = [net.gradient((r[i] + a * (x[i] - r[i]))[None], t[i : i + 1])[0] for a in np.linspace(0, 1, 65)]
        expected[i] = (x[i] - r[i]) * sum((a + b) / 2 for a, b in itertools.pairwise(slopes)) / 64
    assert np.allclose(gathered(f, column(steps=64)), expected, atol=1e-12)
    gap = [p_target(net, x[i], t[i]) - p_target(net, r[i], t[i]) for i in range(len(x))]
    assert np.allclose(gathered(f, column(steps=8_192)).sum(1), gap, atol=1e-7)
    assert np.allclose(gathered(f, column(steps=64, rule="gauss")).sum(1), gap, atol=1e-9)
    # one row a block gives the same
    small = net.path_gradients(x[:1], r[:1], t[:1], *networks.path_rule(64))
    assert np.allclose(small[0], expected[0], atol=1e-12)
    assert len(list(networks.in_blocks(7, networks.BLOCK_CELLS))) == 7


def test_a_linear_output_is_complete_with_any_steps(spark):
    net = Network(Layer(np.array([[0.1], [0.2], [-0.15]]), np.array([0.5])))
    f = spark.createDataFrame([(0, 0, [0.2, 0.1, 0.3]), (1, 1, [0.4, 0.1, 0.2])], "k long, t int, x array<double>").withColumn("r", F.array(*[F.lit(0.0)] * 3))
    total = gathered(f, networks.integrated_gradients(net, F.col("x"), F.col("t"), F.col("r"), 64)).sum(1)
    assert np.allclose(total, [-(0.02 + 0.02 - 0.045), 0.04 + 0.02 - 0.03], atol=1e-12)
    assert np.allclose(gathered(f, networks.target_probability(net, F.col("x"), F.col("t"))), [1 - 0.495, 0.53], atol=1e-12)


def test_occlusion_replaces_one_coordinate(spark):
    net = network()
    f, x, r, t = rows(spark)
    got = gathered(f, networks.occlusion(net, F.col("x"), F.col("t"), F.col("r")))
    for i, j in itertools.product(range(len(x)), range(5)):
        moved = x[i].copy()
        moved[j] = r[i, j]
        assert np.isclose(got[i, j], p_target(net, x[i], t[i]) - p_target(net, moved, t[i]), atol=1e-12)


def test_nulls_wrong_widths_targets_and_outputs(spark):
    net = network()
    f = spark.createDataFrame([(0, None, [0.0] * 5, [0.0] * 5), (1, 1, None, [0.0] * 5), (2, 1, [0.0] * 5, None), (3, 1, [1.0] * 5, [0.0] * 5)], "k long, t int, x array<double>, r array<double>")
    args = F.col("x"), F.col("t"), F.col("r")
    for c in (networks.integrated_gradients(net, *args), networks.occlusion(net, *args), shapley.shapley_values(net, 5, args[0], args[2], args[1])):
        assert [v[0] is None for v in f.orderBy("k").select(c).collect()] == [True, True, True, False]
        assert f.filter("k < 0").select(c).collect() == []
    assert [v[0] is None for v in f.orderBy("k").select(networks.target_probability(net, *args[:2])).collect()] == [True, True, False, False]
    for bad in (f.withColumn("t", F.lit(3)), f.withColumn("x", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="targets that|values"):
            bad.select(networks.gradient_times_input(net, *args[:2])).collect()
    with pytest.raises(Exception, match="not probabilities"):
        f.filter("k = 3").select(networks.probabilities(Network(Layer(np.ones((5, 1)), np.array([1.0]))), args[0])).collect()
    with pytest.raises(ValueError, match="fit together"):
        Network(Layer(np.ones((5, 2)), np.zeros(2)), Layer(np.ones((3, 1)), np.zeros(1)))


def test_networks_are_tables(spark, tmp_path):
    net, x = network(), np.random.default_rng(1).normal(size=(4, 5))
    net.table(spark).write.parquet(str(tmp_path / "net"))
    assert np.array_equal(Network.of_table(spark.read.parquet(str(tmp_path / "net")))(x), net(x))


def enumerated(score, x, background):
    """Shapley values by their definition."""
    n, worth = len(x), {}
    for flags in itertools.product((False, True), repeat=n):
        worth[flags] = np.mean([score(np.where(flags, x, b)[None])[0] for b in background])
    made = np.zeros(n)
    for flags, v in worth.items():
        for j in range(n):
            if not flags[j]:
                size = sum(flags)
                made[j] += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (worth[(*flags[:j], True, *flags[j + 1 :])] - v)
    return made


def product(rows):
    return np.prod(1 + 0.3 * rows, axis=1)


def test_a_product_of_ten_features_equals_full_enumeration(spark):
    rng = np.random.default_rng(2)
    x, background = rng.normal(size=(2, 10)), rng.normal(size=(3, 10))
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    got = gathered(f, shapley.shapley_values(lambda v: np.prod(1 + 0.3 * v, axis=1), 10, F.col("x"), background, budget=1_022))
    for i in range(2):
        assert np.allclose(got[i], enumerated(product, x[i], background), atol=1e-9)
        assert np.isclose(got[i].sum(), product(x[i : i + 1])[0] - product(background).mean())


def test_drawn_coalitions_come_near_and_add_up(spark):
    rng = np.random.default_rng(5)
    x, background = rng.normal(size=(1, 12)), rng.normal(size=(2, 12))
    exact = enumerated(product, x[0], background)
    errors = []
    for budget in (200, 3_000):
        got = shapley.Explainer(product, 12, budget=budget).values(x[0], background)[:, 0]
        assert np.isclose(got.sum(), exact.sum())
        errors.append(np.abs(got - exact).max())
    assert errors[1] < errors[0] < 0.2 * np.abs(exact).max()
    # an additive score is exact with any design that spans it
    w = rng.normal(size=12)
    assert np.allclose(shapley.Explainer(lambda v: v @ w, 12, budget=60).values(x[0], background)[:, 0], w * (x[0] - background.mean(0)), atol=1e-9)


@pytest.mark.parametrize("players,budget", [(2, 2), (3, 6), (7, 126), (8, 100), (9, 60), (64, 2_176), (5, 7)])
def test_designs(players, budget):
    masks, weights = shapley.design(players, budget)
    assert len(masks) <= budget and np.isclose(weights.sum(), 1) and not masks.all(1).any() and masks.any(1).all()
    assert len(np.unique(masks, axis=0)) == len(masks)
    by_mask = {m.tobytes(): w for m, w in zip(masks, weights, strict=True)}
    assert all(np.isclose(by_mask[(~m).tobytes()], w) for m, w in zip(masks, weights, strict=True))
    if budget >= 2**players - 2:
        kernel = np.array([1 / (math.comb(players, s) * s * (players - s)) for s in masks.sum(1)])
        assert len(masks) == 2**players - 2 and np.allclose(weights, kernel / kernel.sum())


def test_groups_outputs_and_references(spark):
    net = network()
    f, x, r, t = rows(spark)
    groups = [0, 1, 0, 2, 1]
    got = gathered(f, shapley.shapley_values(net.probabilities, 5, F.col("x"), F.col("r"), F.col("t"), groups))
    last = gathered(f, shapley.shapley_values(net.probabilities, 5, F.col("x"), F.col("r")))
    for i in range(len(x)):
        inside = lambda flags, i=i: np.where(np.array(flags[0], bool)[groups], x[i], r[i])
        assert np.allclose(got[i], enumerated(lambda v, i=i, f=inside: [net(f(v)[None])[0, t[i]]], np.ones(3), np.zeros((1, 3))), atol=1e-9)
        assert np.allclose(last[i], enumerated(lambda v: net(v)[:, -1], x[i], r[i : i + 1]), atol=1e-9)
    one = spark.createDataFrame([(0, 0, [2.0]), (1, 1, [2.0])], "k long, t int, x array<double>")
    assert gathered(one, shapley.shapley_values(lambda v: v[:, 0] / 4, 1, F.col("x"), np.zeros((1, 1)), F.col("t"))).tolist() == [[-0.5], [0.5]]


def test_fingerprints_of_bytes_equal_hashlib(spark):
    values = [[0.1, -0.0, 3.5], [1e30, -2.000005, 0.0], [], None, [1.25], [0.0, 0.0], [-0.0, 0.0], [-0.0000001]]
    f = spark.createDataFrame(list(enumerate(values)), "k long, x array<double>")
    got = f.orderBy("k").select(hashing.bytes_fingerprint(F.col("x")), hashing.bytes_fingerprint(F.col("x"), "<f4"), hashing.bytes_fingerprint(F.col("x"), "<f4", 5)).collect()
    for v, r in zip(values, got, strict=True):
        if v is None:
            assert tuple(r) == (None, None, None)
            continue
        rounded = np.round(np.array(v, "<f4"), 5)
        for code, plain, made in (("d", v, r[0]), ("f", v, r[1]), ("f", rounded, r[2])):
            assert made == hashlib.sha256(struct.pack(f"<{len(v)}{code}", *[0.0 if y == 0 else y for y in plain])).hexdigest()
    assert got[5] == got[6]
    for bad, dtype in (([float("inf")], "<f8"), ([float("nan")], "<f4"), ([1e300], "<f4"), ([1.0, None], "<f8")):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([(bad,)], "x array<double>").select(hashing.bytes_fingerprint(F.col("x"), dtype)).collect()


def test_fingerprints_of_sliced_batches(spark):
    f = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda i: i * 0.5 + F.col("id"))).alias("x"))
    got = f.repartition(3).filter("k % 2 = 1").select("k", "x", hashing.bytes_fingerprint(F.col("x")).alias("h")).collect()
    assert len(got) == 25
    assert all(r["h"] == (None if r["x"] is None else hashlib.sha256(np.array(r["x"], "<f8").tobytes()).hexdigest()) for r in got)
