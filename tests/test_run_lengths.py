"""Splits dealt out by runs against the rule one component at a time."""

import collections
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import policies

SHARES = (0.7, 0.15, 0.15)
SCHEMA = "component string, label string, n long"


def one_at_a_time(offers, step, n):
    offers, taken = list(offers), [0] * len(offers)
    for _ in range(n):
        i = offers.index(max(offers))
        taken[i] += 1
        offers[i] -= step
    return taken


def test_a_run_is_dealt_as_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(2_000):
        offers, step, n = [int(x) for x in rng.integers(-20, 40, 3)], int(rng.integers(0, 9)), int(rng.integers(0, 40))
        assert policies.dealt(offers, step, n) == one_at_a_time(offers, step, n)
    assert policies.dealt([7 * 10**17, 15 * 10**16, 15 * 10**16], 10, 10**17) == [7 * 10**16, 15 * 10**15, 15 * 10**15]


def sequential(vectors, shares):
    """(total, counts) of components, in order -> how many of each kind each split has."""
    total = [sum(v[i] for _, v in vectors) for i in range(len(vectors[0][1]))]
    lacking = [[Fraction(str(p)) * t for t in total] for p in shares]
    made = collections.Counter()
    for size, v in sorted(vectors, reverse=True):
        scores = [sum(a * b for a, b in zip(row, v, strict=True)) for row in lacking]
        k = scores.index(max(scores))
        lacking[k] = [a - b for a, b in zip(lacking[k], v, strict=True)]
        made[size, v, k] += 1
    return made


@pytest.mark.parametrize("most,seed", [(3, 0), (40, 1)])
def test_one_order_for_the_whole_table(spark, most, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    own = {f"c{i}": tuple(int(n) for n in rng.integers(0, most, 2)) for i in range(400)} | {f"s{i}": (1, 0) for i in range(300)}
    own = {k: v for k, v in own.items() if sum(v)}
    counts = spark.createDataFrame([(k, c, n) for k, v in own.items() for c, n in zip("xy", v, strict=True) if n], SCHEMA)
    expected = sequential([(sum(v), v) for v in own.values()], SHARES)
    for broadcast in (policies.BROADCAST_RUNS, 0):
        monkeypatch.setattr(policies, "BROADCAST_RUNS", broadcast)
        rows = policies.balanced(counts, ["x", "y"], SHARES).collect()
        assert sorted(r["component"] for r in rows) == sorted(own)
        got = collections.Counter((sum(own[r["component"]]), own[r["component"]], policies.SPLITS.index(r["split"])) for r in rows)
        assert got == expected


def test_components_without_a_listed_class_and_empty_tables(spark):
    counts = spark.createDataFrame([("a", "other", 5), ("b", "other", 5), ("c", "x", 1), ("d", None, 2)], SCHEMA)
    assert sorted(r["component"] for r in policies.balanced(counts, ["x"], SHARES).collect()) == ["a", "b", "c", "d"]
    none = counts.filter(F.lit(False))
    split = policies.balanced(none, ["x"], SHARES)
    assert split.collect() == [] and policies.repaired(split, none, ["x"]).collect() == []


def test_repair_moves_the_smallest_and_keeps_the_last(spark):
    rows = [("big", "x", 9), ("big", "z", 5), ("mid", "z", 3), ("low", "z", 2), ("low", "x", 1), ("only", "y", 4), ("v", "x", 1), ("t", "x", 1)]
    counts = spark.createDataFrame(rows, SCHEMA)
    place = {"big": "train", "mid": "train", "low": "train", "only": "train", "v": "validation", "t": "test"}
    assigned = spark.createDataFrame(list(place.items()), "component string, split string")
    got = {r["component"]: r["split"] for r in policies.repaired(assigned, counts, ["x", "y", "z"]).collect()}
    # z is lacking in two splits, the smallest two components that have it go; y has one component, which stays
    assert got == place | {"low": "validation", "mid": "test"}
    assert policies.repaired(assigned, counts, ["x"]) is assigned
