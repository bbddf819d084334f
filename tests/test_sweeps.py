"""Sweeps against the measures of one setting at a time."""

import pytest
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.operators import sweeps
from veritab.operators.sweeps import Setting


def test_one_axis_at_a_time():
    made = sweeps.one_axis_at_a_time(Setting(), top_k=(5, 10, 5), minimum_fraction=(0.9, 0.95))
    assert [s.setting for s in made] == ["baseline", "top_k=5", "minimum_fraction=0.9"]
    assert len(sweeps.measures(made)) == 2
    with pytest.raises(ValueError, match="one name"):
        sweeps.measures([Setting(), Setting(top_k=3)])


def test_measures_of_all_settings_equal_those_of_each(spark):
    rows = [([5.0, 3.0, 2.0, 0.0], [4.0, 4.0, 1.0, 0.5]), ([1.0, 1.0, 1.0, 1.0], [4.0, 3.0, 2.0, 1.0]), ([0.0] * 4, [1.0, 2.0, 3.0, 4.0]), ([0.0] * 4, [0.0] * 4), ([3.0, 2.999, 2.0, 1.0], [3.0, 2.999, 2.0, 1.0]), ([9.0, 8.0], [1.0, 2.0])]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x array<double>, y array<double>")
    settings = sweeps.one_axis_at_a_time(Setting(top_k=2), top_k=(1, 3, 10), mass_floor=(5.0,), tie_tolerance=(0.01,), minimum_fraction=(0.5,))
    got = {(r["i"], r["measure"], r["metric"]): (r["value"], r["identified"]) for r in f.select("i", F.inline(sweeps.measured(F.col("x"), F.col("y"), settings))).collect()}
    assert len(got) == len(rows) * 6 * 4
    flags = {"spearman": "rank_pair_identifiable", "jaccard_10": "top_k_pair_identifiable"}
    for n, (k, floor, tie) in enumerate(sweeps.measures(settings)):
        for r in f.select("i", A.similarity(F.col("x"), F.col("y"), k, floor, tie).alias("s")).collect():
            for metric in ("spearman", "jaccard_10", "weighted_jaccard", "normalized_mass_l1"):
                value, known = got[r["i"], n, metric]
                assert value == pytest.approx(r["s"][metric], abs=1e-12) and known == r["s"][flags.get(metric, "account_pair_nonzero")]


def test_accounts_are_read_twice_at_most_and_coverage_only_changes_evaluability(spark):
    pairs = spark.range(60).select(F.col("id").alias("flow"), (42 + F.col("id") % 5).alias("seed"), (F.col("id") % 2).alias("label"), F.array(*[F.lit(float(v)) for v in (3, 2, 1)]).alias("x"), F.when(F.col("id") < 12, F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(*[F.lit(float(v)) for v in (3, 2, 1)])).alias("y"))
    settings = sweeps.one_axis_at_a_time(Setting(top_k=2, minimum_fraction=0.5), minimum_fraction=(0.95, 0.99), top_k=(1,))
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = sweeps.swept(pairs.mapInPandas(noted, pairs.schema), "x", "y", settings, "label", replicates=50).collect()
    assert len(rows) == 4 * 2 * 4
    values = {}
    for r in rows:
        if r["setting"] != "top_k=1":
            values.setdefault((r["label"], r["metric"]), set()).add((r["estimate"], r["ci_low"], r["ci_high"]))
        if r["setting"] == "minimum_fraction=0.99":
            assert r["gate_status"] == "not_evaluable_account_coverage"
    assert all(len(v) == 1 for v in values.values())
    # the summary and the replicates each read the pairs, whatever the number of settings
    assert seen.value <= 2 * 60
