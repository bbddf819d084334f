
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions import hashing, labels
from veritab.operators import explain, gates, grouping, identity, joins, metrics, replacement, resampling, sampling
from veritab.plans import lineage
from veritab.sources import tables


def test_tie_orders(spark):
    rows = [(0, i, float(v)) for i, v in enumerate([4, 2, 2, 0, 0])] + [(1, i, 0.0) for i in range(5)]
    f = spark.createDataFrame(rows, "flow long, feature int, value double")
    got = {}
    for policy in ("stable", "reverse", "shuffle"):
        for r in sampling.tie_order(f, policy, ["flow"]).orderBy("flow", "position").collect():
            got.setdefault((policy, r["flow"]), []).append(r["feature"])
    assert got["stable", 0] == got["stable", 1] == [0, 1, 2, 3, 4]
    assert got["reverse", 0] == [0, 2, 1, 4, 3] and got["reverse", 1] == [4, 3, 2, 1, 0]
    assert sorted(got["shuffle", 1]) == [0, 1, 2, 3, 4] and got["shuffle", 0][0] == 0 and set(got["shuffle", 0][1:3]) == {1, 2}


def test_null_and_flat_accounts_fail_closed(spark):
    f = spark.createDataFrame([([0.0] * 3, [1.0, 2.0, 3.0]), ([1.0] * 3, [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])], "x array<double>, y array<double>")
    a, b, c = [r["s"] for r in f.select(A.similarity(F.col("x"), F.col("y"), k=2).alias("s")).collect()]
    assert (a["spearman"], a["jaccard_10"], a["weighted_jaccard"], a["normalized_mass_l1"]) == (0, 0, 0, 1) and not a["account_pair_nonzero"]
    assert b["spearman"] == 0 and not b["rank_pair_identifiable"] and b["account_pair_nonzero"]
    assert (c["spearman"], c["jaccard_10"], c["weighted_jaccard"], c["normalized_mass_l1"]) == (1, 1, 1, 0)


def test_equal_counts_are_not_pairing(spark):
    f = spark.createDataFrame([(42, "a", 1, "m"), (42, "b", 1, "n")], "seed int, flow string, target int, method string")
    assert joins.check_pairing(f, "method", ["m", "n"], "seed", "flow", "target").count() == 2
    g = spark.createDataFrame([(42, "a", 1, "m"), (42, "a", 1, "n")], f.schema)
    assert joins.check_pairing(g, "method", ["m", "n"], "seed", "flow", "target").isEmpty()


def test_constant_contrast_has_no_width(spark):
    rows = [(s, f, (s - 42) / 5 + (f == "a") + d, o) for s in range(42, 47) for f in "ab" for o, d in (("base", 0.0), ("donor", 0.25))]
    d = joins.paired_contrast(spark.createDataFrame(rows, "seed int, flow string, v double, op string"), "op", "donor", "base", "v", "seed", "flow")
    r = resampling.crossed_bootstrap(d.withColumn("g", F.lit(1)), "difference", "g", resamples=300).first()
    assert r["n_sources"] == 2 and r["n_seeds"] == 5
    assert all(abs(r[c] - 0.25) < 1e-9 for c in ("estimate", "ci_low", "ci_high"))


def test_linear_model_is_complete(spark):
    model = explain.Logit((0.1, 0.2, -0.15), 0.5)
    f = spark.createDataFrame([([1.0, -2.0, 0.5],), ([3.0, 1.0, 2.0],)], "x array<double>").withColumn("r", F.array(*[F.lit(0.0)] * 3))
    g = f.select(A.total(explain.integrated_gradients(model, F.col("x"), F.col("r"), 512)).alias("s"), (model.probability(F.col("x")) - model.probability(F.col("r"))).alias("d")).collect()
    assert all(abs(r["s"] - r["d"]) < 1e-6 for r in g)


def test_kernel_shap_is_exact_for_an_additive_margin(spark):
    model = explain.Logit((0.4, -0.2, 0.7, 0.1))
    f = spark.createDataFrame([(1, [1.0, 2.0, -1.0, 0.5])], "k long, x array<double>")
    r = explain.kernel_shap(f, "k", "x", model, [0.0] * 4, 200).first()
    assert np.allclose(r["values"], [0.4, -0.4, -0.7, 0.05], atol=1e-9)


def test_threshold_without_a_valid_end_lies_above_all_scores(spark):
    f = spark.createDataFrame([(0, 0.9), (1, 0.9), (0, 0.1)], "truth int, score double")
    r = metrics.threshold_at_fpr(f, 0.05).first()
    assert r["threshold"] > 0.9 and r["recall"] == 0


def test_precedence_guard(spark):
    f = spark.createDataFrame([("train", "a", "x"), ("validation", "a", "y"), ("validation", "b", "y"), ("test", "c", "y"), ("test", "d", "w"), ("test", "e", "x")], "split string, fp string, fp2 string")
    assert sorted((r["split"], r["fp"]) for r in identity.precedence_guard(f, "split", "fp", "fp2").collect()) == [("test", "d"), ("train", "a"), ("validation", "b")]


def test_components_and_splits(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in grouping.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5}
    g = spark.createDataFrame([(i, "x", 1 + i % 7) for i in range(80)], "g long, l string, n long")
    s = grouping.balanced_split(g, "g", "l", "n").join(g.select("g", "n"), "g")
    share = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert abs(share["train"] / sum(share.values()) - 0.7) < 0.03 and len(share) == 3


def test_gates_and_inventory(spark):
    s = spark.createDataFrame([("spearman", 0.9, 1.0, True, True), ("normalized_mass_l1", 0.1, 0.3, True, True), ("spearman", 0.9, 1.0, False, True), ("spearman", None, None, True, True), ("other", 1.0, 1.0, True, True)], "metric string, ci_low double, ci_high double, coverage_sufficient boolean, identification_coverage_sufficient boolean")
    assert [r["gate_status"] for r in gates.apply_gates(s).collect()] == ["pass", "fail", "not_evaluable_seed_coverage", "not_evaluable_account_coverage", "not_predeclared"]


def test_labels_and_hashes(spark):
    f = spark.createDataFrame([(" a�  b ", "Infiltration - Portscan", "YES", -0.0)], "x string, y string, z string, v double")
    r = f.select(labels.normalize_label(F.col("x")).alias("n"), labels.family(F.col("y")).alias("f"), labels.family(F.col("y"), {"Infiltration - Portscan": "Infiltration"}).alias("g"), labels.truthy(F.col("z")).alias("a"), labels.truthy_trimmed(F.col("z")).alias("b"), labels.format_decimal(F.lit(-0.125), 2).alias("d"), (hashing.canonical_zero(F.col("v")) == 0).alias("z")).first()
    assert (r["n"], r["f"], r["g"], r["a"], r["b"]) == ("a b", "PortScan", "Infiltration", False, True) and r["d"].startswith("-.1")


def test_linkability(spark):
    f = spark.createDataFrame([("case-000001", 1, "x")], "flow_id string, sample_order int, tensor_fingerprint_exact string")
    assert tables.linkability_findings(f) == ["direct_linkage_field:sample_order", "direct_linkage_field:tensor_fingerprint_exact", "nonopaque_flow_id"]
    assert tables.linkability_findings(spark.createDataFrame([("rid_" + "0a" * 16, 1.0)], "flow_id string, metric double")) == []


def test_cached_stage(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(10)

    path = str(tmp_path / "stage")
    assert lineage.cached_stage(spark, path, "s", {"a": 1}, compute)[1] is False
    assert lineage.cached_stage(spark, path, "s", {"a": 1}, compute)[1] is True
    assert lineage.cached_stage(spark, path, "s", {"a": 2}, compute)[1] is False
    next(x for x in (tmp_path / "stage").iterdir() if x.suffix == ".parquet").write_bytes(b"torn")
    assert lineage.is_hit(spark, path, lineage.signature({"stage": "s", "payload": {"a": 2}})) is False
    assert len(calls) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" x ,y\n1,2\n")
    assert tables.read_table(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    out = tables.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    assert [r["source_row"] for r in tables.with_identity(tables.read_table(spark, out)).collect()] == [0]
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "x int").isEmpty()
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.json")


def test_incremental_ingest(spark, tmp_path):
    from veritab.streaming.ingest import ingest

    schema = "ts timestamp, event_type string, value double"
    for hour in (1, 5):
        spark.sql(f"SELECT timestamp'2024-01-01 0{hour}:30:00' AS ts, 'a' AS event_type, 1.0D AS value").write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.sql("SELECT timestamp'2024-01-01 09:30:00' AS ts, 'a' AS event_type, 1.0D AS value").write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_moments_of_many_partitions(spark):
    x = np.random.default_rng(6).normal(size=(300, 3)) + 1e4
    f = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "x array<double>").repartition(70)
    mean, sigma = explain.moments(f, "x")
    assert np.allclose(mean, x.mean(0), rtol=1e-13) and np.allclose(sigma, np.cov(x.T), atol=1e-8)
    with pytest.raises(ValueError, match="no rows"):
        explain.moments(f.filter(F.lit(False)), "x")


def test_moments_with_empty_partitions(spark):
    f = spark.range(0, 40, 1, 4).filter("id < 10").select(F.array(F.col("id").cast("double"), (F.col("id") * F.col("id")).cast("double")).alias("x"))
    mean, sigma = explain.moments(f, "x")
    rows = np.array([[i, i * i] for i in range(10)], float)
    assert np.allclose(mean, rows.mean(0)) and np.allclose(sigma, np.cov(rows.T))


def test_quantile_bins_deal_no_rows_by_value(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, v) for k in ("a", "b", None) for v in (0.0, -0.0, 1.0, 1.0, 1.0, 2.5, 7.0, 7.0, None, nan, inf, -inf)] + [("c", nan)]
    frame = spark.createDataFrame(rows, "k string, v double")
    made = sampling.quantile_bins(frame, "v", 3, ["low", "mid", "high"], "k")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "(v#" in x]
    want = {0.0: "low", 1.0: "mid", 2.5: "high", 7.0: "high"}
    found = made.collect()
    assert len(found) == len(rows)
    assert all(r["bin"] == (want.get(r["v"], "") if r["k"] in ("a", "b") else "") for r in found)
    alone = sampling.quantile_bins(frame.filter("k = 'a'"), "v", 3, ["low", "mid", "high"]).collect()
    assert len(alone) == 12 and all(r["bin"] == want.get(r["v"], "") for r in alone)
    assert sampling.quantile_bins(frame.filter("false"), "v", 3, ["low", "mid", "high"], "k").count() == 0


def test_nearest_donor_of_odd_rows(spark):
    nan = float("nan")
    donors = [[0.0, 0.0], [1.0, 5.0], [1.0, 5.0], [9.0, nan]]
    pool = F.array(*[F.struct(F.array(*map(F.lit, d)).alias("x")) for d in donors])
    rows = spark.createDataFrame([(0, [1.0, 4.0], [0]), (1, [9.0, 4.9], []), (2, None, [0]), (3, [None, 5.0], [0]), (4, [8.0, 0.0], [1]), (5, [nan, 1.0], None)], "n int, x array<double>, s array<int>")
    context = spark.range(1).select(F.array(F.lit(2.0), F.lit(1.0)).alias("sd"), pool.alias("pool"))
    made = rows.crossJoin(context).withColumn("place", replacement.nearest_places(context)(F.col("x"), F.col("s")))
    # equal donors: the first; a null coordinate: all distances are null; NaN is larger than any distance
    assert {r["n"]: r["place"] for r in made.collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
