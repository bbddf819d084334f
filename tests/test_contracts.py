"""Readers, contracts and small operators against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions import filters, hashing, labels
from veritab.operators import aggregates, explain, identity, joins, metrics, panels, policies, prefix, preparation, replacement, resampling, transforms
from veritab.plans import lineage
from veritab.sources import tables


def test_splits_are_written_once_and_read_back(spark, tmp_path):
    f = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "k long, split string")
    tables.write_splits(f, f"{tmp_path}/t")
    assert sorted((r["k"], r["split"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "train"), (2, "test"), (3, "train")]
    with pytest.raises(PySparkException):
        tables.write_splits(f, f"{tmp_path}/t")


def test_csv_is_replaced_or_removed(spark, tmp_path):
    f = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    path = tables.write_csv(f, f"{tmp_path}/out.csv")
    tables.write_csv(f.filter("k = 1"), path)
    assert [tuple(r) for r in tables.read_table(spark, path).collect()] == [(1, "a")]
    assert tables.write_csv(f.select(), path) is None and tables.read_or_empty(spark, path, "k long", "csv").isEmpty()


def test_directories_unite_columns_and_paths_tell_their_context(spark, tmp_path):
    base = f"{tmp_path}/dataset=one/model=m/xai=ig"
    spark.createDataFrame([(1, 2.0)], "a long, b double").coalesce(1).write.parquet(f"{base}/x.parquet")
    spark.createDataFrame([(5,)], "a long").coalesce(1).write.parquet(f"{tmp_path}/two/n/lime/y.parquet")
    f = tables.read_directory(spark, str(tmp_path))
    assert sorted(map(tuple, f.select("a", "b").collect()), key=str) == [(1, 2.0), (5, None)]
    got = tables.with_path_context(spark.read.parquet(f"{base}/x.parquet")).first()
    assert (got["dataset"], got["model"], got["xai"]) == ("one", "m", "ig")


def test_snapshots_hold_every_condition_once(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 1), ("c", 2)], "flow string, seed int")
    assert sorted(r["flow"] for r in tables.predictions_snapshot(f, ["flow"], ["seed"]).collect()) == ["b", "c"]


def test_verified_tables_fail_closed(spark, tmp_path):
    f = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    path, sign = f"{tmp_path}/probe", lineage.signature({"stage": "probe"})
    _, hit = lineage.cached_stage(spark, path, "probe", {}, lambda: f)
    sign = lineage.signature({"stage": "probe", "payload": {}})
    assert not hit and lineage.load_verified(spark, path, sign, ["k"], f).count() == 2
    assert lineage.inventory_findings(spark, {"probe": (path, sign), "gone": (f"{tmp_path}/gone", sign), "other": (path, "0")}) == ["gone", "other"]
    for args in ((path, "another signature", ["k"]), (path, sign, ["k"], f.filter("k = 1"))):
        with pytest.raises(ValueError):
            lineage.load_verified(spark, *args)
    spark.createDataFrame([(1, "x"), (1, "y")], f.schema).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        lineage.load_verified(spark, path, sign, ["k"])


def test_known_records_are_found_wherever_they_lie(spark):
    need = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2")], "name string, size long, sha256 string")
    have = spark.createDataFrame([("z", 1, "h1"), ("b", 3, "h2")], need.schema)
    assert [r["name"] for r in lineage.missing_records(need, have).collect()] == ["b"]


def test_linkability_guard(spark, tmp_path):
    rid = "rid_" + "0a" * 16
    (tmp_path / "bad.csv").write_text(f" Flow_ID ,Sample_Order,tensor_fingerprint_exact\n{rid},1,x\n")
    (tmp_path / "legacy.csv").write_text("flow_id\ncase-000001\n")
    (tmp_path / "good.csv").write_text(f"flow_id,metric\n{rid},1.0\n,2.0\n")
    find = lambda n: tables.csv_linkability(spark, f"{tmp_path}/{n}")
    assert find("bad.csv") == ["direct_linkage_field:sample_order", "direct_linkage_field:tensor_fingerprint_exact"]
    assert find("legacy.csv") == ["nonopaque_flow_id"] and find("good.csv") == []
    assert find("missing.csv") == ["unreadable_csv_for_linkability_check"]


def test_secret_rules(spark):
    rows = [("ghp_" + "a" * 20, ["provider_token"]), ("ghp_" + "a" * 19, []), ("API-key: 'twelve chars'", ["credential_literal"]), ("d:\\users\\x and /HOME/y", ["personal_absolute_path", "windows_personal_path"]), (None, [])]
    f = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r["s"] for r in f.select(labels.sensitive(F.col("t")).alias("s")).collect()] == [x for _, x in rows]


def test_filters(spark):
    f = spark.createDataFrame([("d", "x_top_3.csv"), ("d", "x_top10.csv"), ("e", "plain.csv"), ("z", "top99.csv")], "dataset string, path string")
    n = spark.createDataFrame([("d", 10), ("e", 1)], "dataset string, n int")
    assert sorted(r["path"] for r in filters.valid_top_k(f, "path", n, "dataset", "n").collect()) == ["plain.csv", "top99.csv", "x_top_3.csv"]
    u = spark.createDataFrame([(1, 5, True, True), (2, 5, True, False), (3, 5, False, True), (4, 6, True, True)], "k int, seed int, central boolean, stochastic boolean")
    assert [r["k"] for r in filters.condition_units(u, {"seed": 5}, "central").orderBy("k").collect()] == [1, 2]
    assert [r["k"] for r in filters.condition_units(u, {"seed": 5}, "central", "stochastic").collect()] == [1]
    assert [r["k"] for r in filters.in_pairs(u, u.filter("k = 4"), ["seed"]).collect()] == [4]
    p = spark.createDataFrame([(0.1, 0.9)], "prob_a double, prob_b double")
    assert filters.probability_columns(p) == ["prob_a", "prob_b"]
    with pytest.raises(ValueError):
        filters.probability_columns(p.select("prob_a"))


def test_strict_values_are_errors_otherwise(spark):
    f = spark.createDataFrame([("True",), ("0",)], "t string")
    assert [r["b"] for r in f.select(labels.strict_bool(F.col("t")).alias("b")).collect()] == [True, False]
    for bad in (labels.strict_bool(F.lit("maybe")), labels.encoded(F.lit("x"), ["a", "b"])):
        with pytest.raises(PySparkException):
            f.select(bad.alias("b")).collect()
    assert f.select(labels.encoded(F.lit("b"), ["a", "b"]).alias("c")).first()["c"] == 1


def test_joins_with_contracts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    b = spark.createDataFrame([(2, 5.0), (1, 4.0)], "k long, w double")
    assert sorted(map(tuple, joins.one_to_one(a, b, ["k"]).collect())) == [(1, 1.0, 4.0), (2, 2.0, 5.0)]
    wide = joins.aligned({"one": a, "two": b.withColumnRenamed("w", "v")}, "k", "v")
    assert sorted(map(tuple, wide.select("k", "one", "two").collect())) == [(1, 1.0, 4.0), (2, 2.0, 5.0)]
    with pytest.raises(PySparkException):
        joins.one_to_one(a, b.unionByName(b), ["k"]).collect()
    with pytest.raises(PySparkException):
        joins.aligned({"one": a, "two": a.filter("k = 1")}, "k", "v").collect()


def test_stored_values_and_identities(spark):
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    old = spark.createDataFrame([("a", 1.0 + 1e-12), ("b", 2.1), ("d", 4.0)], new.schema)
    assert sorted(r["k"] for r in panels.differences(new, old, ["k"], "v").collect()) == ["b", "c", "d"]
    units = spark.createDataFrame([(0, "x"), (1, "y"), (9, "z")], "at int, fp string")
    test = spark.createDataFrame([(0, "x"), (1, "other")], units.schema)
    assert sorted(r["at"] for r in panels.unlike_identity(units, test, ["at"], ["fp"]).collect()) == [1, 9]


def test_why_cells_cannot_be_judged(spark):
    rows = [("g", True, True, True, 1.0), ("g", False, True, False, 2.0), ("g", False, False, False, float("inf")), ("g", True, True, True, 3.0)]
    f = spark.createDataFrame(rows, "k string, ok boolean, l boolean, r boolean, gap double")
    r = aggregates.non_evaluable(f, "ok", "l", "r", "gap", 0.95, "k").first()
    assert (r["coverage"], round(r["shortfall"], 9), r["one_sided"], r["both_sided"], r["gap_median"]) == (0.5, 0.45, 0.25, 0.25, 2.0)


def test_areas_carry_their_error(spark):
    f = spark.createDataFrame([("a", 0.1, 1.0, 0.1), ("a", 0.2, 2.0, 0.2), ("a", 0.4, 3.0, 0.3)], "k string, f double, v double, se double")
    r = explain.area_with_error(f, "f", "v", "se", "k").first()
    w = np.array([0.1, 0.15, 0.1])  # half the way to both neighbours, from 0 and to the last
    area, se = (w * [1, 2, 3]).sum() / 0.4, np.sqrt(((w * [0.1, 0.2, 0.3]) ** 2).sum()) / 0.4
    assert np.allclose([r["area"], r["area_se"], r["lower95"]], [area, se, area - 1.96 * se])


def test_cluster_bootstrap_draws_whole_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [("g", int(c), float(v)) for c in range(30) for v in rng.normal(c % 3, 0.1, 5)]
    r = resampling.cluster_bootstrap(spark.createDataFrame(rows, "k string, c long, v double"), "v", "c", "k").first()
    means = np.array([np.mean([v for _, c, v in rows if c == i]) for i in range(30)])
    draws = means[np.random.default_rng(0).integers(0, 30, (4000, 30))].mean(1)
    assert r["n_clusters"] == 30 and abs(r["estimate"] - means.mean()) < 1e-9
    assert np.allclose([r["ci_low"], r["ci_high"]], np.quantile(draws, [0.025, 0.975]), atol=0.05)


def test_seeds_and_collapsed_units(spark):
    f = spark.createDataFrame([("a", None, True, 2), ("b", None, False, 1), ("c", 3, None, 1)], "t string, u long, flag boolean, o int")
    got = {r["u"]: (r["any"], r["first"], r["n"]) for r in identity.collapsed(f, ["u"], {"any": "flag"}, {"first": "t"}, "o").collect()}
    assert got == {None: (True, "b", 2), 3: (False, "c", 1)}
    digest = hashlib.sha256(b"a|1").digest()
    assert spark.range(1).select(hashing.stable_seed_le(F.lit("a"), F.lit(1)).alias("s")).first()["s"] == int.from_bytes(digest[:4], "little")


def test_candidates_are_not_chosen_by_the_test_split(spark):
    f = spark.createDataFrame([("t", "a", 0.5, 2.0), ("t", "b", 0.5, 1.0), ("u", "c", 0.1, 1.0)], "task string, name string, f2 double, test_loss double")
    with pytest.raises(ValueError):
        metrics.best_candidate(f, [("f2", True), ("test_loss", False)], "task")
    g = f.withColumnRenamed("test_loss", "loss")
    assert {r["name"] for r in metrics.best_candidate(g, [("f2", True), ("loss", False)], "task").collect()} == {"b", "c"}


def test_multiclass_predictions(spark):
    f = spark.createDataFrame([([0.2, 0.5, 0.3], 1), ([0.4, 0.4, 0.2], 1)], "p array<double>, truth int")
    rows = metrics.prediction_table(f, "p", ["x", "y", "z"], "truth", 0.5).collect()
    assert [(r["pred"], r["correct"], round(r["confidence"], 9), round(r["margin"], 9)) for r in rows] == [(1, True, 0.5, 0.2), (0, False, 0.4, 0.0)]
    assert rows[0]["prob_z"] == 0.3


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = {k: np.round(rng.normal(size=n + k), 1 if k else 6) for k in (0, 1)}
    f = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [(0, None)], "k int, v double").repartition(3)
    for r in prefix.quantiles(f, "v", {"low": 0.05, "mid": 0.5, "high": 0.97}, "k").collect():
        assert np.allclose([r["low"], r["mid"], r["high"]], np.quantile(values[r["k"]], [0.05, 0.5, 0.97]))
    r = prefix.quantiles(f, "v", {"mid": 0.5}).first()
    assert np.isclose(r["mid"], np.quantile(np.concatenate(list(values.values())), 0.5))


def test_permutation_is_one_over_all_rows(spark):
    f = spark.createDataFrame([(i, float(i)) for i in range(400)], "k long, v double").repartition(3)
    got = {r["k"]: r["v"] for r in transforms.permuted(f, "v", "k", "s").collect()}
    assert sorted(got.values()) == [float(i) for i in range(400)] and sorted(got) == list(range(400))
    assert sum(got[i] == i for i in got) < 10 and np.abs(np.corrcoef(list(got), list(got.values()))[0, 1]) < 0.2


def test_equal_columns_are_compared_row_by_row(spark):
    f = spark.createDataFrame([(i, float(i), float(i), float(i if i else 5), None) for i in range(50)], "k long, a double, b double, c double, d double")
    got = {r["feature"]: r["representative"] for r in identity.duplicate_columns(f.withColumn("e", F.col("d")), "k", ["a", "b", "c", "d", "e"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}


def test_precedence_guard_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["train", "validation", "test"]), rng.randint(0, 40), rng.choice([None, *range(40)])) for i in range(150)]
    train = [r for r in rows if r[1] == "train"]
    hit = lambda r, others: any(r[k] is not None and r[k] == o[k] for o in others for k in (2, 3))
    validation = [r for r in rows if r[1] == "validation" and not hit(r, train)]
    test = [r for r in rows if r[1] == "test" and not hit(r, train + validation)]
    f = spark.createDataFrame(rows, "i int, split string, a int, b int").repartition(3)
    assert sorted(r["i"] for r in identity.precedence_guard(f, "split", "a", "b").collect()) == sorted(r[0] for r in train + validation + test)


def test_precedence_guard_shuffles_no_rows_by_keys_that_are_few(spark, monkeypatch):
    rows = [(i, ("train", "validation", "test", "other", None)[i % 5], i % 7, i % 3000) for i in range(6000)]
    f = spark.createDataFrame(rows, "i int, split string, few int, many int")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        made = identity.precedence_guard(f, "split", "few")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        few = sorted(r["i"] for r in made.collect())
        both = sorted(r["i"] for r in identity.precedence_guard(f, "split", "few", "many").collect())
        monkeypatch.setattr(identity, "BROADCAST_KEYS", 0)
        made = identity.precedence_guard(f, "split", "few")
        assert "SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["i"] for r in made.collect()) == few == [i for i in range(6000) if i % 5 == 0]
        assert sorted(r["i"] for r in identity.precedence_guard(f, "split", "few", "many").collect()) == both
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_balanced_assignment_and_repair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", c, int(n)) for i in range(300) for c, n in zip("xy", rng.integers(0, 9, 2), strict=True) if n] + [("rare1", "z", 1), ("rare2", "z", 2), ("rare3", "z", 3)]
    counts = spark.createDataFrame(rows, "component string, label string, n long")
    for size in (50_000, 0):
        monkeypatch.setattr(policies, "BROADCAST_RUNS", size)
        split = policies.repaired(policies.balanced(counts, ["x", "y", "z"], (0.7, 0.15, 0.15)), counts, ["x", "y", "z"])
        got = {r["component"]: r["split"] for r in split.collect()}
        assert set(got) == {r[0] for r in rows}
        held = collections.Counter()
        for c, label, n in rows:
            held[got[c], label] += n
        assert all(held[s, label] for s in ("train", "validation", "test") for label in "xyz")
        total = sum(n for *_, n in rows)
        assert abs(sum(n for (s, _), n in held.items() if s == "train") / total - 0.7) < 0.05
    lone = spark.createDataFrame([("a", "x", 5)], counts.schema)
    assert policies.repaired(policies.balanced(lone, ["x"], (0.7, 0.15, 0.15)), lone, ["x"]).count() == 1


def test_policies(spark):
    rows = [(i, f"g{i % 20}", f"f{i // 2}" if i < 40 else f"f{i}", "x" if i % 2 or i < 40 else "y", i) for i in range(300)] + [(900, "g1", "bad", "x", 1), (901, "g2", "bad", "y", 2)]
    f = spark.createDataFrame(rows, "i int, g string, fp string, s string, t int")
    apart = policies.policy_split(f, {"kind": "grouped", "group": "g", "drop_crossing": True}, "fp", "s", ["x", "y"])
    assert apart.count() == 260 and policies.feasibility(apart, F.lit(302), "s", "g", ["x", "y"]).first()["n_crossing"] == 0
    merged = policies.policy_split(f, {"kind": "grouped", "group": "g"}, "fp", "s", ["x", "y"])
    by = collections.defaultdict(set)
    for r in merged.collect():
        by[r["g"]].add(r["split"])
        by[r["fp"]].add(r["split"])
    assert merged.count() == 300 and all(len(v) == 1 for v in by.values())
    one = policies.feasibility(merged.filter("split = 'train'"), F.lit(302), "s", "g", ["x", "y"]).first()
    assert not one["feasible"] and one["reason"] == "missing_class" and one["n_dropped"] > 2
    with pytest.raises(ValueError):
        policies.policy_split(f, {"kind": "none"}, "fp", "s", ["x"])


def test_files_of_one_task_have_one_schema(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    preparation.same_schema({"x": a, "y": a})
    with pytest.raises(ValueError):
        preparation.same_schema({"x": a, "y": a.select("b", "a")})
    f = spark.createDataFrame([("2020-01-02 03:04:05", "17", " 10.0.0.1 "), ("no time", "x", None)], "t string, port string, ip string")
    rows = preparation.flow_metadata(f, F.col("t"), {"port": F.col("port")}, {"ip": F.col("ip")}).collect()
    assert [(r["timestamp"] is not None, r["port"], r["ip"]) for r in rows] == [(True, 17, "10.0.0.1"), (False, None, None)]


def test_replacement_operators_match_numpy(spark):
    """Replaced rows of all operators; a class that no donor has takes from the whole pool."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(40, 6)), 3)
    label = [i % 3 for i in range(40)]
    f = spark.createDataFrame([(i, label[i], x[i].tolist()) for i in range(40)], "flow long, label int, x array<double>").repartition(3)
    context = replacement.operator_context(f.filter("label < 2"), "flow", "x", "label", 8)
    pool = sorted((d["donor"], d["label"], tuple(d["x"])) for d in context.first()["pool"])
    train = x[[i for i in range(40) if label[i] < 2]]
    c = context.first()
    assert np.allclose(c["median"], np.median(train, 0)) and np.allclose(c["mean"], train.mean(0)) and np.allclose(c["sd"], np.sqrt(train.var(0, ddof=1) + 1e-6))
    assert len(pool) == 8 and all(d[1] < 2 and np.allclose(d[2], x[d[0]]) for d in pool)
    frame = replacement.with_context(f, context, replacement.class_medians(f, "x", "label"), "label").withColumn("selected", F.array(F.lit(1), F.lit(4)))
    named = [(o, replacement.replacement_row(o, F.col("flow"), F.col("x"), F.col("label"), F.col("selected"))) for o in replacement.OPERATORS]
    draw = lambda salt, k, n: int(hashlib.md5(f"{salt}|{k}".encode()).hexdigest()[:8], 16) % n
    for r in frame.select("flow", *[z.alias(o) for o, z in named]).collect():
        i = r["flow"]
        own = [d for d in pool if d[1] == label[i]] or pool
        free = [0, 2, 3, 5]
        distance = [(((x[i][free] - np.array(d[2])[free]) / np.array(c["sd"])[free]) ** 2).sum() for d in pool]
        assert np.allclose(r["training_median"], c["median"]) and np.allclose(r["target_class_median"], np.median(x[[k for k in range(40) if label[k] == label[i]]], 0))
        assert tuple(r["joint_donor"]) == pool[draw("joint-donor", i, 8)][2] and tuple(r["target_class_donor"]) == own[draw("class-donor", i, len(own))][2]
        assert tuple(r["nearest_neighbour_donor"]) == pool[int(np.argmin(distance))][2]
    groups = [0, 1, 2, 0, 1, 2]
    g = frame.select(replacement.expanded(F.array(F.lit(4), F.lit(1)), groups).alias("s"), replacement.group_matched_control(F.col("x"), F.col("median"), F.array(F.lit(4)), groups, 1, F.col("flow")).alias("m")).collect()
    assert all(r["s"] == [1, 4] and r["m"] in ([0, 3], [1, 4], [2, 5]) for r in g) and len({tuple(r["m"]) for r in g}) == 3


def test_conditional_gaussian_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    f = spark.createDataFrame([(i, x[i].tolist(), [2, 0]) for i in range(200)], "k long, x array<double>, s array<int>").repartition(3)
    mean, cov = explain.moments(f, "x")
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    sigma = cov + 1e-6 * np.eye(4)
    for r in explain.conditional_gaussian(f, "k", "x", "s", mean, cov).collect():
        gain = sigma[np.ix_([0, 2], [1, 3])] @ np.linalg.inv(sigma[np.ix_([1, 3], [1, 3])])
        assert np.allclose(r["values"], mean[[0, 2]] + gain @ (x[r["k"]][[1, 3]] - mean[[1, 3]]))
    drawn = {r["k"]: r["values"] for r in explain.conditional_gaussian(f, "k", "x", "s", mean, cov, draw=True).collect()}
    assert drawn == {r["k"]: r["values"] for r in explain.conditional_gaussian(f.coalesce(1), "k", "x", "s", mean, cov, draw=True).collect()}
    gain = sigma[np.ix_([0, 2], [1, 3])] @ np.linalg.inv(sigma[np.ix_([1, 3], [1, 3])])
    rest = np.array([drawn[i] - (mean[[0, 2]] + gain @ (x[i][[1, 3]] - mean[[1, 3]])) for i in range(200)])
    assert np.allclose(np.cov(rest, rowvar=False), sigma[np.ix_([0, 2], [0, 2])] - gain @ sigma[np.ix_([1, 3], [0, 2])], rtol=0.5, atol=0.2)
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [2, 0], [9.0, 8.0])], "x array<double>, s array<int>, v array<double>")
    assert one.select(explain.with_values(F.col("x"), F.col("s"), F.col("v")).alias("z")).first()["z"] == [9.0, 2.0, 8.0, 4.0]
    w = A.total(F.array(F.lit(1.0), F.lit(2.0)))
    assert spark.range(1).select(w.alias("t")).first()["t"] == 3.0


def test_local_surrogate_matches_weighted_ridge(spark):
    model = explain.Logit((0.4, -0.2, 0.7))
    f = spark.createDataFrame([(7, [1.0, 2.0, -1.0]), (8, [0.0, 0.5, 0.3])], "k long, x array<double>")
    for r in explain.lime(f, "k", "x", model, samples=400, width=0.75, ridge=0.5).collect():
        x = np.array({7: [1.0, 2.0, -1.0], 8: [0.0, 0.5, 0.3]}[r["k"]])
        z = np.random.default_rng([42, r["k"]]).standard_normal((400, 3))
        y = 1 / (1 + np.exp(-((x + z) @ np.array(model.weights) + model.bias)))
        d = np.exp(-(z * z).sum(1) / (2 * 0.75**2 * 3))
        design = np.column_stack([np.ones(400), z])  # with an intercept that carries no penalty
        penalty = np.diag([0.0, 0.5, 0.5, 0.5])
        coef = np.linalg.solve(design.T @ (d[:, None] * design) + penalty, design.T @ (d * y))
        rest, mean = y - design @ coef, np.average(y, weights=d)
        assert np.allclose(r["weights"], coef[1:]) and np.isclose(r["r2"], 1 - (d * rest**2).sum() / (d * (y - mean) ** 2).sum())
        assert np.sign(r["weights"]).tolist() == [1, -1, 1]


def test_feature_groups_match_clustering_by_hand(spark):
    """Clusters merged two at a time by mean distance, with names instead of places."""
    from veritab.operators import grouping

    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 3))
    columns = {"a": base[:, 0], "b": base[:, 0] + 0.1 * base[:, 1], "c": -base[:, 0] ** 3, "d": base[:, 1], "e": base[:, 1] + 0.3 * base[:, 2], "f": base[:, 2], "g": np.round(base[:, 2], 1), "h": rng.normal(size=300)}
    f = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns))

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    far = {frozenset((p, q)): 1 - abs(np.corrcoef(ranks(columns[p]), ranks(columns[q]))[0, 1]) for p in columns for q in columns if p < q}
    distances = grouping.feature_distance(f, list(columns))
    assert all(np.isclose(r["distance"], far[frozenset((r["left_feature"], r["right_feature"]))]) for r in distances.collect())
    clusters = [{c} for c in columns]
    while len(clusters) > 1:
        mean, p, q = min((np.mean([far[frozenset((u, v))] for u in a for v in b]), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if mean > 0.3:
            break
        clusters[p] = clusters[p] | clusters.pop(q)
    got = collections.defaultdict(set)
    for r in grouping.feature_groups(distances, list(columns), 0.3, 0.5).collect():
        got[r["group"]].add(r["feature"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, clusters)) and {"a", "b", "c"} in clusters
    small = grouping.feature_groups(distances, list(columns), 0.3, 0.25).toPandas().groupby("group").size()
    assert small.max() <= 2 or small.max() == 3
