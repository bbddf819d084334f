"""Queries on scope filters, contracts between tables, prediction tables, label and secret rules, and audit roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions import filters, labels
from veritab.functions.hashing import unit_sql
from veritab.operators import aggregates, identity, joins, metrics, policies, preparation, resampling, seeds
from veritab.plans._adapter import ACCOUNTS, PREDICTIONS, ROWS, SIMILARITY, accounts, predictions, r6, rows, similar, table
from veritab.sources import tables

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("WITH" + ROWS + " SELECT label, source, count(*)::BIGINT AS n FROM rowset WHERE label IN ('A', 'R') AND source IN (1995, 1996) GROUP BY ALL")
def scope_filter(spark, sf_dir):
    return rows(spark, sf_dir).filter(filters.in_scope(label=["A", "R"], source=[1995, 1996])).groupBy("label", "source").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT p_brand AS dataset, count(*) % 30 + 10 AS n_features FROM part GROUP BY 1), a AS (SELECT p_brand AS dataset, CASE WHEN p_partkey % 5 = 0 THEN 'runs/all.csv' ELSE 'runs/' || p_brand || '/top' || (CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END) || p_size::VARCHAR || '_x.csv' END AS path, p_size, p_partkey FROM part)
SELECT dataset, count(*)::BIGINT AS n, count(*) FILTER (WHERE p_partkey % 5 = 0)::BIGINT AS n_without_k FROM a JOIN f USING (dataset) WHERE p_partkey % 5 = 0 OR p_size < n_features GROUP BY dataset""")
def valid_top_k_artifacts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    counts = p.groupBy(F.col("p_brand").alias("dataset")).agg((F.count("*") % 30 + 10).alias("n_features"))
    named = F.concat(F.lit("runs/"), F.col("p_brand"), F.lit("/top"), F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(""), F.col("p_size").cast("string"), F.lit("_x.csv"))
    a = p.select(F.col("p_brand").alias("dataset"), F.when(F.col("p_partkey") % 5 == 0, "runs/all.csv").otherwise(named).alias("path"), "p_partkey")
    kept = filters.valid_top_k(a, "path", counts, "dataset", "n_features")
    return kept.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("p_partkey") % 5 == 0).alias("n_without_k"))


@query("WITH" + PREDICTIONS + " SELECT flow, event_type, round(p1, 6) AS p1 FROM pred WHERE d1 = truth AND seed = 43 AND truth = 1 AND flow % 8 < 4")
def condition_units(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("central", F.col("d1") == F.col("truth")).withColumn("stochastic", F.col("flow") % 8 < 4)
    return filters.condition_units(p, {"seed": 43, "truth": 1}, "central", "stochastic").select("flow", "event_type", r6("p1").alias("p1"))


@query("""WITH t AS (SELECT n_name AS task, n_regionkey AS policy, count(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING') AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT task, n::BIGINT AS n FROM t WHERE policy = 2 AND n >= 1""")
def feasible_tasks(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    t = joined.groupBy(F.col("n_name").alias("task"), F.col("n_regionkey").alias("policy")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("n"))
    return filters.feasible(t.withColumn("feasible", F.col("n") >= 1), "policy", 2).select("task", "n")


@query("WITH" + PREDICTIONS + """, s AS (SELECT DISTINCT event_type, seed FROM pred WHERE truth = 1 OR flow % 3 = 0) SELECT event_type, seed, count(*)::BIGINT AS n, round(avg(p1), 6) AS p1 FROM pred p WHERE EXISTS (SELECT 1 FROM s WHERE s.event_type = p.event_type AND s.seed = p.seed AND s.seed <> 44) GROUP BY ALL""")
def scope_semi_join(spark, sf_dir):
    p = predictions(spark, sf_dir)
    scope = p.filter("(truth = 1 or flow % 3 = 0) and seed <> 44")
    return filters.in_pairs(p, scope, ["event_type", "seed"]).groupBy("event_type", "seed").agg(F.count("*").alias("n"), r6(F.avg("p1")).alias("p1"))


@query("WITH" + SIMILARITY + """, m AS (SELECT flow, list_sum(m) AS mass, list_max(m) AS top, len(list_filter(m, lambda x: x > 0)) AS nonzero FROM acc)
SELECT flow, round(mass, 6) AS mass, round(top, 6) AS top, nonzero::DOUBLE AS nonzero FROM m""")
def aligned_accounts(spark, sf_dir):
    """Three tables of the same flows in one row each; a table that lacks a flow would be an error."""
    a = accounts(spark, sf_dir)
    parts = {"mass": A.total(F.col("m")), "top": F.array_max("m"), "nonzero": F.size(F.filter("m", lambda x: x > 0)).cast("double")}
    wide = joins.aligned({n: a.select("flow", v.alias("v")) for n, v in parts.items()}, "flow", "v")
    return wide.select("flow", r6("mass").alias("mass"), r6("top").alias("top"), "nonzero")


@query("WITH" + PREDICTIONS + """, a AS (SELECT event_type, seed, avg((d1 = truth)::INT) AS accuracy FROM pred GROUP BY ALL), b AS (SELECT event_type, seed, 1 - avg(abs(p1 - p2)) AS stability FROM pred WHERE flow % 4 <> 0 GROUP BY ALL)
SELECT event_type, seed, round(accuracy, 6) AS accuracy, round(stability, 6) AS stability FROM a JOIN b USING (event_type, seed)""")
def performance_and_stability(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = p.groupBy("event_type", "seed").agg(F.avg((F.col("d1") == F.col("truth")).cast("int")).alias("accuracy"))
    b = p.filter("flow % 4 <> 0").groupBy("event_type", "seed").agg((1 - F.avg(F.abs(F.col("p1") - F.col("p2")))).alias("stability"))
    return joins.one_to_one(a, b, ["event_type", "seed"]).select("event_type", "seed", r6("accuracy").alias("accuracy"), r6("stability").alias("stability"))


@query("WITH" + ROWS + """, s AS (SELECT DISTINCT source, label FROM rowset WHERE NOT (source = 1995 AND label = 'R')), c AS (SELECT source, string_agg(label, ',' ORDER BY label) AS classes FROM s GROUP BY source)
SELECT source, classes, classes = 'A,N,R' AS complete FROM c""")
def class_sets_per_split(spark, sf_dir):
    """The classes of each split, and whether they are all that there are."""
    r = rows(spark, sf_dir).filter(~((F.col("source") == 1995) & (F.col("label") == "R")))
    return identity.class_sets(r, "source", "label", ["A", "N", "R"]).select("source", F.array_join("classes", ",").alias("classes"), "complete")


@query("""WITH c AS (SELECT p_type AS task, p_brand AS candidate, round(avg(p_retailprice), 4) AS f2, round(avg(p_size), 4) AS loss, count(*) AS n FROM part GROUP BY ALL)
SELECT task, candidate, f2, loss FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY f2 DESC, loss, n, candidate) AS k FROM c) t WHERE k = 1""")
def best_candidate(spark, sf_dir):
    """The candidate of each task by several keys; columns of the test split may not decide."""
    p = table(spark, sf_dir, "part")
    c = p.groupBy(F.col("p_type").alias("task"), F.col("p_brand").alias("candidate")).agg(F.round(F.avg("p_retailprice"), 4).alias("f2"), F.round(F.avg("p_size"), 4).alias("loss"), F.count("*").alias("n"))
    return metrics.best_candidate(c, [("f2", True), ("loss", False), ("n", False), ("candidate", False)], "task").select("task", "candidate", "f2", "loss")


@query("WITH" + PREDICTIONS + """ SELECT flow, seed, truth, d1 AS pred, round(1 - p1, 6) AS prob_0, round(p1, 6) AS prob_1, round(CASE WHEN d1 = 1 THEN p1 ELSE 1 - p1 END, 6) AS confidence, round(abs(2 * p1 - 1), 6) AS margin, 0.5::DOUBLE AS decision_threshold, d1 = truth AS correct FROM pred""")
def prediction_table(spark, sf_dir):
    """Predictions as they are stored: a probability column for each class, the decision and its confidence."""
    p = predictions(spark, sf_dir).select("flow", "seed", "truth", F.array(1 - F.col("p1"), F.col("p1")).alias("p"))
    t = metrics.prediction_table(p, "p", ["0", "1"], "truth", 0.5)
    names = filters.probability_columns(t)
    return t.select("flow", "seed", "truth", "pred", *[r6(n).alias(n) for n in names], r6("confidence").alias("confidence"), r6("margin").alias("margin"), "decision_threshold", "correct")


@query("WITH" + PREDICTIONS + """, b AS (SELECT seed, flow % 4 AS batch, sum((truth = 1 AND d1 = 1)::INT * w) AS tp, sum((truth = 0 AND d1 = 1)::INT * w) AS fp, sum((truth = 1 AND d1 = 0)::INT * w) AS fn FROM (SELECT *, 1 + flow % 3 AS w FROM pred) t GROUP BY ALL)
SELECT seed, round(5.0::DOUBLE * sum(tp) / (5 * sum(tp) + 4 * sum(fn) + sum(fp)), 6) AS f2, sum(tp)::DOUBLE AS tp FROM b GROUP BY seed""")
def f2_by_batches(spark, sf_dir):
    """Weighted counts of each batch, added up, then one score."""
    p = predictions(spark, sf_dir).withColumn("w", (1 + F.col("flow") % 3).cast("double")).withColumn("batch", F.col("flow") % 4)
    return metrics.f2_of(metrics.decision_counts(p, "truth", "d1", "w", "seed", "batch"), "seed").select("seed", r6("f2").alias("f2"), "tp")


@query("WITH" + PREDICTIONS + """, c AS (SELECT event_type, m, count(*) AS n, count(DISTINCT d) AS k FROM (SELECT event_type, 'one' AS m, d1 AS d FROM pred WHERE flow % 5 = 0 UNION ALL SELECT event_type, 'two', d2 FROM pred WHERE flow % 5 = 0) t GROUP BY ALL), e AS (SELECT event_type, m, n >= 40 AND k >= 2 AS ok, n FROM c)
SELECT event_type, bool_and(ok) AS eligible, min(ok) = max(ok) AS models_agree, min(n)::BIGINT AS n_validation FROM e GROUP BY event_type""")
def class_eligibility(spark, sf_dir):
    """Classes with enough frozen validation rows; both models must say the same."""
    v = predictions(spark, sf_dir).filter("flow % 5 = 0")
    models = F.inline(F.array(F.struct(F.lit("one").alias("model"), F.col("d1").alias("d")), F.struct(F.lit("two").alias("model"), F.col("d2").alias("d"))))
    counts = v.select("event_type", models).groupBy("event_type", "model").agg(F.count("*").alias("n"), F.countDistinct("d").alias("k"))
    return metrics.class_eligibility(counts.withColumn("ok", (F.col("n") >= 40) & (F.col("k") >= 2)), "event_type", "model", 2, "ok", "n")


@query("""SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS code, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def label_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(labels.encoded(F.col("event_type"), ["click", "error", "purchase", "signup", "view"]).alias("code"), "event_type").agg(F.count("*").alias("n"))


PLANTED = [
    (-1, "token ghp_" + "a1B2" * 6), (-2, "key AKIA" + "ABCD1234" * 2), (-3, "-----BEGIN RSA PRIVATE KEY-----"), (-4, "Password = 'correct horse battery'"), (-5, "see /home/someone/notes and /Users/other/x"), (-6, r"C:\Users\someone\file"), (-7, "password = 'short'"), (-8, "nothing of the kind"), (-9, "AKIAABC -----BEGIN PUBLIC KEY----- ghp_short /homes/x"),
]
PLANTED_SQL = ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in PLANTED)
RULES_SQL = ", ".join(f"('{n}', '" + p.replace("'", "''") + "')" for n, p in labels.SENSITIVE.items())


@query(f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {PLANTED_SQL}) v(doc_id, text)), r AS (SELECT * FROM (VALUES {RULES_SQL}) v(rule, pattern))
SELECT doc_id::BIGINT AS doc_id, rule FROM d, r WHERE regexp_matches(text, pattern)""")
def secret_scan(spark, sf_dir):
    """The rules that documents and some planted texts break."""
    planted = spark.createDataFrame(PLANTED, "doc_id long, text string")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(planted)
    return d.select("doc_id", F.explode(labels.sensitive(F.col("text"))).alias("rule"))


@query("SELECT * FROM (VALUES ('clean', ''), ('linked', 'direct_linkage_field:raw_fingerprint'), ('linked', 'direct_linkage_field:sample_order'), ('linked', 'direct_linkage_field:tensor_fingerprint_new'), ('legacy', 'nonopaque_flow_id')) t(tab, finding) WHERE (SELECT count(*) FROM customer) > 0")
def linkability_guard(spark, sf_dir):
    """Findings on three tables made of customers: sound, with linking columns, and with other ids."""
    c = table(spark, sf_dir, "customer")
    opaque = F.concat(F.lit("rid_"), F.md5(F.col("c_custkey").cast("string")))
    cases = {
        "clean": c.select(F.when(F.col("c_custkey") % 7 == 0, "").otherwise(opaque).alias(" Flow_ID "), "c_acctbal"),
        "linked": c.select(opaque.alias("flow_id"), F.lit(1).alias("Sample_Order "), F.lit("x").alias("raw_fingerprint"), F.lit("y").alias("tensor_fingerprint_new")),
        "legacy": c.select(F.when(F.col("c_custkey") == 1, "case-000001").otherwise(opaque).alias("flow_id")),
    }
    found = [(name, x) for name, f in cases.items() for x in tables.linkability_findings(f) or [""]]  # a few names for each table
    return spark.createDataFrame(sorted(found), "tab string, finding string")


@query("""WITH u AS (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 50 END AS unit, event_type, event_id, value FROM events)
SELECT unit, max((value > 60)::INT) = 1 AS any_high, arg_min(event_type, event_id) AS first_type, count(*)::BIGINT AS n FROM u GROUP BY unit""")
def collapsed_units(spark, sf_dir):
    """Repeated units as one row: flags by maximum, attributes of the first; a null unit is a unit."""
    e = table(spark, sf_dir, "events").withColumn("unit", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 50)).withColumn("high", F.col("value") > 60)
    return identity.collapsed(e, ["unit"], {"any_high": "high"}, {"first_type": "event_type"}, "event_id")


@query("WITH" + SIMILARITY + """, e AS (SELECT label, seed, avg(rank_ok::INT) AS rank_share, avg(top_ok::INT) AS top_share, count(*) AS n FROM simil GROUP BY ALL)
SELECT label, count(*)::BIGINT AS n_seeds, sum(n)::BIGINT AS n_pairs, round(min(top_share), 6) AS least_share, round(greatest(0.95 - min(top_share), 0), 6) AS shortfall FROM e GROUP BY label""")
def coverage_shortfall(spark, sf_dir):
    """How far the identified share of the weakest seed stays below the threshold."""
    s = similar(spark, sf_dir)
    c = seeds.coverage(s, "top_k_pair_identifiable", "label")
    n = s.groupBy("label").agg(F.count("*").alias("n_pairs"))
    least = F.col("minimum_seed_fraction")
    return c.join(n, "label").select("label", "n_seeds", "n_pairs", r6(least).alias("least_share"), r6(F.greatest(F.lit(0.95) - least, F.lit(0.0))).alias("shortfall"))


@query("WITH" + PREDICTIONS + """, t AS (SELECT *, CASE WHEN truth = 1 AND d1 = 1 THEN 'TP' WHEN truth = 0 AND d1 = 0 THEN 'TN' WHEN d1 = 1 THEN 'FP' ELSE 'FN' END AS outcome FROM pred),
s AS (SELECT outcome, seed, avg(v) AS v FROM (SELECT outcome, seed, flow, avg(p1 - p2) AS v FROM t GROUP BY ALL) a GROUP BY ALL)
SELECT s.outcome, round(avg(s.v), 6) AS effect, round(min(s.v), 6) AS least_seed, (SELECT count(DISTINCT flow) FROM t WHERE t.outcome = s.outcome)::BIGINT AS n_sources, (SELECT count(DISTINCT (seed, flow)) FROM t WHERE t.outcome = s.outcome)::BIGINT AS n_seed_flow_cells, count(*)::BIGINT AS n_seeds, (SELECT count(*) FROM t WHERE t.outcome = s.outcome)::BIGINT AS n_rows FROM s GROUP BY s.outcome""")
def outcome_effects(spark, sf_dir):
    """Effects by outcome with equal weight for each seed, and what they rest on (Q16, Q25, Q29)."""
    p = predictions(spark, sf_dir).withColumn("outcome", labels.error_type(F.col("truth"), F.col("d1"))).withColumn("effect", F.col("p1") - F.col("p2"))
    per = seeds.seed_means(p, "effect", "outcome").groupBy("outcome").agg(r6(F.avg("estimate")).alias("effect"), r6(F.min("estimate")).alias("least_seed"))
    return per.join(p.groupBy("outcome").agg(*seeds.support()), "outcome")


@query("WITH" + PREDICTIONS + """, m AS (SELECT seed, avg((d1 = truth)::INT) AS accuracy, avg((p1 - truth) * (p1 - truth)) AS brier, avg(truth) AS base_rate FROM pred GROUP BY seed),
l AS (SELECT seed, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT seed, 'brier', brier FROM m UNION ALL SELECT seed, 'base_rate', base_rate FROM m)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*)::BIGINT AS n_seeds FROM l GROUP BY metric""")
def predictive_context(spark, sf_dir):
    """Mean and deviation over seeds of each metric."""
    p, t = predictions(spark, sf_dir), F.col("truth")
    m = p.groupBy("seed").agg(F.avg((F.col("d1") == t).cast("int")).alias("accuracy"), F.avg((F.col("p1") - t) * (F.col("p1") - t)).alias("brier"), F.avg(t).alias("base_rate"))
    long = m.select("seed", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in ("accuracy", "brier", "base_rate")])))
    out = seeds.mean_and_sd(long, "v", "metric")
    return out.select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), "n_seeds")


@query("WITH" + ACCOUNTS + """, x AS (SELECT flow, label, m, list_reverse_sort(m) AS d FROM acc), b AS (SELECT label, flow, d[10] - d[11] AS gap, greatest(1e-12, d[1] * 1e-8) AS eps, list_sum(m) AS mass FROM x)
SELECT label, count(*)::BIGINT AS records, count(*) FILTER (WHERE gap <= eps)::BIGINT AS nonidentifiable, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS largest_gap, round(avg(mass), 5) AS mean_mass FROM b GROUP BY label""")
def boundary_rollup(spark, sf_dir):
    """Boundary gaps of all accounts by class, from stored records only (Q31, Q32)."""
    a = accounts(spark, sf_dir).select("label", F.array_max("m").alias("top"), A.diagnostics(F.col("m")).alias("d"))
    eps = F.greatest(F.lit(1e-12), F.col("top") * 1e-8)
    g = F.col("d.boundary_gap")
    return a.groupBy("label").agg(F.count("*").alias("records"), F.count_if(g <= eps).alias("nonidentifiable"), r6(aggregates.quantile(g, 0.5)).alias("median_gap"), r6(F.max(g)).alias("largest_gap"), F.round(F.avg("d.mass"), 5).alias("mean_mass"))


@query()
def bootstrap_agreement(spark, sf_dir):
    """Whether the two resampling laws agree: centres and widths of their intervals for each class (M5)."""
    s = similar(spark, sf_dir)
    a = resampling.crossed_bootstrap(s, "normalized_mass_l1", "label", resamples=1_000).select("label", "estimate", (F.col("ci_high") - F.col("ci_low")).alias("width"), ((F.col("ci_high") + F.col("ci_low")) / 2).alias("centre"))
    b = resampling.hash_interval(s, "normalized_mass_l1", "label", replicates=200).select("label", (F.col("ci_high") - F.col("ci_low")).alias("hash_width"), ((F.col("ci_high") + F.col("ci_low")) / 2).alias("hash_centre"))
    j = joins.one_to_one(a, b, ["label"])
    return j.withColumn("agrees", (F.abs(F.col("centre") - F.col("hash_centre")) <= F.greatest("width", "hash_width")) & (F.col("hash_width") <= 4 * F.col("width")) & (F.col("width") <= 4 * F.col("hash_width")))


@query()
def cluster_intervals(spark, sf_dir):
    """Intervals from whole users drawn anew, and of the paired difference of two scores."""
    p = predictions(spark, sf_dir).withColumn("difference", F.col("p1") - F.col("p2"))
    one = resampling.cluster_bootstrap(p, "p1", "user_id", "event_type").withColumn("value", F.lit("p1"))
    return one.unionByName(resampling.cluster_bootstrap(p, "difference", "user_id", "event_type").withColumn("value", F.lit("difference")))


@query("WITH" + PREDICTIONS + """, e AS (SELECT seed, event_type, count(*) FILTER (WHERE d1 = truth) AS a, count(*) AS n FROM pred GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY a::DOUBLE / n DESC, event_type) AS place FROM e)
SELECT seed, event_type, place::BIGINT AS place, round(a::DOUBLE / n, 6) AS accuracy FROM w""")
def condition_ranking(spark, sf_dir):
    """Conditions of each seed in the order of their accuracy (Q35)."""
    p = predictions(spark, sf_dir).groupBy("seed", "event_type").agg(F.avg((F.col("d1") == F.col("truth")).cast("double")).alias("accuracy"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("accuracy"), "event_type"))  # a handful of rows a seed
    return p.select("seed", "event_type", place.cast("long").alias("place"), r6("accuracy").alias("accuracy"))


STATUSES = ["F", "O", "P"]
POLICIES = {
    "temporal": {"kind": "temporal", "order": "o_orderdate"},
    "grouped": {"kind": "grouped", "group": "o_custkey"},
    "grouped_disjoint": {"kind": "grouped", "group": "o_custkey", "drop_crossing": True},
}


def policy_rows(spark, sf_dir):
    """Orders with a fingerprint that a few orders share."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.concat_ws("|", F.floor(F.col("o_totalprice")).cast("string"), "o_orderpriority").alias("fp"))


POLICY_SQL = """WITH o AS (SELECT o_orderkey, o_custkey AS g, o_orderstatus AS s, floor(o_totalprice)::BIGINT::VARCHAR || '|' || o_orderpriority AS fp FROM orders),
k AS (SELECT * FROM o WHERE fp NOT IN (SELECT fp FROM o GROUP BY fp HAVING count(DISTINCT s) > 1)), x AS (SELECT * FROM k WHERE fp NOT IN (SELECT fp FROM k GROUP BY fp HAVING count(DISTINCT g) > 1)),
n AS (SELECT (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM x) AS disjoint_)
SELECT 'temporal' AS policy, kept::BIGINT AS n_kept, (total - kept)::BIGINT AS n_dropped, 0::BIGINT AS n_crossing, true AS feasible, '' AS reason FROM n
UNION ALL SELECT 'grouped_disjoint', disjoint_::BIGINT, (total - disjoint_)::BIGINT, 0::BIGINT, true, '' FROM n"""


@query(POLICY_SQL)
def policy_splits(spark, sf_dir):
    """Feasibility of split policies (G6, G10): rows kept and dropped, no group in two splits, all classes everywhere."""
    o = policy_rows(spark, sf_dir)
    total = F.lit(o.count())
    out = None
    for name in ("temporal", "grouped_disjoint"):
        p = POLICIES[name]
        split = policies.policy_split(o, p, "fp", "o_orderstatus", STATUSES)
        one = policies.feasibility(split, total, "o_orderstatus", p.get("group", "fp"), STATUSES).select(F.lit(name).alias("policy"), "n_kept", "n_dropped", "n_crossing", "feasible", "reason")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def merged_group_split(spark, sf_dir):
    """Groups merged over shared fingerprints: one component may hold most rows, which feasibility tells."""
    o = policy_rows(spark, sf_dir)
    split = policies.policy_split(o, POLICIES["grouped"], "fp", "o_orderstatus", STATUSES)
    return policies.feasibility(split, F.lit(o.count()), "o_orderstatus", "o_custkey", STATUSES)


def raw_rows(spark, sf_dir):
    """Lineitem rows as files by year would hold them: one feature as text, here and there no number."""
    r = rows(spark, sf_dir)
    return r.withColumn("quantity", F.when(F.col("quantity") == 13, "n/a").when(F.col("quantity") == 17, "Infinity").otherwise(F.col("quantity").cast("string"))).withColumn("k", F.concat_ws("|", "k", F.col("price").cast("string")))


RAW_SQL = "WITH" + ROWS + f""", raw AS (SELECT *, quantity IN (13, 17) AS bad, k || '|' || price::VARCHAR AS kk FROM rowset),
pr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {unit_sql('reservoir', 'kk')}, kk) AS place FROM raw WHERE NOT bad), kp AS (SELECT * FROM pr WHERE place <= 800)"""


@query(RAW_SQL + """, a AS (SELECT source, label, count(*)::BIGINT AS n_read, count(*) FILTER (WHERE bad)::BIGINT AS n_dropped FROM raw GROUP BY ALL), b AS (SELECT source, label, count(*)::BIGINT AS n_kept FROM kp GROUP BY ALL)
SELECT source, label, n_read, n_dropped, coalesce(n_kept, 0)::BIGINT AS n_kept FROM a LEFT JOIN b USING (source, label)""")
def finite_capped_inventory(spark, sf_dir):
    """Rows read, dropped and kept by file and class."""
    r = raw_rows(spark, sf_dir)
    kept = preparation.finite_capped(r, ["quantity", "price"], "label", "source", "k", 800)
    return preparation.inventory(r, kept, ["quantity", "price"], "label", "source")


@query(RAW_SQL + """, fp AS (SELECT quantity, price, min(label) AS l FROM kp GROUP BY quantity, price HAVING count(DISTINCT label) = 1)
SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_shared, 0::BIGINT AS n_missing_classes, true AS train_mean_is_0, true AS near_target FROM fp""")
def prepared_task(spark, sf_dir):
    """A task prepared from raw rows to scaled splits, and what its invariants say."""
    kept = preparation.finite_capped(raw_rows(spark, sf_dir), ["quantity", "price"], "label", "source", "k", 800)
    p = preparation.prepared(kept, ["quantity", "price"], "label", "k", ["A", "N", "R"])
    train = F.col("split") == "train"
    one = p.agg(F.count("*").alias("n_rows"), (F.abs(F.avg(F.when(train, F.col("price")))) < 1e-6).alias("train_mean_is_0"), (F.abs(F.avg(train.cast("int")) - 0.7) < 0.02).alias("near_target"))
    return one.crossJoin(preparation.invariants(p, "label", ["A", "N", "R"]))


@query("""WITH p AS (SELECT event_type AS method, 'run' || (event_id % 4) AS run, CASE event_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'reference' ELSE 'replicate' END AS role, user_id FROM events),
s AS (SELECT method, run, role, count(DISTINCT user_id)::BIGINT AS n FROM p GROUP BY ALL), both_ AS (SELECT a.method, a.run AS l, b.run AS r, count(DISTINCT a.user_id)::BIGINT AS n_shared FROM p a JOIN p b ON a.method = b.method AND a.user_id = b.user_id GROUP BY ALL)
SELECT a.method, a.run AS left_run, b.run AS right_run, CASE WHEN a.role = 'primary' THEN b.role || '_versus_primary' ELSE 'between_replicates' END AS comparison, a.n AS n_left, b.n AS n_right, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM s a JOIN s b ON a.method = b.method LEFT JOIN both_ ON both_.method = a.method AND l = a.run AND both_.r = b.run WHERE (a.role = 'primary' AND b.role <> 'primary') OR (a.role = 'replicate' AND b.role = 'replicate' AND a.run < b.run)""")
def probe_comparisons(spark, sf_dir):
    """Pairs of a method's runs by role, with the sources that each run has and that both share (Q8, Q9)."""
    m = F.col("event_id") % 4
    role = F.when(m == 0, "primary").when(m == 1, "reference").otherwise("replicate")
    p = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.concat(F.lit("run"), m.cast("string")).alias("run"), role.alias("role"), "user_id").distinct()
    sizes = p.groupBy("method", "run", "role").agg(F.count("*").alias("n"))
    left, right = sizes.toDF("method", "left_run", "left_role", "n_left"), sizes.toDF("method", "right_run", "right_role", "n_right")
    with_primary = (F.col("left_role") == "primary") & (F.col("right_role") != "primary")
    replicates = (F.col("left_role") == "replicate") & (F.col("right_role") == "replicate") & (F.col("left_run") < F.col("right_run"))
    pairs = left.join(right, "method").filter(with_primary | replicates)  # a row for each method and run
    # runs of one source meet: four at most
    runs = p.groupBy("method", "user_id").agg(F.collect_set("run").alias("runs")).select("method", F.explode("runs").alias("left_run"), "runs")
    shared = runs.select("method", "left_run", F.explode("runs").alias("right_run")).groupBy("method", "left_run", "right_run").agg(F.count("*").alias("n_shared"))
    named = F.when(F.col("left_role") == "primary", F.concat("right_role", F.lit("_versus_primary"))).otherwise("between_replicates")
    return pairs.join(shared, ["method", "left_run", "right_run"], "left").select("method", "left_run", "right_run", named.alias("comparison"), "n_left", "n_right", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))


@query("WITH" + PREDICTIONS + """, g AS (SELECT user_id, min(epoch_us(ts)) AS t, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT user_id, (sum(n) OVER (ORDER BY t, user_id ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(n) OVER () AS s FROM g),
a AS (SELECT p.*, CASE WHEN s <= 0.7 THEN 'train' WHEN s <= 0.85 THEN 'validation' ELSE 'test' END AS policy_split, CASE WHEN flow % 20 < 14 THEN 'train' WHEN flow % 20 < 17 THEN 'validation' ELSE 'test' END AS base_split FROM pred p JOIN c ON p.user_id = c.user_id),
m AS (SELECT 'temporal' AS policy, avg((d1 = truth)::INT) FILTER (WHERE policy_split = 'test') AS accuracy, avg((p1 - truth) * (p1 - truth)) FILTER (WHERE policy_split = 'test') AS brier, count(*) FILTER (WHERE policy_split = 'test')::BIGINT AS n FROM a UNION ALL SELECT 'baseline', avg((d1 = truth)::INT) FILTER (WHERE base_split = 'test'), avg((p1 - truth) * (p1 - truth)) FILTER (WHERE base_split = 'test'), count(*) FILTER (WHERE base_split = 'test')::BIGINT FROM a)
SELECT policy, n, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(accuracy - (SELECT accuracy FROM m WHERE policy = 'baseline'), 6) AS accuracy_change FROM m""")
def policy_versus_baseline(spark, sf_dir):
    """Test metrics under a temporal split of whole users and under the baseline split (Q18, Q21)."""
    from veritab.operators.sampling import temporal_split

    p = predictions(spark, sf_dir)
    groups = p.groupBy("user_id").agg(F.min("ts").alias("t"), F.count("*").alias("n"))
    split = temporal_split(groups, "t", "n", (0.7, 0.85)).select("user_id", F.col("split").alias("policy_split"))
    m = F.col("flow") % 20
    a = p.join(split, "user_id").withColumn("base_split", F.when(m < 14, "train").when(m < 17, "validation").otherwise("test"))
    sides = F.inline(F.array(F.struct(F.lit("temporal").alias("policy"), F.col("policy_split").alias("split")), F.struct(F.lit("baseline").alias("policy"), F.col("base_split").alias("split"))))
    tested = a.select("d1", "truth", "p1", sides).filter("split = 'test'")
    out = tested.groupBy("policy").agg(F.count("*").alias("n"), F.avg((F.col("d1") == F.col("truth")).cast("int")).alias("accuracy"), F.avg((F.col("p1") - F.col("truth")) * (F.col("p1") - F.col("truth"))).alias("brier"))
    base = F.max(F.when(F.col("policy") == "baseline", F.col("accuracy"))).over(Window.partitionBy())  # two rows
    return out.select("policy", "n", r6("accuracy").alias("accuracy"), r6("brier").alias("brier"), r6(F.col("accuracy") - base).alias("accuracy_change"))
