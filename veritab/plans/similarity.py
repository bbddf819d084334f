"""Queries on account similarity, coverage and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.operators import gates, seeds
from veritab.plans._adapter import ACCOUNTS, PAIRS, SIMILARITY, account_pairs, accounts, r6, similar, table

QUERIES, ORACLE_SQL = {}, {}

METRICS = ("spearman", "jaccard_10", "weighted_jaccard", "normalized_mass_l1")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long_similarity(spark, sf_dir):
    """flow, seed, label, metric, value, identified."""
    wide = similar(spark, sf_dir)
    flags = {"spearman": "rank_pair_identifiable", "jaccard_10": "top_k_pair_identifiable"}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(flags.get(m, "account_pair_nonzero")).alias("identified")) for m in METRICS])
    return wide.select("flow", "seed", "label", F.inline(cells))


LONG = SIMILARITY + """,
cells AS (SELECT flow, seed, label, 'spearman' AS metric, spearman AS value, rank_ok AS identified FROM simil
          UNION ALL SELECT flow, seed, label, 'jaccard_10', jaccard_10, top_ok FROM simil
          UNION ALL SELECT flow, seed, label, 'weighted_jaccard', weighted_jaccard, sx >= 1e-12 AND sy >= 1e-12 FROM simil
          UNION ALL SELECT flow, seed, label, 'normalized_mass_l1', normalized_mass_l1, sx >= 1e-12 AND sy >= 1e-12 FROM simil)"""
SUMMARY = LONG + """,
per_flow AS (SELECT label, metric, seed, flow, avg(value) AS v FROM cells GROUP BY ALL),
per_seed AS (SELECT label, metric, seed, avg(v) AS v, count(*) AS n FROM per_flow GROUP BY ALL),
shares AS (SELECT label, metric, seed, avg(identified::INT::DOUBLE) AS share, sum(identified::INT) AS hits, count(*) AS n FROM cells GROUP BY ALL),
cover AS (SELECT label, metric, sum(hits) / sum(n)::DOUBLE AS coverage_fraction, min(share) AS minimum_seed_fraction, count(*) = 5 AS all_seeds FROM shares GROUP BY ALL),
summary AS (SELECT p.label, p.metric, avg(v) AS estimate, any_value(all_seeds) AS all_seeds, any_value(minimum_seed_fraction) AS minimum_seed_fraction FROM per_seed p JOIN cover c ON p.label = c.label AND p.metric = c.metric GROUP BY p.label, p.metric)"""


def gated(threshold: str = "0.95", bound: str = "estimate") -> str:
    return f""",
gated AS (SELECT *, CASE WHEN NOT all_seeds THEN 'not_evaluable_seed_coverage' WHEN minimum_seed_fraction < {threshold} THEN 'not_evaluable_account_coverage'
                 WHEN metric = 'spearman' THEN CASE WHEN estimate >= 0.8 THEN 'pass' ELSE 'fail' END
                 WHEN metric = 'weighted_jaccard' THEN CASE WHEN estimate >= 0.7 THEN 'pass' ELSE 'fail' END
                 WHEN metric = 'jaccard_10' THEN CASE WHEN estimate >= 0.6 THEN 'pass' ELSE 'fail' END
                 ELSE CASE WHEN estimate <= 0.2 THEN 'pass' ELSE 'fail' END END AS gate_status FROM summary)"""


def summary(spark, sf_dir, threshold: float = 0.95):
    """label, metric, estimate, minimum_seed_fraction and the coverage flags. The point estimate stands for both interval ends."""
    return seeds.mean_and_coverage(long_similarity(spark, sf_dir), "value", "identified", "label", "metric", threshold=threshold)


def verdicts(spark, sf_dir, threshold: float = 0.95):
    return gates.apply_gates(summary(spark, sf_dir, threshold), low="estimate", high="estimate")


@query("WITH" + ACCOUNTS + """,
long AS (SELECT flow, unnest(m) AS v, generate_subscripts(m, 1) - 1 AS i FROM acc),
p AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY v DESC, i) AS pos FROM long)
SELECT flow, round(sum(v), 6) AS mass, round(max(v), 6) AS maximum, sum(v) >= 1e-12 AS nonzero, max(v) - min(v) > greatest(1e-12, max(v) * 1e-8) AS rank_identifiable,
       round(max(v) FILTER (WHERE pos = 10) - max(v) FILTER (WHERE pos = 11), 6) AS boundary_gap,
       max(v) FILTER (WHERE pos = 10) - max(v) FILTER (WHERE pos = 11) > greatest(1e-12, max(v) * 1e-8) AS top_k_identifiable,
       count(*) FILTER (WHERE v > 0)::BIGINT AS nonzero_coordinates FROM p GROUP BY flow""")
def account_diagnostics(spark, sf_dir):
    own = accounts(spark, sf_dir).select("flow", "m", A.diagnostics(F.col("m")).alias("d"))
    return own.select("flow", r6("d.mass").alias("mass"), r6(F.array_max("m")).alias("maximum"), "d.nonzero", "d.rank_identifiable", r6("d.boundary_gap").alias("boundary_gap"), "d.top_k_identifiable", F.size(F.filter("m", lambda x: x > 0)).cast("long").alias("nonzero_coordinates"))


@query("WITH" + ACCOUNTS + """,
f AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS fraction),
long AS (SELECT flow, unnest(m) AS v FROM acc),
p AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY v DESC) AS pos FROM long),
b AS (SELECT fraction, flow, ceil(fraction * 64)::INT AS k, max(v) FILTER (WHERE pos = ceil(fraction * 64)) - max(v) FILTER (WHERE pos = ceil(fraction * 64) + 1) AS gap, greatest(1e-12, max(v) * 1e-8) AS epsilon, max(v) - min(v) AS spread FROM p, f GROUP BY fraction, flow)
SELECT fraction, k, count(*)::BIGINT AS records, count(*) FILTER (WHERE gap <= epsilon)::BIGINT AS nonidentifiable, count(*) FILTER (WHERE spread <= epsilon)::BIGINT AS constant_accounts, round(avg(gap), 6) AS mean_gap FROM b GROUP BY fraction, k""")
def account_boundaries(spark, sf_dir):
    own = accounts(spark, sf_dir)
    parts = own.select("flow", "m", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2, 0.3, 0.5)])).alias("fraction"))
    k = F.ceil(F.col("fraction") * F.size("m")).cast("int")
    falling = F.reverse(F.array_sort("m"))
    eps = F.greatest(F.lit(1e-12), F.array_max("m") * 1e-8)
    b = parts.select("fraction", k.alias("k"), (F.get(falling, k - 1) - F.get(falling, k)).alias("gap"), eps.alias("epsilon"), A.spread(F.col("m")).alias("spread"))
    return b.groupBy("fraction", "k").agg(F.count("*").alias("records"), F.count_if(F.col("gap") <= F.col("epsilon")).alias("nonidentifiable"), F.count_if(F.col("spread") <= F.col("epsilon")).alias("constant_accounts"), r6(F.avg("gap")).alias("mean_gap"))


@query("WITH" + SIMILARITY + """
SELECT flow, label, seed, round(spearman, 6) AS spearman, round(jaccard_10, 6) AS jaccard_10, round(weighted_jaccard, 6) AS weighted_jaccard, round(normalized_mass_l1, 6) AS normalized_mass_l1, rank_ok AS rank_pair_identifiable, top_ok AS top_k_pair_identifiable FROM simil""")
def account_similarity_pairs(spark, sf_dir):
    return similar(spark, sf_dir).select("flow", "label", "seed", *[r6(m).alias(m) for m in METRICS], "rank_pair_identifiable", "top_k_pair_identifiable")


@query("WITH" + LONG + """
SELECT label, metric, round(avg(v), 6) AS estimate, count(*)::BIGINT AS n_seeds, sum(n)::BIGINT AS n_flows FROM (
  SELECT label, metric, seed, avg(v) AS v, count(*) AS n FROM (SELECT label, metric, seed, flow, avg(value) AS v FROM cells GROUP BY ALL) a GROUP BY ALL) b GROUP BY label, metric""")
def similarity_equal_seed_mean(spark, sf_dir):
    per = seeds.seed_means(long_similarity(spark, sf_dir), "value", "label", "metric")
    return per.groupBy("label", "metric").agg(r6(F.avg("estimate")).alias("estimate"), F.count("*").alias("n_seeds"), F.sum("n_flows").alias("n_flows"))


@query("WITH" + SUMMARY + gated() + "\nSELECT label, metric, round(estimate, 6) AS estimate, gate_status FROM gated")
def similarity_gate_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir).select("label", "metric", r6("estimate").alias("estimate"), "gate_status")


@query("WITH" + LONG + """
SELECT metric, count(*) FILTER (WHERE identified)::BIGINT AS n_identified, round(avg(value) FILTER (WHERE identified), 6) AS conditional_mean, round(avg(value), 6) AS screening_mean,
       count(DISTINCT flow)::BIGINT AS n_sources, count(DISTINCT (seed, flow))::BIGINT AS n_seed_flow_cells, count(DISTINCT seed)::BIGINT AS n_seeds, count(*)::BIGINT AS n_rows FROM cells GROUP BY metric""")
def similarity_support_and_coverage(spark, sf_dir):
    c = long_similarity(spark, sf_dir)
    return c.groupBy("metric").agg(F.count_if("identified").alias("n_identified"), r6(F.avg(F.when(F.col("identified"), F.col("value")))).alias("conditional_mean"), r6(F.avg("value")).alias("screening_mean"), *seeds.support())


@query("WITH" + SUMMARY + """,
g AS (SELECT t.threshold, s.*, CASE WHEN NOT all_seeds THEN 'not_evaluable_seed_coverage' WHEN minimum_seed_fraction < t.threshold THEN 'not_evaluable_account_coverage'
        WHEN (metric = 'spearman' AND estimate >= 0.8) OR (metric = 'weighted_jaccard' AND estimate >= 0.7) OR (metric = 'jaccard_10' AND estimate >= 0.6) OR (metric = 'normalized_mass_l1' AND estimate <= 0.2) THEN 'pass' ELSE 'fail' END AS st
      FROM summary s, (SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS threshold) t)
SELECT threshold, metric, count(*) FILTER (WHERE st = 'pass')::BIGINT AS n_pass, count(*) FILTER (WHERE st = 'fail')::BIGINT AS n_fail, count(*) FILTER (WHERE st = 'not_evaluable_seed_coverage')::BIGINT AS n_no_seeds,
       count(*) FILTER (WHERE st = 'not_evaluable_account_coverage')::BIGINT AS n_no_accounts, 0::BIGINT AS n_undeclared, count(*)::BIGINT AS n_cells FROM g GROUP BY threshold, metric""")
def similarity_tolerance_sweep(spark, sf_dir):
    s = summary(spark, sf_dir)
    out = None
    for threshold in (0.90, 0.95, 0.99):  # the coverage axis of the sweep: verdicts only, measured once
        g = gates.regate(s, "minimum_seed_fraction", threshold, low="estimate", high="estimate").withColumn("threshold", F.lit(threshold))
        out = g if out is None else out.unionByName(g)
    return gates.gate_counts(out, "threshold", "metric")


@query("WITH" + SUMMARY + gated() + """,
s2 AS (SELECT *, CASE WHEN NOT all_seeds THEN 'not_evaluable_seed_coverage' WHEN minimum_seed_fraction < 0.95 THEN 'not_evaluable_account_coverage'
        WHEN (metric = 'spearman' AND estimate >= 0.0) OR (metric = 'jaccard_10' AND estimate >= 0.05) THEN 'pass' WHEN metric IN ('spearman', 'jaccard_10') THEN 'fail' ELSE 'not_predeclared' END AS v FROM summary)
SELECT g.label, g.metric, gate_status AS baseline_status, v AS variant_status FROM gated g JOIN s2 ON g.label = s2.label AND g.metric = s2.metric WHERE gate_status <> v""")
def similarity_gate_flips(spark, sf_dir):
    s = summary(spark, sf_dir)
    names = {"low": "estimate", "high": "estimate"}
    return gates.flips(gates.apply_gates(s, **names), gates.apply_gates(s, gates=(("spearman", "lower", 0.0), ("jaccard_10", "lower", 0.05)), **names), ["label", "metric"])


@query("WITH" + SUMMARY + gated() + """
SELECT metric, count(*) = 10 AND bool_and(gate_status = 'pass') AS all_pass, bool_or(gate_status = 'pass') AS established, count(*)::BIGINT AS n_cells FROM gated GROUP BY metric""")
def similarity_gate_rollup(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    est = gates.any_pass(v, "metric").select("metric", "established").distinct()
    return gates.all_pass(v, 10, "metric").join(est, "metric")


@query("WITH" + PAIRS + """,
long AS (SELECT flow, unnest(x) AS x, unnest(y) AS y, generate_subscripts(x, 1) - 1 AS i FROM pairs),
r AS (SELECT *, rank() OVER (PARTITION BY flow ORDER BY x) + (count(*) OVER (PARTITION BY flow, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY flow ORDER BY y) + (count(*) OVER (PARTITION BY flow, y) - 1) / 2.0 AS ry,
             row_number() OVER (PARTITION BY flow ORDER BY x, i) AS ox, row_number() OVER (PARTITION BY flow ORDER BY y, i) AS oy,
             row_number() OVER (PARTITION BY flow ORDER BY x DESC, i) AS px, row_number() OVER (PARTITION BY flow ORDER BY y DESC, i) AS py FROM long),
q AS (SELECT flow, quantile_cont(x, 1.0 / 3) AS x1, quantile_cont(x, 2.0 / 3) AS x2, quantile_cont(y, 1.0 / 3) AS y1, quantile_cont(y, 2.0 / 3) AS y2 FROM long GROUP BY flow),
tau AS (SELECT a.flow, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x)))::DOUBLE * sum(abs(sign(a.y - b.y)))) AS tau FROM long a JOIN long b ON a.flow = b.flow AND a.i < b.i GROUP BY a.flow),
w AS (SELECT a.flow, avg(abs(a.x - b.y)) AS w FROM r a JOIN r b ON a.flow = b.flow AND a.ox = b.oy GROUP BY a.flow),
g AS (SELECT l.flow, (x > x1)::INT + (x > x2)::INT AS gx, (y > y1)::INT + (y > y2)::INT AS gy FROM long l JOIN q ON l.flow = q.flow),
cell AS (SELECT flow, gx, gy, count(*) AS n FROM g GROUP BY ALL),
ari AS (SELECT flow, sum(n * (n - 1) / 2.0) AS c FROM cell GROUP BY flow),
ra AS (SELECT flow, sum(n * (n - 1) / 2.0) AS c FROM (SELECT flow, gx, sum(n) AS n FROM cell GROUP BY ALL) t GROUP BY flow),
ca AS (SELECT flow, sum(n * (n - 1) / 2.0) AS c FROM (SELECT flow, gy, sum(n) AS n FROM cell GROUP BY ALL) t GROUP BY flow),
m AS (SELECT flow, corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) FILTER (WHERE px <= 5 AND py <= 5) AS s5 FROM r GROUP BY flow)
SELECT m.flow, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(tau, 6) AS kendall, round(w, 6) AS wasserstein,
       round((ari.c - ra.c * ca.c / 2016.0) / ((ra.c + ca.c) / 2 - ra.c * ca.c / 2016.0), 6) AS adjusted_rand, round(s5 / 5.0, 6) AS overlap_5, round(s5 / (10.0 - s5), 6) AS jaccard_5
FROM m JOIN tau ON m.flow = tau.flow JOIN w ON m.flow = w.flow JOIN ari ON m.flow = ari.flow JOIN ra ON m.flow = ra.flow JOIN ca ON m.flow = ca.flow""")
def pairwise_stability_legacy(spark, sf_dir):
    p, x, y = account_pairs(spark, sf_dir), F.col("x"), F.col("y")
    p = p.withColumn("gx", A.tertiles(x)).withColumn("gy", A.tertiles(y))
    return p.select("flow", r6(A.pearson(x, y)).alias("pearson"), r6(A.safe_spearman(x, y)).alias("spearman"), r6(A.kendall_tau_b(x, y)).alias("kendall"), r6(A.wasserstein(x, y)).alias("wasserstein"), r6(A.adjusted_rand(F.col("gx"), F.col("gy"))).alias("adjusted_rand"), r6(A.overlap_at(x, y, 5)).alias("overlap_5"), r6(A.jaccard_at(x, y, 5)).alias("jaccard_5"))


@query("WITH" + ACCOUNTS + """, long AS (SELECT label, unnest(m) AS v, generate_subscripts(m, 1)::INT - 1 AS feature FROM acc),
g AS (SELECT label, feature, avg(v) AS importance FROM long GROUP BY ALL)
SELECT label, feature, round(importance, 6) AS importance, position FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY importance DESC, feature)::INT AS position FROM g) t WHERE position <= 5""")
def global_importance_topk(spark, sf_dir):
    from pyspark.sql import Window

    g = accounts(spark, sf_dir).select("label", F.posexplode("m").alias("feature", "v")).groupBy("label", "feature").agg(F.avg("v").alias("importance"))
    pos = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("importance"), "feature"))
    return g.withColumn("position", pos).filter("position <= 5").select("label", "feature", r6("importance").alias("importance"), "position")


@query("WITH" + SIMILARITY + """
SELECT s.flow, round(spearman, 6) AS spearman, round(jaccard_10, 6) AS jaccard_10 FROM simil s JOIN events e ON s.flow = e.event_id
WHERE (e.value > 50) = (e.value + 1 > 50) AND (coalesce(spearman, -1) < 0.1 OR coalesce(jaccard_10, -1) < 0.1)""")
def same_decision_different_account(spark, sf_dir):
    s, e = similar(spark, sf_dir), table(spark, sf_dir, "events").select("event_id", (F.col("value") > 50).alias("before"), (F.col("value") + 1 > 50).alias("after"))
    j = s.join(e, s["flow"] == e["event_id"])
    return j.filter((F.col("before") == F.col("after")) & ((F.coalesce("spearman", F.lit(-1.0)) < 0.1) | (F.coalesce("jaccard_10", F.lit(-1.0)) < 0.1))).select("flow", r6("spearman").alias("spearman"), r6("jaccard_10").alias("jaccard_10"))


@query("WITH" + LONG + """,
p AS (SELECT metric, seed, avg(v) AS estimate, count(*)::BIGINT AS n_flows FROM (SELECT metric, seed, flow, avg(value) AS v FROM cells GROUP BY ALL) t GROUP BY ALL)
SELECT metric, seed, round(estimate, 6) AS estimate, n_flows, round((sum(estimate) OVER (PARTITION BY metric) - estimate) / (count(*) OVER (PARTITION BY metric) - 1), 6) AS without_seed FROM p""")
def leave_one_seed_out(spark, sf_dir):
    out = seeds.leave_one_seed_out(long_similarity(spark, sf_dir), "value", "metric")
    return out.select("metric", "seed", r6("estimate").alias("estimate"), "n_flows", r6("without_seed").alias("without_seed"))


@query("WITH" + LONG + """, p AS (SELECT metric, seed, avg(value) AS v FROM cells GROUP BY ALL)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*)::BIGINT AS n_seeds FROM p GROUP BY metric""")
def metric_mean_and_sd_over_seeds(spark, sf_dir):
    per = long_similarity(spark, sf_dir).groupBy("metric", "seed").agg(F.avg("value").alias("v"))
    out = seeds.mean_and_sd(per, "v", "metric")
    return out.select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), "n_seeds")


@query("WITH" + LONG + """
SELECT metric, CASE WHEN grouping(flag) = 1 THEN 'all' WHEN flag THEN 'changed' ELSE 'unchanged' END AS stratum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median,
       round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, count(value)::BIGINT AS n, (count(*) - count(value))::BIGINT AS n_missing
FROM (SELECT *, flow % 3 = 0 AS flag FROM cells) t GROUP BY GROUPING SETS ((metric), (metric, flag))""")
def stability_by_stratum(spark, sf_dir):
    from veritab.operators.aggregates import stability_summary

    out = stability_summary(long_similarity(spark, sf_dir).withColumn("changed", F.col("flow") % 3 == 0), "value", "changed", "metric")
    return out.select("metric", "stratum", *[r6(c).alias(c) for c in ("mean", "std", "median", "iqr")], "n", "n_missing")


@query("""WITH e AS (SELECT n_name AS nation, m.metric FROM nation, (SELECT unnest(['a', 'b']) AS metric) m),
o AS (SELECT n_name AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'c' END AS metric, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT coalesce(e.nation, o.nation) AS nation, coalesce(e.metric, o.metric) AS metric, coalesce(n, 0)::BIGINT AS n_rows,
       CASE WHEN n IS NULL THEN 'missing' WHEN e.nation IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'complete' END AS status
FROM e FULL JOIN o ON e.nation = o.nation AND e.metric = o.metric""")
def inventory_completeness(spark, sf_dir):
    """Of all nations and customers."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    expected = gates.expected_cells(nation.select(F.col("n_name").alias("nation")), spark.createDataFrame([("a",), ("b",)], "metric string"))
    seen = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    observed = seen.select(F.col("n_name").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("c").alias("metric"))
    return gates.inventory(expected, observed, ["nation", "metric"])
