"""Verdicts on resampled intervals: similarity of repeated accounts, intervals over sources and seeds, gates, roll-ups."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions.hashing import unit_sql
from veritab.operators import gates, joins, resampling, seeds
from veritab.operators.staging import staged
from veritab.plans._adapter import ACCOUNTS, PAIRS, SIMILARITY, accounts, r6
from veritab.plans.similarity import LONG, METRICS, SUMMARY

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The comparisons: how far a second account lies from the first, a shift of its draws, and the bounds it is held to.
KINDS = {"repeatability": (1.1, 0, gates.REPEATABILITY), "cross_model": (1.6, 331, gates.EQUIVALENCE), "cross_probe": (1.35, 77, gates.EQUIVALENCE)}
REPLICATES = 1_000


def second_account(kind: str):
    """Each coordinate of an account times a number between 1 - spread / 2 and 1 + spread / 2, fixed by flow and place."""
    spread, shift, _ = KINDS[kind]
    draw = lambda i: ((F.col("flow") * 7919 + i * 104729 + shift) % 1000).cast("double") / F.lit(1000.0) - F.lit(0.5)
    return F.transform("m", lambda x, i: x * (F.lit(1.0) + F.lit(spread) * draw(i)))


def cells(spark, sf_dir, kind: str):
    """flow, seed, label, metric, value, identified of an account and its second one."""
    own = accounts(spark, sf_dir)
    s = own.select("flow", "seed", "label", A.similarity(F.col("m"), second_account(kind)).alias("s")).select("flow", "seed", "label", "s.*")
    flags = {"spearman": "rank_pair_identifiable", "jaccard_10": "top_k_pair_identifiable"}
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(flags.get(m, "account_pair_nonzero")).alias("identified")) for m in METRICS])
    return s.select("flow", "seed", "label", F.inline(rows))


def summarised(spark, sf_dir, kind: str):
    """label, metric, estimate, interval and coverage: what a gate is applied to."""
    c = cells(spark, sf_dir, kind)
    interval = resampling.hash_interval(c, "value", "label", "metric", replicates=REPLICATES)
    return seeds.mean_and_coverage(c, "value", "identified", "label", "metric").join(interval, ["label", "metric"])


def verdicts(spark, sf_dir, kind: str):
    """The published rule: the lower (or upper) end of the interval meets the bound (V1-V3, V5)."""
    return gates.apply_gates(summarised(spark, sf_dir, kind), KINDS[kind][2])


def cells_sql(kind: str) -> str:
    spread, shift, _ = KINDS[kind]
    own = ACCOUNTS + f""",
pairs AS (SELECT flow, label, seed, a, a AS b, m AS x, list_transform(m, lambda x, i: x * (1.0::DOUBLE + {spread}::DOUBLE * (((flow * 7919 + (i - 1) * 104729 + {shift}) % 1000)::DOUBLE / 1000.0::DOUBLE - 0.5::DOUBLE))) AS y FROM acc)"""
    return own + SIMILARITY[len(PAIRS) :] + LONG[len(SIMILARITY) :]


def summary_sql(kind: str) -> str:
    _, _, bounds = KINDS[kind]
    met = " ".join(f"WHEN s.metric = '{m}' THEN CASE WHEN {'ci_low >=' if side == 'lower' else 'ci_high <='} {b} THEN 'pass' ELSE 'fail' END" for m, side, b in bounds)
    at_point = " ".join(f"WHEN s.metric = '{m}' THEN CASE WHEN estimate {'>=' if side == 'lower' else '<='} {b} THEN 'pass' ELSE 'fail' END" for m, side, b in bounds)
    declared = "', '".join(m for m, _, _ in bounds)
    rule = lambda x: f"CASE WHEN s.metric NOT IN ('{declared}') THEN 'not_predeclared' WHEN NOT all_seeds THEN 'not_evaluable_seed_coverage' WHEN minimum_seed_fraction < 0.95 THEN 'not_evaluable_account_coverage' {x} END"
    return cells_sql(kind) + SUMMARY[len(LONG) :] + f""",
ex AS (SELECT *, {unit_sql('boot', 'replicate', 'flow')} / 4294967296.0::DOUBLE AS u FROM per_flow, (SELECT unnest(range(0, {REPLICATES})) AS replicate) r),
wx AS (SELECT *, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 ELSE 3 END AS w FROM ex),
dr AS (SELECT label, metric, replicate, avg(m) AS estimate FROM (SELECT label, metric, replicate, seed, sum(w * v) / nullif(sum(w), 0) AS m FROM wx GROUP BY ALL) t GROUP BY ALL),
ci AS (SELECT label, metric, quantile_cont(estimate, 0.025) AS ci_low, quantile_cont(estimate, 0.975) AS ci_high FROM dr GROUP BY ALL),
verdict AS (SELECT s.label, s.metric, estimate, ci_low, ci_high, {rule(met)} AS gate_status, {rule(at_point)} AS point_status FROM summary s JOIN ci ON s.label = ci.label AND s.metric = ci.metric)"""


def verdict_rows(spark, sf_dir, kind: str):
    """One summary, gated twice: on the interval and, for comparison, on the point estimate."""
    v = verdicts(spark, sf_dir, kind).withColumnRenamed("gate_status", "interval_status").drop("gate_bound", "gate_direction", "gate_pass")
    p = gates.apply_gates(v, KINDS[kind][2], low="estimate", high="estimate")
    return p.select("label", "metric", *[r6(c).alias(c) for c in ("estimate", "ci_low", "ci_high")], F.col("interval_status").alias("gate_status"), F.col("gate_status").alias("point_status"))


def verdict_query(kind: str):
    def run(spark, sf_dir):
        return verdict_rows(spark, sf_dir, kind)

    run.__name__ = f"{kind}_verdicts"
    run.__doc__ = f"Interval and point verdicts of the {kind} comparison."
    return query("WITH" + summary_sql(kind) + " SELECT label, metric, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, gate_status, point_status FROM verdict")(run)


repeatability_verdicts, cross_model_verdicts, cross_probe_verdicts = map(verdict_query, KINDS)


@query("WITH" + summary_sql("repeatability") + """, lo AS (SELECT label, metric, min(w) AS least_without, max(w) AS most_without FROM (SELECT label, metric, (sum(v) OVER p - v) / (count(*) OVER p - 1) AS w FROM per_seed WINDOW p AS (PARTITION BY label, metric)) t GROUP BY ALL)
SELECT v.label, v.metric, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(least_without, 6) AS least_without, round(most_without, 6) AS most_without,
       round((SELECT avg(value) FILTER (WHERE identified) FROM cells c WHERE c.label = v.label AND c.metric = v.metric), 6) AS conditional_mean, gate_status FROM verdict v JOIN lo ON v.label = lo.label AND v.metric = lo.metric""")
def repeatability_rollup(spark, sf_dir):
    """Estimate, interval, range without any one seed, mean over identified pairs, verdict (Q11, Q22, Q26, Q27)."""
    c = cells(spark, sf_dir, "repeatability")
    loso = seeds.leave_one_seed_out(c, "value", "label", "metric").groupBy("label", "metric").agg(F.min("without_seed").alias("least_without"), F.max("without_seed").alias("most_without"))
    conditional = c.groupBy("label", "metric").agg(F.avg(F.when(F.col("identified"), F.col("value"))).alias("conditional_mean"))
    v = verdicts(spark, sf_dir, "repeatability").join(loso, ["label", "metric"]).join(conditional, ["label", "metric"])
    return v.select("label", "metric", *[r6(n).alias(n) for n in ("estimate", "ci_low", "ci_high", "least_without", "most_without", "conditional_mean")], "gate_status")


def union_sql(body) -> str:
    """One statement over all comparisons: the common table expressions of each, renamed by its place."""
    return "\nUNION ALL ".join(f"SELECT * FROM (WITH{summary_sql(kind)} {body(kind)}) t{i}" for i, kind in enumerate(KINDS))


@query(union_sql(lambda kind: f"SELECT '{kind}' AS inventory, metric, count(*) FILTER (WHERE gate_status = 'pass')::BIGINT AS n_pass, count(*) FILTER (WHERE gate_status = 'fail')::BIGINT AS n_fail, count(*) FILTER (WHERE gate_status LIKE 'not_evaluable%')::BIGINT AS n_open, count(*) FILTER (WHERE gate_status = 'not_predeclared')::BIGINT AS n_undeclared, count(*)::BIGINT AS n_cells, bool_and(gate_status = 'pass') AS all_pass FROM verdict GROUP BY metric"))
def audit_rollup(spark, sf_dir):
    """All inventories' verdicts in one table (Q1, Q12): counts of each status, and whether all cells pass."""
    # a source weighs the same in all inventories, so its weights are drawn once for all of them
    keys = ["inventory", "label", "metric"]
    c = joins.union_tagged({kind: cells(spark, sf_dir, kind) for kind in KINDS}, "inventory")
    interval = resampling.hash_interval(c, "value", *keys, replicates=REPLICATES)
    summary = staged(seeds.mean_and_coverage(c, "value", "identified", *keys).join(interval, keys), "summary")
    gated = {kind: gates.apply_gates(summary.filter(F.col("inventory") == kind), bounds) for kind, (_, _, bounds) in KINDS.items()}
    named = functools.reduce(DataFrame.unionByName, [g.select("inventory", "label", "metric", "gate_status", "gate_pass") for g in gated.values()])
    s = F.col("gate_status")
    return named.groupBy("inventory", "metric").agg(F.count_if(s == "pass").alias("n_pass"), F.count_if(s == "fail").alias("n_fail"), F.count_if(s.startswith("not_evaluable")).alias("n_open"), F.count_if(s == "not_predeclared").alias("n_undeclared"), F.count("*").alias("n_cells"), F.bool_and(s == "pass").alias("all_pass"))


@query("WITH" + summary_sql("cross_model") + """, r AS (SELECT label, metric, 1 - avg(value) AS disagreement FROM cells GROUP BY ALL), q AS (SELECT label, metric, 1 - avg(value) AS base FROM (""" + "SELECT * FROM (WITH" + cells_sql("repeatability") + """ SELECT * FROM cells) i) t GROUP BY ALL)
SELECT r.label, r.metric, round(disagreement, 6) AS disagreement, round(base, 6) AS within, round(disagreement - base, 6) AS excess, round((disagreement - base) / nullif(disagreement, 0), 6) AS excess_share FROM r JOIN q ON r.label = q.label AND r.metric = q.metric WHERE r.metric <> 'normalized_mass_l1'""")
def architecture_excess(spark, sf_dir):
    """Disagreement between models beyond that of repeated runs, and its share (Q15)."""
    of = lambda kind, name: cells(spark, sf_dir, kind).filter("metric <> 'normalized_mass_l1'").groupBy("label", "metric").agg((1 - F.avg("value")).alias(name))
    j = joins.one_to_one(of("cross_model", "disagreement"), of("repeatability", "within"), ["label", "metric"])
    excess = F.col("disagreement") - F.col("within")
    return j.select("label", "metric", r6("disagreement").alias("disagreement"), r6("within").alias("within"), r6(excess).alias("excess"), r6(F.try_divide(excess, F.nullif("disagreement", F.lit(0.0)))).alias("excess_share"))


@query("WITH" + summary_sql("cross_probe") + """ SELECT label, round(min(ci_low), 6) AS least_change, bool_or(ci_low >= 0.2) AS established, count(*)::BIGINT AS n_cells FROM ci WHERE metric = 'normalized_mass_l1' GROUP BY label""")
def parameter_sanity(spark, sf_dir):
    """Whether accounts change when a model is fitted anew: the lower end of the moved mass."""
    v = gates.apply_gates(summarised(spark, sf_dir, "cross_probe").filter("metric = 'normalized_mass_l1'"), gates.PARAMETER_CHANGE)
    e = gates.any_pass(v, "label")
    return e.groupBy("label").agg(r6(F.min("ci_low")).alias("least_change"), F.bool_or("established").alias("established"), F.count("*").alias("n_cells"))


@query("WITH" + cells_sql("repeatability") + """, b AS (SELECT label, flow, n AS budget, value FROM (SELECT label, flow, value, row_number() OVER (PARTITION BY label ORDER BY flow) AS k FROM cells WHERE metric = 'spearman') t, (SELECT unnest([2, 4, 8]) AS n) u WHERE k <= n)
SELECT budget, CASE WHEN grouping(label) = 1 THEN -1 ELSE label END AS label, round(avg(value), 6) AS mean, count(value)::BIGINT AS n FROM b GROUP BY GROUPING SETS ((budget, label), (budget))""")
def convergence_by_budget(spark, sf_dir):
    """Repeatability at growing sampling budgets, by class (-1: all classes)."""
    from pyspark.sql import Window

    from veritab.operators.aggregates import convergence

    c = cells(spark, sf_dir, "repeatability").filter("metric = 'spearman'")
    place = F.row_number().over(Window.partitionBy("label").orderBy("flow"))
    budgets = F.filter(F.array(F.lit(2), F.lit(4), F.lit(8)), lambda n: F.col("place") <= n)
    # the largest budget is cut first, so a class's order is that of a few rows
    drawn = c.withColumn("place", place).filter("place <= 8").withColumn("budget", F.explode(budgets))
    out = convergence(drawn, "value", "budget", "label")
    return out.select("budget", F.when(F.col("level") > 0, -1).otherwise(F.col("label")).alias("label"), r6("mean").alias("mean"), "n")
