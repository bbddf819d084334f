"""Queries on panels and comparisons between conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions.hashing import unit_sql
from veritab.operators import aggregates, panels
from veritab.plans._adapter import ACCOUNTS, PREDICTIONS, ROWS, accounts, predictions, r6, rows

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BOTH = PREDICTIONS + """, lng AS (SELECT flow, event_type, 'one' AS model, d1 = truth AS correct FROM pred UNION ALL SELECT flow, event_type, 'two', d2 = truth FROM pred)"""


def both_models(spark, sf_dir):
    p = predictions(spark, sf_dir)
    models = F.inline(F.array(F.struct(F.lit("one").alias("model"), (F.col("d1") == F.col("truth")).alias("correct")), F.struct(F.lit("two").alias("model"), (F.col("d2") == F.col("truth")).alias("correct"))))
    return p.select("flow", "event_type", models)


@query("WITH" + BOTH + f""", c AS (SELECT flow, event_type FROM lng GROUP BY ALL HAVING bool_and(correct) AND count(*) = 2),
a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {unit_sql('central-panel', 'flow')}, flow) AS n FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {unit_sql('central-subset', 'flow')}, flow) <= 8 AS in_subset FROM a WHERE n <= 128)
SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE in_subset)::BIGINT AS n_flagged, bool_or(in_subset) AS any_flagged, bool_and(in_subset) AS all_flagged, sum(flow)::BIGINT AS flow_sum FROM b GROUP BY event_type""")
def central_panel_support(spark, sf_dir):
    p = panels.central_panel(both_models(spark, sf_dir), "flow", "correct", 2, "event_type")
    return panels.panel_support(p, "event_type", "in_subset").join(p.groupBy("event_type").agg(F.sum("flow").alias("flow_sum")), "event_type")


@query("WITH" + BOTH + f""", r AS (SELECT *, row_number() OVER (PARTITION BY model, event_type, correct ORDER BY CASE WHEN correct THEN {unit_sql('outcome-correct', 'flow')} ELSE {unit_sql('outcome-error', 'flow')} END, flow) AS n FROM lng)
SELECT model, event_type, correct, count(*)::BIGINT AS n, sum(flow)::BIGINT AS flow_sum FROM r WHERE n <= 40 GROUP BY ALL""")
def outcome_panel(spark, sf_dir):
    p = panels.outcome_panel(both_models(spark, sf_dir), "flow", "correct", 40, 40, "model", "event_type")
    return p.groupBy("model", "event_type", "correct").agg(F.count("*").alias("n"), F.sum("flow").alias("flow_sum"))


RUNS = ACCOUNTS + """, runs AS (SELECT label, (flow // 10) % 4 AS run, min(flow) AS flow FROM acc GROUP BY ALL), ra AS (SELECT runs.label, runs.run, acc.m FROM runs JOIN acc ON runs.flow = acc.flow)"""


def run_accounts(spark, sf_dir):
    run = (F.floor(F.col("flow") / 10) % 4).alias("run")
    return accounts(spark, sf_dir).groupBy("label", run).agg(F.min_by("m", "flow").alias("m"))


@query("WITH" + RUNS + """, p AS (SELECT a.label, a.run AS left_run, b.run AS right_run, CASE WHEN a.run % 2 = b.run % 2 THEN 'same_architecture' WHEN a.run // 2 = b.run // 2 THEN 'same_seed' ELSE 'neither' END AS kind, unnest(a.m) AS x, unnest(b.m) AS y FROM ra a JOIN ra b ON a.label = b.label AND a.run < b.run),
t AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy FROM p WINDOW w AS (PARTITION BY label, left_run, right_run))
SELECT label, left_run, right_run, kind, round(0.5 * sum(abs(x / sx - y / sy)), 6) AS normalized_mass_l1 FROM t GROUP BY ALL""")
def condition_pair_similarity(spark, sf_dir):
    a = run_accounts(spark, sf_dir).withColumn("architecture", F.col("run") % 2).withColumn("fit", F.floor(F.col("run") / 2))
    s = panels.condition_pairs(a, ["label"], "run", "m", "architecture", "fit")
    return s.select("label", "left_run", "right_run", "kind", r6("normalized_mass_l1").alias("normalized_mass_l1"))


@query("WITH" + RUNS + """, z AS (SELECT label, unnest(m) AS v, generate_subscripts(m, 1) - 1 AS i FROM ra), m AS (SELECT label, i, avg(v) AS v FROM z GROUP BY ALL) SELECT label, round(sum(v), 6) AS total, round(sum(v * i), 6) AS weighted FROM m GROUP BY label""")
def mean_account_over_runs(spark, sf_dir):
    from veritab.functions import accounts as A

    m = panels.mean_account(run_accounts(spark, sf_dir), "m", "label")
    return m.select("label", r6(A.total(F.col("m"))).alias("total"), r6(A.total(F.transform("m", lambda v, i: v * i))).alias("weighted"))


@query("WITH" + RUNS + """, p AS (SELECT a.label, a.run, unnest(a.m) AS x, unnest(b.m) AS y FROM ra a JOIN ra b ON a.label = b.label AND a.run <> 0 AND b.run = 0), t AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy FROM p WINDOW w AS (PARTITION BY label, run))
SELECT label, run, round(sum(least(x / sx, y / sy)) / sum(greatest(x / sx, y / sy)), 6) AS weighted_jaccard FROM t GROUP BY ALL""")
def reference_run_similarity(spark, sf_dir):
    s = panels.with_reference_run(run_accounts(spark, sf_dir), ["label"], "run", 0, "m")
    return s.select("label", "run", r6("weighted_jaccard").alias("weighted_jaccard"))


@query("WITH" + PREDICTIONS + """ SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE flow IS NULL)::BIGINT AS null_keys, count(*) FILTER (WHERE NOT (p1 BETWEEN 0 AND 1))::BIGINT AS score_in_range, count(*) FILTER (WHERE d1 <> (p1 >= 0.5)::INT)::BIGINT AS decision_consistent, (count(*) - count(DISTINCT flow))::BIGINT AS repeated_keys FROM pred""")
def prediction_frame_violations(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return panels.violations(p, ["flow"], {"score_in_range": F.col("p1").between(0, 1), "decision_consistent": F.col("d1") == (F.col("p1") >= 0.5).cast("int")})


@query("WITH" + ROWS + """ SELECT source, count(*) FILTER (WHERE label = 'A')::BIGINT AS A, count(*) FILTER (WHERE label = 'N')::BIGINT AS N, count(*) FILTER (WHERE label = 'R')::BIGINT AS R FROM rowset GROUP BY source""")
def class_row_matrix(spark, sf_dir):
    return aggregates.class_row_matrix(rows(spark, sf_dir), "source", "label", ["A", "N", "R"])


@query("WITH" + PREDICTIONS + """ SELECT event_type, count(*)::BIGINT AS records, round(median(abs(p1 - p2)), 6) AS median, round(quantile_cont(abs(p1 - p2), 0.95), 6) AS p95, round(max(abs(p1 - p2)), 6) AS maximum, count(*) FILTER (WHERE abs(p1 - p2) > 0.5)::BIGINT AS above_tolerance FROM pred GROUP BY event_type""")
def residual_summary(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("r", F.abs(F.col("p1") - F.col("p2")))
    s = aggregates.residual_summary(p, "r", 0.5, "event_type")
    return s.select("event_type", "records", *[r6(c).alias(c) for c in ("median", "p95", "maximum")], "above_tolerance")
