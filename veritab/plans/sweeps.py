"""Queries on sweeps of tops, floors, tolerances and coverage thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.operators import gates, sweeps
from veritab.plans._adapter import accounts, r6
from veritab.plans.verdicts import REPLICATES, cells_sql, second_account, summary_sql

QUERIES, ORACLE_SQL = {}, {}
KIND = "cross_model"
SETTINGS = sweeps.one_axis_at_a_time(sweeps.Setting(), top_k=(5, 10, 15), mass_floor=(1e-12, 6.0), tie_tolerance=(1e-8, 0.001, 0.02), minimum_fraction=(0.5, 0.9, 0.95, 0.99))
MEASURES = sweeps.measures(SETTINGS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def swept_sql() -> str:
    """The long way: every measurement from ranked features; measure and label travel as one number."""
    cells = cells_sql(KIND)
    ranked = cells[: cells.index(",\nsim AS (")]
    measure_rows = ", ".join(f"({i}, {k}, {floor!r}::DOUBLE, {tie!r}::DOUBLE)" for i, (k, floor, tie) in enumerate(MEASURES))
    fan = ", ".join(f"('{s.setting}', {MEASURES.index(s.measured)}, {s.minimum_fraction}::DOUBLE)" for s in SETTINGS)
    wide = f""",
me AS (SELECT * FROM (VALUES {measure_rows}) t(measure, k, floor, tie)),
sim AS (SELECT measure, k, floor, tie, flow, label, seed, corr(rx, ry) AS r, max(abs(x - y)) AS maxdiff, max(x) AS maxx, max(y) AS maxy, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(sx) AS sx, max(sy) AS sy,
               max(x) FILTER (WHERE px = k) - max(x) FILTER (WHERE px = k + 1) AS gx, max(y) FILTER (WHERE py = k) - max(y) FILTER (WHERE py = k + 1) AS gy,
               count(*) FILTER (WHERE px <= k AND py <= k) AS shared, sum(least(x / sx, y / sy)) AS low, sum(greatest(x / sx, y / sy)) AS high, 0.5 * sum(abs(x / sx - y / sy)) AS l1 FROM ranked, me GROUP BY ALL),
ok AS (SELECT *, sx >= floor AND sy >= floor AS nz, sx >= floor AND sy >= floor AND ex > greatest(floor, maxx * tie) AND ey > greatest(floor, maxy * tie) AS rank_ok,
              sx >= floor AND sy >= floor AND gx > greatest(floor, maxx * tie) AND gy > greatest(floor, maxy * tie) AS top_ok FROM sim),
cells AS (SELECT flow, seed, measure * 1000 + label AS label, 'spearman' AS metric, CASE WHEN rank_ok THEN CASE WHEN maxdiff <= 1e-12 THEN 1.0 ELSE r END ELSE 0.0 END AS value, rank_ok AS identified FROM ok
          UNION ALL SELECT flow, seed, measure * 1000 + label, 'jaccard_10', CASE WHEN top_ok THEN shared / (2.0 * k - shared) ELSE 0.0 END, top_ok FROM ok
          UNION ALL SELECT flow, seed, measure * 1000 + label, 'weighted_jaccard', CASE WHEN nz THEN low / high ELSE 0.0 END, nz FROM ok
          UNION ALL SELECT flow, seed, measure * 1000 + label, 'normalized_mass_l1', CASE WHEN nz THEN l1 ELSE 1.0 END, nz FROM ok)"""
    summaries = summary_sql(KIND)
    summaries = summaries[len(cells) : summaries.index(",\nverdict AS (")]
    met = " ".join(f"WHEN s.metric = '{m}' THEN CASE WHEN {'ci_low >=' if side == 'lower' else 'ci_high <='} {b} THEN 'pass' ELSE 'fail' END" for m, side, b in gates.EQUIVALENCE)
    return ranked + wide + summaries + f""",
fan AS (SELECT * FROM (VALUES {fan}) t(setting, measure, minimum_fraction)),
swept AS (SELECT setting, s.label % 1000 AS label, s.metric, estimate, ci_low, ci_high, CASE WHEN NOT all_seeds THEN 'not_evaluable_seed_coverage' WHEN minimum_seed_fraction < minimum_fraction THEN 'not_evaluable_account_coverage' {met} END AS gate_status
          FROM summary s JOIN ci ON s.label = ci.label AND s.metric = ci.metric JOIN fan ON s.label // 1000 = fan.measure)"""


def sweep(spark, sf_dir):
    pairs = accounts(spark, sf_dir).select("flow", "seed", "label", F.col("m").alias("x"), second_account(KIND).alias("y"))
    return sweeps.swept(pairs, "x", "y", SETTINGS, "label", replicates=REPLICATES)


@query("WITH" + swept_sql() + " SELECT setting, label, metric, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, gate_status FROM swept")
def threshold_sweep(spark, sf_dir):
    """Interval verdicts of every setting."""
    return sweep(spark, sf_dir).select("setting", "label", "metric", *[r6(c).alias(c) for c in ("estimate", "ci_low", "ci_high")], "gate_status")


@query("WITH" + swept_sql() + """ SELECT a.setting, a.label, a.metric, b.gate_status AS baseline_status, a.gate_status AS variant_status
FROM swept a JOIN swept b ON a.label = b.label AND a.metric = b.metric AND b.setting = 'baseline' WHERE a.setting <> 'baseline' AND a.gate_status <> b.gate_status""")
def threshold_sweep_flips(spark, sf_dir):
    """Verdicts that a setting changes."""
    return sweeps.flipped(sweep(spark, sf_dir), "label")
