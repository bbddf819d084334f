"""Queries on explanations of a layered scorer with three classes, and on fingerprints of bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veritab.functions import hashing
from veritab.operators import networks, shapley
from veritab.operators.networks import Layer, Network
from veritab.plans._adapter import ACCOUNTS, accounts, r6
from veritab.plans.explanations import summed, with_reference

QUERIES, ORACLE_SQL = {}, {}
HIDDEN, CLASSES, WIDTH, STEPS, GROUPS = 4, 3, 64, 64, 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def model() -> Network:
    """A layer of tanh and one of softmax, with weights from a rule that SQL can state too."""
    i, h, c = np.arange(WIDTH)[:, None], np.arange(HIDDEN), np.arange(CLASSES)
    return Network(Layer(0.05 * ((i * 7 + h * 3) % 11 - 5), 0.1 * (h - 1), "tanh"), Layer(0.5 * ((h[:, None] * 5 + c * 2) % 7 - 3), 0.1 * c, "softmax"))


W1 = "(0.05::DOUBLE * ((i * 7 + h * 3) % 11 - 5))"
W2 = "(0.5::DOUBLE * ((h * 5 + c * 2) % 7 - 3))"
HS = f"(SELECT unnest(range(0, {HIDDEN}))::INT AS h) hs"
CS = f"(SELECT unnest(range(0, {CLASSES}))::INT AS c) cs"

#: lx: coordinates with their reference; hz: first sums of a flow and of the reference.
FIRST = ACCOUNTS + f""", l0 AS (SELECT flow, label % {CLASSES} AS target, unnest(a) AS x, generate_subscripts(a, 1)::INT - 1 AS i FROM acc),
md AS (SELECT i, median(x) AS r FROM l0 GROUP BY i),
lx AS (SELECT l0.*, r FROM l0 JOIN md ON l0.i = md.i),
hz AS (SELECT flow, target, h, sum(x * {W1}) + 0.1 * (h - 1) AS zx, sum(r * {W1}) + 0.1 * (h - 1) AS zr FROM lx, {HS} GROUP BY flow, target, h)"""


def passed(points: str) -> str:
    """CTEs over points (flow, target, k, h, z): prob (flow, k, p of the target, by class) and grad (flow, k, h, g)."""
    return FIRST + f""", points AS ({points}),
lg AS (SELECT flow, target, k, c, exp(sum((2 / (1 + exp(-2 * z)) - 1) * {W2}) + 0.1 * c) AS e FROM points, {CS} GROUP BY flow, target, k, c),
sm AS (SELECT flow, target, k, c, e / sum(e) OVER (PARTITION BY flow, k) AS p FROM lg),
prob AS (SELECT flow, k, max(p) FILTER (WHERE c = target) AS p FROM sm GROUP BY flow, k),
back AS (SELECT sm.flow, sm.k, h, sum({W2} * prob.p * ((c = target)::INT - sm.p)) AS g FROM sm JOIN prob ON sm.flow = prob.flow AND sm.k = prob.k, {HS} GROUP BY sm.flow, sm.k, h),
grad AS (SELECT back.flow, back.k, back.h, g * (1 - (2 / (1 + exp(-2 * z)) - 1) ** 2) AS g FROM back JOIN points ON back.flow = points.flow AND back.k = points.k AND back.h = points.h)"""


AT_X = "SELECT flow, target, 0 AS k, h, zx AS z FROM hz"


def flows(spark, sf_dir):
    return with_reference(spark, sf_dir).withColumn("target", F.col("label") % CLASSES)


@query("WITH" + passed(AT_X) + " SELECT sm.flow, round(max(sm.p) FILTER (WHERE c = 0), 6) AS p0, round(max(sm.p) FILTER (WHERE c = 1), 6) AS p1, round(max(sm.p) FILTER (WHERE c = 2), 6) AS p2, round(max(sm.p) FILTER (WHERE c = target), 6) AS p_target FROM sm GROUP BY sm.flow")
def network_probabilities(spark, sf_dir):
    f = accounts(spark, sf_dir).select("flow", (F.col("label") % CLASSES).alias("target"), networks.probabilities(model(), F.col("a")).alias("p"))
    return f.select("flow", *[r6(F.get("p", F.lit(c))).alias(f"p{c}") for c in range(CLASSES)], r6(F.get("p", F.col("target").cast("int"))).alias("p_target"))


@query("WITH" + passed(AT_X) + f" SELECT lx.flow, round(sum(x * {W1} * g), 6) AS total, round(sum(x * {W1} * g * i), 6) AS weighted FROM lx JOIN grad ON lx.flow = grad.flow GROUP BY lx.flow")
def network_gradient_times_input(spark, sf_dir):
    f = accounts(spark, sf_dir).select("flow", networks.gradient_times_input(model(), F.col("a"), F.col("label") % CLASSES).alias("g"))
    return f.select("flow", *summed(F.col("g")))


@query("WITH" + passed(f"SELECT flow, target, k, h, zr + (zx - zr) * k / {STEPS}.0::DOUBLE AS z FROM hz, (SELECT unnest(range(0, {STEPS + 1}))::INT AS k) ks") + f""",
mean AS (SELECT flow, h, sum(CASE WHEN k IN (0, {STEPS}) THEN 0.5 ELSE 1 END * g) / {STEPS} AS g FROM grad GROUP BY flow, h)
SELECT lx.flow, round(sum((x - r) * {W1} * g), 6) AS total, round(sum((x - r) * {W1} * g * i), 6) AS weighted FROM lx JOIN mean ON lx.flow = mean.flow GROUP BY lx.flow""")
def network_integrated_gradients(spark, sf_dir):
    f = flows(spark, sf_dir).select("flow", networks.integrated_gradients(model(), F.col("x"), F.col("target"), F.col("reference"), STEPS).alias("g"))
    return f.select("flow", *summed(F.col("g")))


@query("WITH" + passed(f"SELECT lx.flow, lx.target, i AS k, h, zx + (r - x) * {W1} AS z FROM lx JOIN hz ON lx.flow = hz.flow UNION ALL SELECT flow, target, -1, h, zx FROM hz") + """
SELECT a.flow, round(sum(b.p - a.p), 6) AS total, round(sum((b.p - a.p) * a.k), 6) AS weighted FROM prob a JOIN prob b ON a.flow = b.flow AND a.k >= 0 AND b.k = -1 GROUP BY a.flow""")
def network_occlusion(spark, sf_dir):
    f = flows(spark, sf_dir).select("flow", networks.occlusion(model(), F.col("x"), F.col("target"), F.col("reference")).alias("g"))
    return f.select("flow", *summed(F.col("g")))


@query("WITH" + passed(f"""SELECT hz.flow, hz.target, k, hz.h, zr + coalesce(sum(d) FILTER (WHERE (k >> j) & 1 = 1), 0) AS z
FROM hz JOIN (SELECT flow, h, i % {GROUPS} AS j, sum((x - r) * {W1}) AS d FROM lx, {HS} GROUP BY flow, h, i % {GROUPS}) dz ON hz.flow = dz.flow AND hz.h = dz.h, (SELECT unnest(range(0, {2**GROUPS}))::INT AS k) ks GROUP BY hz.flow, hz.target, k, hz.h, zr""") + f"""
SELECT a.flow, j AS player, round(sum((b.p - a.p) / ({GROUPS} * (factorial({GROUPS - 1}) / (factorial(bit_count(a.k)::INT) * factorial({GROUPS - 1} - bit_count(a.k)::INT)))::DOUBLE)), 6) AS value
FROM prob a, (SELECT unnest(range(0, {GROUPS}))::INT AS j) js JOIN prob b ON a.flow = b.flow AND b.k = a.k + (1 << j) WHERE (a.k >> j) & 1 = 0 GROUP BY a.flow, j""")
def network_group_shapley(spark, sf_dir):
    """Six groups of coordinates as players, so that all coalitions are enumerated."""
    made = shapley.shapley_values(model().probabilities, WIDTH, F.col("x"), F.col("reference"), F.col("target"), [i % GROUPS for i in range(WIDTH)])
    return flows(spark, sf_dir).select("flow", F.posexplode(made).alias("player", "v")).select("flow", "player", r6("v").alias("value"))


@query()
def network_kernel_shapley(spark, sf_dir):
    """Every coordinate a player: sizes 1 and 63 whole, the others drawn in pairs."""
    made = shapley.shapley_values(model().probabilities, WIDTH, F.col("x"), F.col("reference"), F.col("target"))
    return flows(spark, sf_dir).select("flow", made.alias("values"))


@query()
def byte_fingerprints(spark, sf_dir):
    """Exact and rounded fingerprints of each vector's float32 bytes, and how many vectors share them."""
    f = accounts(spark, sf_dir).select("flow", hashing.bytes_fingerprint(F.col("a"), "<f4").alias("exact"), hashing.bytes_fingerprint(F.col("a"), "<f4", 5).alias("rounded"))
    shared = lambda name: f.groupBy(name).agg(F.count("*").alias(f"n_{name}"))
    return f.join(shared("exact"), "exact").join(shared("rounded"), "rounded").select("flow", "exact", "rounded", "n_exact", "n_rounded")
