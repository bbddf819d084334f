"""Queries on replacement operators, their controls and the roll-ups of perturbation studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions.hashing import unit_sql
from veritab.operators import aggregates, explain, gates, joins, replacement, resampling, seeds
from veritab.operators.staging import staged
from veritab.plans._adapter import accounts, r6
from veritab.plans.explanations import MODEL, OCC

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


WIDTH, TOP, POOL = 64, 3, 64
GROUPS = [i % 16 for i in range(WIDTH)]

CONTEXT = OCC + f""",
pool AS (SELECT *, row_number() OVER (ORDER BY donor) - 1 AS j, row_number() OVER (PARTITION BY label ORDER BY donor) - 1 AS jc, count(*) OVER (PARTITION BY label) AS nc, count(*) OVER () AS n
         FROM (SELECT flow AS donor, label FROM acc ORDER BY {unit_sql('pool', 'flow')}, flow LIMIT {POOL}) t),
cx AS (SELECT i, avg(x) AS mean, sqrt(var_samp(x) + 1e-6) AS sd, median(x) AS med FROM lx GROUP BY i),
cm AS (SELECT label, i, median(x) AS c FROM lx GROUP BY ALL),
rk AS (SELECT flow, i, row_number() OVER (PARTITION BY flow ORDER BY abs(o) DESC, i) AS pos FROM oc),
top AS (SELECT flow, i FROM rk WHERE pos <= {TOP}),
grp AS (SELECT DISTINCT t.flow, l.i FROM top t JOIN (SELECT DISTINCT i FROM lx) l ON l.i % 16 = t.i % 16),
jd AS (SELECT a.flow, p.donor FROM acc a JOIN pool p ON p.j = {unit_sql('joint-donor', 'a.flow')} % p.n),
nol AS (SELECT a.flow, a.label FROM acc a WHERE a.label NOT IN (SELECT label FROM pool)),
cd AS (SELECT a.flow, p.donor FROM acc a JOIN pool p ON p.label = a.label AND p.jc = {unit_sql('class-donor', 'a.flow')} % p.nc
       UNION ALL SELECT a.flow, p.donor FROM nol a JOIN pool p ON p.j = {unit_sql('class-donor', 'a.flow')} % p.n),
px AS (SELECT p.donor, p.j, l.i, l.x FROM pool p JOIN lx l ON l.flow = p.donor),
nd AS (SELECT l.flow, d.donor, d.j, sum((l.x - d.x) * (l.x - d.x) / (cx.sd * cx.sd)) AS dist FROM lx l JOIN px d ON d.i = l.i JOIN cx ON cx.i = l.i
       WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.flow = l.flow AND t.i = l.i) GROUP BY l.flow, d.donor, d.j),
nn AS (SELECT flow, donor FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY dist, j) AS k FROM nd) t WHERE k = 1),
pm AS (SELECT i, avg(x) AS x FROM px GROUP BY i),
z AS (SELECT l.flow, 'training_median' AS operator, l.i, cx.med AS z, cx.med AS origin FROM lx l JOIN cx ON cx.i = l.i
      UNION ALL SELECT l.flow, 'target_class_median', l.i, cm.c, cm.c FROM lx l JOIN cm ON cm.i = l.i AND cm.label = l.label
      UNION ALL SELECT l.flow, 'joint_donor', l.i, px.x, px.x FROM lx l JOIN jd ON jd.flow = l.flow JOIN px ON px.donor = jd.donor AND px.i = l.i
      UNION ALL SELECT l.flow, 'target_class_donor', l.i, px.x, px.x FROM lx l JOIN cd ON cd.flow = l.flow JOIN px ON px.donor = cd.donor AND px.i = l.i
      UNION ALL SELECT l.flow, 'nearest_neighbour_donor', l.i, px.x, pm.x FROM lx l JOIN nn ON nn.flow = l.flow JOIN px ON px.donor = nn.donor AND px.i = l.i JOIN pm ON pm.i = l.i
      UNION ALL SELECT l.flow, 'correlation_group_median', l.i, cx.med, cx.med FROM lx l JOIN cx ON cx.i = l.i
      UNION ALL SELECT l.flow, 'correlation_group_joint_donor', l.i, px.x, px.x FROM lx l JOIN jd ON jd.flow = l.flow JOIN px ON px.donor = jd.donor AND px.i = l.i),
sel AS (SELECT o.operator, t.flow, t.i FROM top t, (SELECT DISTINCT operator FROM z WHERE operator NOT LIKE 'correlation%') o UNION ALL SELECT o.operator, g.flow, g.i FROM grp g, (SELECT DISTINCT operator FROM z WHERE operator LIKE 'correlation%') o),
ef AS (SELECT z.flow, any_value(lx.label) AS label, z.operator, count(s.i)::BIGINT AS n_selected,
              1 / (1 + exp(-any_value(mg.m))) - 1 / (1 + exp(-(any_value(mg.m) + sum(CASE WHEN s.i IS NOT NULL THEN w * (z.z - x) ELSE 0 END)))) AS deletion,
              1 / (1 + exp(-(sum(w * z.origin) + 0.1 + sum(CASE WHEN s.i IS NOT NULL THEN w * (x - z.origin) ELSE 0 END)))) - 1 / (1 + exp(-(sum(w * z.origin) + 0.1))) AS insertion
       FROM z JOIN lx ON lx.flow = z.flow AND lx.i = z.i JOIN mg ON mg.flow = z.flow LEFT JOIN sel s ON s.operator = z.operator AND s.flow = z.flow AND s.i = z.i GROUP BY z.flow, z.operator)"""


def context_of(spark, sf_dir):
    """The accounts and their context."""
    own = accounts(spark, sf_dir).select("flow", "label", "seed", F.col("a").alias("x"))
    return own, replacement.operator_context(own, "flow", "x", "label", POOL)


def flows_in_context(spark, sf_dir, held=None):
    """flow, label, seed, x, ranking by occlusion against the medians, and the context."""
    own, context = held or context_of(spark, sf_dir)
    joined = replacement.with_context(own, context, replacement.class_medians(own, "x", "label"), "label")
    return joined.withColumn("ranking", A.top_k(explain.occlusion(MODEL, F.col("x"), F.col("median")), WIDTH))


def effects(spark, sf_dir, carry=()):
    own, context = context_of(spark, sf_dir)
    context = staged(context, "context")  # one row, which the search for donors reads too
    flows = flows_in_context(spark, sf_dir, (own, context))
    return replacement.operator_effects(flows, "flow", "x", "label", "ranking", MODEL, GROUPS, TOP, context, carry=carry)


@query("WITH" + CONTEXT + f""" SELECT i AS coordinate, round(mean, 6) AS mean, round(sd, 6) AS sd, round(med, 6) AS median, (SELECT count(*) FROM pool)::BIGINT AS pool_rows, (SELECT sum(donor) FROM pool)::BIGINT AS donors FROM cx""")
def operator_context(spark, sf_dir):
    own = accounts(spark, sf_dir).select("flow", "label", F.col("a").alias("x"))
    c = replacement.operator_context(own, "flow", "x", "label", POOL)
    cells = F.posexplode(F.arrays_zip("mean", "sd", "median")).alias("coordinate", "c")
    donors = F.aggregate("pool", F.lit(0).cast("long"), lambda s, d: s + d["donor"])
    out = c.select(cells, F.size("pool").cast("long").alias("pool_rows"), donors.alias("donors"))
    return out.select("coordinate", *[r6(f"c.{n}").alias(n) for n in ("mean", "sd", "median")], "pool_rows", "donors")


@query("WITH" + CONTEXT + " SELECT flow, operator, n_selected, round(deletion, 6) AS deletion, round(insertion, 6) AS insertion FROM ef")
def replacement_operator_effects(spark, sf_dir):
    return effects(spark, sf_dir).select("flow", "operator", F.col("n_selected").cast("long").alias("n_selected"), r6("deletion").alias("deletion"), r6("insertion").alias("insertion"))


@query("WITH" + CONTEXT + """, d AS (SELECT operator, (42 + flow % 5)::INT AS seed, flow, deletion AS v FROM ef), s AS (SELECT operator, seed, avg(v) AS v FROM d GROUP BY ALL), o AS (SELECT operator, avg(v) AS estimate, min(v) AS lowest, count(*) FILTER (WHERE v > 0)::BIGINT AS n_positive, count(*)::BIGINT AS n_seeds FROM s GROUP BY operator),
b AS (SELECT seed, v AS base FROM s WHERE operator = 'training_median'), c AS (SELECT operator, avg(v - base) AS contrast FROM s JOIN b USING (seed) GROUP BY operator), r AS (SELECT lowest > 0 AS established FROM o WHERE operator = 'training_median')
SELECT o.operator, round(estimate, 6) AS estimate, round(lowest, 6) AS lowest_seed, n_positive, n_seeds, round(contrast, 6) AS contrast, (lowest > 0) AS established, (lowest > 0) <> r.established AS verdict_changed FROM o JOIN c USING (operator), r""")
def operator_contrast_summary(spark, sf_dir):
    """Each operator against the training median: effects over seeds, the paired contrast and whether the verdict changes (Q17, Q24, Q28)."""
    per = seeds.seed_means(effects(spark, sf_dir, ("seed",)), "deletion", "operator")
    base = per.filter("operator = 'training_median'").select("seed", F.col("estimate").alias("base"))
    paired = per.join(F.broadcast(base), "seed")  # one row for each seed
    out = paired.groupBy("operator").agg(F.avg("estimate").alias("estimate"), F.min("estimate").alias("lowest_seed"), F.count_if(F.col("estimate") > 0).alias("n_positive"), F.count("*").alias("n_seeds"), F.avg(F.col("estimate") - F.col("base")).alias("contrast"), (F.min("base") > 0).alias("_reference"))
    established = F.col("lowest_seed") > 0
    return out.select("operator", r6("estimate").alias("estimate"), r6("lowest_seed").alias("lowest_seed"), "n_positive", "n_seeds", r6("contrast").alias("contrast"), established.alias("established"), (established != F.col("_reference")).alias("verdict_changed"))


@query("WITH" + CONTEXT + ", g AS (SELECT flow, count(*)::BIGINT AS n, sum(i)::BIGINT AS coordinates, count(DISTINCT i % 16)::BIGINT AS n_groups FROM grp GROUP BY flow) SELECT * FROM g")
def group_expanded_selection(spark, sf_dir):
    f = flows_in_context(spark, sf_dir).select("flow", replacement.expanded(F.slice("ranking", 1, TOP), GROUPS).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    return f.select("flow", F.size("s").cast("long").alias("n"), total.alias("coordinates"), F.size(F.array_distinct(F.transform("s", lambda i: i % 16))).cast("long").alias("n_groups"))


@query("WITH" + CONTEXT + f""", gd AS (SELECT l.flow, l.i % 16 AS g, sum(abs(l.x - cx.med)) / 4 AS v FROM lx l JOIN cx ON cx.i = l.i GROUP BY ALL),
gb AS (SELECT *, floor((row_number() OVER (PARTITION BY flow ORDER BY v, g) - 1) * 4 / 16)::INT AS b FROM gd),
gc AS (SELECT gb.*, EXISTS (SELECT 1 FROM top t WHERE t.flow = gb.flow AND t.i % 16 = gb.g) AS c FROM gb),
gp AS (SELECT flow, g, row_number() OVER (PARTITION BY flow, b ORDER BY {unit_sql('group-control', 'flow', 'g')}, g) <= sum(c::INT) OVER (PARTITION BY flow, b) AS drawn FROM gc)
SELECT flow, count(*)::BIGINT * 4 AS n, sum(CASE WHEN drawn THEN 4 * g + 96 ELSE 0 END)::BIGINT AS coordinates FROM gp WHERE drawn GROUP BY flow""")
def group_matched_controls(spark, sf_dir):
    f = flows_in_context(spark, sf_dir)
    c = replacement.group_matched_control(F.col("x"), F.col("median"), F.slice("ranking", 1, TOP), GROUPS, 4, F.col("flow"))
    return f.select("flow", c.alias("c")).select("flow", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda s, i: s + i).alias("coordinates"))


FRACTIONS, REPETITIONS = (0.05, 0.1, 0.25), 2
ARMS = CONTEXT + f""",
fr AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in FRACTIONS)}]) AS fraction), rp AS (SELECT unnest(range(0, {REPETITIONS})) AS rep),
un AS (SELECT flow, rep, i, row_number() OVER (PARTITION BY flow, rep ORDER BY u, i) AS pos FROM (SELECT l.flow, rep, l.i, {unit_sql('uniform', 'l.flow', 'rep', 'l.i')} AS u FROM lx l, rp) t),
arm AS (SELECT flow, fraction, -1 AS rep, i FROM rk, fr WHERE pos <= greatest(ceil(fraction * 64), 1) UNION ALL SELECT flow, fraction, rep, i FROM un, fr WHERE pos <= greatest(ceil(fraction * 64), 1)),
ae AS (SELECT a.flow, fraction, a.rep, z.operator, 1 / (1 + exp(-any_value(m))) - 1 / (1 + exp(-(any_value(m) + sum(w * (z.z - x))))) AS effect FROM arm a JOIN z ON z.flow = a.flow AND z.i = a.i AND z.operator IN ('training_median', 'joint_donor') JOIN lx ON lx.flow = a.flow AND lx.i = a.i JOIN mg ON mg.flow = a.flow GROUP BY a.flow, fraction, a.rep, z.operator),
cv2 AS (SELECT flow, operator, fraction, max(effect) FILTER (WHERE rep = -1) AS attribution, avg(effect) FILTER (WHERE rep >= 0) AS random, stddev_samp(effect) FILTER (WHERE rep >= 0) / sqrt({REPETITIONS}.0) AS random_se FROM ae GROUP BY ALL)"""


def arm_curves(spark, sf_dir):
    """flow, seed, operator, fraction, attribution, random (mean of uniform selections) and its error."""
    f = flows_in_context(spark, sf_dir)
    arms = F.explode(F.sequence(F.lit(-1), F.lit(REPETITIONS - 1))).alias("rep")
    grid = f.select("*", F.explode(F.array(*map(F.lit, FRACTIONS))).alias("fraction")).select("*", arms)
    k = F.greatest(F.ceil(F.col("fraction") * WIDTH), F.lit(1)).cast("int")
    chosen = F.when(F.col("rep") < 0, F.slice("ranking", F.lit(1), k)).otherwise(replacement.uniform_selection(F.col("flow"), F.col("rep"), WIDTH, k))
    grid = grid.withColumn("selected", chosen)
    p, x, s = MODEL.probability, F.col("x"), F.col("selected")
    cells = [F.struct(F.lit(o).alias("operator"), (p(x) - p(A.replace_selected(x, replacement.replacement_row(o, F.col("flow"), x, F.col("label"), s), s))).alias("effect")) for o in ("training_median", "joint_donor")]
    each = grid.select("flow", "seed", "fraction", "rep", F.inline(F.array(*cells)))
    uniform = F.when(F.col("rep") >= 0, F.col("effect"))
    return each.groupBy("flow", "seed", "operator", "fraction").agg(F.max(F.when(F.col("rep") < 0, F.col("effect"))).alias("attribution"), F.avg(uniform).alias("random"), (F.stddev_samp(uniform) / F.sqrt(F.lit(float(REPETITIONS)))).alias("random_se"))


@query("WITH" + ARMS + " SELECT flow, operator, fraction, round(attribution, 6) AS attribution, round(random, 6) AS random, round(random_se, 6) AS random_se FROM cv2")
def operator_curves_with_controls(spark, sf_dir):
    return arm_curves(spark, sf_dir).select("flow", "operator", "fraction", *[r6(c).alias(c) for c in ("attribution", "random", "random_se")])


AREAS = ARMS + """,
wt2 AS (SELECT *, (lead(fraction, 1, fraction) OVER l - lag(fraction, 1, 0) OVER l) / 2 AS wt FROM cv2 WINDOW l AS (PARTITION BY flow, operator ORDER BY fraction)),
ar AS (SELECT flow, operator, sum(wt * (attribution - random)) / 0.25 AS area, sqrt(sum(wt * wt * random_se * random_se)) / 0.25 AS area_se FROM wt2 GROUP BY ALL)"""


@query("WITH" + AREAS + " SELECT flow, operator, round(area, 6) AS area, round(area_se, 6) AS area_se, round(area - 1.96 * area_se, 6) AS lower95 FROM ar")
def attribution_minus_random_area(spark, sf_dir):
    """The area between attribution and random curves with its Monte-Carlo error."""
    c = arm_curves(spark, sf_dir).withColumn("difference", F.col("attribution") - F.col("random"))
    a = explain.area_with_error(c, "fraction", "difference", "random_se", "flow", "operator")
    return a.select("flow", "operator", *[r6(n).alias(n) for n in ("area", "area_se", "lower95")])


@query("WITH" + AREAS + """, v AS (SELECT operator, (42 + flow % 5)::INT AS seed, avg(area) AS primary_area, avg(area - 1.96 * area_se) AS conservative FROM ar GROUP BY ALL)
SELECT operator, seed, round(primary_area, 6) AS primary_area, round(conservative, 6) AS conservative, primary_area > 0 AS primary_pass, conservative > 0 AS conservative_pass, (primary_area > 0) AND (conservative > 0) AS robust, (primary_area > 0) <> (conservative > 0) AS sensitive FROM v""")
def monte_carlo_sensitivity(spark, sf_dir):
    """Primary and conservative summaries joined one to one, and the verdicts of both."""
    c = arm_curves(spark, sf_dir).withColumn("difference", F.col("attribution") - F.col("random"))
    a = explain.area_with_error(c, "fraction", "difference", "random_se", "flow", "operator").withColumn("seed", (42 + F.col("flow") % 5).cast("int"))
    primary = a.groupBy("operator", "seed").agg(F.avg("area").alias("primary_area"))
    conservative = a.groupBy("operator", "seed").agg(F.avg("lower95").alias("conservative"))
    m = joins.one_to_one(primary, conservative, ["operator", "seed"])
    p, q = F.col("primary_area") > 0, F.col("conservative") > 0
    return m.select("operator", "seed", r6("primary_area").alias("primary_area"), r6("conservative").alias("conservative"), p.alias("primary_pass"), q.alias("conservative_pass"), (p & q).alias("robust"), (p != q).alias("sensitive"))


@query("WITH" + AREAS + """, e AS (SELECT operator, label, count(*)::BIGINT AS n_conditions, count(*) FILTER (WHERE low > 0)::BIGINT AS n_positive, avg(est) AS mean_effect, min(low) AS min_ci_low, avg(low) AS mean_ci_low
 FROM (SELECT operator, acc.label, (42 + ar.flow % 5)::INT AS seed, avg(area) AS est, avg(area - 1.96 * area_se) AS low FROM ar JOIN acc ON acc.flow = ar.flow GROUP BY ALL) t GROUP BY ALL)
SELECT operator, label, n_conditions, n_positive, round(mean_effect, 6) AS mean_effect, round(min_ci_low, 6) AS min_ci_low, round(mean_ci_low, 6) AS mean_ci_low, round(n_positive::DOUBLE / n_conditions, 6) AS positive_fraction FROM e""")
def positive_effect_counts(spark, sf_dir):
    """Conditions with a positive lower bound, by operator and class."""
    c = arm_curves(spark, sf_dir).withColumn("difference", F.col("attribution") - F.col("random"))
    a = explain.area_with_error(c, "fraction", "difference", "random_se", "flow", "operator")
    a = a.join(accounts(spark, sf_dir).select("flow", "label", "seed"), "flow")
    cells = a.groupBy("operator", "label", "seed").agg(F.avg("area").alias("estimate"), F.avg("lower95").alias("ci_low"))
    out = aggregates.effect_counts(cells, "estimate", "ci_low", "operator", "label")
    return out.select("operator", "label", "n_conditions", "n_positive", *[r6(n).alias(n) for n in ("mean_effect", "min_ci_low", "mean_ci_low", "positive_fraction")])


STEPS = (2, 4, 8, 16, 32)


@query("WITH" + CONTEXT + f""", st AS (SELECT unnest([{', '.join(map(str, STEPS))}]) AS steps), sl AS (SELECT flow, steps, m, mr, sum(CASE WHEN t IN (0, steps) THEN 0.5 ELSE 1 END * p * (1 - p)) / steps AS slope FROM (SELECT flow, steps, t, m, mr, 1 / (1 + exp(-(mr + (m - mr) * t / steps::DOUBLE))) AS p FROM mg, st, (SELECT unnest(range(0, 33)) AS t) tt WHERE t <= steps) q GROUP BY flow, steps, m, mr),
rs AS (SELECT flow, steps, abs((m - mr) * slope - (1 / (1 + exp(-m)) - 1 / (1 + exp(-mr)))) AS residual FROM sl), fs AS (SELECT flow, coalesce(min(steps) FILTER (WHERE residual <= 2e-8), 32) AS steps FROM rs GROUP BY flow)
SELECT steps::INT AS steps, count(*)::BIGINT AS n, count(*) FILTER (WHERE residual > 2e-8)::BIGINT AS n_open FROM fs JOIN rs USING (flow, steps) GROUP BY steps""")
def integration_steps(spark, sf_dir):
    """The least number of steps, doubled from 2, at which each account's sum is the score's change; those open at the last (Q33, Q34)."""
    from veritab.plans.explanations import with_reference

    f = with_reference(spark, sf_dir).select("flow", "x", "reference")
    p = MODEL.probability
    change = p(F.col("x")) - p(F.col("reference"))
    cells = [F.struct(F.lit(s).alias("steps"), F.abs(A.total(explain.integrated_gradients(MODEL, F.col("x"), F.col("reference"), s)) - change).alias("residual")) for s in STEPS]
    levels = f.select("flow", F.array(*cells).alias("r"))
    first = F.coalesce(F.array_min(F.transform(F.filter("r", lambda c: c["residual"] <= 2e-8), lambda c: c["steps"])), F.lit(STEPS[-1]))
    chosen = levels.select(first.alias("steps"), F.element_at("r", -1)["residual"].alias("last"))
    return chosen.groupBy("steps").agg(F.count("*").alias("n"), F.count_if((F.col("steps") == STEPS[-1]) & (F.col("last") > 2e-8)).alias("n_open"))


@query("WITH" + ARMS + """, tk AS (SELECT flow, sum(i)::BIGINT AS top_sum, string_agg(i::VARCHAR, ',' ORDER BY i) AS top_k FROM rk WHERE pos <= 5 GROUP BY flow), uk AS (SELECT flow, string_agg(i::VARCHAR, ',' ORDER BY i) AS random_k FROM un WHERE rep = 0 AND pos <= 5 GROUP BY flow)
SELECT flow, top_k, random_k FROM tk JOIN uk USING (flow)""")
def feature_selections(spark, sf_dir):
    """Sorted indices of the top five coordinates and of five at random (Q45)."""
    f = flows_in_context(spark, sf_dir)
    shown = lambda c: F.array_join(F.transform(F.array_sort(c), lambda i: i.cast("string")), ",")
    return f.select("flow", shown(F.slice("ranking", 1, 5)).alias("top_k"), shown(replacement.uniform_selection(F.col("flow"), F.lit(0), WIDTH, F.lit(5))).alias("random_k"))


@query("WITH" + CONTEXT + """, s AS (SELECT operator, (42 + flow % 5)::INT AS seed, avg(deletion) AS v FROM ef GROUP BY ALL), n AS (SELECT operator, seed, v, round(v, 3) AS stored FROM s)
SELECT operator, seed, round(v, 6) AS recomputed, stored FROM n WHERE abs(v - stored) > 0.0003""")
def functional_verification(spark, sf_dir):
    """Recomputed means that differ from stored ones, here rounded to three digits, by more than a tolerance."""
    from veritab.operators.panels import differences

    now = seeds.seed_means(effects(spark, sf_dir, ("seed",)), "deletion", "operator").select("operator", "seed", F.col("estimate").alias("v"))
    stored = now.withColumn("v", F.round("v", 3))
    return differences(now, stored, ["operator", "seed"], "v", 0.0003).select("operator", "seed", r6("new_value").alias("recomputed"), F.col("old_value").alias("stored"))


@query()
def kernel_width_ablation(spark, sf_dir):
    """Fit of the local surrogate by kernel width and ridge (Q14): mean and least r2 over all accounts."""
    own = accounts(spark, sf_dir).select("flow", F.col("a").alias("x"))
    out = None
    for width in (0.5, 0.75, 1.0):
        for ridge in (0.1, 1.0):
            one = explain.lime(own, "flow", "x", MODEL, samples=200, width=width, ridge=ridge).agg(F.avg("r2").alias("mean_r2"), F.min("r2").alias("least_r2"), F.count("*").alias("n"))
            one = one.select(F.lit(width).alias("width"), F.lit(ridge).alias("ridge"), "mean_r2", "least_r2", "n")
            out = one if out is None else out.unionByName(one)
    return out


@query()
def gaussian_operator_effects(spark, sf_dir):
    """Deletion effects of the two conditional-Gaussian operators, the mean and a draw."""
    f = flows_in_context(spark, sf_dir).select("flow", "x", F.slice("ranking", 1, TOP).alias("selected"))
    mean, covariance = explain.moments(f, "x")
    p, out = MODEL.probability, None
    for name, draw in (("conditional_gaussian_mean", False), ("conditional_gaussian_draw", True)):
        made = explain.conditional_gaussian(f, "flow", "x", "selected", mean, covariance, replacement.RIDGE, draw)
        z = explain.with_values(F.col("x"), F.col("selected"), F.col("values"))
        one = f.join(made, "flow").select("flow", F.lit(name).alias("operator"), r6(p(F.col("x")) - p(z)).alias("deletion"))
        out = one if out is None else out.unionByName(one)
    return out
