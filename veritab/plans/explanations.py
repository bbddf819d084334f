"""Queries on preparation, explanations, curves, splits, resampling and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions.hashing import unit_sql
from veritab.operators import explain, gates, grouping, matching, resampling, seeds, transforms
from veritab.operators.prefix import quantiles
from veritab.plans._adapter import ACCOUNTS, PREDICTIONS, ROWS, SIMILARITY, accounts, predictions, r6, rows, similar, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


MODEL = explain.Logit(tuple(round(0.05 * ((i * 7) % 11 - 5), 4) for i in range(64)), 0.1)
W = "[" + ", ".join(f"{w}::DOUBLE" for w in MODEL.weights) + "]"
SCORED = ACCOUNTS + f""", wt AS (SELECT {W} AS w),
lx AS (SELECT flow, label, unnest(a) AS x, unnest(w) AS w, generate_subscripts(a, 1)::INT - 1 AS i FROM acc, wt),
md AS (SELECT i, median(x) AS r FROM lx GROUP BY i),
mg AS (SELECT flow, sum(x * w) + 0.1 AS m, sum(r * w) + 0.1 AS mr FROM lx JOIN md ON lx.i = md.i GROUP BY flow)"""


def with_reference(spark, sf_dir):
    """flow, label, x, reference: the median of each coordinate, one row, broadcast."""
    own = accounts(spark, sf_dir).select("flow", "label", F.col("a").alias("x"))
    med = quantiles(own.select(F.posexplode("x").alias("i", "v")), "v", {"r": 0.5}, "i")
    one = med.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]).alias("reference"))
    return own.crossJoin(F.broadcast(one))


def summed(c):
    """Digest of an account: sum, and sum weighted by place."""
    return [r6(A.total(c)).alias("total"), r6(A.total(F.transform(c, lambda v, i: v * i))).alias("weighted")]


@query("WITH" + SCORED + """ SELECT lx.flow, round(sum(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) * w * x), 6) AS total, round(sum(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) * w * x * i), 6) AS weighted FROM lx JOIN mg ON lx.flow = mg.flow GROUP BY lx.flow""")
def gradient_logit(spark, sf_dir):
    f = with_reference(spark, sf_dir).select("flow", explain.gradient_times_input(MODEL, F.col("x")).alias("g"))
    return f.select("flow", *summed(F.col("g")))


@query("WITH" + SCORED + """, s AS (SELECT flow, avg_slope FROM (SELECT flow, sum(CASE WHEN t IN (0, 64) THEN 0.5 ELSE 1 END * p * (1 - p)) / 64 AS avg_slope FROM (SELECT flow, t, 1 / (1 + exp(-(mr + (m - mr) * t / 64.0::DOUBLE))) AS p FROM mg, (SELECT unnest(range(0, 65)) AS t) tt) q GROUP BY flow) z)
SELECT lx.flow, round(sum((x - r) * w * avg_slope), 6) AS total, round(sum((x - r) * w * avg_slope * lx.i), 6) AS weighted FROM lx JOIN md ON lx.i = md.i JOIN s ON lx.flow = s.flow GROUP BY lx.flow""")
def integrated_gradients_logit(spark, sf_dir):
    f = with_reference(spark, sf_dir).select("flow", explain.integrated_gradients(MODEL, F.col("x"), F.col("reference")).alias("g"))
    return f.select("flow", *summed(F.col("g")))


OCC = SCORED + """, oc AS (SELECT lx.flow, lx.i, 1 / (1 + exp(-m)) - 1 / (1 + exp(-(m + w * (r - x)))) AS o FROM lx JOIN md ON lx.i = md.i JOIN mg ON lx.flow = mg.flow)"""


@query("WITH" + OCC + " SELECT flow, round(sum(o), 6) AS total, round(sum(o * i), 6) AS weighted FROM oc GROUP BY flow")
def occlusion_logit(spark, sf_dir):
    f = with_reference(spark, sf_dir).select("flow", explain.occlusion(MODEL, F.col("x"), F.col("reference")).alias("g"))
    return f.select("flow", *summed(F.col("g")))


@query("WITH" + SCORED + " SELECT lx.flow, round(sum(w * (x - r)), 6) AS total, round(sum(w * (x - r) * lx.i), 6) AS weighted FROM lx JOIN md ON lx.i = md.i GROUP BY lx.flow")
def shapley_logit_margin(spark, sf_dir):
    f = with_reference(spark, sf_dir).select("flow", explain.shapley_logit_margin(MODEL, F.col("x"), F.col("reference")).alias("g"))
    return f.select("flow", *summed(F.col("g")))


CURVES = OCC + """, rk AS (SELECT flow, i, row_number() OVER (PARTITION BY flow ORDER BY abs(o) DESC, i) AS pos FROM oc),
cv AS (SELECT lx.flow, fraction, 1 / (1 + exp(-max(m))) - 1 / (1 + exp(-(max(m) + sum(CASE WHEN pos <= ceil(fraction * 64) THEN w * (r - x) ELSE 0 END)))) AS deletion,
              1 / (1 + exp(-(max(mr) + sum(CASE WHEN pos <= ceil(fraction * 64) THEN w * (x - r) ELSE 0 END)))) - 1 / (1 + exp(-max(mr))) AS insertion
       FROM lx JOIN md ON lx.i = md.i JOIN mg ON lx.flow = mg.flow JOIN rk ON lx.flow = rk.flow AND lx.i = rk.i, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS fraction) f GROUP BY lx.flow, fraction)"""


def flow_curves(spark, sf_dir):
    f = with_reference(spark, sf_dir)
    occ = f.withColumn("o", explain.occlusion(MODEL, F.col("x"), F.col("reference")))
    ranked = occ.withColumn("ranking", A.top_k(F.col("o"), 64))
    return explain.curves(ranked, ["flow"], "x", "reference", "ranking", MODEL)


@query("WITH" + CURVES + " SELECT flow, fraction, round(deletion, 6) AS deletion, round(insertion, 6) AS insertion FROM cv")
def deletion_insertion_curves(spark, sf_dir):
    return flow_curves(spark, sf_dir).select("flow", "fraction", r6("deletion").alias("deletion"), r6("insertion").alias("insertion"))


@query("WITH" + CURVES + """, ww AS (SELECT *, (lead(fraction, 1, fraction) OVER l - lag(fraction, 1, 0) OVER l) / 2 AS wt FROM cv WINDOW l AS (PARTITION BY flow ORDER BY fraction))
SELECT flow, round(sum(wt * deletion) / 0.5, 6) AS deletion, round(sum(wt * insertion) / 0.5, 6) AS insertion, count(*)::BIGINT AS n_fractions FROM ww GROUP BY flow""")
def aopc_trapezoid(spark, sf_dir):
    a = explain.area(flow_curves(spark, sf_dir), "fraction", ["deletion", "insertion"], "flow")
    return a.select("flow", r6("deletion").alias("deletion"), r6("insertion").alias("insertion"), "n_fractions")


@query("WITH" + ACCOUNTS + """, lx AS (SELECT flow, label, unnest(a) AS x, generate_subscripts(a, 1)::INT - 1 AS i FROM acc), md AS (SELECT i, median(x) AS r FROM lx GROUP BY i), cm AS (SELECT label, i, median(x) AS c FROM lx GROUP BY ALL)
SELECT lx.flow, round(sum(r), 6) AS training_median, round(sum(c), 6) AS target_class_median, round(sum(d.x), 6) AS joint_donor FROM lx JOIN md ON lx.i = md.i JOIN cm ON lx.i = cm.i AND lx.label = cm.label JOIN lx d ON d.i = lx.i AND d.flow = (lx.flow * 31 + 7) % (SELECT count(*) FROM acc) GROUP BY lx.flow""")
def median_donor_operators(spark, sf_dir):
    f = with_reference(spark, sf_dir)
    cls = f.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.percentile("v", F.lit(0.5)).alias("c")).groupBy("label").agg(F.sum("c").alias("c"))
    donors = f.select(F.col("flow").alias("donor"), F.col("x").alias("d"))
    picked = f.withColumn("donor", (F.col("flow") * 31 + 7) % F.lit(f.count())).join(donors, "donor").join(cls, "label")
    return picked.select("flow", r6(A.total(F.col("reference"))).alias("training_median"), r6("c").alias("target_class_median"), r6(A.total(F.col("d"))).alias("joint_donor"))


@query("WITH" + ROWS + """, st AS (SELECT avg(price) FILTER (WHERE source <= 1995) AS a, stddev_pop(price) FILTER (WHERE source <= 1995) AS b, min(tax) FILTER (WHERE source <= 1995) AS c, max(tax) FILTER (WHERE source <= 1995) - min(tax) FILTER (WHERE source <= 1995) AS d FROM rowset)
SELECT source, round(avg((price - a) / b), 6) AS price_z, round(avg((tax - c) / d), 6) AS tax_unit, count(*)::BIGINT AS n FROM rowset, st GROUP BY source""")
def standardise_train_only(spark, sf_dir):
    r, train = rows(spark, sf_dir), F.col("source") <= 1995
    z = transforms.standardised(r, ["price"], train)
    z = transforms.standardised(z, ["tax"], train, "minmax")
    return z.groupBy("source").agg(r6(F.avg("price")).alias("price_z"), r6(F.avg("tax")).alias("tax_unit"), F.count("*").alias("n"))


@query("WITH" + ROWS + """, h AS (SELECT label, CASE WHEN quantity > 45 THEN NULL ELSE quantity END AS quantity, price FROM rowset), m AS (SELECT median(quantity) AS q, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM h)
SELECT label, round(avg(coalesce(quantity, q)), 6) AS quantity, round(avg(greatest(least(price, hi), lo)), 4) AS price, count(*)::BIGINT AS n FROM h, m GROUP BY label""")
def impute_clip_clean(spark, sf_dir):
    r = rows(spark, sf_dir).select("label", F.when(F.col("quantity") <= 45, F.col("quantity").cast("string")).otherwise("bad").alias("quantity"), "price")
    c = transforms.clip_quantiles(transforms.impute(transforms.finite(r, ["quantity"]), ["quantity"]), ["price"], 0.05, 0.95)
    return c.groupBy("label").agg(r6(F.avg("quantity")).alias("quantity"), F.round(F.avg("price"), 4).alias("price"), F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, event_type, value FROM events), sd AS (SELECT stddev_pop(value) AS s FROM e),
n AS (SELECT event_type, value + sqrt(-2 * ln(({unit_sql('g-u', 'event_id')} + 0.5) / 4294967296.0::DOUBLE)) * cos(2 * 3.141592653589793 * ({unit_sql('g-v', 'event_id')} / 4294967296.0::DOUBLE)) * 0.1 * s AS v FROM e, sd)
SELECT event_type, round(avg(v), 5) AS noisy_mean, count(*)::BIGINT AS n, round(avg(CASE WHEN v > 50 THEN 1 ELSE 0 END), 5) AS share FROM n GROUP BY event_type""")
def gaussian_noise(spark, sf_dir):
    e = transforms.noisy(table(spark, sf_dir, "events"), "value", "event_id", 0.1, "g")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("noisy_mean"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 50, 1).otherwise(0)), 5).alias("share"))


@query("SELECT count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS largest, true AS moved FROM events")
def feature_permutation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("value").alias("was"))
    p = transforms.permuted(e, "value", "event_id", "perm")
    return p.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("largest"), (F.count_if(F.col("value") != F.col("was")) > 0).alias("moved"))


@query("WITH" + ROWS + """, r AS (SELECT rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS q, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS p, rank() OVER (ORDER BY tax) + (count(*) OVER (PARTITION BY tax) - 1) / 2.0 AS t FROM rowset)
SELECT * FROM (SELECT 'quantity' AS left_feature, 'price' AS right_feature, round(1 - abs(corr(q, p)), 6) AS distance FROM r UNION ALL SELECT 'quantity', 'tax', round(1 - abs(corr(q, t)), 6) FROM r UNION ALL SELECT 'price', 'tax', round(1 - abs(corr(p, t)), 6) FROM r) u""")
def spearman_feature_distance(spark, sf_dir):
    d = grouping.feature_distance(rows(spark, sf_dir), ["quantity", "price", "tax"])
    return d.select("left_feature", "right_feature", r6("distance").alias("distance"))


@query()
def correlation_groups(spark, sf_dir):
    features = ["quantity", "price", "discount", "tax"]
    return grouping.feature_groups(grouping.feature_distance(rows(spark, sf_dir), features), features)


@query("""WITH m AS (SELECT o_custkey, least(2 * o_custkey, min(2 * o_orderkey + 1)) AS c FROM orders GROUP BY o_custkey)
SELECT (2 * o_custkey)::BIGINT AS node, c::BIGINT AS component FROM m UNION SELECT (2 * o_orderkey + 1)::BIGINT, c::BIGINT FROM orders JOIN m USING (o_custkey)""")
def connected_components(spark, sf_dir):
    """The graph of all customers (even nodes) and their orders (odd nodes). As an order has one customer, SQL needs no recursion."""
    o = table(spark, sf_dir, "orders")
    return grouping.connected_components(o.select((F.col("o_custkey") * 2).cast("long").alias("a"), (F.col("o_orderkey") * 2 + 1).cast("long").alias("b")))


def group_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("label"), F.count("*").alias("n"))


@query()
def balanced_group_split(spark, sf_dir):
    return grouping.balanced_split(group_sizes(spark, sf_dir), "o_custkey", "label", "n")


@query("SELECT 0::BIGINT AS n_violations, 3::BIGINT AS n_splits, true AS near_target, (SELECT count(*) FROM orders)::BIGINT AS n_rows")
def balanced_split_invariants(spark, sf_dir):
    s = balanced_group_split(spark, sf_dir)
    o = table(spark, sf_dir, "orders").join(s.drop("label"), "o_custkey")
    bad = grouping.split_violations(o, "split", "o_custkey").agg(F.count("*").alias("n_violations"))
    share = o.agg(F.countDistinct("split").alias("n_splits"), (F.abs(F.avg((F.col("split") == "train").cast("int")) - 0.7) < 0.03).alias("near_target"), F.count("*").alias("n_rows"))
    return bad.crossJoin(share)


@query("""WITH s AS (SELECT *, CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 = 7 THEN 'validation' ELSE 'test' END AS split, epoch_us(ts) / 1e6::DOUBLE AS t FROM events)
SELECT split, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share, count(*)::BIGINT AS n_rows, count(DISTINCT user_id)::BIGINT AS n_groups, count(DISTINCT event_type)::BIGINT AS n_classes, round(median(t), 1) AS median_time FROM s GROUP BY split""")
def split_diagnostics(spark, sf_dir):
    m = F.col("event_id") % 10
    e = table(spark, sf_dir, "events").withColumn("split", F.when(m < 7, "train").when(m == 7, "validation").otherwise("test"))
    d = grouping.split_diagnostics(e, "split", "ts", "user_id", "event_type")
    return d.select("split", r6("share").alias("share"), "n_rows", "n_groups", "n_classes", F.round(F.get("t", F.lit(1)), 1).alias("median_time"))


@query()
def bootstrap_crossed_numpy(spark, sf_dir):
    return resampling.crossed_bootstrap(similar(spark, sf_dir), "spearman", "label")


@query("WITH" + SIMILARITY + f""", c AS (SELECT seed, flow, avg(normalized_mass_l1) AS v FROM simil GROUP BY ALL), e AS (SELECT *, {unit_sql('boot', 'replicate', 'flow')} / 4294967296.0::DOUBLE AS u FROM c, (SELECT unnest(range(0, 5000)) AS replicate) r),
w AS (SELECT *, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 ELSE 3 END AS w FROM e), p AS (SELECT replicate, seed, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), d AS (SELECT replicate, avg(m) AS estimate FROM p GROUP BY replicate)
SELECT round(quantile_cont(estimate, 0.025), 6) AS ci_low, round(quantile_cont(estimate, 0.975), 6) AS ci_high, count(estimate)::BIGINT AS n_replicates FROM d""")
def bootstrap_crossed_hash(spark, sf_dir):
    """With the reference's 5,000 replicates."""
    i = resampling.hash_interval(similar(spark, sf_dir), "normalized_mass_l1", replicates=5_000)
    return i.select(r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "n_replicates")


@query("WITH" + ACCOUNTS + """, r AS (SELECT label, flow % 6 AS run, flow, m FROM acc), s AS (SELECT label, run, min(flow) AS flow FROM r GROUP BY ALL), q AS (SELECT s.label, s.run, a.m FROM s JOIN acc a ON s.flow = a.flow),
p AS (SELECT a.label, a.run AS l, b.run AS r, list_sum(list_transform(range(1, 65), lambda i: abs(a.m[i] - b.m[i]))) / 64 AS v FROM q a JOIN q b ON a.label = b.label AND a.run < b.run),
u AS (SELECT label, avg(v) AS u, count(*) AS np FROM p GROUP BY label), x AS (SELECT label, run, avg(v) AS p FROM (SELECT label, l AS run, v FROM p UNION ALL SELECT label, r, v FROM p) t GROUP BY ALL),
n AS (SELECT label, count(*) AS n FROM x GROUP BY label), z AS (SELECT x.label, u, np, n, (2 * (n - 1) * p - n * u) / nullif(n - 2, 0) AS v FROM x JOIN u ON x.label = u.label JOIN n ON x.label = n.label)
SELECT label, round(max(u), 6) AS estimate, round(stddev_samp(v) / sqrt(count(*)), 6) AS jackknife_se, count(*)::BIGINT AS n_runs, max(np)::BIGINT AS n_pairs FROM z GROUP BY label""")
def run_pair_u_statistic(spark, sf_dir):
    from veritab.operators.joins import unordered_pairs

    runs = accounts(spark, sf_dir).groupBy("label", (F.col("flow") % 6).alias("run")).agg(F.min_by("m", "flow").alias("m"))
    pairs = unordered_pairs(runs, ["label"], "run", ["m"])
    d = A.total(F.zip_with("left_m", "right_m", lambda a, b: F.abs(a - b))) / F.size("left_m")
    u = resampling.run_pair_statistic(pairs.withColumn("v", d), "v", "label")
    return u.select("label", r6("estimate").alias("estimate"), r6("jackknife_se").alias("jackknife_se"), "n_runs", "n_pairs")


def run_panel(spark, sf_dir):
    """seed, flow, run, q: magnitudes as shares of their sum, four runs of each flow and seed; incomplete panels are left out."""
    a = accounts(spark, sf_dir).select("seed", F.floor(F.col("flow") / 20).alias("source"), (F.floor(F.col("flow") / 5) % 4).alias("run"), F.transform("m", lambda x: x / A.total("m")).alias("q"))
    whole = a.groupBy("seed", "source").agg(F.count("*").alias("n")).filter("n = 4").select("seed", "source")
    return a.join(whole, ["seed", "source"]).withColumnRenamed("source", "flow")


def run_pairs(spark, sf_dir):
    from veritab.operators.joins import unordered_pairs

    pairs = unordered_pairs(run_panel(spark, sf_dir).withColumn("part", F.col("flow") % 2), ["part", "seed", "flow"], "run", ["q"])
    return pairs.withColumn("v", A.total(F.zip_with("left_q", "right_q", lambda x, y: F.abs(x - y))) / 2)


@query("WITH" + ACCOUNTS + f""", a AS (SELECT seed, flow // 20 AS source, (flow // 5) % 4 AS run, list_transform(m, lambda x: x / list_sum(m)) AS q FROM acc), w AS (SELECT seed, source FROM a GROUP BY ALL HAVING count(*) = 4),
p AS (SELECT x.source % 2 AS part, x.seed, x.source, x.run AS l, y.run AS r, list_sum(list_transform(range(1, 65), lambda i: abs(x.q[i] - y.q[i]))) / 2 AS v FROM a x JOIN a y ON x.seed = y.seed AND x.source = y.source AND x.run < y.run JOIN w ON w.seed = x.seed AND w.source = x.source),
j AS (SELECT part, seed, source, run, avg(v) AS p FROM (SELECT part, seed, source, l AS run, v FROM p UNION ALL SELECT part, seed, source, r, v FROM p) t GROUP BY ALL), reps AS (SELECT unnest(range(0, 1000)) AS rep),
h AS (SELECT source, rep, {unit_sql('boot', 'rep', 'source')} / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT source FROM j) d, reps), g AS (SELECT source, rep, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 ELSE 3 END AS w FROM h),
m AS (SELECT part, rep, seed, run, sum(w * p) / nullif(sum(w), 0) AS m FROM j JOIN g ON j.source = g.source GROUP BY ALL), pseudo AS (SELECT *, (2 * 3 * m - 4 * avg(m) OVER (PARTITION BY part, rep, seed)) / 2 AS z FROM m),
picks AS (SELECT rep, seed, k, {unit_sql('boot run', 'rep', 'seed', 'k')} * 4 // 4294967296 AS run FROM reps, (SELECT DISTINCT seed FROM j) s, (SELECT unnest(range(0, 4)) AS k) kk),
draws AS (SELECT part, rep, avg(v) AS d FROM (SELECT part, rep, seed, avg(z) AS v FROM pseudo JOIN picks USING (rep, seed, run) GROUP BY ALL) t GROUP BY ALL),
e AS (SELECT part, avg(s) AS estimate, count(*)::BIGINT AS n_seeds FROM (SELECT part, seed, avg(p) AS s FROM j GROUP BY ALL) t GROUP BY part),
i AS (SELECT part, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM draws GROUP BY part)
SELECT e.part, 'normalized_mass_l1' AS metric, round(estimate, 6) AS estimate, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, n_seeds, 4::BIGINT AS n_runs, n_seeds = 5 AS coverage_sufficient, true AS identification_coverage_sufficient,
CASE WHEN n_seeds <> 5 THEN 'not_evaluable_seed_coverage' WHEN hi <= 0.2 THEN 'pass' ELSE 'fail' END AS gate_status FROM e JOIN i ON e.part = i.part""")
def lime_u_intervals(spark, sf_dir):
    """Intervals of run-pair statistics with coverage and gate, under hashed draws."""
    pairs = run_pairs(spark, sf_dir)
    i = resampling.run_pair_hash_interval(pairs, "v", "part").withColumn("metric", F.lit("normalized_mass_l1"))
    c = seeds.coverage(pairs.withColumn("identified", F.col("v").isNotNull()), "identified", "part").drop("n_seeds")
    g = gates.apply_gates(i.join(c, "part"))
    return g.select("part", "metric", *[r6(x).alias(x) for x in ("estimate", "ci_low", "ci_high")], "n_seeds", "n_runs", "coverage_sufficient", "identification_coverage_sufficient", "gate_status")


@query()
def lime_u_bootstrap(spark, sf_dir):
    """The same statistics under the reference's law: seeds, sources and shared runs drawn 5,000 times."""
    return resampling.run_pair_bootstrap(run_pairs(spark, sf_dir), "v", "part")


@query()
def caliper_matching(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("correct", (F.col("truth") == F.col("d1")).cast("int"))
    return matching.caliper_matching(p, "correct", 1, 0, ["p1", "value"], "flow", "seed")


@query()
def conditional_gaussian(spark, sf_dir):
    a = accounts(spark, sf_dir).select("flow", F.col("a").alias("x"), F.slice(F.array_sort(A.top_k(F.col("a"), 3)), 1, 3).alias("selected"))
    return explain.conditional_gaussian(a, "flow", "x", "selected", *explain.moments(a, "x"))


@query()
def lime_ridge(spark, sf_dir):
    return explain.lime(accounts(spark, sf_dir).withColumnRenamed("a", "x"), "flow", "x", MODEL)


@query()
def kernel_shap_logit(spark, sf_dir):
    return explain.kernel_shap(accounts(spark, sf_dir).withColumnRenamed("a", "x"), "flow", "x", MODEL, [0.0] * 64)


@query("WITH" + PREDICTIONS + " SELECT seed, round(sum(p1), 4) AS total, count(*)::BIGINT AS n FROM pred GROUP BY seed")
def scored_by_batches(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("x", F.array("p1"))
    s = explain.scored(p, "x", lambda rows: rows[:, 0], "s")
    return s.groupBy("seed").agg(F.round(F.sum("s"), 4).alias("total"), F.count("*").alias("n"))
