"""Queries on predictions: metrics, thresholds, calibration, weighting and agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritab.functions import labels
from veritab.operators import aggregates, metrics
from veritab.plans._adapter import PREDICTIONS, ROWS, predictions, r6, rows, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def one(spark, sf_dir):
    return predictions(spark, sf_dir).withColumnsRenamed({"p1": "score", "d1": "decision"})


CM = "count(*) FILTER (WHERE truth = 1 AND d1 = 1)::BIGINT AS tp, count(*) FILTER (WHERE truth = 0 AND d1 = 1)::BIGINT AS fp, count(*) FILTER (WHERE truth = 1 AND d1 = 0)::BIGINT AS fn, count(*) FILTER (WHERE truth = 0 AND d1 = 0)::BIGINT AS tn"
RATES = """round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fn + fp, 0), 0), 6) AS f1, round(coalesce(5 * tp::DOUBLE / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2, round(fp::DOUBLE / greatest(fp + tn, 1), 6) AS fpr, round(fn::DOUBLE / greatest(fn + tp, 1), 6) AS fnr,
round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy"""


@query("WITH" + PREDICTIONS + f", c AS (SELECT seed, {CM} FROM pred GROUP BY seed) SELECT seed, tp, fp, fn, tn, {RATES} FROM c")
def confusion_and_rates(spark, sf_dir):
    m = metrics.binary_metrics(one(spark, sf_dir), "seed")
    return m.select("seed", "tp", "fp", "fn", "tn", *[r6(n).alias(n) for n in metrics.rates()])


@query("WITH" + PREDICTIONS + """, c AS (SELECT seed, p1, sum(truth) AS pos, count(*) AS n FROM pred GROUP BY ALL),
w AS (SELECT *, sum(n - pos) OVER (PARTITION BY seed ORDER BY p1) - (n - pos) AS below, sum(pos) OVER (PARTITION BY seed ORDER BY p1 DESC) AS tp, sum(n) OVER (PARTITION BY seed ORDER BY p1 DESC) AS seen FROM c),
a AS (SELECT seed, sum(pos * (below + (n - pos) / 2.0))::DOUBLE / (sum(pos) * sum(n - pos)) AS roc_auc, sum(pos * tp::DOUBLE / seen) / sum(pos) AS average_precision FROM w GROUP BY seed),
l AS (SELECT seed, avg(-(truth * ln(least(greatest(p1, 1e-15), 1 - 1e-15)) + (1 - truth) * ln(1 - least(greatest(p1, 1e-15), 1 - 1e-15)))) AS log_loss, avg((p1 - truth) * (p1 - truth)) AS brier FROM pred GROUP BY seed)
SELECT a.seed, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM a JOIN l ON a.seed = l.seed""")
def binary_metric_suite(spark, sf_dir):
    p = one(spark, sf_dir)
    out = metrics.roc_auc(p, "seed").join(metrics.average_precision(p, "seed"), "seed").join(p.groupBy("seed").agg(*metrics.probability_scores()), "seed")
    return out.select("seed", *[r6(n).alias(n) for n in ("roc_auc", "average_precision", "log_loss", "brier")])


@query("WITH" + PREDICTIONS + """, b AS (SELECT seed, least(floor(least(greatest(p1, 0), 1) * 15), 14)::INT AS bin, count(*) AS n, avg(p1) AS s, avg(truth) AS t FROM pred GROUP BY ALL)
SELECT seed, round(sum(n * abs(s - t)) / sum(n), 6) AS calibration_error FROM b GROUP BY seed""")
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(one(spark, sf_dir), 15, "seed").select("seed", r6("calibration_error").alias("calibration_error"))


@query("WITH" + PREDICTIONS + """, c AS (SELECT seed, p1 AS th, sum(truth) AS pos, count(*) AS n FROM pred GROUP BY ALL),
e AS (SELECT seed, th, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY seed) AS p, sum(n - pos) OVER (PARTITION BY seed) AS q FROM c WINDOW w AS (PARTITION BY seed ORDER BY th DESC)),
s AS (SELECT seed, th, tp::DOUBLE / p AS recall, fp::DOUBLE / q AS fpr, tp::DOUBLE / greatest(tp + fp, 1) AS pr FROM e),
r AS (SELECT *, 5 * pr * recall / greatest(4 * pr + recall, 2.220446049250313e-16) AS f2 FROM s WHERE fpr <= 0.05 + 1e-15),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY recall DESC, f2 DESC, th DESC) AS n FROM r)
SELECT seed, round(th, 6) AS threshold, round(recall, 6) AS recall, round(f2, 6) AS f2, round(fpr, 6) AS fpr, round(pr, 6) AS precision FROM k WHERE n = 1""")
def threshold_at_fpr_cap(spark, sf_dir):
    t = metrics.threshold_at_fpr(one(spark, sf_dir), 0.05, "seed")
    return t.select("seed", *[r6(n).alias(n) for n in ("threshold", "recall", "f2", "fpr", "precision")])


GRID = PREDICTIONS + f""", g AS (SELECT unnest(range(0, 1001)) AS step),
h AS (SELECT least(floor(p1 * 1000 + 1e-9), 1000)::INT AS step, sum(truth) AS pos, count(*) AS n FROM pred GROUP BY ALL),
j AS (SELECT g.step, coalesce(pos, 0) AS pos, coalesce(n, 0) AS n FROM g LEFT JOIN h ON g.step = h.step),
c AS (SELECT step / 1000.0::DOUBLE AS threshold, sum(pos) OVER (ORDER BY step DESC) AS tp, sum(n - pos) OVER (ORDER BY step DESC) AS fp, sum(pos) OVER () - sum(pos) OVER (ORDER BY step DESC) AS fn, sum(n - pos) OVER () - sum(n - pos) OVER (ORDER BY step DESC) AS tn FROM j),
t AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {RATES} FROM c)"""


@query("WITH" + GRID + " SELECT * FROM t")
def threshold_grid_1001(spark, sf_dir):
    g = metrics.threshold_grid(one(spark, sf_dir))
    return g.select("threshold", "tp", "fp", "fn", "tn", *[r6(n).alias(n) for n in metrics.rates()])


@query("WITH" + GRID + """ SELECT 'best_f1' AS strategy, threshold, f1 AS value FROM (SELECT * FROM t ORDER BY f1 DESC, fnr, fpr, threshold LIMIT 1) a
UNION ALL SELECT 'best_f2', threshold, f2 FROM (SELECT * FROM t ORDER BY f2 DESC, fnr, fpr, threshold LIMIT 1) b
UNION ALL SELECT 'min_fnr_at_max_fpr', threshold, fnr FROM (SELECT * FROM t WHERE fpr <= 0.05 ORDER BY fnr, fpr, f2 DESC, threshold DESC LIMIT 1) c""")
def threshold_strategies(spark, sf_dir):
    g = metrics.threshold_grid(one(spark, sf_dir))
    g = g.select("threshold", *[r6(n).alias(n) for n in metrics.rates()])
    out = None
    for strategy, value in (("best_f1", "f1"), ("best_f2", "f2"), ("min_fnr_at_max_fpr", "fnr")):
        one_row = metrics.tuned_threshold(g, strategy, 0.05).select(F.lit(strategy).alias("strategy"), "threshold", F.col(value).alias("value"))
        out = one_row if out is None else out.unionByName(one_row)
    return out


@query("WITH" + ROWS + ", c AS (SELECT label, count(*) AS n FROM rowset GROUP BY label) SELECT label, n::BIGINT AS n, round(least(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 10), 6) AS weight, n >= 20 AS eligible FROM c")
def class_weights_capped(spark, sf_dir):
    r = rows(spark, sf_dir)
    w = metrics.class_weights(r, "label").join(metrics.eligible_classes(r, "label").select("label", "eligible"), "label")
    return w.select("label", "n", r6("weight").alias("weight"), "eligible")


PER = ROWS + """, p AS (SELECT *, CASE WHEN price * (1 - discount) > 60000 THEN 'R' WHEN quantity > 20 THEN 'N' ELSE 'A' END AS decision FROM rowset),
k AS (SELECT DISTINCT source FROM p), cls AS (SELECT unnest(['A', 'N', 'R', 'Z']) AS class),
pc AS (SELECT k.source, cls.class, count(*) FILTER (WHERE p.label = cls.class AND p.decision = cls.class) AS tp, count(*) FILTER (WHERE p.label = cls.class) AS support, count(*) FILTER (WHERE p.decision = cls.class) AS predicted FROM k, cls, p WHERE p.source = k.source GROUP BY ALL),
m AS (SELECT source, class, support, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(support + predicted, 0), 0) AS f1 FROM pc)"""


def decided(spark, sf_dir):
    d = F.when(F.col("price") * (1 - F.col("discount")) > 60000, "R").when(F.col("quantity") > 20, "N").otherwise("A")
    return rows(spark, sf_dir).withColumn("decision", d)


def per_class(spark, sf_dir):
    classes = spark.createDataFrame([(c,) for c in "ANRZ"], "class string")
    return metrics.per_class(decided(spark, sf_dir), classes, "label", "decision", "source")


@query("WITH" + PER + " SELECT source, class, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def per_class_metrics(spark, sf_dir):
    return per_class(spark, sf_dir).select("source", "class", F.col("support").cast("long").alias("support"), *[r6(n).alias(n) for n in ("precision", "recall", "f1")])


SUMMARY = PER + """, s AS (SELECT source, sum(recall * support) / sum(support) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(support) AS n FROM m GROUP BY source)"""


@query("WITH" + SUMMARY + " SELECT source, n::BIGINT AS n, round(accuracy, 6) AS accuracy, round(balanced, 6) AS balanced_accuracy_present_classes, round(macro_f1, 6) AS macro_f1_all_classes, round(weighted_f1, 6) AS weighted_f1 FROM s")
def per_source_metrics(spark, sf_dir):
    s = metrics.class_summary(per_class(spark, sf_dir), "source")
    return s.select("source", F.col("n").cast("long").alias("n"), *[r6(n).alias(n) for n in ("accuracy", "balanced_accuracy_present_classes", "macro_f1_all_classes", "weighted_f1")])


@query("WITH" + SUMMARY + """ SELECT 'row_pooled' AS estimand, round((SELECT avg((label = decision)::INT) FROM p), 6) AS accuracy UNION ALL SELECT 'source_unweighted', round(avg(accuracy), 6) FROM s
UNION ALL SELECT 'source_support_weighted', round(sum(accuracy * n) / sum(n), 6) FROM s
UNION ALL SELECT 'one_row_per_fingerprint', round(avg((label = decision)::INT), 6) FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY k, price) AS i FROM p) t WHERE i = 1""")
def weighting_estimands(spark, sf_dir):
    p = decided(spark, sf_dir).withColumn("hit", (F.col("label") == F.col("decision")).cast("int"))
    by_source = p.groupBy("source").agg(F.avg("hit").alias("a"), F.count("*").alias("n"))
    unique = p.withColumn("i", F.row_number().over(Window.partitionBy("fp").orderBy("k", "price"))).filter("i = 1")
    cells = {"row_pooled": p.agg(F.avg("hit").alias("a")), "source_unweighted": by_source.agg(F.avg("a").alias("a")), "source_support_weighted": by_source.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("a")), "one_row_per_fingerprint": unique.agg(F.avg("hit").alias("a"))}
    out = None
    for name, f in cells.items():
        f = f.select(F.lit(name).alias("estimand"), r6("a").alias("accuracy"))
        out = f if out is None else out.unionByName(f)
    return out


@query("""WITH d AS (SELECT lang, source, toxic AS truth, (n_chars > 1500)::INT AS decision FROM documents JOIN labels USING (doc_id))
SELECT coalesce(lang, source) AS stratum, CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS kind, count(*) FILTER (WHERE truth = 1)::BIGINT AS n, round(avg(decision) FILTER (WHERE truth = 1), 6) AS recall FROM d GROUP BY GROUPING SETS ((lang), (source))""")
def subgroup_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", F.col("toxic").alias("truth"), (F.col("n_chars") > 1500).cast("int").alias("decision"))
    g = d.groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.grouping("lang").alias("g"), F.count_if(F.col("truth") == 1).alias("n"), r6(F.avg(F.when(F.col("truth") == 1, F.col("decision")))).alias("recall"))
    return g.select(F.coalesce("lang", "source").alias("stratum"), F.when(F.col("g") == 0, "lang").otherwise("source").alias("kind"), "n", "recall")


@query("WITH" + PREDICTIONS + """, c AS (SELECT seed, count(*) AS n, count(*) FILTER (WHERE d1 = d2)::BIGINT AS a, count(*) FILTER (WHERE d1 = truth AND d2 = truth)::BIGINT AS bc, count(*) FILTER (WHERE d1 <> truth AND d2 <> truth)::BIGINT AS bw, count(*) FILTER (WHERE d1 = truth AND d2 <> truth)::BIGINT AS lo, count(*) FILTER (WHERE d1 <> truth AND d2 = truth)::BIGINT AS ro FROM pred GROUP BY seed)
SELECT seed, n::BIGINT AS n, a AS n_agree, bc AS n_both_correct, bw AS n_both_wrong, lo AS n_left_only, ro AS n_right_only, round(a / n::DOUBLE, 6) AS agree_rate FROM c""")
def prediction_agreement_models(spark, sf_dir):
    a = metrics.agreement(predictions(spark, sf_dir), "truth", "d1", "d2", "seed")
    return a.select("seed", "n", *[f"n_{x}" for x in ("agree", "both_correct", "both_wrong", "left_only", "right_only")], r6("agree_rate").alias("agree_rate"))


@query("WITH" + PREDICTIONS + """, q AS (SELECT flow // 5 AS sample, seed, d1, truth FROM pred), u AS (SELECT sample, min(d1) = max(d1) AS unanimous, bool_and(d1 = truth) AS all_ok, bool_or(d1 = truth) AS any_ok FROM q GROUP BY sample),
p AS (SELECT a.seed AS x, b.seed AS y, avg((a.d1 = b.d1)::INT) AS r FROM q a JOIN q b ON a.sample = b.sample AND a.seed < b.seed GROUP BY ALL)
SELECT (SELECT count(*) FROM u)::BIGINT AS n_samples, round((SELECT avg(unanimous::INT) FROM u), 6) AS unanimity_rate, round((SELECT avg(all_ok::INT) FROM u), 6) AS all_correct_rate, round((SELECT avg(any_ok::INT) FROM u), 6) AS any_correct_rate,
count(*)::BIGINT AS n_pairs, round(avg(r), 6) AS mean_agreement, round(min(r), 6) AS min_agreement, round(max(r), 6) AS max_agreement FROM p""")
def prediction_agreement_seeds(spark, sf_dir):
    from veritab.operators.joins import unordered_pairs

    q = predictions(spark, sf_dir).select(F.floor(F.col("flow") / 5).alias("sample"), "seed", "d1", "truth")
    rate = lambda c: F.avg(c.cast("int"))
    u = q.groupBy("sample").agg((F.min("d1") == F.max("d1")).alias("unanimous"), F.bool_and(F.col("d1") == F.col("truth")).alias("all_ok"), F.bool_or(F.col("d1") == F.col("truth")).alias("any_ok"))
    u = u.agg(F.count("*").alias("n_samples"), r6(rate(F.col("unanimous"))).alias("unanimity_rate"), r6(rate(F.col("all_ok"))).alias("all_correct_rate"), r6(rate(F.col("any_ok"))).alias("any_correct_rate"))
    pairs = unordered_pairs(q, ["sample"], "seed", ["d1"]).groupBy("left_seed", "right_seed").agg(rate(F.col("left_d1") == F.col("right_d1")).alias("r"))
    return u.crossJoin(pairs.agg(F.count("*").alias("n_pairs"), r6(F.avg("r")).alias("mean_agreement"), r6(F.min("r")).alias("min_agreement"), r6(F.max("r")).alias("max_agreement")))


@query("WITH" + PREDICTIONS + """, e AS (SELECT *, CASE WHEN truth = 1 AND d1 = 1 THEN 'TP' WHEN truth = 0 AND d1 = 0 THEN 'TN' WHEN d1 = 1 THEN 'FP' ELSE 'FN' END AS error_type, CASE WHEN d1 = 1 THEN p1 ELSE 1 - p1 END AS confidence, abs(p1 - 0.5) AS margin FROM pred)
SELECT seed, error_type, count(*)::BIGINT AS n, round(min(confidence), 6) AS q00, round(quantile_cont(confidence, 0.05), 6) AS q05, round(quantile_cont(confidence, 0.25), 6) AS q25, round(median(confidence), 6) AS q50, round(quantile_cont(confidence, 0.75), 6) AS q75, round(quantile_cont(confidence, 0.95), 6) AS q95, round(max(confidence), 6) AS q100, round(median(margin), 6) AS margin_q50 FROM e GROUP BY ALL""")
def score_quantiles_by_outcome(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    names = ("q00", "q05", "q25", "q50", "q75", "q95", "q100")
    q = o.groupBy("seed", "error_type").agg(F.count("*").alias("n"), aggregates.quantile("confidence", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]).alias("q"), r6(aggregates.quantile("margin", 0.5)).alias("margin_q50"))
    return q.select("seed", "error_type", "n", *[r6(F.get("q", F.lit(i))).alias(x) for i, x in enumerate(names)], "margin_q50")


def outcomes(spark, sf_dir):
    p = one(spark, sf_dir)
    return p.select("flow", "seed", "value", labels.error_type(F.col("truth"), F.col("decision")).alias("error_type"), metrics.decided_confidence(F.col("score"), F.col("decision")).alias("confidence"), metrics.binary_margin(F.col("score"), 0.5).alias("margin"))


@query("WITH" + PREDICTIONS + """, e AS (SELECT *, CASE WHEN truth = 1 AND d1 = 1 THEN 'TP' WHEN truth = 0 AND d1 = 0 THEN 'TN' WHEN d1 = 1 THEN 'FP' ELSE 'FN' END AS error_type, CASE WHEN d1 = 1 THEN p1 ELSE 1 - p1 END AS confidence FROM pred),
b AS (SELECT seed, greatest(min(confidence) FILTER (WHERE error_type = 'TP'), min(confidence) FILTER (WHERE error_type = 'FP')) AS low, least(max(confidence) FILTER (WHERE error_type = 'TP'), max(confidence) FILTER (WHERE error_type = 'FP')) AS high FROM e GROUP BY seed)
SELECT b.seed, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (WHERE error_type = 'TP' AND confidence BETWEEN low AND high)::BIGINT AS left_retained, count(*) FILTER (WHERE error_type = 'FP' AND confidence BETWEEN low AND high)::BIGINT AS right_retained FROM e JOIN b ON e.seed = b.seed GROUP BY ALL""")
def common_support(spark, sf_dir):
    c = aggregates.common_support(outcomes(spark, sf_dir), "confidence", "error_type", "TP", "FP", "seed")
    return c.select("seed", r6("low").alias("low"), r6("high").alias("high"), "left_retained", "right_retained")


@query("WITH" + PREDICTIONS + """, r AS (SELECT seed, rank() OVER (PARTITION BY seed ORDER BY p1) + (count(*) OVER (PARTITION BY seed, p1) - 1) / 2.0 AS a, rank() OVER (PARTITION BY seed ORDER BY value) + (count(*) OVER (PARTITION BY seed, value) - 1) / 2.0 AS b FROM pred)
SELECT seed, round(corr(a, b), 6) AS spearman, count(*)::BIGINT AS n FROM r GROUP BY seed""")
def spearman_score_effect(spark, sf_dir):
    return aggregates.spearman(predictions(spark, sf_dir), "p1", "value", "seed").select("seed", r6("spearman").alias("spearman"), "n")


@query("WITH" + PREDICTIONS + """, e AS (SELECT *, CASE WHEN truth = 1 AND d1 = 1 THEN 'TP' WHEN truth = 0 AND d1 = 0 THEN 'TN' WHEN d1 = 1 THEN 'FP' ELSE 'FN' END AS error_type FROM pred),
l AS (SELECT 'all' AS stratum_kind, 'all' AS stratum, p1 FROM e UNION ALL SELECT 'error_type', error_type, p1 FROM e UNION ALL SELECT 'seed', seed::VARCHAR, p1 FROM e UNION ALL SELECT 'error_typexseed', error_type || '/' || seed, p1 FROM e)
SELECT stratum_kind, stratum, count(*)::BIGINT AS n, round(avg(p1), 6) AS mean_score FROM l GROUP BY ALL""")
def error_taxonomy_strata(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("error_type", labels.error_type(F.col("truth"), F.col("d1")))
    s = aggregates.long_strata(p, ["error_type", "seed", ("error_type", "seed")])
    return s.groupBy("stratum_kind", "stratum").agg(F.count("*").alias("n"), r6(F.avg("p1")).alias("mean_score"))


@query("""SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey)::BIGINT AS level, sum(50 * 32)::BIGINT AS evaluations, count(*)::BIGINT AS n_units FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def workload_rollup(spark, sf_dir):
    w = aggregates.workload(table(spark, sf_dir, "customer"), F.lit(50 * 32), "c_mktsegment", "c_nationkey")
    return w.select("c_mktsegment", "c_nationkey", F.col("level").cast("long").alias("level"), F.col("evaluations").cast("long").alias("evaluations"), "n_units")


@query("WITH" + ROWS + """, c AS (SELECT source, label, count(*) AS n FROM rowset GROUP BY ALL) SELECT source, label, n::BIGINT AS n, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 6) AS share FROM c""")
def class_distribution(spark, sf_dir):
    return aggregates.class_distribution(rows(spark, sf_dir), "label", "source").select("source", "label", "n", r6("share").alias("share"))


@query("""SELECT event_type, round(median(value * 1000), 4) AS median_ms, round(quantile_cont(value * 1000, 0.95), 4) AS p95_ms, round(min(value * 1000), 4) AS min_ms, round(max(value * 1000), 4) AS max_ms, count(*)::BIGINT AS n FROM events WHERE event_id % 9 > 0 GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("repetition", F.col("event_id") % 9)
    s = aggregates.latency_summary(e, "value", "repetition", "event_type")
    return s.select("event_type", *[F.round(c, 4).alias(c) for c in ("median_ms", "p95_ms", "min_ms", "max_ms")], "n")


@query("WITH" + ROWS + """ SELECT label, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_std, round(min(price), 4) AS price_min, round(max(price), 4) AS price_max, round(avg(tax), 6) AS tax_mean, round(stddev_samp(tax), 6) AS tax_std, min(tax) AS tax_min, max(tax) AS tax_max FROM rowset GROUP BY label""")
def numeric_summary(spark, sf_dir):
    s = aggregates.numeric_summary(rows(spark, sf_dir), ["price", "tax"], "label")
    return s.select("label", *[F.round(f"price_{x}", 4).alias(f"price_{x}") for x in ("mean", "std", "min", "max")], *[r6(f"tax_{x}").alias(f"tax_{x}") for x in ("mean", "std")], "tax_min", "tax_max")


@query("WITH" + ROWS + " SELECT count(*)::BIGINT AS n_rows, 9::INT AS n_columns, count(DISTINCT label)::BIGINT AS n_classes FROM rowset")
def dataset_summary(spark, sf_dir):
    return aggregates.table_summary(rows(spark, sf_dir), "label")
