"""Prediction metrics, thresholds, calibration and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.prefix import running_totals


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def confusion(truth: str = "truth", decision: str = "decision") -> list[Column]:
    t, d = F.col(truth), F.col(decision)
    return [F.count_if((t == a) & (d == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    return ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def rates() -> dict[str, Column]:
    """From columns tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f_beta(tp, fp, fn, 1), "f2": f_beta(tp, fp, fn, 2),
        "fpr": ratio(fp, F.greatest(fp + tn, F.lit(1))), "fnr": ratio(fn, F.greatest(fn + tp, F.lit(1))), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
    }


def binary_metrics(frame: DataFrame, *keys: str, truth: str = "truth", decision: str = "decision") -> DataFrame:
    counts = frame.groupBy(*keys).agg(*confusion(truth, decision))
    return counts.select(*keys, "tp", "fp", "fn", "tn", *[c.alias(n) for n, c in rates().items()])


def roc_auc(frame: DataFrame, *keys: str, truth: str = "truth", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums; rows are first counted by score, so ties are one row."""
    counts = frame.groupBy(*keys, score).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    counts = running_totals(counts.withColumn("neg", F.col("n") - F.col("pos")), score, ["neg"], *keys)
    each = counts.select(*keys, "pos", "neg", (F.col("cum_neg") - F.col("neg")).alias("below"))
    return each.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"), None).alias("roc_auc"))


def average_precision(frame: DataFrame, *keys: str, truth: str = "truth", score: str = "score") -> DataFrame:
    counts = frame.groupBy(*keys, score).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    each = running_totals(counts, score, ["pos", "n"], *keys, descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_n": "seen"})
    return each.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos"), None).alias("average_precision"))


def probability_scores(truth: str = "truth", score: str = "score") -> list[Column]:
    p, t = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15)), F.col(truth)
    return [F.avg(-(t * F.log(p) + (1 - t) * F.log(1 - p))).alias("log_loss"), F.avg((F.col(score) - t) * (F.col(score) - t)).alias("brier")]


def calibration_bins(frame: DataFrame, bins: int, *keys: str, truth: str = "truth", score: str = "score") -> DataFrame:
    place = F.least(F.floor(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return frame.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("mean_truth"))


def calibration_error(frame: DataFrame, bins: int = 15, *keys: str, truth: str = "truth", score: str = "score") -> DataFrame:
    """Expected calibration error (P5; with top-class confidence and correctness, P6)."""
    b = calibration_bins(frame, bins, *keys, truth=truth, score=score)
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_truth"))) / F.sum("n")).alias("calibration_error"))


def per_class(frame: DataFrame, classes: DataFrame, truth: str, decision: str, *keys: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, those without rows too (P7). classes: one column ``class``."""
    sides = frame.select(*keys, F.inline(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("d"), (F.col(truth) == F.col(decision)).cast("int").alias("hit")), F.struct(F.col(decision).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("hit")))))
    counts = sides.groupBy(*keys, "class").agg(F.sum("hit").alias("tp"), F.sum("t").alias("support"), F.sum("d").alias("predicted"))
    every = frame.select(*keys).distinct().crossJoin(F.broadcast(classes)) if keys else classes
    full = every.join(counts, [*keys, "class"], "left").na.fill(0, ["tp", "support", "predicted"])
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return full.select(*keys, "class", "support", ratio(tp, predicted).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, support + predicted).alias("f1"))


def class_summary(per: DataFrame, *keys: str) -> DataFrame:
    """Macro and weighted metrics from per_class; balanced accuracy over present classes only."""
    present = F.col("support") > 0
    return per.groupBy(*keys).agg(
        ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"), F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy_present_classes"),
        F.avg("f1").alias("macro_f1_all_classes"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"),
    )


def threshold_at_fpr(frame: DataFrame, most_fpr: float, *keys: str, truth: str = "truth", score: str = "score") -> DataFrame:
    """The score end with the largest recall, then F2, then threshold, among those under the cap.

    Without one, a threshold above all scores. Rows are first counted by score, and ordered bucket by bucket.
    """
    counts = frame.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    counts = counts.withColumn("neg", F.col("n") - F.col("pos"))
    ends = running_totals(counts, "threshold", ["pos", "neg"], *keys, descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    ends = ends.join(totals, list(keys)) if keys else ends.crossJoin(F.broadcast(totals))
    recall, fpr, precision = F.col("tp") / F.col("p"), F.col("fp") / F.col("q"), F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    scored = ends.select(*keys, "threshold", recall.alias("recall"), fpr.alias("fpr"), precision.alias("precision"))
    scored = scored.withColumn("f2", 5.0 * F.col("precision") * F.col("recall") / F.greatest(4.0 * F.col("precision") + F.col("recall"), F.lit(2.220446049250313e-16)))
    ok = F.col("fpr") <= most_fpr + 1e-15
    best = scored.groupBy(*keys).agg(F.max(F.when(ok, F.struct("recall", "f2", "threshold", "fpr", "precision"))).alias("b"), F.max("threshold").alias("top"))
    none = F.col("b").isNull()
    above = F.col("top") + F.greatest(F.abs("top"), F.lit(2.2250738585072014e-308)) * 2.220446049250313e-16
    out = {n: F.when(none, 0.0).otherwise(F.col(f"b.{n}")) for n in ("recall", "f2", "fpr", "precision")}
    return best.select(*keys, F.when(none, above).otherwise(F.col("b.threshold")).alias("threshold"), *[c.alias(n) for n, c in out.items()])


def threshold_grid(frame: DataFrame, *keys: str, steps: int = 1000, truth: str = "truth", score: str = "score") -> DataFrame:
    """Confusion counts at thresholds 0, 1/steps ... 1.

    Each row falls into the last step that it reaches; sums from above give the counts, so the work is one
    shuffle of (steps + 1) rows for each key and task.
    """
    step = F.least(F.greatest(F.floor(F.col(score) * steps + 1e-9), F.lit(-1)), F.lit(steps)).cast("int")
    counts = frame.groupBy(*keys, step.alias("step")).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    grid = frame.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(-1), F.lit(steps))).alias("step")) if keys else frame.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(counts, [*keys, "step"], "left").na.fill(0, ["pos", "n"])
    down, every = Window.partitionBy(*keys).orderBy(F.desc("step")), Window.partitionBy(*keys)
    tp, fp = F.sum("pos").over(down), F.sum(F.col("n") - F.col("pos")).over(down)
    out = full.withColumn("tp", tp).withColumn("fp", fp).withColumn("fn", F.sum("pos").over(every) - tp).withColumn("tn", F.sum(F.col("n") - F.col("pos")).over(every) - fp)
    return out.filter("step >= 0").select(*keys, (F.col("step") / F.lit(float(steps))).alias("threshold"), "tp", "fp", "fn", "tn", *[c.alias(n) for n, c in rates().items()])


def tuned_threshold(grid: DataFrame, strategy: str, most_fpr: float, *keys: str) -> DataFrame:
    """One row of a threshold grid by strategy: min_fnr_at_max_fpr, best_f2 or best_f1."""
    order = {"best_f2": ["-f2", "fnr", "fpr", "threshold"], "best_f1": ["-f1", "fnr", "fpr", "threshold"], "min_fnr_at_max_fpr": ["fnr", "fpr", "-f2", "-threshold"]}[strategy]
    rank = F.struct(*[(-F.col(c[1:]) if c[0] == "-" else F.col(c)).alias(f"o{i}") for i, c in enumerate(order)])
    if strategy == "min_fnr_at_max_fpr":
        within = F.col("fpr") <= most_fpr
        fallback = F.struct(F.col("fpr").alias("o0"), F.col("fnr").alias("o1"), (-F.col("threshold")).alias("o2"), F.lit(0.0).alias("o3"))
        rank = F.struct((~within).cast("int").alias("no"), F.when(within, rank).otherwise(fallback).alias("o"))
    cols = [c for c in grid.columns if c not in keys]
    best = grid.groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("b"))
    return best.select(*keys, "b.*")


def class_weights(frame: DataFrame, label: str, most: float = 10.0) -> DataFrame:
    """n / (classes * n of the class), capped."""
    counts = frame.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row for each class
    return counts.withColumn("weight", F.least(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), F.lit(most)))


def eligible_classes(frame: DataFrame, label: str, least: int = 20) -> DataFrame:
    """Classes with enough validation rows (P10)."""
    return frame.groupBy(label).agg(F.count("*").alias("support")).withColumn("eligible", F.col("support") >= least)


def decided_confidence(probability: Column, decision: Column) -> Column:
    return F.when(decision == 1, probability).otherwise(1 - probability)


def binary_margin(probability: Column, threshold: float) -> Column:
    return F.abs(probability - threshold)


def top_margin(probabilities: Column) -> Column:
    """Largest less second largest."""
    ordered = F.reverse(F.array_sort(probabilities))
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def agreement(frame: DataFrame, truth: str, left: str, right: str, *keys: str) -> DataFrame:
    """Counts and rates of two decisions' agreement."""
    t, a, b = F.col(truth), F.col(left), F.col(right)
    flags = {"agree": a == b, "both_correct": (a == t) & (b == t), "both_wrong": (a != t) & (b != t), "left_only": (a == t) & (b != t), "right_only": (a != t) & (b == t)}
    out = frame.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{n}") for n, c in flags.items()])
    return out.select("*", *[(F.col(f"n_{n}") / F.col("n")).alias(f"{n}_rate") for n in flags])


def prediction_table(frame: DataFrame, p: str, classes: list[str], truth: str, threshold: float) -> DataFrame:
    """The frame with prob_<class> columns instead of the array, the decision, its confidence and margin.

    Two classes are decided by the threshold, more by the largest probability, the first of equal ones.
    """
    two = len(classes) == 2
    pred = F.when(F.get(p, F.lit(1)) >= threshold, 1).otherwise(0) if two else F.array_position(p, F.array_max(p)) - 1
    out = frame.select("*", pred.cast("int").alias("pred"), *[F.get(p, F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(classes)])
    ranked = F.reverse(F.array_sort(p))
    margin = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
    out = out.select("*", F.get(p, F.col("pred")).alias("confidence"), margin.alias("margin"), F.lit(threshold).alias("decision_threshold"), (F.col("pred") == F.col(truth)).alias("correct"))
    return out.drop(p)


def decision_counts(frame: DataFrame, truth: str, decision: str, weight: str, *keys: str) -> DataFrame:
    """Weighted true positives, false positives and false negatives: what batches of a score add up."""
    of = lambda t, d: F.sum(F.when((F.col(truth) == t) & (F.col(decision) == d), F.col(weight)).otherwise(0.0))
    return frame.groupBy(*keys).agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"))


def f2_of(counts: DataFrame, *keys: str) -> DataFrame:
    """F2 of counts summed over their batches; 0 where nothing is positive."""
    summed = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return summed.withColumn("f2", F.coalesce(F.try_divide(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")), F.lit(0.0)))


def best_candidate(frame: DataFrame, order: list[tuple[str, bool]], *keys: str) -> DataFrame:
    """The first candidate of each key by columns in turn, each with whether more is better (O7). Columns of the test split are an error."""
    if bad := [c for c, _ in order if "test" in c.lower()]:
        raise ValueError(f"selection may not look at the test split: {bad}")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if more else F.asc(c) for c, more in order]))
    return frame.withColumn("_k", place).filter("_k = 1").drop("_k")


def class_eligibility(counts: DataFrame, label: str, model: str, models: int, ok: str, n: str) -> DataFrame:
    """Classes that every model finds eligible on frozen validation counts, and whether the models agree."""
    grouped = counts.groupBy(label).agg(F.bool_and(ok).alias("_all"), (F.bool_and(ok) == F.bool_or(ok)).alias("models_agree"), F.countDistinct(model).alias("_m"), F.min(n).alias("n_validation"))
    return grouped.select(label, (F.col("_all") & (F.col("_m") == models)).alias("eligible"), "models_agree", "n_validation")
