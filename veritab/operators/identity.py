"""Duplicates, overlaps and leak guards between splits (H6-H12, J16, G1 conflicts, G16, X26 sets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")
#: Distinct keys that are broadcast at most; of 64 characters each, some 30 MB.
BROADCAST_KEYS = 1 << 18


def conflicts(frame: DataFrame, fingerprint: str, label: str) -> DataFrame:
    """Fingerprints that carry more than one label, with their numbers of labels and rows."""
    return frame.groupBy(fingerprint).agg(F.countDistinct(label).alias("n_labels"), F.count("*").alias("n_rows")).filter("n_labels > 1")


def overlap(frame: DataFrame, split: str, *kinds: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Distinct fingerprints that two splits share, for each kind and pair of splits (H8, H9)."""
    cells = frame.select(split, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("fp")) for k in kinds]))).distinct()
    sides = cells.groupBy("kind", "fp").agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in splits])
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    out = F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), (F.col(a) * F.col(b)).alias("both")) for a, b in pairs])
    return sides.select("kind", F.inline(out)).groupBy("kind", "left_split", "right_split").agg(F.sum("both").cast("long").alias("n_shared"))


def overlap_status(n_exact: Column, rate: Column) -> Column:
    return F.when(rate == 0, "clean").when((n_exact == 0) & (rate < 1e-4), "negligible_conflicts").otherwise("material_conflicts")


def precedence_guard(frame: DataFrame, split: str, *keys: str) -> DataFrame:
    """Drops validation rows that share a key with train, then test rows that share one with train or surviving validation (H7).

    Train is kept as it is, so none of its rows shuffle, only its distinct keys. Keys of which train and validation have
    few (BROADCAST_KEYS at most, by an estimate of a few per cent) go first and are broadcast; what these leave of the
    later splits is joined with the other keys.
    """
    of = lambda rows, name: rows.filter(F.col(split) == name)
    sides = {f"{i}{name}": F.approx_count_distinct(F.when(F.col(split) == name, F.col(k))) for i, k in enumerate(keys) for name in SPLITS[:2]}
    counts = frame.filter(F.col(split).isin(*SPLITS[:2])).agg(F.lit(0).alias("_"), *[n.alias(c) for c, n in sides.items()]).first()
    most = {k: max(counts[f"{i}{name}"] for name in SPLITS[:2]) for i, k in enumerate(keys)}

    def without(rows: DataFrame, taken: DataFrame) -> DataFrame:
        for k in sorted(keys, key=lambda k: most[k]):
            known = taken.select(k).distinct()
            rows = rows.join(F.broadcast(known) if most[k] <= BROADCAST_KEYS else known, k, "left_anti")
        return rows.select(*frame.columns)

    train = of(frame, "train")
    validation, test = without(of(frame, "validation"), train), without(of(frame, "test"), train)
    return train.unionByName(validation).unionByName(without(test, validation))


def keep_first(frame: DataFrame, order: list[Column], *keys: str) -> DataFrame:
    """The first row of each key in turn (H11): the second key is judged on what the first has left."""
    for i, k in enumerate(keys):
        n = f"_place{i}"
        frame = frame.withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(*order))).filter(F.col(n) == 1).drop(n)
    return frame


def duplicate_columns(frame: DataFrame, row_key: str, columns: list[str]) -> DataFrame:
    """Columns that equal an earlier one on all rows: column, representative (H6).

    Each column is one order-free digest, from one reading of the table. Columns of equal digests are then compared row by
    row with the first of them, in one more aggregate, so that a column counts as equal only if it is.
    """
    digests = []
    for c in columns:
        h = F.xxhash64(F.col(row_key).cast("string"), F.col(c).cast("double"))
        digests += [F.sum(F.pmod(h, F.lit(2147483647))).alias(f"{c}_a"), F.sum(F.pmod(F.xxhash64(h), F.lit(2147483629))).alias(f"{c}_b")]
    one = frame.agg(*digests)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for i, c in enumerate(columns)])))
    first = F.first("feature").over(Window.partitionBy("a", "b").orderBy("place"))
    found = rows.select("place", "feature", first.alias("representative")).orderBy("place").collect()  # one row for each column
    pairs = [(r["feature"], r["representative"]) for r in found if r["feature"] != r["representative"]]
    equal = frame.agg(F.lit(True).alias("_"), *[F.coalesce(F.bool_and(F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))), F.lit(True)).alias(f"{a}~{b}") for a, b in pairs])
    same = equal.first().asDict()
    sound = [(r["feature"], r["representative"] if same.get(f"{r['feature']}~{r['representative']}", True) else r["feature"]) for r in found]
    return frame.sparkSession.createDataFrame([(a, b, a != b) for a, b in sound], "feature string, representative string, is_duplicate boolean")


def deduplicate_with_contract(frame: DataFrame, fingerprint: str, order: list[Column], constant: list[str]) -> DataFrame:
    """One row per fingerprint with its multiplicity; consistent tells whether ``constant`` columns had one value."""
    by = Window.partitionBy(fingerprint)
    flags = [(F.min(c).over(by) == F.max(c).over(by)) for c in constant]
    ok = flags[0]
    for f in flags[1:]:
        ok = ok & f
    numbered = frame.select("*", F.count("*").over(by).alias("multiplicity"), ok.alias("consistent"), F.row_number().over(by.orderBy(*order)).alias("_place"))
    return numbered.filter("_place = 1").drop("_place")


def class_sets(frame: DataFrame, split: str, label: str, classes: list) -> DataFrame:
    """The distinct classes of each split, sorted, and whether they are exactly those expected."""
    found = frame.select(split, label).distinct().groupBy(split).agg(F.array_sort(F.collect_list(label)).alias("classes"))
    return found.withColumn("complete", F.col("classes") == F.array(*map(F.lit, sorted(classes))))


def collapsed(frame: DataFrame, keys: list[str], flags: dict[str, str], attributes: dict[str, str], order: str) -> DataFrame:
    """One row for each key, nulls included: flags by or, attributes of the first row in order, and the number of rows."""
    any_of = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()]
    return frame.groupBy(*keys).agg(*any_of, *[F.min_by(c, order).alias(n) for n, c in attributes.items()], F.count("*").alias("n"))
