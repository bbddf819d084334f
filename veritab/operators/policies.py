"""Split policies: label conflicts, groups that must stay whole, balanced assignment with coverage repair, feasibility.

Whatever is sequential works on runs of components with equal counts by class, or on a few small components; rows are
only ever joined with the split of their component.
"""

from __future__ import annotations

import collections
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.hashing import unit
from veritab.operators.grouping import SPLITS, connected_components
from veritab.operators.prefix import running_totals
from veritab.operators.sampling import temporal_split
from veritab.operators.staging import released, staged

#: Runs that are broadcast, and parts of a run that are joined apart where there are more.
BROADCAST_RUNS, SALTS = 1 << 16, 16
#: A split is feasible if no share is further from its target, and no split has fewer rows.
MOST_DEVIATION, LEAST_ROWS = 0.1, 10


def conflicting(frame: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have more than one value."""
    return frame.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a <> _b").select(key)


def without_conflicts(frame: DataFrame, key: str, value: str) -> DataFrame:
    return frame.join(conflicting(frame, key, value), key, "left_anti").select(*frame.columns)


def merged(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The frame with a component: rows that share a value of any key are in one.

    A null joins nothing; a row whose keys are all null is a component of its own, together with its exact copies.
    """
    alone = F.concat(F.lit("row "), F.xxhash64(*frame.columns).cast("string"))
    if len(keys) == 1:
        return frame.withColumn("component", F.coalesce(F.col(keys[0]).cast("string"), alone))
    nodes = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), F.col(k).cast("string"))) for k in keys]))
    rows = frame.withColumn("_nodes", nodes)
    edges = rows.select(F.get("_nodes", F.lit(0)).alias("a"), F.explode("_nodes").alias("b")).distinct()
    found = connected_components(edges)
    joined = rows.join(found, F.get("_nodes", F.lit(0)) == found["node"], "left")
    return joined.select(*frame.columns, F.coalesce(F.col("component").cast("string"), alone).alias("component"))


def class_counts(frame: DataFrame, label: str) -> DataFrame:
    return frame.groupBy("component", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def dealt(offers: list[int], step: int, n: int) -> list[int]:
    """How many of n equal components each split takes, if each goes to the highest offer (the first of equals) and lowers it by step.

    A split's offers are a falling sequence, so the n taken are those above a level, which halving finds, and the first
    ones at it.
    """
    if step == 0 or n == 0:
        return [n if i == offers.index(max(offers)) else 0 for i in range(len(offers))]
    above = lambda level: [(o - level) // step + 1 if o >= level else 0 for o in offers]
    low, high = min(offers) - step * n, max(offers) + 1  # n or more lie at low or above, none at high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(above(middle)) >= n else (low, middle)
    taken = above(high)
    for i, (now, more) in enumerate(zip(taken, above(low), strict=True)):
        if more > now and sum(taken) < n:
            taken[i] += 1
    return taken


def balanced(counts: DataFrame, classes: list, proportions: tuple[float, float, float], salt: str = "policy") -> DataFrame:
    """component, split: large components first, each where the classes that it has are shortest of their targets.

    counts: component, label, n. Components of one size come in the order of their counts by class. Those with equal
    counts are a run: they are interchangeable, so a run is dealt out at once, in whole numbers, and a hash rank says
    which of them go where. One order holds for the whole table: runs are streamed through one task, which keeps what
    each split still lacks of each class and nothing else.
    """
    of = [F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).cast("long") for c in classes]
    rows = counts.groupBy("component").agg(F.array(*of).alias("held"), F.sum("n").cast("long").alias("total"))
    rows = staged(rows.select("component", "held", "total", unit(salt, F.col("component")).alias("u"), F.lit(1).alias("one")), "components")
    sums = rows.agg(*[F.coalesce(F.sum(F.get("held", F.lit(i))), F.lit(0)).alias(f"c{i}") for i in range(len(classes))]).first()
    shares = [Fraction(str(p)) for p in proportions]
    unit_of = lcm(*[p.denominator for p in shares])
    targets = [[int(p * unit_of) * int(t) for t in sums] for p in shares]

    def deal(batches):
        lacking = [list(t) for t in targets]  # in parts of a row, so that all sums are whole
        for batch in batches:
            made = []
            for held, m in zip(batch["held"], batch["m"], strict=True):
                own = [int(h) for h in held]
                taken = dealt([sum(a * b for a, b in zip(row, own, strict=True)) for row in lacking], unit_of * sum(o * o for o in own), int(m))
                lacking = [[a - unit_of * k * o for a, o in zip(row, own, strict=True)] for row, k in zip(lacking, taken, strict=True)]
                made.append(taken)
            yield pd.DataFrame({"total": batch["total"], "held": batch["held"], "taken": made})

    runs = rows.groupBy("total", "held").agg(F.count("*").alias("m")).repartition(1).sortWithinPartitions(F.desc("total"), F.desc("held"))
    plan = staged(runs.mapInPandas(deal, "total long, held array<long>, taken array<long>"), "runs")
    ranked = running_totals(rows, "u", ["one"], "total", "held", ties=("component",))
    if plan.count() <= BROADCAST_RUNS:
        joined = ranked.join(F.broadcast(plan), ["total", "held"])
    else:
        salted = plan.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = ranked.withColumn("s", F.pmod("u", F.lit(SALTS)).cast("int")).join(salted, ["total", "held", "s"])
    first, second = F.get("taken", F.lit(0)), F.get("taken", F.lit(0)) + F.get("taken", F.lit(1))
    split = F.when(F.col("cum_one") <= first, SPLITS[0]).when(F.col("cum_one") <= second, SPLITS[1]).otherwise(SPLITS[2])
    out = staged(joined.select("component", split.alias("split")), "splits")
    released(rows, plan)
    return out


def repaired(assigned: DataFrame, counts: DataFrame, classes: list) -> DataFrame:
    """The assignment, with the smallest possible component moved into each split that lacks a class.

    A move may not take the last rows of the class from the split that gives; what can't be repaired stays, for
    feasibility to tell. There are three moves a class at most, so one pass suffices: it keeps, for each split and
    class, one component more than there are moves, and no further one can be asked for.
    """
    cells = counts.join(assigned, "component")
    held = collections.Counter({(r["split"], r["label"]): r["n"] for r in cells.groupBy("split", "label").agg(F.sum("n").alias("n")).collect()})
    wanted = [(s, c) for s in SPLITS for c in classes]
    if all(held[cell] for cell in wanted):
        return assigned
    size = counts.groupBy("component").agg(F.sum("n").alias("total"))
    line = Window.partitionBy("split", "label").orderBy("total", "component")
    first = cells.join(size, "component").withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= len(wanted) + 1)
    whole = first.select("component", "split", "total").distinct().join(counts, "component")
    known: dict[tuple, dict] = collections.defaultdict(dict)
    for r in whole.collect():
        known[r["total"], r["component"], r["split"]][r["label"]] = r["n"]
    small = [[total, component, split, own] for (total, component, split), own in sorted(known.items())]
    moves: dict[str, str] = {}
    for _ in wanted:
        free = ((s, part) for s, c in wanted if not held[s, c] for part in small if part[2] != s and 0 < part[3].get(c, 0) < held[part[2], c])
        target, part = next(free, (None, None))
        if part is None:
            break
        for label, n in part[3].items():
            held[part[2], label] -= n
            held[target, label] += n
        part[2] = moves[part[1]] = target
    if not moves:
        return assigned
    new = F.create_map(*[F.lit(x) for move in moves.items() for x in move])
    return assigned.select("component", F.coalesce(new[F.col("component")], F.col("split")).alias("split"))


def policy_split(frame: DataFrame, policy: dict, fingerprint: str, label: str, classes: list, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """The frame's rows with their component and split; rows with a conflicting label, and crossing ones, have none.

    policy: kind temporal (order: a time column) or grouped (group: a column; drop_crossing: drop rows whose fingerprint
    spans several groups, instead of merging the groups).
    """
    kept = without_conflicts(frame, fingerprint, label)
    if policy["kind"] == "temporal":
        kept = merged(kept, [fingerprint])
        spans = kept.groupBy("component").agg(F.min(policy["order"]).alias("t"), F.count("*").alias("n"))
        splits = temporal_split(spans, "t", "n", (proportions[0], proportions[0] + proportions[1])).select("component", "split")
    elif policy["kind"] == "grouped":
        if policy.get("drop_crossing"):
            kept = merged(without_conflicts(kept, fingerprint, policy["group"]), [policy["group"]])
        else:
            kept = merged(kept, [fingerprint, policy["group"]])
        counts = class_counts(kept, label)
        splits = repaired(balanced(counts, classes, proportions), counts, classes)
    else:
        raise ValueError(f"no such policy: {policy['kind']}")
    return kept.join(splits, "component")


def feasibility(split_rows: DataFrame, total: Column, label: str, group: str, classes: list, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15), most_deviation: float = MOST_DEVIATION, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row: rows kept and dropped, groups in several splits, the largest deviation, and whether and why not the split will do."""
    sizes = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    seen = [F.countDistinct(F.when(F.col("split") == s, F.col(label))).alias(f"c_{s}") for s in SPLITS]
    one = split_rows.agg(F.count("*").alias("n_kept"), *sizes, *seen)
    crossing = split_rows.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n_crossing"))
    deviation = F.greatest(*[F.abs(F.try_divide(F.col(f"n_{s}"), F.col("n_kept")) - F.lit(p)) for s, p in zip(SPLITS, proportions, strict=True)])
    reason = (
        F.when(F.col("n_kept") == 0, "no_rows").when(F.col("n_crossing") > 0, "crossing_groups")
        .when(F.least(*[F.col(f"c_{s}") for s in SPLITS]) < len(classes), "missing_class")
        .when(F.least(*[F.col(f"n_{s}") for s in SPLITS]) < least_rows, "too_few_rows")
        .when(F.col("deviation") > most_deviation, "off_target").otherwise("")
    )
    out = one.crossJoin(crossing).withColumn("deviation", F.coalesce(deviation, F.lit(1.0))).withColumn("reason", reason)
    return out.select("n_kept", (total - F.col("n_kept")).alias("n_dropped"), "n_crossing", "deviation", (F.col("reason") == "").alias("feasible"), "reason")
