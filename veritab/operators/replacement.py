"""Replacement operators on accounts, their context, whole-group selections and matched controls.

A context is one row that is broadcast: means, deviations and medians of each coordinate, and a pool of donors, which
is a hash sample of at most ``cap`` rows whatever the input. Everything else is an expression on a flow's arrays, so
no operator shuffles flows. Only the search for the nearest donor, which compares a flow with the whole pool, is NumPy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.functions.hashing import unit
from veritab.operators.explain import Logit
from veritab.operators.prefix import quantiles

POOL_ROWS, RIDGE = 256, 1e-6
#: Operators that need no matrix; the two conditional-Gaussian ones are explain.conditional_gaussian.
OPERATORS = ("training_median", "target_class_median", "joint_donor", "target_class_donor", "nearest_neighbour_donor", "correlation_group_median", "correlation_group_joint_donor")


def as_array(frame: DataFrame, place: str, values: dict[str, Column], *keys: str) -> DataFrame:
    """Rows of numbered values as arrays in the order of their places: one row for each key."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(place).alias("_i"), *[v.alias(n) for n, v in values.items()])))
    return frame.groupBy(*keys).agg(cells.alias("_c")).select(*keys, *[F.col(f"_c.{n}").alias(n) for n in values])


def class_medians(frame: DataFrame, x: str, label: str) -> DataFrame:
    """label, class_median: the exact median of each coordinate in each class."""
    cells = frame.select(label, F.posexplode(x).alias("i", "v"))
    return as_array(quantiles(cells, "v", {"class_median": 0.5}, label, "i"), "i", {"class_median": F.col("class_median")}, label)


def donor_pool(frame: DataFrame, key: str, x: str, label: str, cap: int = POOL_ROWS, salt: str = "pool") -> DataFrame:
    """One row: the ``cap`` rows of smallest hash, in the order of their keys."""
    chosen = frame.select(F.col(key).alias("donor"), F.col(label).alias("label"), F.col(x).alias("x")).orderBy(unit(salt, F.col(key)), key).limit(cap)
    return chosen.agg(F.array_sort(F.collect_list(F.struct("donor", "label", "x"))).alias("pool"))


def operator_context(frame: DataFrame, key: str, x: str, label: str, cap: int = POOL_ROWS, ridge: float = RIDGE) -> DataFrame:
    """One row: mean, sd (of the ridged variance; 1 where there is none) and median of each coordinate, the pool and its mean."""
    cells = frame.select(F.posexplode(x).alias("i", "v"))
    moments = cells.groupBy("i").agg(F.avg("v").alias("mean"), F.sqrt(F.coalesce(F.var_samp("v"), F.lit(0.0)) + ridge).alias("sd"))
    moments = moments.join(quantiles(cells, "v", {"median": 0.5}, "i"), "i")
    sd = F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    arrays = as_array(moments, "i", {"mean": F.col("mean"), "sd": sd, "median": F.col("median")})
    both = arrays.crossJoin(F.broadcast(donor_pool(frame, key, x, label, cap)))  # one row with one row
    return both.withColumn("pool_mean", F.transform(F.col("median"), lambda _, i: A.total(F.transform(F.col("pool"), lambda d: F.get(d["x"], i))) / F.size("pool")))


def expanded(selected: Column, groups: list[int]) -> Column:
    """All coordinates of the groups that the selected ones belong to, rising."""
    group = F.array(*map(F.lit, groups))
    return A.let(F.transform(selected, lambda i: F.get(group, i)), lambda chosen: F.filter(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda i: F.array_contains(chosen, F.get(group, i))))


def picked(pool: Column, salt: str, key: Column) -> Column:
    """The pool's member whose place is a hash of the key."""
    return F.get(pool, F.pmod(unit(salt, key), F.size(pool).cast("long")).cast("int"))


def nearest_places(context: DataFrame) -> Callable[[Column, Column], Column]:
    """For x and its selected coordinates, the place in the pool of the donor that is closest in the other coordinates, in
    units of their deviations; the first of equal ones. A null distance is the smallest, one that is no number the largest.

    The context's one row, of a fixed size, goes to the tasks with the function. Terms are added in the order of coordinates.
    """
    row = context.select("sd", F.transform("pool", lambda d: d["x"]).alias("donors")).first()
    sd, donors = (row["sd"], row["donors"]) if row else ([], [])
    usable = np.array([d is not None and len(d) == len(sd) and None not in d for d in donors], bool)
    pool = np.array([d if ok else [0.0] * len(sd) for d, ok in zip(donors, usable, strict=True)], float).reshape(len(donors), len(sd))

    def places(x: pd.Series, selected: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        whole = [i for i, v in enumerate(x) if v is not None and len(v) == len(sd) and not any(c is None for c in v)]
        for at in (whole[i : i + 1024] for i in range(0, len(whole), 1024)):
            rows, free = np.stack([x.iloc[i] for i in at]).astype(float), np.ones((len(at), len(sd)))
            for j, i in enumerate(at):
                if (chosen := selected.iloc[i]) is not None:
                    free[j, [c for c in chosen if c is not None and 0 <= c < len(sd)]] = 0.0
            d = np.zeros((len(at), len(pool)))
            with np.errstate(all="ignore"):
                for c, s in enumerate(sd):
                    moved = rows[:, c, None] - pool[None, :, c]
                    d += free[:, c, None] * moved * moved / (s * s)
            d = np.where(np.isnan(d), np.inf, np.minimum(d, np.finfo(float).max))
            d[:, ~usable] = -np.inf
            out[at] = d.argmin(1)
        return pd.Series(out)

    return lambda x, selected: F.when(F.size("pool") > 0, F.pandas_udf(places, "int")(x, selected))


def nearest_place(x: Column, selected: Column) -> Column:
    """The same place as an expression on the context's columns, for frames without their context at hand."""
    free = F.transform(x, lambda _, i: F.when(F.array_contains(selected, i), 0.0).otherwise(1.0))

    def distance(d: Column, mask: Column) -> Column:
        parts = F.arrays_zip(x.alias("a"), d.alias("b"), F.col("sd").alias("s"), mask.alias("m"))
        return A.total(F.transform(parts, lambda p: p["m"] * (p["a"] - p["b"]) * (p["a"] - p["b"]) / (p["s"] * p["s"])))

    ranked = A.let(free, lambda mask: F.array_min(F.transform(F.col("pool"), lambda d, i: F.struct(distance(d["x"], mask).alias("d"), i.alias("i")))))
    return ranked["i"]


def replacement_row(operator: str, key: Column, x: Column, target: Column, selected: Column, nearest: Column | None = None) -> Column:
    """The row whose selected coordinates replace those of x (X11). Columns of the context and class_median are at hand;
    nearest is the place of the nearest donor, where it is known already.

    A class without donors takes them from the whole pool.
    """
    pool = F.col("pool")
    if operator in ("training_median", "correlation_group_median"):
        return F.col("median")
    if operator == "target_class_median":
        return F.coalesce("class_median", "median")
    if operator in ("joint_donor", "correlation_group_joint_donor"):
        return picked(pool, "joint-donor", key)["x"]
    if operator == "target_class_donor":
        own = F.filter(pool, lambda d: d["label"] == target)
        return A.let(F.when(F.size(own) > 0, own).otherwise(pool), lambda p: picked(p, "class-donor", key)["x"])
    if operator == "nearest_neighbour_donor":
        return F.get(pool, nearest_place(x, selected) if nearest is None else nearest)["x"]
    raise ValueError(f"no such operator: {operator}")


def complete_row(operator: str, key: Column, x: Column, target: Column) -> Column:
    """What all coordinates become, the origin of insertions (X13): of the nearest neighbour, the pool's mean."""
    if operator == "nearest_neighbour_donor":
        return F.col("pool_mean")
    return replacement_row(operator, key, x, target, F.array().cast("array<int>"))


def with_context(frame: DataFrame, context: DataFrame, medians: DataFrame, label: str) -> DataFrame:
    """The flows with the context's one row and their class' medians (one row for each class)."""
    return frame.join(F.broadcast(medians), label, "left").crossJoin(F.broadcast(context))


def operator_effects(frame: DataFrame, key: str, x: str, target: str, ranking: str, model: Logit, groups: list[int], k: int, context: DataFrame, operators: tuple[str, ...] = OPERATORS, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, operator, n_selected, deletion and insertion of the ranking's first k coordinates.

    Operators named correlation_group_* replace the whole groups of these. The frame has this context.
    """
    p, cells = model.probability, []
    if "nearest_neighbour_donor" in operators:
        frame = frame.withColumn("nearest", nearest_places(context)(F.col(x), F.slice(ranking, 1, k)))
    for name in operators:
        top = F.slice(ranking, 1, k)
        selected = expanded(top, groups) if name.startswith("correlation_group") else top
        z, origin = replacement_row(name, F.col(key), F.col(x), F.col(target), selected, F.col("nearest")), complete_row(name, F.col(key), F.col(x), F.col(target))
        cells.append(F.struct(F.lit(name).alias("operator"), selected.alias("selected"), z.alias("z"), origin.alias("origin")))
    each = frame.withColumn("_p", p(F.col(x))).select(key, x, "_p", *carry, F.inline(F.array(*cells)))
    deletion = F.col("_p") - p(A.replace_selected(F.col(x), F.col("z"), F.col("selected")))
    insertion = p(A.insert_selected(F.col(x), F.col("origin"), F.col("selected"))) - p(F.col("origin"))
    return each.select(key, *carry, "operator", F.size("selected").alias("n_selected"), deletion.alias("deletion"), insertion.alias("insertion"))


def uniform_selection(key: Column, repetition: Column, width: int, k: Column, salt: str = "uniform") -> Column:
    """k coordinates at random, by a hash of key, repetition and coordinate (W19, for X16)."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(unit(salt, key, repetition, i).alias("u"), i.alias("i"))))
    return F.transform(F.slice(ranked, F.lit(1), k), lambda s: s["i"])


def group_matched_control(x: Column, reference: Column, selected: Column, groups: list[int], bins: int, key: Column, salt: str = "group-control") -> Column:
    """Coordinates of as many groups as the selection touches, drawn from the same bins of mean displacement.

    Groups are ordered by the mean of |x - reference| over their coordinates and cut into ``bins``; of each bin as many
    are drawn by hash as it has chosen ones. Draws may be chosen groups.
    """
    names = sorted(set(groups))
    members = {g: [i for i, h in enumerate(groups) if h == g] for g in names}
    moved = F.zip_with(x, reference, lambda a, b: F.abs(a - b))

    def of(d: Column) -> Column:
        means = F.array(*[F.struct((sum((F.get(d, F.lit(i)) for i in members[g][1:]), F.get(d, F.lit(members[g][0]))) / len(members[g])).alias("v"), F.lit(g).alias("g")) for g in names])
        chosen = F.transform(selected, lambda i: F.get(F.array(*map(F.lit, groups)), i))
        bin_of = lambda place: F.floor(place * bins / len(names)).cast("int")
        placed = F.transform(F.array_sort(means), lambda s, i: F.struct(bin_of(i).alias("b"), unit(salt, key, s["g"]).alias("u"), s["g"].alias("g"), F.array_contains(chosen, s["g"]).alias("c")))
        drawn = lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: A.let(F.filter(p, lambda s: s["b"] == b), lambda own: F.slice(F.array_sort(F.transform(own, lambda s: F.struct(s["u"].alias("u"), s["g"].alias("g")))), F.lit(1), F.size(F.filter(own, lambda s: s["c"]))))))
        groups_of = A.let(placed, drawn)
        return F.transform(groups_of, lambda s: s["g"])

    return A.let(A.let(moved, of), lambda drawn: F.filter(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda i: F.array_contains(drawn, F.get(F.array(*map(F.lit, groups)), i))))
