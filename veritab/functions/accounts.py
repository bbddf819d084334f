"""Expressions on attribution accounts (array<double> columns): ranks, top-k, masses and similarity.

All are compositions of built-in array functions, so they stay in the JVM and need no shuffle. A missing or
flat account identifies no features: similarities that depend on it fail closed (0, or 1 for a distance).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASS_FLOOR, TIE_TOLERANCE, TOP_K = 1e-12, 1e-8, 10


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def absolute(values: Column) -> Column:
    return F.transform(values, lambda x: F.abs(x.cast("double")))


def average_ranks(values: Column) -> Column:
    """Rank of each value from 1, ties sharing their mean: from a sorted copy, first and last place of the value."""
    ranked = lambda s: F.transform(s["v"], lambda x: (F.array_position(s["up"], x) + F.size(s["v"]) + 1 - F.array_position(s["down"], x)) / F.lit(2.0))
    return let(F.struct(values.alias("v"), F.array_sort(values).alias("up"), F.reverse(F.array_sort(values)).alias("down")), ranked)


def top_k(values: Column, k: int) -> Column:
    """Zero-based indexes of the k largest magnitudes; the lower index wins a tie."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-F.abs(x)).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def top_k_last(values: Column, k: int) -> Column:
    """As top_k, but the higher index wins a tie (the older rule)."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-F.abs(x)).alias("v"), (-i).alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: -s["i"])


def complement(selected: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_except(F.sequence(F.lit(0), size - 1), selected)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two arrays from their sums; null where one is constant."""

    def of(s: Column) -> Column:
        sums = F.struct(
            F.size(s["x"]).cast("double").alias("n"), total(s["x"]).alias("x"), total(s["y"]).alias("y"), total(F.transform(s["x"], lambda a: a * a)).alias("xx"),
            total(F.transform(s["y"], lambda a: a * a)).alias("yy"), total(F.zip_with(s["x"], s["y"], lambda a, b: a * b)).alias("xy"),
        )
        return let(sums, lambda t: F.try_divide(t["xy"] - t["x"] * t["y"] / t["n"], F.sqrt(F.greatest(F.lit(0.0), (t["xx"] - t["x"] * t["x"] / t["n"]) * (t["yy"] - t["y"] * t["y"] / t["n"])))))

    return let(F.struct(x.alias("x"), y.alias("y")), of)


def spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def max_difference(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def nearly_constant(values: Column) -> Column:
    """Every value within 1e-8 + 1e-5 * |first| of the first."""
    return F.greatest(F.array_max(values) - F.element_at(values, 1), F.element_at(values, 1) - F.array_min(values)) <= 1e-8 + 1e-5 * F.abs(F.element_at(values, 1))


def safe_spearman(x: Column, y: Column) -> Column:
    """Rank correlation: 1 where the arrays agree within 1e-12, else 0 where one is nearly constant."""
    value = pearson(average_ranks(x), average_ranks(y))
    return F.when(F.size(x) < 2, F.lit(None).cast("double")).when(max_difference(x, y) <= 1e-12, 1.0).when(nearly_constant(x) | nearly_constant(y), 0.0).otherwise(value)


def diagnostics(values: Column, k: int = TOP_K, mass_floor: float = MASS_FLOOR, tie_tolerance: float = TIE_TOLERANCE) -> Column:
    """What an account of magnitudes identifies: mass, nonzero, boundary_gap, rank_identifiable, top_k_identifiable.

    The gap is infinite where all features lie inside the cut.
    """

    def of(s: Column) -> Column:
        nonzero = s["mass"] >= mass_floor
        tolerance = F.greatest(F.lit(mass_floor), s["high"] * tie_tolerance)
        gap = F.when(~nonzero, 0.0).when(s["n"] <= k, F.lit(float("inf"))).otherwise(F.get(s["down"], F.lit(k - 1)) - F.get(s["down"], F.lit(k)))
        return F.struct(s["mass"].alias("mass"), nonzero.alias("nonzero"), gap.alias("boundary_gap"), (nonzero & (s["high"] - s["low"] > tolerance)).alias("rank_identifiable"), (nonzero & (gap > tolerance)).alias("top_k_identifiable"))

    return let(F.struct(total(values).alias("mass"), F.reverse(F.array_sort(values)).alias("down"), F.array_max(values).alias("high"), F.array_min(values).alias("low"), F.size(values).alias("n")), of)


def similarity(x: Column, y: Column, k: int = TOP_K, mass_floor: float = MASS_FLOOR, tie_tolerance: float = TIE_TOLERANCE) -> Column:
    """A struct: agreement of two accounts of magnitudes, and whether the pair identifies what each measure compares."""

    def of(s: Column) -> Column:
        left, right = s["dx"], s["dy"]
        both = {n: left[n] & right[n] for n in ("nonzero", "rank_identifiable", "top_k_identifiable")}
        shared = F.size(F.array_intersect(s["tx"], s["ty"]))
        mass = lambda v, d: F.transform(s[v], lambda a: F.try_divide(a, d["mass"]))
        moved = lambda m: total(F.zip_with(m["p"], m["q"], lambda a, b: F.abs(a - b)))
        # of shares that sum to 1, the smaller ones sum to 1 - moved / 2 and the larger ones to 1 + moved / 2
        half = F.when(both["nonzero"], let(F.struct(mass("x", left).alias("p"), mass("y", right).alias("q")), lambda m: moved(m) * 0.5)).otherwise(1.0)
        return F.struct(
            F.when(both["rank_identifiable"], safe_spearman(s["x"], s["y"])).otherwise(0.0).alias("spearman"),
            F.when(both["top_k_identifiable"], shared / (F.size(s["tx"]) + F.size(s["ty"]) - shared)).otherwise(0.0).alias("jaccard_10"),
            let(half, lambda h: (F.lit(1.0) - h) / (F.lit(1.0) + h)).alias("weighted_jaccard"),
            half.alias("normalized_mass_l1"),
            both["nonzero"].alias("account_pair_nonzero"), both["rank_identifiable"].alias("rank_pair_identifiable"), both["top_k_identifiable"].alias("top_k_pair_identifiable"),
            (~left["nonzero"] & ~right["nonzero"]).alias("agreement_on_null_accounts"), left["mass"].alias("left_mass"), right["mass"].alias("right_mass"),
        )

    d = lambda v: diagnostics(v, k, mass_floor, tie_tolerance)
    return let(F.struct(x.alias("x"), y.alias("y"), d(x).alias("dx"), d(y).alias("dy"), top_k(x, k).alias("tx"), top_k(y, k).alias("ty")), of)


def jaccard_at(x: Column, y: Column, k: int) -> Column:
    a, b = top_k(x, k), top_k(y, k)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def overlap_at(x: Column, y: Column, k: int) -> Column:
    return F.size(F.array_intersect(top_k(x, k), top_k(y, k))) / F.least(F.size(x), F.lit(k))


def wasserstein(x: Column, y: Column) -> Column:
    """Of equally many values: the mean gap of the sorted arrays."""
    return total(F.zip_with(F.array_sort(x), F.array_sort(y), lambda a, b: F.abs(a - b))) / F.size(x)


def kendall_tau_b(x: Column, y: Column) -> Column:
    """From the signs of all pairs of places; quadratic in the length of the arrays only."""
    places = F.sequence(F.lit(0), F.size(x) - 1)
    each = lambda f: total(F.transform(places, lambda i: total(F.transform(places, lambda j: F.when(j > i, f(i, j)).otherwise(0.0)))))
    sign = lambda v, i, j: F.signum(F.get(v, i) - F.get(v, j))
    agreement = each(lambda i, j: sign(x, i, j) * sign(y, i, j))
    untied_x, untied_y = each(lambda i, j: F.abs(sign(x, i, j))), each(lambda i, j: F.abs(sign(y, i, j)))
    return F.try_divide(agreement, F.sqrt(untied_x * untied_y))


def quantile(values: Column, q: float) -> Column:
    """Linear interpolation between the two nearest of the sorted values."""

    def of(s: Column) -> Column:
        low = F.floor(s["place"]).cast("int")
        high = F.least(low + 1, F.size(s["v"]) - 1)
        return F.get(s["v"], low) + (F.get(s["v"], high) - F.get(s["v"], low)) * (s["place"] - low)

    return let(F.struct(F.array_sort(values).alias("v"), ((F.size(values) - 1) * F.lit(q)).alias("place")), of)


def tertiles(values: Column) -> Column:
    """Group 0, 1 or 2 of each magnitude, cut at the thirds (a value on a cut stays below); flat arrays are all 0."""
    cut = lambda s: F.transform(values, lambda v: (v > s["a"]).cast("int") + (v > s["b"]).cast("int"))
    return F.when(spread(values) <= 1e-12, F.transform(values, lambda _: F.lit(0))).otherwise(let(F.struct(quantile(values, 1 / 3).alias("a"), quantile(values, 2 / 3).alias("b")), cut))


def adjusted_rand(a: Column, b: Column, groups: int = 3) -> Column:
    """Agreement of two groupings with labels below ``groups``, adjusted for chance; 1 where both are one group."""
    choose = lambda n: n * (n - 1) / 2.0
    count = lambda flags: total(F.transform(flags, lambda f: f.cast("double")))
    labels = F.sequence(F.lit(0), F.lit(groups - 1))
    rows = total(F.transform(labels, lambda g: choose(count(F.transform(a, lambda v: v == g)))))
    cols = total(F.transform(labels, lambda g: choose(count(F.transform(b, lambda v: v == g)))))
    cells = total(F.transform(labels, lambda g: total(F.transform(labels, lambda h: choose(count(F.zip_with(a, b, lambda v, w: (v == g) & (w == h))))))))
    expected = rows * cols / choose(F.size(a).cast("double"))
    return F.when((rows + cols) / 2 - expected == 0, 1.0).otherwise(F.try_divide(cells - expected, (rows + cols) / 2 - expected))


def replace_selected(values: Column, replacement: Column, selected: Column) -> Column:
    """Deletion: the selected coordinates become those of the replacement."""
    return F.transform(values, lambda x, i: F.when(F.array_contains(selected, i), F.get(replacement, i)).otherwise(x))


def insert_selected(values: Column, replacement: Column, selected: Column) -> Column:
    """Insertion: the replacement with the selected coordinates of the values."""
    return replace_selected(replacement, values, selected)


def dot(x: Column, weights: list[float]) -> Column:
    return total(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
