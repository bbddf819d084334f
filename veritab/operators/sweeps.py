"""Sweeps of the choices behind verdicts: two reads of the accounts for any number of settings.

A setting's size of the top, mass floor and tie tolerance decide what is measured; its coverage threshold only whether a
cell can be judged. So settings share measurements: each distinct choice of the first three is measured once, all of
them as one array expression on a pair of accounts, resampled once, and fanned out to its settings, which are gated.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.operators import gates, resampling, seeds

BASELINE = "baseline"


@dataclass(frozen=True)
class Setting:
    setting: str = BASELINE
    top_k: int = A.TOP_K
    mass_floor: float = A.MASS_FLOOR
    tie_tolerance: float = A.TIE_TOLERANCE
    minimum_fraction: float = 0.95

    @property
    def measured(self) -> tuple[int, float, float]:
        """Settings with the same values here have the same measurements."""
        return self.top_k, self.mass_floor, self.tie_tolerance


def one_axis_at_a_time(default: Setting, **axes: tuple) -> list[Setting]:
    """The default, and it with one choice changed, for each other value of each axis (V9)."""
    found = [default]
    for axis, values in axes.items():
        found += [replace(default, setting=f"{axis}={v}", **{axis: v}) for v in dict.fromkeys(values) if v != getattr(default, axis)]
    return found


def measures(settings: list[Setting]) -> list[tuple[int, float, float]]:
    if len({s.setting for s in settings}) < len(settings):
        raise ValueError("two settings of one name")
    return sorted({s.measured for s in settings})


def measured(x: Column, y: Column, settings: list[Setting]) -> Column:
    """array of (measure, metric, value, identified) of two accounts of magnitudes; measure counts ``measures``.

    What settings share is computed once: sorted values, masses, the rank correlation, the moved mass, and the longest
    top, of which shorter ones are the beginning. The metric of the top is named jaccard_10 at any size, as gates name it.
    """
    each = measures(settings)
    most = max(k for k, *_ in each)

    def side(v: Column) -> Column:
        return F.struct(v.alias("v"), A.total(v).alias("mass"), F.array_max(v).alias("high"), A.spread(v).alias("spread"), F.reverse(F.array_sort(v)).alias("down"), A.top_k(v, most).alias("top"))

    def rows(s: Column) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        share = lambda t: F.transform(t["v"], lambda a: F.try_divide(a, t["mass"]))
        shared = F.struct(A.safe_spearman(l["v"], r["v"]).alias("spearman"), (A.total(F.zip_with(share(l), share(r), lambda a, b: F.abs(a - b))) * 0.5).alias("moved"))

        def of(c: Column) -> Column:
            made = []
            for n, (k, floor, tie) in enumerate(each):
                limit = lambda t: F.greatest(F.lit(floor), t["high"] * tie)  # noqa: B023, E731
                gap = lambda t: F.coalesce(F.get(t["down"], F.lit(k - 1)) - F.get(t["down"], F.lit(k)), F.lit(float("inf")))  # noqa: B023, E731
                nonzero = (l["mass"] >= floor) & (r["mass"] >= floor)
                ranks = nonzero & (l["spread"] > limit(l)) & (r["spread"] > limit(r))
                tops = nonzero & (gap(l) > limit(l)) & (gap(r) > limit(r))
                common = A.let(F.size(F.array_intersect(F.slice(l["top"], 1, k), F.slice(r["top"], 1, k))), lambda m: m / (F.least(F.lit(k), F.size(l["v"])) + F.least(F.lit(k), F.size(r["v"])) - m))  # noqa: B023
                moved = F.when(nonzero, c["moved"]).otherwise(1.0)
                for metric, value, known in (("spearman", F.when(ranks, c["spearman"]).otherwise(0.0), ranks), ("jaccard_10", F.when(tops, common).otherwise(0.0), tops), ("weighted_jaccard", (1.0 - moved) / (1.0 + moved), nonzero), ("normalized_mass_l1", moved, nonzero)):
                    made.append(F.struct(F.lit(n).alias("measure"), F.lit(metric).alias("metric"), value.alias("value"), known.alias("identified")))
            return F.array(*made)

        return A.let(shared, of)

    return A.let(F.struct(side(x).alias("l"), side(y).alias("r")), rows)


def swept(pairs: DataFrame, x: str, y: str, settings: list[Setting], *keys: str, bounds=gates.EQUIVALENCE, replicates: int = 1_000, **names) -> DataFrame:
    """setting, keys, metric, estimate, interval, coverage and gate columns of every setting.

    pairs: keys, seed, flow and two accounts of magnitudes. Each measurement is resampled once by hash, whatever the
    number of settings that use it; the summary and the replicates read the pairs once each.
    """
    cells = pairs.select("seed", "flow", *keys, F.inline(measured(F.col(x), F.col(y), settings)))
    by = ["measure", *keys, "metric"]
    summary = seeds.mean_and_coverage(cells, "value", "identified", *by, **names).join(resampling.hash_interval(cells, "value", *by, replicates=replicates), by)
    place = {m: i for i, m in enumerate(measures(settings))}
    fan = pairs.sparkSession.createDataFrame([(s.setting, place[s.measured], float(s.minimum_fraction)) for s in settings], "setting string, measure int, minimum_fraction double")
    each = summary.join(F.broadcast(fan), "measure").withColumn("identification_coverage_sufficient", F.col("coverage_sufficient") & (F.col("minimum_seed_fraction") >= F.col("minimum_fraction")))
    return gates.apply_gates(each, bounds).drop("measure")


def flipped(sweep: DataFrame, *keys: str, baseline: str = BASELINE) -> DataFrame:
    """Cells of a setting whose verdict differs from the declared one's."""
    declared = sweep.filter(F.col("setting") == baseline).select(*keys, "metric", F.col("gate_status").alias("baseline_status"))
    other = sweep.filter(F.col("setting") != baseline).select("setting", *keys, "metric", F.col("gate_status").alias("variant_status"))
    return other.join(declared, [*keys, "metric"]).filter("baseline_status <> variant_status")
