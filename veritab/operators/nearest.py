"""Exact nearest rows of pools of any size by a metric index.

A bounded hash sample of the pool's vectors serves as pivots; each vector of the pool lies in the cell of its nearest
pivot. A query looks into the nearest cells first. What it finds there bounds its distance, and the triangle inequality
then tells which other cells, and which distances from their pivots, can hold anything nearer. Only those are compared.

Equal vectors are searched once, and of a pool's equal vectors only the two smallest keys are kept, as a row is never
its own neighbour: a group of copies costs one vector, however large it is. Cells are packed into groups (large ones are
dealt over several) and a query goes once to each group with a cell that it visits, so what is shuffled is a copy of the
queries for each group at most. Where distances tell little (many dimensions, no clusters) most cells are visited and the
work is that of all pairs, in matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.networks import in_blocks
from veritab.operators.replicates import dealt
from veritab.operators.staging import released, staged

#: Pivots at most (they go to tasks with their code), and rows that a cell holds on average below that.
MOST_PIVOTS, CELL_ROWS = 4_096, 512
SLACK = 1e-9
#: Blocks of rows, of the pool and of queries, that a task holds at most, and queries that it compares at once.
HELD_BLOCKS, QUERIES_AT_ONCE = 8, 256
EMPTY = pd.DataFrame({"q": [], "donor": pd.Series([], dtype=object), "distance": [], "n": []})


def two_smallest(frame: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first two rows of each key, told before the shuffle; column ``_n``."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n <= 2")


def from_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances by differences, as bounds must not suffer from cancellation."""
    out = np.empty((len(rows), len(pivots)))
    for s in in_blocks(len(rows), pivots.size):
        out[s] = np.sqrt(((rows[s, None] - pivots) ** 2).sum(-1))
    return out


class Index:
    """Pivots, and what is known of each cell: rows, and the least and greatest distance from its pivot."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.rows = np.zeros(len(pivots), int)
        self.least, self.most = np.zeros(len(pivots)), np.full(len(pivots), -np.inf)

    def first(self, distances: np.ndarray) -> np.ndarray:
        """Flags: a query's nearest cells, as many as hold two rows."""
        order = np.argsort(distances, 1, kind="stable")
        held = self.rows[order]
        needed = (held > 0) & (held.cumsum(1) - held < 2)
        flags = np.zeros(distances.shape, bool)
        np.put_along_axis(flags, order, needed, 1)
        return flags

    def open(self, distances: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Flags: other cells that may hold a row within a query's bound."""
        lower = np.maximum(distances - self.most, self.least - distances)
        lower = np.maximum(lower, (distances - distances.min(1, keepdims=True)) / 2)
        return (self.rows > 0) & (lower <= bound[:, None] + SLACK * (bound[:, None] + distances)) & ~self.first(distances)


def _assigned(pool: DataFrame, pivots: np.ndarray) -> DataFrame:
    @F.pandas_udf("cell int, r double")
    def run(v: pd.Series) -> pd.DataFrame:
        d = from_pivots(np.stack(v.to_numpy()), pivots) if len(v) else np.zeros((0, len(pivots)))
        return pd.DataFrame({"cell": d.argmin(1).astype("int32"), "r": d.min(1)})

    return pool.select("donor", "v", run("v").alias("c")).select("donor", "v", "c.cell", "c.r")


def _visits(queries: DataFrame, index: Index, later: bool) -> DataFrame:
    """q, v, bound, cell and the query's distance from the cell's pivot, for each cell to look into."""

    def run(batches):
        for batch in batches:
            # blocks of rows, and arrays instead of objects: a row may visit every cell
            for s in in_blocks(len(batch), len(index.pivots)):
                part = batch.iloc[s]
                d = from_pivots(np.stack(part["v"].to_numpy()), index.pivots)
                flags = index.open(d, part["bound"].to_numpy()) if later else index.first(d)
                cells = [np.flatnonzero(f).astype("int32") for f in flags]
                yield part.assign(cells=pd.Series(cells, index=part.index, dtype=object), ds=pd.Series([row[c] for row, c in zip(d, cells, strict=True)], index=part.index, dtype=object))

    made = queries.select("q", "v", "bound").mapInPandas(run, "q long, v array<double>, bound double, cells array<int>, ds array<double>")
    return made.select("q", "v", "bound", F.explode(F.arrays_zip(F.col("cells").alias("cell"), F.col("ds").alias("d"))).alias("c")).select("q", "v", "bound", "c.*")


def _places(rows: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each cell, and over how many it is dealt: a group holds some ``held`` rows, of several cells or of one."""
    place, parts, group, room = np.zeros(len(rows), int), np.ones(len(rows), int), -1, 0
    for c, n in enumerate(rows.tolist()):
        if n > held:
            place[c], parts[c], room = group + 1, -(-n // held), 0
            group += parts[c]
        elif n:
            group, room = (group, room - n) if n <= room else (group + 1, held - n)
            place[c] = group
    return place, parts


def _group_visits(queries: DataFrame, index: Index, place: np.ndarray, parts: np.ndarray, told: bool = True) -> DataFrame:
    """q, v, bound, cells, group: one row for each group that holds any of the open cells, or, untold, the group alone."""
    names = ["q", "v", "bound", "cells", "place", "n"] if told else ["place", "n"]

    def run(batches):
        for batch in batches:
            for s in in_blocks(len(batch), len(index.pivots)):
                part = batch.iloc[s]
                d = from_pivots(np.stack(part["v"].to_numpy()), index.pivots)
                row, cell = np.nonzero(index.open(d, part["bound"].to_numpy()))
                if not len(row):
                    continue
                at = place[cell]
                starts = np.append(0, np.flatnonzero((row[1:] != row[:-1]) | (at[1:] != at[:-1])) + 1)
                made = part.iloc[row[starts]].assign(place=at[starts], n=parts[cell[starts]])
                if told:
                    cells = np.split(cell.astype("int32"), starts[1:])
                    made["cells"] = pd.Series(cells, index=made.index, dtype=object)
                yield made[names]

    kinds = {"q": "long", "v": "array<double>", "bound": "double", "cells": "array<int>", "place": "int", "n": "int"}
    made = queries.select("q", "v", "bound").mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names))
    return made.withColumn("group", F.explode(F.sequence("place", F.col("place") + F.col("n") - 1))).drop("place", "n")


def _compared(visits: DataFrame, asked: dict[int, int], pool: DataFrame, index: Index, block: int) -> DataFrame:
    """The nearest donors of each visit to a group, two at least if there are two within its bound, and in a row without a
    donor how many rows were compared. asked: visits of each group."""
    turns = {g: -(-n // block) for g, n in asked.items()} or {0: 1}
    at = F.create_map(*[F.lit(int(x)) for p in turns.items() for x in p])[F.col("group")]
    left = visits.withColumn("turn", F.pmod(F.xxhash64("q"), at))
    right = pool.withColumn("turn", F.explode(F.sequence(F.lit(0), at - 1).cast("array<long>")))
    kind = pool.schema["donor"].dataType.simpleString()
    pivots = index.pivots

    def run(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(a) or not len(b):
            return
        b = b.sort_values(["cell", "r"], kind="stable")
        cell, r, names, vb = b["cell"].to_numpy(), b["r"].to_numpy(), b["donor"].to_numpy(), np.stack(b["v"].to_numpy())
        sb, repeated = (vb * vb).sum(1), b["donor"].duplicated().any()
        held = np.unique(cell)
        begin, end = np.searchsorted(cell, held, "left"), np.searchsorted(cell, held, "right")
        for p in range(0, len(a), QUERIES_AT_ONCE):
            part = a.iloc[p : p + QUERIES_AT_ONCE]
            va, bound, q = np.stack(part["v"].to_numpy()), part["bound"].to_numpy(), part["q"].to_numpy()
            sa = (va * va).sum(1)
            looked = np.concatenate(part["cells"].to_numpy())
            asking = np.repeat(np.arange(len(part)), part["cells"].map(len))
            order = np.argsort(looked, kind="stable")
            looked, asking = looked[order], asking[order]
            n, found = np.zeros(len(part), int), []
            # products name the candidates: what may be as near as the second of those seen; they are taken again by differences
            seen, slack = np.full((len(part), 2), np.inf), SLACK * (sa + sb.max()) + 1e-300
            most = bound * bound * (1 + SLACK) - sa
            for c, i, j in zip(held.tolist(), begin.tolist(), end.tolist(), strict=True):
                rows = asking[np.searchsorted(looked, c, "left") : np.searchsorted(looked, c, "right")]
                if not len(rows):
                    continue
                d = np.sqrt(((va[rows] - pivots[c]) ** 2).sum(-1))
                reach = bound[rows] + SLACK * (bound[rows] + d)
                low, high = np.searchsorted(r[i:j], d - reach, "left"), np.searchsorted(r[i:j], d + reach, "right")
                n[rows] += high - low
                rough = sb[i:j] - 2 * va[rows] @ vb[i:j].T
                if low.any() or (high < j - i).any():
                    places = np.arange(j - i)
                    rough[(places < low[:, None]) | (places >= high[:, None])] = np.inf
                if not repeated:
                    two = np.concatenate([seen[rows], rough if j - i < 2 else np.partition(rough, 1, axis=1)[:, :2]], 1)
                    two.sort(1)
                    seen[rows] = two[:, :2]
                limit = np.minimum(seen[rows, 1], most[rows]) + slack[rows]
                x, y = np.nonzero((rough <= limit[:, None]) & (rough < np.inf))
                found.append((rows[x], i + y, rough[x, y]))
            yield pd.DataFrame({"q": q, "donor": pd.Series([None] * len(q), dtype=object), "distance": None, "n": n})
            x, y, rough = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
            near = rough <= (np.minimum(seen[:, 1], most) + slack)[x] if len(x) else []
            x, y = x[near], y[near]
            exact = [((vb[y[s]] - va[x[s]]) ** 2).cumsum(1)[:, -1] for s in in_blocks(len(x), vb.shape[1])]
            # as objects, since pandas' own strings may come in several chunks
            best = pd.DataFrame({"q": x, "donor": pd.Series(names[y], dtype=object), "distance": np.concatenate([*exact, np.zeros(0)]), "n": 0})
            best = best.sort_values(["q", "distance", "donor"], kind="stable").drop_duplicates(["q", "donor"]).groupby("q").head(2)
            yield best.assign(q=q[best["q"].to_numpy(int)])

    both = (dealt(x, "group", "turn").groupBy("group", "turn") for x in (left, right))
    return next(both).cogroup(next(both)).applyInPandas(lambda a, b: pd.concat([EMPTY, *run(a, b)]), f"q long, donor {kind}, distance double, n long")


def nearest_rows(flows: DataFrame, donors: DataFrame, key: str, donor_key: str, x: str, d: str, block: int = 4_096, pivots: int | None = None) -> DataFrame:
    """key, donor_key, distance (squared), n_compared: the nearest row of the pool for each flow, smaller key among equals.

    Rows without a vector are left out, no flow is its own donor, and a flow without any donor has no row; repeated flows
    have a row each. Vectors have one width, without null values. n_compared counts the pool's rows that were compared
    with the flow's vector, which flows with equal vectors share.
    """
    pool = two_smallest(donors.select(F.col(donor_key).alias("donor"), F.col(d).cast("array<double>").alias("v")).dropna().distinct(), ["v"], "donor").drop("_n")
    pool = staged(pool, "pool")
    asking = flows.select(F.col(key).alias("f"), F.col(x).cast("array<double>").alias("v")).dropna()
    queries = staged(asking.select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v", F.lit(float("inf")).alias("bound")), "queries")
    n = pool.count()
    wanted = pivots or min(MOST_PIVOTS, -(-n // CELL_ROWS))
    sample = pool.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(max(1, wanted)).collect()
    index = Index(np.array([s["v"] for s in sample], float) if sample else np.zeros((1, 1)))
    cells = staged(_assigned(pool, index.pivots), "cells")
    for c in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).collect():
        index.rows[c["cell"]], index.least[c["cell"]], index.most[c["cell"]] = c["n"], c["a"], c["b"]

    # a task holds a group of cells, and a query goes to a group once: few copies of either are shuffled
    sides = math.ceil(math.sqrt(4 * flows.sparkSession.sparkContext.defaultParallelism))
    share = lambda rows: min(HELD_BLOCKS * block, max(block, -(-rows // sides)))
    place, parts = _places(index.rows, share(n))
    told = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell"))
    grouped = cells.withColumn("group", (told(place) + F.pmod(F.xxhash64("donor"), told(parts))).cast("int"))
    turn = share(queries.count())

    nobody = queries.limit(0) if n == 0 else queries
    own = _visits(nobody, index, False).withColumn("group", F.explode(F.sequence(told(place), told(place) + told(parts) - 1)))
    own = own.select("q", "v", "bound", F.array("cell").alias("cells"), "group")
    first = staged(_compared(own, dict(own.groupBy("group").count().collect()), grouped, index, turn), "first")
    best = two_smallest(first.filter("donor is not null").groupBy("q", "donor").agg(F.min("distance").alias("distance")), ["q"], "distance", "donor")
    bounds = best.groupBy("q").agg(F.when(F.count("*") == 2, F.sqrt(F.max("distance"))).otherwise(float("inf")).alias("bound"))
    rest = staged(nobody.drop("bound").join(bounds, "q"), "bounds")
    asked = dict(_group_visits(rest, index, place, parts, False).groupBy("group").count().collect())
    later = staged(_compared(_group_visits(rest, index, place, parts), asked, grouped, index, turn), "later")

    found = first.unionByName(later)
    best = two_smallest(found.filter("donor is not null").groupBy("q", "donor").agg(F.min("distance").alias("distance")), ["q"], "distance", "donor")
    pick = lambda i: F.max(F.when(F.col("_n") == i, F.struct("donor", "distance"))).alias(f"b{i}")
    wide = queries.select("q", "v").join(best.groupBy("q").agg(pick(1), pick(2)), "q").join(found.groupBy("q").agg(F.sum("n").alias("n_compared")), "q")
    own = asking.join(wide, "v").withColumn("b", F.when(F.col("b1.donor").eqNullSafe(F.col("f")), F.col("b2")).otherwise(F.col("b1"))).filter("b is not null")
    out = staged(own.select(F.col("f").alias(key), F.col("b.donor").alias(donor_key), F.col("b.distance").alias("distance"), "n_compared"), "nearest")
    released(pool, queries, cells, first, rest, later)
    return out
