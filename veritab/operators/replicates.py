"""Sums of resampled sources as vectors with one place for each replicate, which merge like any other sums.

Each source (a flow, a cluster) brings vectors to some columns (a seed) of a cell; a replicate weighs sources, the same
weight in all columns. Two laws of weights:

- ``multinomial_sums``: each replicate draws as many sources as the cell has, with replacement. Sources lie in the
  leaves of a binary tree by their hash. How many draws of a replicate fall into a leaf is found by walking down from
  the root: at every node a binomial draw from a generator that is seeded by cell and node alone, so all leaves agree
  without talking to each other. A leaf then deals its draws to its sources. The law is exactly the multinomial one.
- ``hashed_sums``: a source's weight is 0, 1, 2 or 3 by a hash of replicate and source, which SQL can repeat.

A task holds the sources of one leaf, or one Arrow batch, and a block of replicates; sums of leaves are added in groups
of ``FAN``. So nothing grows with the sources of a cell, and no row is multiplied by replicates.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources of a leaf, replicates that are drawn at once, and leaves that are added at once.
LEAF_SOURCES, BLOCK, FAN = 4_096, 256, 32


def generator(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little"))


def _columns(cells: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """cells: (source place, column, x, n). Columns, and x and n by source, column and component; absent cells are 0."""
    names, at = np.unique(cells["column"].to_numpy(), return_inverse=True)
    x = np.stack(cells["x"].to_list())
    row = cells["row"].to_numpy()
    values, n = np.zeros((row.max() + 1, len(names), x.shape[1])), np.zeros((row.max() + 1, len(names)))
    np.add.at(values, (row, at), x)
    np.add.at(n, (row, at), cells["n"].to_numpy(float))
    return names.tolist(), values, n


def _weighted(values: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by replicate, column and component, and weights by replicate and column."""
    return np.tensordot(weights, values, 1), weights @ n


def vectors(sums: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """sums by replicate and component, weights by replicate; the last replicate counts every source once."""
    w = np.frombuffer(weights)
    return np.frombuffer(sums).reshape(len(w), -1), w


def _added(frame: DataFrame, keys: list[str], part: str) -> DataFrame:
    """One row for each key and column: sums of all parts, added in groups of FAN parts at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def level(rows: DataFrame, names: list[str]) -> DataFrame:
        def add(held: pd.DataFrame) -> pd.DataFrame:
            sums = {c: np.sum([np.frombuffer(b) for b in held[c]], axis=0).tobytes() for c in ("sums", "weights")}
            return pd.DataFrame([{k: held[k].iloc[0] for k in names} | sums])

        return rows.groupBy(*names).applyInPandas(add, ", ".join([*[f"`{k}` {kinds.get(k, 'long')}" for k in names], "sums binary, weights binary"]))

    names = [*keys, "column"]
    return level(level(frame.withColumn("_p", F.floor(F.col(part) / FAN)), [*names, "_p"]), names)


def multinomial_sums(cells: DataFrame, *keys: str, replicates: int, seed: int, leaf_sources: int = LEAF_SOURCES) -> DataFrame:
    """cells: keys, source, column, x (array of doubles), n; one row for each source and column of a cell.

    Rows (keys, column, sums, weights) as ``vectors`` reads them, for ``replicates`` draws and one of every source once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    cell = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    sources = cells.groupBy(cell.alias("_cell"), *keys, "source").agg(F.collect_list(F.struct("column", "x", "n")).alias("_cells"))
    sources = sources.withColumn("_h", F.xxhash64("source"))
    size = sources.groupBy("_cell").agg(F.count("*").alias("size"))
    depth = F.greatest(F.ceil(F.log2(F.col("size") / leaf_sources)), F.lit(0)).cast("int")
    # leaves of a cell with the sources of each node on their way down
    placed = sources.join(size.select("_cell", depth.alias("_depth")), "_cell").withColumn("_leaf", F.pmod("_h", F.pow(F.lit(2.0), F.col("_depth")).cast("long")))
    leaves = placed.groupBy("_cell", "_depth", "_leaf").agg(F.count("*").alias("n"))
    nodes = leaves.select("_cell", "_leaf", "n", F.explode(F.sequence(F.lit(0), "_depth")).alias("level")).withColumn("node", F.pmod("_leaf", F.pow(F.lit(2.0), F.col("level")).cast("long")))
    held = nodes.groupBy("_cell", "level", "node").agg(F.sum("n").alias("held"))
    way = nodes.join(held, ["_cell", "level", "node"]).groupBy("_cell", "_leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "held"))), lambda x: x["held"]).alias("_way"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "source"], kind="stable")
        name, leaf, way = rows["_cell"].iloc[0], int(rows["_leaf"].iloc[0]), list(rows["_way"].iloc[0])
        mine = np.full(replicates, way[0], np.int64)
        for level, (whole, own) in enumerate(zip(way, way[1:], strict=False)):
            right = leaf >> level & 1
            left = generator(seed, name, level, leaf % (1 << level)).binomial(mine, (whole - own if right else own) / whole)
            mine = mine - left if right else left
        flat = pd.DataFrame([(i, c["column"], c["x"], c["n"]) for i, held in enumerate(rows["_cells"]) for c in held], columns=["row", "column", "x", "n"])
        columns, values, n = _columns(flat)
        rng, sums, weights = generator(seed, name, "leaf", leaf, len(way)), [], []
        for a in range(0, replicates, BLOCK):
            times = mine[a : a + BLOCK]
            dealt = rng.integers(0, len(rows), int(times.sum())) + np.repeat(np.arange(len(times)) * len(rows), times)
            s, w = _weighted(values, n, np.bincount(dealt, minlength=len(times) * len(rows)).reshape(len(times), -1).astype(float))
            sums.append(s)
            weights.append(w)
        sums, weights = np.concatenate([*sums, values.sum(0)[None]]), np.concatenate([*weights, n.sum(0)[None]])
        made = {k: [rows[k].iloc[0]] * len(columns) for k in keys}
        return pd.DataFrame(made | {"column": columns, "_leaf": leaf, "sums": [sums[:, i].tobytes() for i in range(len(columns))], "weights": [weights[:, i].tobytes() for i in range(len(columns))]})

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"column {kinds['column']}", "_leaf long", "sums binary", "weights binary"])
    drawn = dealt(placed.join(way, ["_cell", "_leaf"]), "_cell", "_leaf").groupBy("_cell", "_leaf").applyInPandas(draw, schema)
    return _added(drawn, list(keys), "_leaf")


#: Cumulative Poisson(1) probabilities; the rest are threes.
WEIGHTS = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058])


def dealt(frame: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to as many tasks as the session's shuffles have, or as can run at once: few bytes may be much work, so
    partitions are not to be joined by their size."""
    spark = frame.sparkSession
    return frame.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


@functools.lru_cache(8)
def _heads(replicates: int, salt: str) -> list[bytes]:
    return [f"{salt}|{r}|".encode() for r in range(replicates)]


def hashed_weights(source, replicates: int, salt: str) -> np.ndarray:
    """The weight of a source in each replicate, from the first 32 bits of an MD5."""
    tail, md5 = f"{source}".encode(), hashlib.md5
    digests = b"".join([md5(head + tail).digest() for head in _heads(replicates, salt)])
    return np.searchsorted(WEIGHTS, np.frombuffer(digests, ">u4")[::4] / 4294967296.0, "right").astype(float)


def hashed_sums(cells: DataFrame, *keys: str, replicates: int, salt: str) -> DataFrame:
    """The same rows as ``multinomial_sums`` under hashed weights, which one source has in all cells."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    names = [*keys, "column"]
    sources = dealt(cells.withColumn("source", F.col("source").cast("string")), "source").groupBy("source").agg(F.collect_list(F.struct(*names, "x", "n")).alias("cells"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for source, own in zip(batch["source"], batch["cells"], strict=True):
                w = np.append(hashed_weights(source, replicates, salt), 1.0)
                for c in own:
                    s, n = held.setdefault(tuple(c[k] for k in names), [0.0, 0.0])
                    held[tuple(c[k] for k in names)] = [s + w[:, None] * np.asarray(c["x"], float), n + w * c["n"]]
        part = TaskContext.get().partitionId() % (FAN * FAN)
        yield pd.DataFrame([(*k, part, s.tobytes(), n.tobytes()) for k, (s, n) in held.items()], columns=[*names, "_leaf", "sums", "weights"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in names], "_leaf long", "sums binary", "weights binary"])
    return _added(sources.mapInPandas(add, schema), list(keys), "_leaf")
