"""Two Bloom filters over hashes, once seen and twice seen, in shards that no driver ever holds.

Tasks settle what recurs among the keys that they hold, so a hash that a third of all rows have becomes one witness
a task. The other hashes, 8 bytes and what belongs to them, are dealt out once to shards of about ``SHARD_KEYS``
rows; where these are more than ``MOST_PARTITIONS``, a partition holds several, one after the other. A shard sets the
cells of each hash in its once-seen filter; where they were set before, in its twice-seen filter; then it lets pass
the rows that the twice-seen filter can't rule out. The filters have a fixed size and live as long as their shard: the
number of shards follows the input, the error rate and the number of partitions don't, and texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import lean, mixed, released, signed, staged, trimmed

#: Rows of a shard on average, cells of each of its filters, and cells that a hash sets.
SHARD_KEYS, CELLS, PROBES = 1 << 18, 1 << 22, 2
#: Partitions that keys are dealt to at most, at any size.
MOST_PARTITIONS = 1 << 13
#: Keys that a task compares with each other before it passes them on.
HELD_KEYS = 1 << 18
#: A set of at most so many hashes (16 MB) is broadcast; a larger one is joined.
BROADCAST_HASHES = 1 << 21

UNKNOWN, WITNESS, REPEATED = 0, 1, 2


def flat_longs(lists: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)


def settled(h: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Keys that a task holds, with their columns and a kind: 0 unknown, 1 repeated and the witness of its hash, 2 repeated."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    kind = np.where(same[:-1] | same[1:], np.where(same[:-1], REPEATED, WITNESS), UNKNOWN).astype(np.int32)
    chosen = pa.array(order)
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(kind), *[x.take(chosen) for x in columns.values()]], names=["h", "kind", *columns])


def cells_of(hashes: np.ndarray) -> list[np.ndarray]:
    """The cells of 64-bit hashes, one array for each probe."""
    x = hashes.view(np.uint64)
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    return [(mixed(x + np.uint64(probe + 1)) >> shift).astype(np.int64) for probe in range(PROBES)]


class Filters:
    """The once-seen and the twice-seen filter of a shard."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(CELLS, bool), np.zeros(CELLS, bool)

    def add(self, hashes: np.ndarray, repeated: np.ndarray) -> None:
        cells = cells_of(hashes)
        seen = repeated | np.logical_and.reduce([self.once[c] for c in cells])
        order = np.argsort(hashes, kind="stable")
        again = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
        seen[order[again]] = True
        for c in cells:
            self.twice[c[seen]] = True
            self.once[c] = True

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.twice[c] for c in cells_of(hashes)])


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: the rows of unknown kind whose hash may have been seen twice. Columns: h, kind, and others.

    Rows that are equal in all columns, as several tasks may tell them, count once.
    """
    held, filters = [], None
    hashes = lambda b: np.asarray(b.column(0).to_numpy(zero_copy_only=False))
    for batch in batches:
        if batch.num_rows:
            filters = filters or Filters()
            kind = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            rest = batch.drop_columns(["kind"])
            told = hashes(rest)[kind == WITNESS]
            filters.add(told, np.ones(len(told), bool))
            held.append(rest.filter(pa.array(kind == UNKNOWN)))
    if filters is None:
        return
    rows = pa.Table.from_batches(held)
    if not any(map(pa.types.is_nested, rows.schema.types)):
        rows = rows.group_by(rows.column_names, use_threads=False).aggregate([])
    held = rows.to_batches(max_chunksize=1 << 16)
    for batch in held:
        filters.add(hashes(batch), np.zeros(batch.num_rows, bool))
    for batch in held:
        yield batch.filter(pa.array(filters.suspects(hashes(batch))))
    del rows, held, filters, batch
    trimmed()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of a partition, one after the other: rows come sorted by their last column, the shard's number."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        rest = batch.drop_columns([batch.schema.names[-1]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and number[a] != now:
                yield from _passed(iter(held))
                held = []
            held.append(rest.slice(a, b - a))
            now = number[a]
    yield from _passed(iter(held))


def twice_seen(keys: DataFrame) -> DataFrame:
    """keys: a staged table (h long, kind int, other columns) as ``settled`` makes it. Its rows without the kind
    whose hash occurs twice, and few others."""
    dealt = keys.filter(F.col("kind") < REPEATED)
    shards = max(1, -(-dealt.count() // SHARD_KEYS))
    rest = keys.drop("kind")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    each = -(-shards // MOST_PARTITIONS)
    if each == 1:
        passed = dealt.repartition(shards, "h").mapInArrow(lean(_passed), schema)
    else:  # xxhash64 and the hash that deals rows to partitions don't hang together
        numbered = dealt.repartition(MOST_PARTITIONS, "h").withColumn("_shard", F.pmod(F.xxhash64("h"), F.lit(each)).cast("int"))
        passed = numbered.sortWithinPartitions("_shard").mapInArrow(lean(_by_shard), schema)
    return passed.unionByName(keys.filter(F.col("kind") > UNKNOWN).drop("kind"))


class Chosen:
    """A set of 64-bit hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes


def small_set(hashes: DataFrame, most: int | None = None) -> Broadcast | None:
    """A broadcast Chosen of the distinct values of the one column of longs; None if they are more than ``most``."""
    distinct = staged(hashes.distinct(), "hashes", hashes.count())
    if distinct.count() > (BROADCAST_HASHES if most is None else most):
        released(distinct)
        return None
    held = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in distinct.toArrow().column(0).chunks]
    released(distinct)
    return hashes.sparkSession.sparkContext.broadcast(Chosen(np.concatenate([np.zeros(0, np.int64), *held])))
