"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are encoded once, each with an end token; those longer than ``limit`` are cut into pieces of ``limit`` tokens,
of which the first may be shorter. From then on only lengths count: Spark counts the pieces of each length, and the
driver, which sees no more than ``limit`` such counts, solves the configuration linear program over them. A configuration
is a multiset of lengths that fits in a sequence, and the program asks for the fewest sequences whose configurations
cover all pieces. Multiplicative weights solve it: each length has a price, a knapsack over all capacities by dynamic
programming finds the configuration of the greatest price that begins with each length, near-best ones share the
round's mass, and prices of lengths that are covered more than others fall. Configurations are rounded up, most mass
first, as far as pieces remain, and the program is solved again for what is left. A share of each length is kept from
the program; it and the rest are placed by best fit in order of decreasing length. The plan, a table whose size hangs on ``limit`` and the number of rounds alone, is broadcast.
Each piece finds its sequence and offset in it by its number among the pieces of its length: its place within its
task, and a running sum over tasks of the counts, so no task ever sees all pieces of one length.

Null and empty texts are one piece of one token. Very long texts are encoded in chunks, as token_counts does. Pieces of
equal length are told apart by where their rows lie, so ties change no count of sequences. Repeated rows are packed
each on its own, and rows with one id may lie in different sequences. An empty table gives an empty one. Only the id and
the text are read, so extra columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._core import small_batches, staged
from veritab.llm.token_counts import Counter

LIMIT, END_ID = 2_048, 0
#: Rounds of one solution of the program, solutions, how fast prices fall with the covered part, the share of the best
#: configuration's price from which on others take part, and how much faster what lacks cover is used.
ROUNDS, SOLUTIONS, RATE, NEAR_BEST, LACK = 48, 4, 2, 0.98, 12
#: The share of the pieces of each length that the program leaves to best fit, so that it has small ones to fill gaps with.
SPARE = 1 / 8
#: Pieces of one length that the plan tells apart at most: two numbers share one 64-bit key.
PLACE_BITS = 44

Plan = list[tuple[dict[int, int], int]]


def token_pieces(frame: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, task, place): all pieces of all documents; place counts the pieces of
    one length within a task. with_ids: adds ids (binary, 4 bytes each). Stage it before use: tasks are numbered anew."""
    spark = frame.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    kind = frame.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen, task = Counter(ranks.value), [0] * (limit + 1), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 + with_ids)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([counter.encode(text).astype("<u4"), end]) if text else end
                first = (len(ids) - 1) % limit + 1
                for piece, b in enumerate(range(first, len(ids) + 1, limit)):
                    a = max(0, b - limit)
                    packed = ids[a:b].tobytes()
                    for column, x in zip(rows, (i, piece, a, b - a, zlib.crc32(packed), seen[b - a], packed), strict=False):
                        column.append(x)
                    seen[b - a] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(x, k) for x, k in zip(rows[1:], kinds, strict=False)]
            made.insert(4, pa.array([task] * len(rows[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *made], names=["id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"][: 7 + with_ids])

    texts = frame.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * with_ids)


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the greatest total price of lengths that fit, and one length of such a choice (0: none).

    price: of each length from 0 on; lengths without a price above 0 are left out. Any length may be taken repeatedly.
    """
    lengths = np.flatnonzero(price > 0)
    lengths = lengths[lengths > 0]
    value, taken = np.zeros(len(price)), np.zeros(len(price), np.int64)
    own = price[lengths]
    for room in range(1, len(price)):
        n = int(np.searchsorted(lengths, room, "right"))
        value[room], taken[room] = value[room - 1], 0
        if n:
            tried = own[:n] + value[room - lengths[:n]]
            k = int(np.argmax(tried))
            if tried[k] > value[room]:
                value[room], taken[room] = tried[k], lengths[k]
        if not taken[room]:
            taken[room] = taken[room - 1]
    return value, taken


def configurations(first: np.ndarray, taken: np.ndarray, limit: int) -> list[dict[int, int]]:
    """Configurations that begin with the given lengths and fill what is left as the knapsack says."""
    made = [{int(x): 1} for x in first]
    room, which = limit - first, np.arange(len(first))
    while len(which):
        item = taken[room]
        which, room, item = which[item > 0], room[item > 0], item[item > 0]
        times = room // item  # a repeated best length stays the best as long as it is what the knapsack names
        again = (times > 1) & (taken[np.maximum(room - item, 0)] == item)
        times = np.where(again, 2, 1)
        for i, x, n in zip(which.tolist(), item.tolist(), times.tolist(), strict=True):
            made[i][x] = made[i].get(x, 0) + n
        room = room - item * times
    return made


def solve(demand: np.ndarray, limit: int, rounds: int = ROUNDS) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations and how often each is used in a nearly optimal fractional cover of ``demand`` pieces of each length.

    Prices start at the share of a sequence that a length takes, and fall exponentially with the part of the length's
    demand that is covered, beside the mean part; the sum of all rounds' configurations is the cover.
    """
    lengths = np.flatnonzero(demand)
    own, wanted = lengths / limit, demand[lengths]
    covered, mass = np.zeros(limit + 1), {}
    total = float((wanted * own).sum())
    for _ in range(rounds):
        done, price = covered[lengths] / wanted, np.zeros(limit + 1)
        price[lengths] = own * np.exp(-RATE * np.clip(done - np.average(done, weights=wanted * own), -1, 1))
        value, taken = knapsack(price)
        worth = price[lengths] + value[limit - lengths]
        near = lengths[worth >= NEAR_BEST * worth.max()]
        # lengths that have been covered least take most of the round
        lacking = demand[near] * np.exp(-LACK * covered[near] / demand[near])
        for config, x in zip(configurations(near, taken, limit), (lacking / lacking.sum() * total / rounds).tolist(), strict=True):
            key = tuple(sorted(config.items()))
            mass[key] = mass.get(key, 0.0) + x
            for length, n in config.items():
                covered[length] += n * x
    return mass


def best_fit(demand: np.ndarray, limit: int) -> Plan:
    """Best fit in order of decreasing length, on counts: sequences with one configuration are placed together."""
    groups: dict[int, list[list]] = {}  # by room that is left: [configuration, number of sequences]
    done: Plan = []

    def put(config: dict[int, int], room: int, times: int) -> None:
        groups.setdefault(room, []).append([config, times]) if room else done.append((config, times))

    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        while left and (rooms := [r for r in groups if r >= length]):
            room = min(rooms)
            config, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
            fits = min(room // length, max(1, left // times)) if times <= left else 1
            used = min(times, left // fits)
            if used < times:
                groups.setdefault(room, []).append([config, times - used])
            put({**config, length: config.get(length, 0) + fits}, room - fits * length, used)
            left -= used * fits
        each = limit // length
        if left // each:
            put({length: each}, limit - each * length, left // each)
        if left % each:
            put({length: left % each}, limit - left % each * length, 1)
    return done + [(c, n) for held in groups.values() for c, n in held]


def plan(counts: dict[int, int], limit: int = LIMIT, rounds: int = ROUNDS, solutions: int = SOLUTIONS) -> Plan:
    """Configurations with the number of sequences that use each, which together hold exactly the counted pieces."""
    left = np.zeros(limit + 1)
    for length, n in counts.items():
        left[length] = n
    made: Plan = [({limit: 1}, int(left[limit]))] if left[limit] else []
    left[limit] = 0
    spare = np.ceil(left * SPARE)
    left -= spare
    for _ in range(solutions):
        if not left.any():
            break
        before = left.sum()
        mass = solve(left, limit, rounds)
        for config, x in sorted(mass.items(), key=lambda kv: (-kv[1], kv[0])):
            times = int(min(np.ceil(x), min(left[length] // n for length, n in config)))
            if times > 0 and sum(length * n for length, n in config) == limit:
                made.append((dict(config), times))
                for length, n in config:
                    left[length] -= n * times
        if left.sum() > 0.9 * before:
            break
    return made + best_fit(left + spare, limit)


def segments(made: Plan) -> np.ndarray:
    """The plan by length and place: rows (key, first sequence, pieces of the length a sequence, offset of the first one,
    length), sorted by key = length * 2 ** PLACE_BITS + the number of pieces of this length before."""
    before: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in made:
        offset = 0
        for length in sorted(config, reverse=True):
            at = before.get(length, 0)
            rows.append((length << PLACE_BITS | at, sequence, config[length], offset, length))
            before[length] = at + times * config[length]
            offset += length * config[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()


def packed(frame: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, end_id: int = END_ID, outputs: bool = True) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id, offset, and ids (binary, 4 bytes each).

    outputs: False leaves out ids.
    """
    spark = frame.sparkSession
    pieces = staged(token_pieces(frame, vocabulary, id_column, text_column, limit, end_id, outputs), "pieces")
    each = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    each = staged(each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    if counts and max(counts.values()) >> PLACE_BITS:
        raise ValueError("too many pieces of one length")
    table = spark.sparkContext.broadcast(segments(plan(counts, limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, times, offset, _ = table.value
        for batch in batches:
            length, place = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            key = (length << PLACE_BITS) + place
            at = np.searchsorted(keys, key, "right") - 1
            nth = key - keys[at]
            columns = [pa.array(sequence[at] + nth // times[at]), pa.array(offset[at] + nth % times[at] * length)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], names=["sequence_id", "offset", "row"])

    shown = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * outputs]
    numbered = pieces.join(each.select("length", "task", "before"), ["length", "task"])
    numbered = numbered.select("length", (F.col("place") + F.col("before")).alias("place"), F.struct(*shown).alias("row"))
    made = numbered.mapInArrow(run, f"sequence_id long, offset long, row {numbered.schema['row'].dataType.simpleString()}")
    names = {"id": id_column}
    return made.select(*[F.col(f"row.{c}").alias(names.get(c, c)) for c in shown], "sequence_id", "offset")
