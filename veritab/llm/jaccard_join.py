"""Self-join of documents by Jaccard similarity of word n-grams, with adaptive multi-match prefixes.

A document's set holds its distinct n-grams of words (A-Z lower-cased); with fewer words the whole sequence is
its one n-gram, and without words the set is empty and linked with nothing. Two documents link when
100 * intersection >= percent * union. The result has one row for each input row: its id, n_shingles and
component_id, the smallest id reachable by links.

1. One pass hashes all n-grams, gives every document the hash of its set, and counts n-grams in a sketch of a
   fixed number of counters. Documents with equal sets are one node from here on.
2. n-grams are ordered from rare to frequent by the sketch. Sets that link share at least T = ceil(percent % of
   the larger size) n-grams, so they share at least m of them within the first size - T + m of each. Each
   document chooses its m from 1 to ``most_matches``: where the prefix holds n-grams with many candidates, a
   longer prefix that demands m matches is cheaper. A pair must share the smaller m of its two documents.
3. Prefix entries are dealt out by n-gram to shards, whose twice-seen filters drop those that no second document has.
4. Each n-gram's entries are first compared with one of them only, the pivot, round after round with another
   pivot. So a large group of near copies becomes one component after a number of comparisons that grows with
   its size, not with its square.
5. What is left are entries of one n-gram that lie in different components. All their pairs of compatible
   sizes whose parity bits differ in no more places than linked sets can, and that share as many prefix entries
   as linked sets must, are compared, so no link between different
   components is missed. Only the texts of documents in such pairs are read again.

Comparisons count common hashes of 64 bits; a false one would need colliding n-grams. Rows with the same id are
rows of their own. Null ids compare as the smallest id. Empty tables give empty results. Very long texts are read
whole; a set may have any size. Among equal pivots and equal counts the smaller set hash goes first, which decides the
order of comparisons, not the result. Only the id and the text are read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._components import components
from veritab.llm._core import buffer_of, lean, lowered, mixed, packed, released, sequence_hashes, signed, slices, small_batches, staged, swept, trimmed, window_hashes, word_hashes, words
from veritab.llm._filters import HELD_KEYS, flat_longs, settled, small_set, twice_seen

SHINGLE, PERCENT, MOST_MATCHES = 5, 80, 4
SHORT_SEED = 1
#: Longs of a set's parity bits.
WORDS = 8
#: Counters of the sketch (4 bytes each in every worker).
COUNTERS = 1 << 22
#: Rounds with a single pivot before the rest is compared pair by pair.
PIVOT_ROUNDS = 2


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all rows, one after the other, and where each row's begin (rows + 1)."""
    low = lowered(raw)
    start, end, first = words(low, offsets)
    hashes = word_hashes(low, start, end)
    grams, at = window_hashes(hashes, first, size)
    row = np.searchsorted(first, at, "right") - 1
    counts = np.diff(first)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        grams = np.concatenate([grams, sequence_hashes(hashes, first[few], first[few + 1], SHORT_SEED)])
        row = np.concatenate([row, few])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(offsets)))


def set_hashes(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each row's set; rows without n-grams have none that matters."""
    return sequence_hashes(grams, begin[:-1], begin[1:])


def parity_bits(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows of WORDS longs: each n-gram flips one bit. Two rows differ in no more bits than their sets in n-grams."""
    out = np.zeros((len(begin) - 1, WORDS), np.uint64)
    filled = np.flatnonzero(np.diff(begin))
    if len(filled):
        x = mixed(grams + np.uint64(1))
        place, bit = (x >> np.uint64(6)) & np.uint64(WORDS - 1), np.uint64(1) << (x & np.uint64(63))
        for k in range(WORDS):
            out[filled, k] = np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), begin[filled])
    return out


def counter_of(grams: np.ndarray) -> np.ndarray:
    return (mixed(grams) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, e, bits) of documents and, at the end, one row with the task's counters."""
    import zlib

    counters = np.zeros(COUNTERS, np.uint32)
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        raw, offsets = buffer_of(batch.column(1))
        n, e, bits = [], [], []
        for _, _, part, own in slices(raw, offsets):
            grams, begin = shingle_sets(part, own, size)
            bits.append(parity_bits(grams, begin))
            n.append(np.diff(begin))
            e.append(signed(set_hashes(grams, begin)))
            cells, more = np.unique(counter_of(grams), return_counts=True)
            counters[cells] += more.astype(np.uint32)
        if n:
            rows = sum(map(len, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(e), pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, WORDS * rows + 1, WORDS), pa.int32()), pa.array(signed(np.concatenate(bits).reshape(-1)))), pa.nulls(rows, pa.binary())], names=["id", "n", "e", "bits", "counters"])
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([zlib.compress(counters.tobytes(), 1)], pa.binary())], names=["id", "n", "e", "bits", "counters"])


def _summed(frame: DataFrame) -> np.ndarray:
    """The tasks' counters added up, slice by slice in executors; the sum has a fixed size."""
    import zlib

    import pandas as pd

    pieces = 16
    width = COUNTERS // pieces

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                one = np.frombuffer(zlib.decompress(packed), np.uint32)
                total = one.astype(np.uint64) if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(pieces)], pa.binary())], names=["piece", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for packed in parts["part"]:
            total += np.frombuffer(zlib.decompress(packed), np.uint64)
        return pd.DataFrame({"piece": parts["piece"].iloc[:1], "part": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

    cutter = frame.filter("counters is not null").select("counters").mapInArrow(lean(cut), "piece int, part binary")
    found = np.zeros(COUNTERS, np.uint32)
    for r in cutter.groupBy("piece").applyInPandas(add, "piece int, part binary").collect():  # 16 rows of a fixed size
        found[r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(zlib.decompress(r["part"]), np.uint32)
    return found


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Intersections of a set of n with a set it links to are at least this large."""
    return -(-n * percent // 100)


def choose_prefix(ordered: np.ndarray, cost: np.ndarray, n: int, percent: int, most_matches: int) -> tuple[int, int]:
    """Length of the prefix and matches it demands. cost: candidates that each entry brings, in the set's order.

    The estimate for m matches is the sum of the prefix' costs over m squared, as candidates by chance share
    single entries and true ones share most.
    """
    shared = int(least_overlap(np.int64(n), percent))
    best, chosen = None, (n - shared + 1, 1)
    for m in range(1, min(most_matches, shared) + 1):
        length = n - shared + m
        estimate = float(cost[:length].sum()) / (m * m) + length
        if best is None or estimate < best:
            best, chosen = estimate, (length, m)
    return chosen


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, most_matches: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (e, n, m, h): each document's prefix in the common order and the matches it demands."""
    usual = 2 * float(counts.mean()) + 8  # what a counter holds of rare n-grams only
    for batch in batches:
        raw, offsets = buffer_of(batch.column(0))
        e, n, m, lists = [], [], [], []
        for _, _, part, own in slices(raw, offsets):
            grams, begin = shingle_sets(part, own, size)
            seen = counts[counter_of(grams)].astype(np.float64)
            level = np.where(seen > usual, seen, 0.0)
            own_hashes = signed(set_hashes(grams, begin))
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            order = np.lexsort((grams, level, row))
            grams, level = grams[order], level[order]
            for i in np.flatnonzero(np.diff(begin)):
                a, b = begin[i], begin[i + 1]
                length, matches = choose_prefix(grams[a:b], level[a:b], int(b - a), percent, most_matches)
                e.append(own_hashes[i])
                n.append(int(b - a))
                m.append(matches)
                lists.append(signed(grams[a : a + length]))
        if e:
            flat = pa.array(np.concatenate(lists), pa.int64())
            places = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int32()), pa.ListArray.from_arrays(places, flat)], names=["e", "n", "m", "h"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, kind, e, n, m): prefix entries; a task tells a set once. Columns: e, n, m, h."""
    told: set[int] = set()
    held: list[tuple[np.ndarray, pa.RecordBatch]] = []
    n = 0

    def flushed() -> pa.RecordBatch:
        columns = pa.Table.from_batches([x for _, x in held]).combine_chunks().to_batches()[0]
        return settled(np.concatenate([x for x, _ in held]), dict(zip(columns.schema.names, columns.columns, strict=True)))

    for batch in batches:
        new = [e not in told and not told.add(e) for e in batch.column(0).to_pylist()]
        batch = batch.filter(pa.array(new, pa.bool_()))
        h = flat_longs(batch.column(3))
        rows = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(3).value_lengths())))
        if len(h):
            held.append((h, batch.select(["e", "n", "m"]).take(rows)))
            n += len(h)
        if n >= HELD_KEYS:
            yield flushed()
            held, n = [], 0
            if len(told) > HELD_KEYS:  # only here: no set may come twice among the entries of one flush
                told.clear()
    if held:
        yield flushed()
    held, told = [], set()
    trimmed()


def _entries(texts: DataFrame, size: int, percent: int, most_matches: int, counts) -> DataFrame:
    """Staged rows (t, e, n, m): prefix entries that a second document may have."""
    keys = staged(texts.mapInArrow(lean(lambda b: _keys(_prefixes(b, size, percent, most_matches, counts.value))), "h long, kind int, e long, n long, m int"), "keys")
    out = staged(twice_seen(keys).withColumnRenamed("h", "t").distinct(), "entries", keys.count())
    released(keys)
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffer_of(batch.column(0))
        for _, _, part, own in slices(raw, offsets):
            grams, begin = shingle_sets(part, own, size)
            yield pa.RecordBatch.from_arrays([pa.array(signed(set_hashes(grams, begin))), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(signed(grams)))], names=["e", "tokens"])


def _linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The staged pairs (a, b) of set hashes that link.

    Their texts are found by the hashes of their ids: broadcast if they are few, else joined.
    """
    needed = staged(pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct().join(nodes.select("e", "id"), "e"), "needed", 2 * pairs.count())
    seen = small_set(needed.select(F.xxhash64("id").alias("h")))
    hashed = rows.select(F.xxhash64("id").alias("h"), "text")
    if seen is None:
        hashed = hashed.join(needed.select(F.xxhash64("id").alias("h")).distinct(), "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            if seen is not None:
                texts = texts.filter(pa.array(seen.value.has(np.asarray(batch.column(0).to_numpy(zero_copy_only=False)))))
            yield from _sets([pa.RecordBatch.from_arrays([texts], names=["text"])], size)

    found = hashed.mapInArrow(lean(run), "e long, tokens array<long>")
    sets = staged(found.join(needed.select("e"), "e", "left_semi").dropDuplicates(["e"]), "sets", 16 * needed.count())
    released(needed)
    if seen is not None:
        seen.destroy()
    both = pairs.join(sets.select(F.col("e").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("e").alias("b"), F.col("tokens").alias("y")), "b")
    counted = both.select("a", "b", F.size("x").alias("i"), F.size("y").alias("j"), F.size(F.array_intersect("x", "y")).alias("c"))
    out = staged(counted.filter(F.col("c") * 100 >= percent * (F.col("i") + F.col("j") - F.col("c"))).select("a", "b"), "links", 16 * pairs.count())
    released(sets)
    return out


def _demanded(an: str, am: str, bn: str, bm: str, percent: int) -> Column:
    """Prefix entries that two linked sets share at least.

    Of the two prefixes, take the one whose last entry comes first: what the sets share up to there lies in both
    prefixes, and what they share beyond is no more than that set has beyond its prefix. A prefix of m matches
    leaves T - m entries of its set, and an intersection is at least percent / (100 + percent) of both sizes.
    """
    beyond = lambda n, m: F.ceil(F.col(n) * percent / 100) - F.col(m)
    needed = F.ceil((F.col(an) + F.col(bn)) * percent / (100 + percent) - 1e-9)
    return F.greatest(F.least(am, bm).cast("long"), needed - F.greatest(beyond(an, am), beyond(bn, bm)))


def _fits(n: str, other: str, percent: int):
    return F.least(n, other) * 100 >= percent * F.greatest(n, other)


def jaccard_components(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, most_matches: int = MOST_MATCHES) -> DataFrame:
    """Per row: the id, n_shingles and component_id."""
    spark = frame.sparkSession
    small_batches(spark)
    kind = frame.schema[id_column].dataType.simpleString()
    rows = packed(frame).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    made = staged(rows.mapInArrow(lean(lambda b: _profiles(b, shingle)), f"id {kind}, n long, e long, bits array<long>, counters binary"), "profiles")
    counts = spark.sparkContext.broadcast(_summed(made))
    profiles = made.filter("counters is null")
    nodes = profiles.filter("n > 0").groupBy("e").agg(F.min(F.struct(F.col("id"))).alias("least"), F.first("n").alias("n"))
    nodes = staged(nodes.select("e", "n", F.col("least.id").alias("id")), "nodes", profiles.count())

    told = _entries(rows.select("text"), shingle, percent, most_matches, counts)
    counts.destroy()
    several = told.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    n = told.count()
    shared = staged(told.join(several, "t"), "entries", n)
    released(told)
    # the original of a group of near copies holds the entries that most others hold: the best pivot
    weights = staged(shared.groupBy("e").agg(F.sum("c").alias("w")), "weights", n)
    entries = staged(shared.join(weights, "e").select("t", "e", "n", "m", "w"), "entries", n)
    released(shared, weights)
    swept(spark)

    links, roots = None, None
    for step in range(PIVOT_ROUNDS + 1):
        if roots is None:
            placed = entries.withColumn("root", F.col("e"))
        else:
            placed = entries.join(roots, entries["e"] == roots["node"], "left").select("t", "e", "n", "m", "w", F.coalesce("root", "e").alias("root"))
        order = -F.col("w") if step % 2 == 0 else F.xxhash64("e", F.lit(step))
        pivot = F.min(F.struct(order, "e", "n", "m", "root"))
        lists = placed.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pivot.alias("p")).filter("lo < hi")
        placed = staged(placed, "placed", n) if roots is not None else placed
        lists = staged(lists.select("t", F.col("p.e").alias("b"), F.col("p.n").alias("bn"), F.col("p.m").alias("bm"), F.col("p.root").alias("br")), "lists", n)
        left = placed.select("t", F.col("e").alias("a"), F.col("n").alias("an"), F.col("m").alias("am"), F.col("root").alias("ar"))
        if step < PIVOT_ROUNDS:
            each, share = left.join(lists, "t"), 0.5  # pairs with a pivot come early, not instead of others
        else:
            rest = left.join(lists.select("t"), "t")
            bits = profiles.filter("n > 0").join(rest.select(F.col("a").alias("e")).distinct(), "e", "left_semi").groupBy("e").agg(*[F.first(F.get("bits", F.lit(k))).alias(f"ab{k}") for k in range(WORDS)])
            rest = staged(rest.join(bits, rest["a"] == bits["e"]).drop("e"), "rest", n)
            other = rest.select("t", *[F.col(c).alias("b" + c[1:]) for c in rest.columns if c != "t"])
            apart = sum([F.bit_count(F.col(f"ab{k}").bitwiseXOR(F.col(f"bb{k}"))) for k in range(1, WORDS)], F.bit_count(F.col("ab0").bitwiseXOR(F.col("bb0"))))
            allowed = F.col("an") + F.col("bn") - 2 * F.ceil((F.col("an") + F.col("bn")) * percent / (100 + percent) - 1e-9)
            each, share = rest.join(other, "t").filter((F.col("a") < F.col("b")) & (apart <= allowed)), 1.0
        each = each.filter((F.col("ar") != F.col("br")) & _fits("an", "bn", percent))
        counted = each.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("an", "am", "bn", "bm")])
        pairs = counted.filter(F.col("c") >= share * _demanded("an", "am", "bn", "bm", percent))
        if step < PIVOT_ROUNDS:  # of all pivots that a set meets, the one that shares most with it
            pairs = pairs.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = staged(pairs, "pairs", n)
        released(lists, *([placed] if roots is not None else []), *([rest] if step == PIVOT_ROUNDS else []))
        new = None if pairs.isEmpty() else _linked(pairs, rows, nodes, shingle, percent)
        released(pairs)
        if new is None or new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        released(roots)
        roots = components(links)
        swept(spark)
    released(entries)

    if roots is not None:
        groups = nodes.join(roots, nodes["e"] == roots["node"], "left").select("e", "id", F.coalesce("root", "e").alias("root"))
        least = staged(groups.groupBy("root").agg(F.min(F.struct(F.col("id"))).alias("c")), "least-ids", nodes.count())
        named = staged(groups.join(least, "root").select("e", F.col("c.id").alias("c")), "named", nodes.count())
        released(roots, least, nodes)
        swept(spark)
    else:
        named = nodes.select("e", F.col("id").alias("c"))
    out = profiles.join(named, "e", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id")
