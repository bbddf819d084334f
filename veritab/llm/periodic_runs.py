"""Periodic runs of words, found on a harmonic grid with prefix hashes, and texts with each run collapsed.

A run is a stretch of consecutive words with smallest period q and at least ``max(least_words, exponent * q)`` words
that no neighbouring word extends keeping period q. In a run of period p, the words that equal the one p places on
form a stretch of ``max(least_words, exponent * p) - p`` words at least, so a grid of that spacing has a point in it:
the grids of all periods together have some (n / 3) ln n points for exponent 4. For all (period, grid point) pairs of a
slice of texts at once, the longest common extensions of the point and its partner one period on are found forwards
and backwards by doubling and halving over prefix hashes modulo a prime. Pairs that give the same stretch are one run,
whose period is the smallest of them. Every word of every run is then compared with its partner. A hash can only make
a stretch too long, so runs that pass are exact; where one doesn't, the slice is done again with another base.

Null and empty texts, and texts of white space, have no words and no runs. Very long texts are taken whole; memory grows
with their number of words, grid points come in blocks. Runs of equal length are told apart by start, then period.
Repeated rows are judged each on its own. An empty table gives an empty one. Only the id and the text are read, so extra
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import buffer_of, slices, small_batches, word_hashes, words
from veritab.llm.bpe import spread

LEAST_WORDS, EXPONENT = 6, 4
#: Grid points that are looked at in one go.
BLOCK_POINTS = 1 << 19
PRIME = np.uint64((1 << 31) - 1)
#: Bases of the hashes, one after the other where one deceives.
BASES = (1_103_515_245, 1_566_083_941, 1_812_433_253, 1_664_525_203)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The base to the power of 0, 1, 2 ... modulo PRIME, n of them at least."""
    held = _powers.get(base, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate([held, held * np.uint64(pow(base, len(held), int(PRIME))) % PRIME])
    _powers[base] = held
    return held


class Prefixes:
    """Hashes of all stretches of a sequence of 64-bit values, by prefix sums modulo a prime."""

    def __init__(self, values: np.ndarray, base: int):
        self.power = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values % PRIME) * self.power[: len(values)] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def same(self, at: np.ndarray, period: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` values from ``at`` on hash like those one period on."""
        other = at + period
        left = (self.sums[at + size] + PRIME - self.sums[at]) % PRIME * self.power[period] % PRIME
        return left == (self.sums[other + size] + PRIME - self.sums[other]) % PRIME

    def extension(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many values from ``at`` on (or before it) equal those one period on, ``limit`` at most; never too few."""
        low, high = np.zeros(len(at), np.int64), limit.copy()

        def tried(which: np.ndarray, size: np.ndarray) -> np.ndarray:
            same = self.same(at[which] - size if back else at[which], period[which], size)
            low[which[same]] = size[same]
            high[which[~same]] = size[~same] - 1
            return same

        rest, step = np.flatnonzero(limit > 0), 1
        while len(rest):
            size = np.minimum(step, limit[rest])
            rest = rest[tried(rest, size) & (size < limit[rest])]
            step *= 2
        rest = np.flatnonzero(low < high)
        while len(rest):
            tried(rest, (low[rest] + high[rest] + 1) >> 1)
            rest = rest[low[rest] < high[rest]]
        return low


def grid(first: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Points of all grids, in blocks: point, period, first word of the row, word after its last."""
    n = np.diff(first)
    periods = np.where(n >= least, n // exponent, 0)
    row = np.repeat(np.arange(len(n)), periods)
    period = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    step = np.maximum(least, exponent * period) - period
    points = (n[row] - 1 - period) // step + 1
    bounds = np.append(0, np.cumsum(points))
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK_POINTS, "right")) - 1)
        each = points[a:b]
        place = np.arange(bounds[b] - bounds[a]) - np.repeat(bounds[a:b] - bounds[a], each)
        begin = first[row[a:b]]
        yield np.repeat(begin, each) + place * np.repeat(step[a:b], each), np.repeat(period[a:b], each), np.repeat(begin, each), np.repeat(first[row[a:b] + 1], each)
        a = b


def _smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct stretches, each with its smallest period, by start and period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _partners(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of all runs that have a partner one period on, run by run, and the number of the run of each."""
    size = end - start - period
    run = np.repeat(np.arange(len(start)), size)
    return np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + start[run], run


def find_runs(values: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of rows of values: row i is values[first[i] : first[i + 1]]; by start, then period."""
    for base in BASES:
        prefixes = Prefixes(values, base)
        found = [np.zeros((3, 0), np.int64)]
        for at, period, begin, end in grid(first, least, exponent):
            equal = values[at] == values[at + period]
            at, period, begin, end = at[equal], period[equal], begin[equal], end[equal]
            low = at - prefixes.extension(at, period, at - begin, True)
            high = at + period + prefixes.extension(at, period, end - at - period, False)
            long = high - low >= np.maximum(least, exponent * period)
            found.append(np.stack(_smallest_periods(low[long], high[long], period[long])))
        start, end, period = _smallest_periods(*np.concatenate(found, axis=1))
        place, run = _partners(start, end, period)
        if np.array_equal(values[place], values[place + period[run]]):
            return start, end, period
    raise RuntimeError("all bases deceive")


def planted(first: np.ndarray, seeds: list[int | None]) -> np.ndarray:
    """For each word of each row the word that stands in its place.

    A row of n words whose seed h is a multiple of 10 ends in a run: with g = h // 10, word i from a = g % n on becomes
    word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8).
    """
    source = np.arange(first[-1])
    for i, h in enumerate(seeds):
        n = int(first[i + 1] - first[i])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return source


def texts_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray, first: np.ndarray) -> Iterator[bytes]:
    """For each row its kept words, joined by one space. first: where each row's begin among the kept ones."""
    flat, bounds = spread(np.append(raw, np.uint8(32)), start, end - start + 1, kept)
    flat[bounds[1:] - 1] = 32
    flat, at = flat.tobytes(), bounds[first].tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield flat[a : max(a, b - 1)]


def runs_of(raw: np.ndarray, offsets: np.ndarray, seeds: list[int | None] | None, least: int, exponent: int) -> tuple[list[list[tuple[int, int, int]]], Iterator[bytes]]:
    """For each row its runs (start, length, period), and its text with all runs collapsed to their first period."""
    start, end, first = words(raw, offsets)
    source = planted(first, seeds) if seeds else np.arange(len(start))
    values = word_hashes(raw, start, end)[source]
    begin, stop, q = find_runs(values, first, least, exponent)
    place, run = _partners(begin, stop, q)
    a, b = source[place], source[place + q[run]]
    alike = np.array_equal(end[a] - start[a], end[b] - start[b]) and np.array_equal(spread(raw, start, end - start, a)[0], spread(raw, start, end - start, b)[0])
    if not alike:  # two words of one hash: name words by their bytes instead
        flat, names = raw.tobytes(), {}
        values = np.array([names.setdefault(flat[x:y], len(names)) for x, y in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)[source]
        begin, stop, q = find_runs(values, first, least, exponent)
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, begin + q, 1)
    np.add.at(covered, stop, -1)
    kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    row = np.searchsorted(first, begin, "right") - 1
    of_row: list[list[tuple[int, int, int]]] = [[] for _ in offsets[1:]]
    for i, s, length, period in zip(row.tolist(), (begin - first[row]).tolist(), (stop - begin).tolist(), q.tolist(), strict=True):
        of_row[i].append((s, length, period))
    return of_row, texts_of(raw, start, end, source[kept], np.searchsorted(kept, first))


def periodic_runs(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: Column | None = None, least_words: int = LEAST_WORDS, exponent: int = EXPONENT, outputs: bool = True) -> DataFrame:
    """Per row: the id, n_runs, start, length, period and exponent_milli of the longest run (null without one), digests
    runs_sha256 (lines ``start,length,period``) and collapsed_sha256, the runs and the collapsed text.

    outputs: False leaves out runs and collapsed. seed: longs by which some texts get a periodic end before runs are
    looked for (``planted``); null plants nothing.
    """
    if exponent < 2 or least_words < 2:
        raise ValueError("a run has two periods and two words at least")
    small_batches(frame.sparkSession)
    kind, with_seed = frame.schema[id_column].dataType.simpleString(), seed is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(2).to_pylist() if with_seed else None
            made: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
            for low, high, part, own in slices(*buffer_of(batch.column(1))):
                runs, collapsed = runs_of(part, own, seeds and seeds[low:high], least_words, exponent)
                for found, text in zip(runs, collapsed, strict=True):
                    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
                    lines = "".join([f"{s},{n},{q}\n" for s, n, q in found]).encode()
                    values = (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest(), *([dict(zip(("start", "length", "period"), x, strict=True)) for x in found], text.decode()) * outputs)
                    for column, x in zip(made.values(), values, strict=False):
                        column.append(x)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])), pa.string()] * outputs
            names = list(made)[: len(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(made[k], t) for k, t in zip(names, kinds, strict=True)]], names=["id", *names])

    schema = f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * outputs
    texts = frame.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *([seed.cast("long").alias("seed")] if with_seed else []))
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_column)
