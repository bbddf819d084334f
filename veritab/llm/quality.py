"""Quality rules: counts that fail a text outright, and a calibrated classifier on hashed word and character n-grams.

The classifier is a logistic regression on relative frequencies of hashed words (case kept, as repeated capitals
are a signal) and of hashed runs of GRAM characters. It is fitted on a bounded sample of labelled rows, of which a
fifth is kept back to turn its margins into probabilities. Whole texts are scored in Arrow batches, straight
from their bytes, against a fixed threshold.

Null, empty and wordless texts have zero counts and fail on their words. Very long texts are scored whole.
Repeated rows are judged each on its own. Without labels of both kinds, the probability is 1 for all texts. A
probability of exactly the threshold is kept. An empty table gives an empty one. Only the id and the text are read, so
extra columns may have any name. Null ids are ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import _logistic
from veritab.llm._core import SEPARATOR, buffer_of, mixed, slices, small_batches, window_hashes, word_hashes, words

#: Bound of the sample; hashed columns for words and for runs of characters; characters in a run.
FIT_ROWS, WORD_COLUMNS, GRAM_COLUMNS, GRAM = 4_000, 1 << 15, 1 << 14, 3
LEAST_WORDS, MOST_REPEATED_PERCENT, THRESHOLD = 50, 50, 0.5
SCALE = 30.0
BLANK = " \t\n\x0b\x0c\r"

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """For each row, words in windows of ``size`` words that its text holds twice or more."""
    grams, at = window_hashes(hashes, first, size)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((grams, row))
    same = np.zeros(len(grams) + 1, bool)
    same[1:-1] = (grams[order][1:] == grams[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = at[order[same[:-1] | same[1:]]]
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + size, -1)
    return per_row(np.cumsum(covered[:-1]) > 0, first)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def columns_of(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and for runs of characters: hashed columns of all occurrences, their rows' bounds, and each row's number of them."""
    start, end, first = words(raw, offsets)
    by_word = (word_hashes(raw, start, end) & np.uint64(WORD_COLUMNS - 1)).astype(np.int64)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    x = np.zeros(max(0, len(points) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        x = (x << np.uint64(21)) | points[i : len(points) - GRAM + 1 + i].astype(np.uint64)
    by_gram = WORD_COLUMNS + (mixed(x) & np.uint64(GRAM_COLUMNS - 1)).astype(np.int64)
    # runs that begin in the last characters of a row would leave it
    own = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
    bounds = np.minimum(np.stack([own[:-1], np.maximum(own[1:] - GRAM + 1, own[:-1])]), len(by_gram))
    return [(by_word, np.stack([first[:-1], first[1:]]), np.diff(first)), (by_gram, bounds, np.diff(bounds, axis=0)[0])]


def margins(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(offsets) - 1, bias)
    for columns, bounds, n in columns_of(raw, offsets):
        total = np.concatenate([[0.0], np.cumsum(weights[columns])])
        out += SCALE * (total[bounds[1]] - total[bounds[0]]) / np.maximum(n, 1)
    return out


def learn(sample: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights of the hashed columns and bias, such that sigmoid(margin) is the calibrated probability of label 1."""
    y = np.array([r[2] for r in sample], float)
    width = WORD_COLUMNS + GRAM_COLUMNS
    if not len(y) or y.min() == y.max():
        return np.zeros(width), 40.0
    raw, offsets = buffer_of(pa.array([r[1] for r in sample], pa.large_string()))
    rows, cols, values = [], [], []
    for low, high, part, own in slices(raw, offsets):
        for columns, bounds, n in columns_of(part, own):
            lengths = bounds[1] - bounds[0]
            row = np.repeat(np.arange(high - low), lengths)
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(bounds[0], lengths)
            keys, counts = np.unique(row * width + columns[place], return_counts=True)
            rows.append(keys // width + low)
            cols.append(keys % width)
            values.append(SCALE * counts / np.maximum(n, 1)[keys // width])
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
    kept_back = np.arange(len(y)) % 5 == 4
    inner = ~kept_back[r]
    index = np.cumsum(~kept_back) - 1
    weights, bias = _logistic.fit(index[r[inner]], c[inner], v[inner], y[~kept_back], width, penalty=1e-6, rounds=80, rate=0.05)
    margin = np.bincount(r, v * weights[c], len(y)) + bias
    slope, shift = _logistic.calibrate(margin[kept_back], y[kept_back])
    return weights * slope, bias * slope + shift


def quality(frame: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, most_repeated_percent: int = MOST_REPEATED_PERCENT) -> DataFrame:
    """Per row: the id, the counts, base_failed, kept and the probability of good quality."""
    small_batches(frame.sparkSession)
    held = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            raw, offsets = buffer_of(batch.column(1))
            made = []
            for _, _, part, own in slices(raw, offsets):
                start, end, first = words(part, own)
                letters = ~SEPARATOR[part] & ((part & 0xC0) != 0x80)
                hashes = word_hashes(part, start, end)
                made.append((np.diff(first), per_row(letters, own), per_row(SYMBOL[part], own), repeated_words(hashes, first), _logistic.sigmoid(margins(part, own, weights, bias))))
            if not made:
                continue
            n, chars, symbols, repeated, p = (np.concatenate(x) for x in zip(*made, strict=True))
            lines = np.array([duplicate_lines(x) for x in batch.column(1).to_pylist()], np.int64)
            failed = (n < least_words) | (100 * repeated > most_repeated_percent * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, repeated)], pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    kind = frame.schema[id_column].dataType.simpleString()
    texts = frame.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double").withColumnRenamed("id", id_column)
