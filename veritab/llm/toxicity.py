"""Toxicity scores of whole texts: fuzzy lexicon hits, weighted by their context.

The lexicon is a list of given terms, and terms and stems mined from a bounded sample of labelled documents.
It is a trie; terms of at least ``fuzzy_length`` letters are also found with one letter wrong, missing, added
or swapped with the next: the trie is intersected with their Levenshtein automata, whose states are sets of
(trie node, edits so far). States and steps are made when a word first needs them, so that a word costs one
table look-up for each letter and most words end in the dead state after a few.

Around each hit a window of words tells quotation (quotation marks, or words of reporting) from abuse (words
of address). A logistic regression on counts of hits, hits by context, and hits of each term gives the score.

Null, empty and wordless texts get the score of a text without hits. Very long texts are read whole. Repeated
rows are scored each on its own. Of several terms that one misspelled word is next to, the first in the lexicon counts.
A score of exactly the threshold is predicted 1. An empty table gives an empty one; without labelled rows of both kinds
the given terms alone decide. Only the id and the text are read, so extra columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import _logistic
from veritab.llm._core import small_batches

#: Bounds: labelled rows of the sample, mined terms, words that a worker remembers.
FIT_ROWS, MINED_TERMS, KEPT_WORDS = 6_000, 200, 300_000
FUZZY_LENGTH, CONTEXT = 5, 6
STEM_LENGTHS = (3, 4, 5, 6)

#: Terms to start with, and words that show who speaks.
TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown")
REPORTING = frozenset("said says quote quoted quotes called wrote word term dit disait mot sagte wort dijo palabra".split())
ADDRESS = frozenset("you your yours you're u du dich dein ihr tu toi ton vous votre te usted tus".split())
QUOTES = re.compile(r"[\"“”«»„‘’]")

WORD = re.compile(r"\w+")


class Lexicon:
    """terms: whole words; stems: beginnings of words. Both are lower case."""

    def __init__(self, terms: list[str], stems: list[str], fuzzy_length: int = FUZZY_LENGTH):
        self.names = [*terms, *[f"{x}-" for x in stems]]
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.fuzzy: list[bool] = [False]  # whether a term below the node may be misspelled
        for i, term in enumerate(terms):
            self.word[self._insert(term, len(term) >= fuzzy_length)] = i
        for i, stem in enumerate(stems):
            self.stem[self._insert(stem, False)] = len(terms) + i
        self.fuzzy_length = fuzzy_length
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(frozenset(self._skips({(0, 0, "")})))
        self.known: dict[str, tuple[tuple[int, bool], ...]] = {}

    def _insert(self, text: str, fuzzy: bool) -> int:
        node = 0
        self.fuzzy[0] |= fuzzy
        for ch in text:
            if ch not in self.children[node]:
                self.children[node][ch] = len(self.children)
                self.children.append({})
                self.word.append(-1)
                self.stem.append(-1)
                self.fuzzy.append(False)
            node = self.children[node][ch]
            self.fuzzy[node] |= fuzzy
        return node

    def _skips(self, items: set) -> set:
        """Also the nodes reached by leaving out a letter of the term."""
        more = {(child, 1, "") for node, edits, owed in items if not edits and not owed for child in self.children[node].values() if self.fuzzy[child]}
        return items | more

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
        return self.states[items]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, edits, owed in self.sets[state]:
            if owed:  # the letter that a swap has put off
                if ch == owed:
                    out.add((node, 1, ""))
                continue
            if ch in self.children[node] and (not edits or self.fuzzy[self.children[node][ch]]):
                out.add((self.children[node][ch], edits, ""))
            if not edits and self.fuzzy[node]:
                out.add((node, 1, ""))  # added
                for letter, child in self.children[node].items():
                    if self.fuzzy[child]:
                        if letter != ch:
                            out.add((child, 1, ""))  # wrong
                        if ch != letter and ch in self.children[child] and self.fuzzy[self.children[child][ch]]:
                            out.add((self.children[child][ch], 1, letter))  # swapped
        return self._state(frozenset(self._skips(out)))

    def find(self, word: str) -> tuple[tuple[int, bool], ...]:
        """Lexicon entries in a lower-case word, each with whether it is misspelled."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = self._find(word)
        return found

    def _find(self, word: str) -> tuple[tuple[int, bool], ...]:
        hits = []
        state, node = self.start, 0
        for ch in word:
            if node >= 0:
                node = self.children[node].get(ch, -1)
                if node >= 0 and self.stem[node] >= 0:
                    hits.append((self.stem[node], False))
            after = self.steps[state].get(ch)
            if after is None:
                after = self.steps[state][ch] = self._step(state, ch)
            state = after
            if not self.sets[state]:
                break
        else:
            ends = {(self.word[n], e) for n, e, owed in self.sets[state] if not owed and self.word[n] >= 0}
            exact = {w for w, e in ends if not e}
            hits += [(w, False) for w in exact]
            if not exact:
                hits += [(w, True) for w, e in sorted(ends)[:1]]
        return tuple(hits)


EXTRA = ("exact", "fuzzy", "stems", "quoted", "addressed", "plain", "density", "any")


def features(lexicon: Lexicon, text: str | None) -> dict[int, float]:
    """Counts by column: the EXTRA ones first, then one for each lexicon entry."""
    lower = text.lower() if text else ""
    spans = WORD.findall(lower)
    find = lexicon.find
    hits = [(i, found) for i, found in enumerate(map(find, spans)) if found]
    out: dict[int, float] = defaultdict(float)
    if not hits:
        return out
    places = None
    for i, found in hits:
        for entry, fuzzy in found:
            out[len(EXTRA) + entry] += 1
            if lexicon.names[entry].endswith("-"):
                out[2] += 1
                continue
            out[1 if fuzzy else 0] += 1
            if places is None:
                places = [m.span() for m in WORD.finditer(lower)]
            near = spans[max(0, i - CONTEXT) : i] + spans[i + 1 : i + 1 + CONTEXT]
            around = lower[places[max(0, i - 1)][1] if i else 0 : places[i + 1][0] if i + 1 < len(places) else len(lower)]
            quoted = bool(QUOTES.search(around)) or not REPORTING.isdisjoint(near)
            out[3 if quoted else 4 if not ADDRESS.isdisjoint(near) else 5] += 1
    for k in list(out):
        out[k] = float(np.log1p(out[k]))
    out[6] = float(np.log1p(100 * sum(len(found) for _, found in hits) / len(spans)))
    out[7] = 1.0
    return out


def mine(sample: list[tuple[str, str, int]], most: int = MINED_TERMS) -> tuple[list[str], list[str]]:
    """Words and stems that speak for toxic documents: the largest log-likelihood ratios, of distinct texts."""
    toxic, clean = Counter(), Counter()
    n = [0, 0]
    for text, y in {t.lower(): y for _, t, y in sample}.items():
        words = set(WORD.findall(text))
        own = {w for w in words if len(w) >= 4} | {w[:k] + "-" for w in words for k in STEM_LENGTHS if len(w) > k}
        (toxic if y else clean).update(own)
        n[y] += 1
    if not n[0] or not n[1]:
        return list(TERMS), []
    scored = []
    for x, a in toxic.items():
        b = clean[x]
        if a < 5 or a / n[1] < 4 * b / n[0]:
            continue
        rest = np.array([a, b, n[1] - a, n[0] - b], float)
        expected = np.array([(a + b) * n[1], (a + b) * n[0], (n[1] + n[0] - a - b) * n[1], (n[1] + n[0] - a - b) * n[0]], float) / (n[0] + n[1])
        scored.append((2 * float((rest * np.log(np.maximum(rest, 1e-9) / np.maximum(expected, 1e-9))).sum()), x))
    best = [x for score, x in sorted(scored, key=lambda s: (-s[0], s[1]))[:most] if score > 12]
    return [*TERMS, *[x for x in best if not x.endswith("-") and x not in TERMS]], [x[:-1] for x in best if x.endswith("-")]


def learn(sample: list[tuple[str, str, int]], most: int = MINED_TERMS) -> tuple[list[str], list[str], np.ndarray, float]:
    """Terms, stems, weights of the feature columns and bias. Without labels of both kinds, exact hits alone decide."""
    terms, stems = mine(sample, most)
    lexicon = Lexicon(terms, stems)
    width = len(EXTRA) + len(lexicon.names)
    y = np.array([r[2] for r in sample], float)
    if not len(y) or y.min() == y.max():
        weights = np.zeros(width)
        weights[0] = 4.0
        return terms, stems, weights, -2.0
    rows, cols, values = [], [], []
    for i, (_, text, _) in enumerate(sample):
        for col, value in features(lexicon, text).items():
            rows.append(i)
            cols.append(col)
            values.append(value)
    weights, bias = _logistic.fit(np.array(rows, np.int64), np.array(cols, np.int64), np.array(values), y, width, penalty=2e-4, rounds=300, rate=0.1)
    return terms, stems, weights, bias


def held_out(id_column: str, parts: int = 5) -> Column:
    """Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == 0, F.lit(False))


_kept: dict[tuple, Lexicon] = {}


def kept_lexicon(terms: list[str], stems: list[str]) -> Lexicon:
    key = (*terms, "", *stems)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Lexicon(terms, stems)
    return _kept[key]


def toxicity(frame: DataFrame, model: tuple[list[str], list[str], np.ndarray, float], id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: the id, score, predicted, and the counts n_exact, n_fuzzy and n_quoted of lexicon terms."""
    small_batches(frame.sparkSession)
    held = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, stems, weights, bias = held.value
        lexicon = kept_lexicon(terms, stems)
        for batch in batches:
            made = [features(lexicon, x) for x in batch.column(1).to_pylist()]
            margin = np.array([bias + sum(weights[k] * v for k, v in x.items()) for x in made], float)
            score = _logistic.sigmoid(margin)
            counts = [pa.array([round(np.expm1(x.get(k, 0.0))) for x in made], pa.int64()) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *counts], names=["id", "score", "predicted", "n_exact", "n_fuzzy", "n_quoted"])

    kind = frame.schema[id_column].dataType.simpleString()
    texts = frame.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {kind}, score double, predicted int, n_exact long, n_fuzzy long, n_quoted long").withColumnRenamed("id", id_column)
