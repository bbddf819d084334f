"""Shapley values of scorers that don't add up, against backgrounds of many rows.

The worth of a coalition is the mean score of rows whose coalition's coordinates are the explained row's and whose
others are a background row's. Small and large coalitions are enumerated together, size by size, for as long as the
budget covers their share of the kernel's weight; the rest is drawn in pairs of complements. With a budget of all
2^n - 2 coalitions values are exact. One design and one solution matrix serve all rows of a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.operators.networks import in_blocks, known_rows, stacked, targets

MOST_COALITIONS, MOST_BACKGROUND = 1 << 16, 1_000

Scorer = Callable[[np.ndarray], np.ndarray]


def design(players: int, budget: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions (rows of flags, neither empty nor full) and their kernel weights, which sum to 1."""
    if not 2 <= budget <= MOST_COALITIONS:
        raise ValueError(f"a budget lies between 2 and {MOST_COALITIONS}")
    if players < 2:
        return np.zeros((0, players), bool), np.zeros(0)
    half = range(1, players // 2 + 1)
    twin = {s: 1 if 2 * s == players else 2 for s in half}
    mass = {s: twin[s] / (s * (players - s)) for s in half}
    count = {s: twin[s] * math.comb(players, s) for s in half}
    everything, masks, weights, left, open_sizes = sum(count.values()) <= budget, [], [], budget, list(half)
    while open_sizes:
        s = open_sizes[0]
        if not everything and count[s] > left * mass[s] / sum(mass[o] for o in open_sizes):
            break
        rows = np.zeros((math.comb(players, s), players), bool)
        for row, members in zip(rows, combinations(range(players), s), strict=True):
            row[list(members)] = True
        for part in (rows, ~rows)[: twin[s]]:
            masks.append(part)
            weights.append(np.full(len(part), mass[s] / count[s]))
        left -= count[s]
        open_sizes.pop(0)
    if open_sizes and left >= 2:
        rng, share = np.random.default_rng(seed), np.array([mass[s] for s in open_sizes])
        sizes = rng.choice(open_sizes, size=left // 2, p=share / share.sum())
        # members of a draw are the players with the smallest random numbers
        rows = rng.random((len(sizes), players)).argsort(1).argsort(1) < sizes[:, None]
        drawn, times = np.unique(np.concatenate([rows, ~rows]), axis=0, return_counts=True)
        masks.append(drawn)
        weights.append(times * share.sum() / times.sum())
    made = np.concatenate(weights)
    return np.concatenate(masks), made / made.sum()


def solution(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix from worths, less the last player's share of the total, to the values of all players but the last."""
    root = np.sqrt(weights)
    return np.linalg.pinv((masks[:, :-1].astype(float) - masks[:, -1:]) * root[:, None]) * root


class Explainer:
    """Values of rows against a background (rows x width) with row weights; players are groups of coordinates."""

    def __init__(self, scorer: Scorer, width: int, groups: list[int] | None = None, budget: int | None = None, seed: int = 42):
        group = np.arange(width) if groups is None else np.asarray(groups)
        names, self.player = np.unique(group, return_inverse=True)
        if len(group) != width:
            raise ValueError("one group for each coordinate")
        self.scorer, self.width, self.players = scorer, width, len(names)
        self.masks, weights = design(self.players, budget or min(2 * self.players + 2_048, MOST_COALITIONS), seed)
        self.cells = self.masks[:, self.player]
        self.solve = solution(self.masks, weights) if len(self.masks) else None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Always two axes; scores that aren't finite are an error."""
        made = np.asarray(self.scorer(rows), float)
        made = made[:, None] if made.ndim == 1 else made
        if len(made) != len(rows) or not np.isfinite(made).all():
            raise ValueError("scores that are not one finite row each")
        return made

    def values(self, x: np.ndarray, background: np.ndarray) -> np.ndarray:
        """players x outputs of one row."""
        base, full = self.scores(background).mean(0), self.scores(x[None])[0]
        if self.players == 1:
            return (full - base)[None]
        worth = np.empty((len(self.masks), len(full)))
        for s in in_blocks(len(self.masks), len(background) * self.width):
            rows = np.where(self.cells[s, None, :], x, background[None])
            worth[s] = self.scores(rows.reshape(-1, self.width)).reshape(len(rows), len(background), -1).mean(1)
        most = self.solve @ (worth - base - self.masks[:, -1:] * (full - base))
        return np.concatenate([most, (full - base - most.sum(0))[None]])


def shapley_values(scorer: Scorer, width: int, x: Column, background: np.ndarray | Column, target: Column | None = None, groups: list[int] | None = None, budget: int | None = None, seed: int = 42) -> Column:
    """Values of each player, in order of their groups' names, for the target's output (without a target: the last one).

    ``scorer`` takes rows and gives one score each, or one for each output; one score p of two classes is p or 1 - p by
    target. ``background`` is a matrix of at most MOST_BACKGROUND rows, or a column with each row's own reference. Nulls
    in x, target or reference give null; rows of another width are an error.
    """
    fixed = None if isinstance(background, Column) else np.atleast_2d(np.asarray(background, float))
    if fixed is not None and (fixed.shape[1] != width or not 1 <= len(fixed) <= MOST_BACKGROUND):
        raise ValueError(f"a background has 1 to {MOST_BACKGROUND} rows of {width} values")

    aimed, own = target is not None, fixed is None  # tasks get no columns

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        explainer = Explainer(scorer, width, groups, budget, seed)
        for xs, ts, rs in batches:
            out, at = [None] * len(xs), known_rows(xs, ts, rs)
            rows = stacked(xs.iloc[at], width)
            refs = stacked(rs.iloc[at], width) if own else None
            for n, i in enumerate(at):
                made = explainer.values(rows[n], refs[n : n + 1] if own else fixed)
                if not aimed:
                    out[i] = made[:, -1]
                else:
                    t = int(targets(ts.iloc[i : i + 1], made.shape[1])[0])
                    out[i] = made[:, t] if made.shape[1] > 1 else made[:, 0] * (1 if t == 1 else -1)
            yield pd.Series(out, dtype=object)

    return run(x, target.cast("long") if aimed else F.lit(0).cast("long"), background if own else x)
