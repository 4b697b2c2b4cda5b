"""Exact null distributions. Arrow-batched helpers over one row per test (not per draw)."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from drawstat.settings import Game


def overlap_masses(game: Game) -> np.ndarray:
    rest, total = game.pool - game.pick, comb(game.pool, game.pick)
    return np.array([comb(game.pick, k) * comb(rest, game.pick - k) / total for k in range(game.pick + 1)])


def total_hits_pmf(game: Game, trials: int) -> tuple[int, np.ndarray]:
    """Offset and masses of the sum of ``trials`` independent overlaps, by repeated squaring.
    Ends that underflow to zero are trimmed, so the work grows with the spread, not the support."""
    offset, power = 0, np.array([1.0])
    base_offset, base = 0, overlap_masses(game)
    while trials:
        if trials & 1:
            offset, power = _trim(offset + base_offset, np.convolve(power, base))
        trials >>= 1
        if trials:
            base_offset, base = _trim(2 * base_offset, np.convolve(base, base))
    return offset, power


def _trim(offset: int, masses: np.ndarray) -> tuple[int, np.ndarray]:
    positive = np.flatnonzero(masses)
    return offset + int(positive[0]), masses[positive[0] : positive[-1] + 1]


def null_pmf(trials: Column, game: Game) -> Column:
    """``struct(first_total, masses)`` of the total hits over ``trials`` draws."""

    @F.pandas_udf("first_total bigint, masses array<double>")
    def pmf(n: pd.Series) -> pd.DataFrame:
        table = {t: total_hits_pmf(game, int(t)) for t in n.unique()}
        return pd.DataFrame({"first_total": [table[t][0] for t in n], "masses": [table[t][1] for t in n]})

    return pmf(trials)


def hit_tails(trials: Column, observed: Column, game: Game) -> Column:
    """``struct(lower_p, upper_p, two_sided_p)`` of an observed total; two-sided doubles the smaller tail."""

    @F.pandas_udf("lower_p double, upper_p double, two_sided_p double")
    def tails(n: pd.Series, seen: pd.Series) -> pd.DataFrame:
        table = {t: total_hits_pmf(game, int(t)) for t in n.unique()}
        rows = []
        for t, s in zip(n, seen):
            first, masses = table[t]
            cut = int(s) - first
            lower = float(masses[: max(cut + 1, 0)].sum())
            upper = float(masses[max(cut, 0) :].sum())
            rows.append((lower, upper, min(1.0, 2 * min(lower, upper))))
        return pd.DataFrame(rows, columns=["lower_p", "upper_p", "two_sided_p"])

    return tails(trials, observed)


def binomial_two_sided(successes: Column, trials: Column, probability: Column) -> Column:
    """Sum of all binomial masses not above the observed one (relative tolerance 1e-12).
    Masses are built as running log ratios, so long series do not underflow."""

    @F.pandas_udf("double")
    def p_value(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for seen, total, prob in zip(k, n, p):
            j = np.arange(int(total))
            ratios = np.log((total - j) / (j + 1)) + np.log(prob / (1 - prob))
            logs = total * np.log1p(-prob) + np.concatenate(([0.0], np.cumsum(ratios)))
            kept = logs <= logs[int(seen)] + np.log1p(1e-12)
            out.append(min(1.0, float(np.exp(logs[kept]).sum())))
        return pd.Series(out)

    return p_value(successes, trials, probability)
