"""Monte Carlo null distributions over whole simulated series.

A row is a block of replicas of one series, and the blocks are spread over the cluster. A block is simulated
together, one draw at a time, so memory is (replicas in a block) x pool whatever the series length, and only
one statistic row per replica leaves the task. Replica streams depend on (seed, replica) alone: a lost task
recomputes the same values, and neither block size nor partitioning changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawstat.functions.prng import uniforms_at, xorshift_starts, xorshift_step
from drawstat.operators.draws import spread
from drawstat.settings import AUDIT_SEED, PAIR_SEED_MASK, VERIFY_SEED_MASK, Game

_REPLICAS = 1250  # wide enough for array operations, small enough to share out
_BLOCK = 64
Draw = Callable[[], np.ndarray]


def replica_blocks(sizes: DataFrame, count: int) -> DataFrame:
    """(series, draws, observed) -> one row per series and block of replicas. The observed statistic travels
    along, so comparing it needs no second pass over the data."""
    firsts = F.explode(F.sequence(F.lit(0), F.lit(count - 1), F.lit(_REPLICAS))).alias("first")
    return spread(sizes.select("series", "draws", "observed", firsts), "series", "first", per_slot=4)


def _simulate(sizes: DataFrame, count: int, columns: str, statistic: Callable[[int, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.arange(row.first, min(row.first + _REPLICAS, count))
                yield pd.DataFrame({"series": row.series, "observed": row.observed, "replica": ids, **statistic(row.draws, ids)})

    return replica_blocks(sizes, count).mapInPandas(run, f"series string, observed double, replica int, {columns}")


# ------------------------------------------------------------------ samplers


def floyd_draws(uniform: Draw, size: int, game: Game) -> Iterator[np.ndarray]:
    """Endless draws of ``pick`` distinct zero-based numbers (pick x replicas), ``pick`` uniforms each."""
    while True:
        picks = np.empty((game.pick, size), dtype=np.int32)
        for j, top in enumerate(range(game.pool - game.pick, game.pool)):
            candidate = (uniform() * (top + 1)).astype(np.int32)
            taken = (picks[:j] == candidate).any(axis=0)
            picks[j] = np.where(taken, top, candidate)
        yield picks


def xorshift_uniform(seed: int, ids: np.ndarray, outputs: int) -> Draw:
    """Uniforms of one long xorshift stream, replica r starting after r * ``outputs`` values."""
    state = xorshift_starts(seed, ids, outputs)

    def draw() -> np.ndarray:
        nonlocal state
        state = xorshift_step(state)
        return state / 4294967296.0

    return draw


def counter_uniform(seed: int, starts: np.ndarray) -> Draw:
    """Uniforms of the counter stream from given positions on, computed ``_BLOCK`` steps at a time."""
    def rows() -> Iterator[np.ndarray]:
        positions = starts.astype(np.uint64) + np.arange(_BLOCK, dtype=np.uint64)[:, None]
        while True:
            yield from uniforms_at(seed, positions)
            positions = positions + np.uint64(_BLOCK)

    return rows().__next__


def rejection_counts(draws: int, uniform: Draw, size: int, game: Game) -> np.ndarray:
    """Occurrence counts when a repeated number inside a draw is drawn again. Replicas advance on their own:
    one output per replica and step, until every replica has all its draws."""
    counts = np.zeros((size, game.pool), dtype=np.int32)
    last_draw = np.full(size * game.pool, -1, dtype=np.int32)
    accepted = np.zeros(size, dtype=np.int32)
    lanes = np.arange(size) * game.pool
    wanted = draws * game.pick
    while True:
        open_lanes = accepted < wanted
        if not open_lanes.any():
            return counts
        number = (uniform() * game.pool).astype(np.int64)
        cell = lanes + number
        current = accepted // game.pick
        fresh = open_lanes & (last_draw[cell] != current)
        chosen = cell[fresh]
        last_draw[chosen] = current[fresh]
        counts.ravel()[chosen] += 1
        accepted += fresh


# ---------------------------------------------------------------- statistics


def _uniformity(counts: np.ndarray, draws: int, game: Game) -> dict[str, np.ndarray]:
    expected = draws * game.pick / game.pool
    gap = counts - expected
    return {"pearson": (gap * gap / expected).sum(axis=1), "max_deviation": np.abs(gap).max(axis=1)}


def pearson_null(sizes: DataFrame, game: Game, count: int, seed: int = AUDIT_SEED) -> DataFrame:
    """Pearson statistic and largest deviation per replica, rejection sampler on the counter generator.
    Replicas own disjoint stretches of the 2**32 stream positions."""
    stretch = 2**32 // count

    def statistic(draws: int, ids: np.ndarray) -> dict[str, np.ndarray]:
        uniform = counter_uniform(seed, ids.astype(np.uint64) * np.uint64(stretch))
        return _uniformity(rejection_counts(draws, uniform, len(ids), game), draws, game)

    return _simulate(sizes, count, "pearson double, max_deviation double", statistic)


def pearson_null_verification(sizes: DataFrame, game: Game, count: int, seed: int = AUDIT_SEED ^ VERIFY_SEED_MASK) -> DataFrame:
    """The same statistics from an independent generator and Floyd's sampler."""

    def statistic(draws: int, ids: np.ndarray) -> dict[str, np.ndarray]:
        source = floyd_draws(xorshift_uniform(seed, ids, draws * game.pick), len(ids), game)
        counts = np.zeros(len(ids) * game.pool, dtype=np.int64)
        lanes = np.arange(len(ids)) * game.pool
        for first in range(0, draws, _BLOCK):
            block = np.stack([next(source) for _ in range(first, min(first + _BLOCK, draws))])
            counts += np.bincount((block + lanes).ravel(), minlength=len(counts))
        return _uniformity(counts.reshape(len(ids), game.pool), draws, game)

    return _simulate(sizes, count, "pearson double, max_deviation double", statistic)


def pair_max_null(sizes: DataFrame, game: Game, count: int, seed: int = AUDIT_SEED ^ PAIR_SEED_MASK) -> DataFrame:
    """Largest pair count of each simulated series: the selection-adjusted null of the strongest pair."""
    pairs = list(combinations(range(game.pick), 2))

    def statistic(draws: int, ids: np.ndarray) -> dict[str, np.ndarray]:
        source = floyd_draws(xorshift_uniform(seed, ids, draws * game.pick), len(ids), game)
        counts = np.zeros((len(ids), game.pool * game.pool), dtype=np.int32)
        cells, lanes = counts.ravel(), np.arange(len(ids)) * counts.shape[1]
        for _ in range(draws):
            picks = next(source)
            for a, b in pairs:
                cells[lanes + np.minimum(picks[a], picks[b]) * game.pool + np.maximum(picks[a], picks[b])] += 1
        return {"max_pair": counts.max(axis=1)}

    return _simulate(sizes, count, "max_pair int", statistic)


def archive_null(sizes: DataFrame, game: Game, count: int, seed: int, offset: int = 0) -> DataFrame:
    """Total hits of the fixed ticket 1..pick over simulated series; ``offset`` outputs were used before."""

    def statistic(draws: int, ids: np.ndarray) -> dict[str, np.ndarray]:
        starts = np.uint64(offset) + ids.astype(np.uint64) * np.uint64(draws * game.pick)
        source = floyd_draws(counter_uniform(seed, starts), len(ids), game)
        total = np.zeros(len(ids), dtype=np.int64)
        for _ in range(draws):
            total += (next(source) < game.pick).sum(axis=0)
        return {"total_hits": total}

    return _simulate(sizes, count, "total_hits bigint", statistic)
