"""Circular-shift replicates of the date-conditioned backtest.

A replicate turns the features of a series against its draws and repeats the backtest. The bins of all positions
are cut out of the bitmaps once, and a replicate only reads them at another position.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.functions.prng import uniforms_at
from drawstat.operators.bitmaps import shifted_hits
from drawstat.settings import BINNED_MODELS, HISTORY_WINDOW, SHIFT_SEED, SHRINKAGE_DRAWS, Game
from drawstat.streaming.storage import stored


def shift_list(n_draws: Column, replicates: int, seed: int = SHIFT_SEED, distinct: bool = True) -> Column:
    """``replicates`` shifts in 1..n-1 in stream order; with ``distinct`` repeated values are drawn again. A series too
    short for that many has none, which leaves the other series as they are."""

    @F.pandas_udf("array<int>")
    def shifts(sizes: pd.Series) -> pd.Series:
        @cache
        def draw(n: int) -> list[int]:
            if n < 2 or (distinct and n - 1 < replicates):
                return []
            found: dict[int, None] = {}
            kept: list[int] = []
            position = 0
            while len(kept) < replicates:
                batch = 1 + np.floor(uniforms_at(seed, np.arange(position, position + replicates)) * (n - 1)).astype(int)
                position += replicates
                for s in batch.tolist():
                    if len(kept) < replicates and not (distinct and s in found):
                        found[s] = None
                        kept.append(s)
            return kept

        return sizes.map(draw)

    return shifts(n_draws)


def replicates_of(indexed: DataFrame, replicates: int, seed: int = SHIFT_SEED, distinct: bool = True) -> DataFrame:
    """(series, replicate, shift); replicate 0 is the observed backtest, shift 0."""
    lengths = indexed.groupBy("series").agg(F.max("n_draws").alias("n_draws"))
    shifts = F.concat(F.array(F.lit(0)), shift_list(F.col("n_draws"), replicates, seed, distinct))
    return lengths.select("series", F.posexplode(shifts).alias("replicate", "shift"))


def shifted_totals(featured: DataFrame, game: Game, replicates: int, seed: int = SHIFT_SEED, distinct: bool = True,
                   models: dict[str, tuple[str, ...]] = BINNED_MODELS, window: int = HISTORY_WINDOW,
                   prior: int = SHRINKAGE_DRAWS) -> DataFrame:
    """Tested draws and total hits per series, replicate, shift and model. Shift 0 is the observed backtest and comes as
    replicate 0, so observed and shifted totals share one evaluation."""
    features = tuple(dict.fromkeys(f for names in models.values() for f in names))
    featured = stored(featured.select("series", "draw_idx", "n_draws", "draw_date", "numbers", *features), "featured-draws")
    return shifted_hits(featured, replicates_of(featured, replicates, seed, distinct), game, models, window, prior)
