"""Trailing-window counts and scores over the dense number grid.

Counts over the last W draws come from one running total per (series, number) and a lag of it, so a row
costs the same for every W. Counts among the draws of one bin are taken from position bitmaps (bitmaps.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawstat.functions.columns import horizon_z
from drawstat.operators.draws import spread
from drawstat.settings import Game


def trailing_counts(grid: DataFrame, windows: Sequence[int], keys: Sequence[str] = ("series",)) -> DataFrame:
    """Add ``count_W``: occurrences of the number in the W draws before the current one.

    The explicit shuffle by (keys, number) spreads a single hot series over all numbers; without it the
    windows would inherit the coarser partitioning by series."""
    grid = spread(grid, *keys, "number")
    by_number = Window.partitionBy(*keys, "number").orderBy("draw_idx")
    before = F.coalesce(F.sum("hit").over(by_number.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = grid.withColumn("seen_before", before)
    return counted.select("*", *[
        (F.col("seen_before") - F.lag("seen_before", w, 0).over(by_number)).alias(f"count_{w}") for w in windows
    ]).drop("seen_before")


def horizon_score(windows: Sequence[int], game: Game) -> Column:
    """Mean of the horizon z-scores, summed in window order so that equal scores stay equal."""
    score = F.lit(0.0)
    for w in windows:
        score = score + horizon_z(F.col(f"count_{w}"), w, game) / len(windows)
    return score
