"""Capped top-k selection: best scores first, at most ``cap`` numbers per decade, sorted ticket.

Taking the best ``cap`` of every decade and then the best ``pick`` of those gives the same set as choosing
greedily, because a number skipped for a full decade is never needed later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.functions.columns import decade_of, overlap
from drawstat.operators.draws import spread
from drawstat.settings import Game


def capped_tickets(scored: DataFrame, methods: Sequence[str], game: Game, keys: Sequence[str] = ("series", "draw_idx"),
                   carry: Sequence[str] = ("draw_date",)) -> DataFrame:
    """One row per key with ``<method>_ticket`` for every score column and the drawn numbers as ``actual``.

    The rows are shuffled once by ``keys``. Decades (at most ten rows) and then whole draws (at most 27
    candidates per method) are collected on that partitioning, for all methods together."""
    def ordered(method: str) -> Column:
        return F.sort_array(F.collect_list(F.struct((-F.col(method)).alias("cost"), "number")))

    decades = spread(scored, *keys).groupBy(*keys, decade_of(F.col("number"), game).alias("decade")).agg(
        F.collect_list(F.when(F.col("hit") == 1, F.col("number"))).alias("drawn"),
        *[F.slice(ordered(m), 1, game.cap).alias(f"pool_{m}") for m in methods],
        *[F.first(c).alias(c) for c in carry])
    draws = decades.groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("drawn"))).alias("actual"),
        *[F.flatten(F.collect_list(f"pool_{m}")).alias(f"pool_{m}") for m in methods],
        *[F.first(c).alias(c) for c in carry])
    return draws.select(*keys, *carry, "actual", *[_best(F.col(f"pool_{m}"), game).alias(f"{m}_ticket") for m in methods])


def _best(pool: Column, game: Game) -> Column:
    return F.array_sort(F.slice(F.sort_array(pool), 1, game.pick)["number"])


def with_hits(tickets: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Add ``<method>_hits`` for tickets already on the row."""
    return tickets.select("*", *[overlap(F.col(f"{m}_ticket"), F.col("actual")).alias(f"{m}_hits") for m in methods])


def require_full(tickets: DataFrame, method: str, game: Game) -> DataFrame:
    """Raise inside the job when the cap leaves fewer than ``pick`` numbers."""
    column = F.col(f"{method}_ticket")
    return tickets.withColumn(f"{method}_ticket", F.when(F.size(column) == game.pick, column).otherwise(
        F.raise_error(F.lit("no ticket satisfies the cap"))))
