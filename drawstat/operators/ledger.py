"""Batch form of the forward ledger.

A ledger starts after a known draw, scores every later draw with the tickets frozen before it, and stops
at its target. Because those tickets depend on earlier draws only, the whole ledger is one window query.
The rules for announcements (valid, known, consecutive, in order) are aggregates and joins on the date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.functions.columns import gross_return, net_profit, overlap, payout_status, prize_category
from drawstat.functions.prng import random_ticket
from drawstat.operators.backtest import horizon_scores
from drawstat.operators.draws import packed, unpacked, with_next_draw
from drawstat.operators.tickets import capped_tickets
from drawstat.settings import FORWARD_SEED, FORWARD_TARGET, HISTORY_WINDOW, Game

METHODS = ("integrated", "frequency52", "random")


def frozen_tickets(indexed: DataFrame, game: Game, start_idx: int, target: int | None = FORWARD_TARGET,
                   seed: int = FORWARD_SEED) -> DataFrame:
    """Tickets held before each ledger draw, the next one (NULL date) included. Draws that no horizon of the
    ledger reaches are left out before the grid is built. Without a target the ledger has no end."""
    reach = indexed.filter(F.col("draw_idx") >= start_idx - HISTORY_WINDOW)
    if target is not None:
        reach = reach.filter(F.col("draw_idx") < start_idx + target)
    extended = with_next_draw(reach)
    scored = horizon_scores(extended, game).filter(F.col("draw_idx") >= start_idx)
    tickets = capped_tickets(scored, METHODS[:2], game, carry=("draw_date", "bonus"))
    return tickets.withColumn("random_ticket", random_ticket(seed, F.col("draw_idx") - start_idx, game))


def ledger(indexed: DataFrame, game: Game, start_idx: int, target: int = FORWARD_TARGET, stake: int = 1,
           seed: int = FORWARD_SEED) -> DataFrame:
    """One row per processed draw and method: frozen ticket, hits, category, returns, counter and status.

    ``indexed`` carries ``bonus``; the contest number is the draw position plus one."""
    tickets = frozen_tickets(indexed, game, start_idx, target, seed).filter(F.col("draw_date").isNotNull())
    rows = tickets.select(
        "series", "draw_idx", "draw_date", "bonus", "actual",
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_ticket").alias("prediction")) for m in METHODS])).alias("m"))
    hits = overlap(F.col("prediction"), F.col("actual"))
    scored = rows.select("series", "draw_idx", "draw_date", "bonus", "actual", "m.*").withColumn("main_hits", hits)
    processed = F.col("draw_idx") - start_idx + 1
    return scored.select(
        "series", "draw_date", (F.col("draw_idx") + 1).alias("contest"), "method", "prediction", "actual", "bonus", "main_hits",
        prize_category(F.col("main_hits"), F.col("prediction"), F.col("bonus")).alias("category"),
        F.lit(stake).alias("stake"), gross_return(F.col("main_hits")).alias("gross_return"),
        net_profit(F.col("main_hits"), F.lit(stake)).alias("net_profit"), payout_status(F.col("main_hits")).alias("payout_status"),
        processed.alias("processed_draws"), status_after(processed, target).alias("status"))


def status_after(processed: Column, target: int | Column) -> Column:
    return F.when(processed >= target, F.lit("COMPLETE")).otherwise(F.lit("ACTIVE"))


def intake(announcements: DataFrame, keys: tuple[str, ...] = ("draw_date",)) -> DataFrame:
    """Outcome of repeated announcements per date: the first valid one is recorded, equal later ones change
    nothing, different ones are conflicts, invalid ones are refused.

    Equal announcements are counted before dates are compared, so a date announced millions of times is
    reduced to its few distinct contents ahead of the second shuffle. Given masks instead of arrays, both steps
    hash rows of fixed size and nothing is sorted."""
    masks = "numbers" not in announcements.columns
    content = packed(announcements).groupBy(*keys, "low", "high", "odd", "bonus", (F.size("violations") == 0).alias("valid")).agg(
        F.count("*").alias("n"), F.min("source_ord").alias("first_ord"))
    ord_of_valid = F.when(F.col("valid"), F.col("first_ord"))
    carried = ["low", "high", "bonus", "n", *([] if masks else ["odd"])]
    summary = content.groupBy(*keys).agg(
        *[F.min_by(c, ord_of_valid).alias(c) for c in carried], F.min(ord_of_valid).alias("first_ord"),
        F.sum("n").alias("announced"), F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)).alias("n_valid"))
    numbers = F.when(F.col("first_ord").isNotNull(), unpacked(F.col("low"), F.col("high")))
    if not masks:
        numbers = F.coalesce("odd", numbers)
    return summary.select(
        *keys, numbers.alias("numbers"), "bonus", "first_ord", "announced",
        (F.col("announced") - F.col("n_valid")).alias("refused"),
        F.coalesce(F.col("n") - 1, F.lit(0)).alias("repeated"),
        F.coalesce(F.col("n_valid") - F.col("n"), F.lit(0)).alias("conflicting"))
