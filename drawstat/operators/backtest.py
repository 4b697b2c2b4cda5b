"""No-look-ahead backtests. Every frame ends before the evaluated draw, so a whole backtest is one query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawstat.functions.columns import overlap, ticket_text
from drawstat.functions.exact import hit_tails
from drawstat.functions.prng import random_ticket
from drawstat.operators.bitmaps import binned_tickets
from drawstat.operators.draws import number_grid, with_next_draw
from drawstat.operators.stats import holm
from drawstat.operators.tickets import capped_tickets, require_full, with_hits
from drawstat.operators.windows import horizon_score, trailing_counts
from drawstat.settings import (AUDIT_SEED, BASELINE_WINDOW, BINNED_MODELS, FEATURES, HISTORY_WINDOW, HORIZONS,
                               SHRINKAGE_DRAWS, Game)

WALK_METHODS = ("integrated", "frequency52")


def horizon_scores(indexed: DataFrame, game: Game, windows: Sequence[int] = HORIZONS,
                   baseline: int = BASELINE_WINDOW) -> DataFrame:
    """Score columns ``integrated`` and ``frequency52`` for every draw and number."""
    grid = number_grid(indexed, game)
    counted = trailing_counts(grid, sorted({*windows, baseline}))
    return counted.select(*grid.columns, horizon_score(windows, game).alias("integrated"),
                          F.col(f"count_{baseline}").cast("double").alias("frequency52"))


def walk_forward(indexed: DataFrame, game: Game, warmup: int = HISTORY_WINDOW, seed: int = AUDIT_SEED,
                 include_next: bool = False) -> DataFrame:
    """Tickets and hits of the multi-horizon, trailing-52 and random methods for every draw after the warm-up.
    With ``include_next`` the draw not yet held is predicted too (NULL date, empty ``actual``)."""
    source = with_next_draw(indexed) if include_next else indexed
    scored = horizon_scores(source, game).filter(F.col("draw_idx") >= warmup)
    tickets = require_full(capped_tickets(scored, WALK_METHODS, game), "integrated", game)
    with_random = tickets.withColumn("random_ticket", random_ticket(seed, F.col("draw_idx") - warmup, game))
    return with_hits(with_random, (*WALK_METHODS, "random"))


def next_tickets(indexed: DataFrame, game: Game, warmup: int = HISTORY_WINDOW) -> DataFrame:
    """Tickets for the draw after the last one held. Only the last draws that any horizon reaches are kept."""
    reach = max(*HORIZONS, BASELINE_WINDOW)
    recent = with_next_draw(indexed).filter((F.col("draw_idx") >= F.col("n_draws") - reach) & (F.col("n_draws") >= warmup))
    scored = horizon_scores(recent, game).filter(F.col("draw_date").isNull())
    return capped_tickets(scored, WALK_METHODS, game).select(
        "series", "draw_idx", *[f"{m}_ticket" for m in WALK_METHODS])


# ------------------------------------------------------------ date-conditioned


def attach_features(indexed: DataFrame, features: DataFrame) -> DataFrame:
    """Feature bins of each draw's own date. ``features`` may be any table; the optimizer broadcasts it when its
    size allows and shuffles it otherwise."""
    return indexed.join(features, "draw_date")


def rotate_features(featured: DataFrame, shift: Column | int, names: Sequence[str] = FEATURES) -> DataFrame:
    """Give draw i the features of draw (i + shift) mod n of its series."""
    shift_col = F.lit(shift) if isinstance(shift, int) else shift
    source = featured.select("series", F.col("draw_idx").alias("from_idx"), *names)
    moved = featured.drop(*names).withColumn("from_idx", F.pmod(F.col("draw_idx") + shift_col, F.col("n_draws")))
    return moved.join(source, ["series", "from_idx"]).drop("from_idx")


def binned_backtest(featured: DataFrame, game: Game, models: dict[str, tuple[str, ...]] = BINNED_MODELS,
                    window: int = HISTORY_WINDOW, prior: int = SHRINKAGE_DRAWS) -> DataFrame:
    """Tickets and hits of every model and of the trailing-frequency baseline (``frequency``)."""
    return with_hits(binned_tickets(featured, game, models, window, prior), (*models, "frequency"))


# --------------------------------------------------------------------- results


def long_rows(backtest: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per draw and method: the ticket, the drawn numbers and the hits."""
    per_method = F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(f"{m}_ticket").alias("ticket"), F.col(f"{m}_hits").alias("hits"))
        for m in methods])).alias("m")
    return backtest.select("series", "draw_idx", "draw_date", "actual", per_method).select(
        "series", "draw_idx", "draw_date", "actual", "m.method", "m.ticket", "m.hits")


def method_totals(backtest: DataFrame, methods: Sequence[str], game: Game, by_series: bool = True) -> DataFrame:
    """Total and mean hits per method against the expectation of a uniform draw. Sums are taken wide, one
    partial row per task and series, and turned long afterwards."""
    keys = ["series"] if by_series else []
    sums = backtest.groupBy(*keys).agg(F.count("*").alias("trials"), *[F.sum(f"{m}_hits").alias(m) for m in methods])
    long = sums.filter(F.col("trials") > 0).unpivot([*keys, "trials"], list(methods), "method", "total_hits")
    return long.select(*keys, "method", "trials", "total_hits", (F.col("total_hits") / F.col("trials")).alias("mean_hits"),
                       (F.col("trials") * game.expected_hits).alias("expected_hits"))


def method_tests(totals: DataFrame, game: Game, families: Sequence[str] = ("series",)) -> DataFrame:
    """Exact tails of each total under the hypergeometric null, Holm-corrected over a family's upper tails."""
    tested = totals.withColumn("tails", hit_tails(F.col("trials"), F.col("total_hits"), game)).select(
        *totals.columns, "tails.lower_p", "tails.upper_p", "tails.two_sided_p")
    return holm(tested, families, "upper_p", "holm_p")


def series_rollup(backtest: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Hits per method and series with subtotals per method and the grand total."""
    return long_rows(backtest, methods).rollup("method", "series").agg(
        F.count("*").alias("trials"), F.sum("hits").alias("total_hits"))


def last_predictions(backtest: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The prediction made for the last draw already observed, per series and method."""
    latest = backtest.groupBy("series").agg(F.max_by(
        F.struct("draw_idx", "draw_date", *[f"{m}_ticket" for m in methods]), "draw_idx").alias("last"))
    per_method = F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), ticket_text(F.col(f"last.{m}_ticket")).alias("ticket")) for m in methods]))
    return latest.select("series", F.col("last.draw_date").alias("draw_date"), per_method.alias("m")).select(
        "series", "draw_date", "m.method", "m.ticket")


def match_saved(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """Saved tickets (method, series, ticket) against drawn numbers (series, numbers): hits in ticket order,
    their count and the method's total."""
    matched = predictions.join(actual, "series").withColumn("hits", F.array_intersect("ticket", "numbers")).withColumn(
        "hit_count", F.size("hits"))
    return matched.withColumn("method_total", F.sum("hit_count").over(Window.partitionBy("method")))


def match_next(predictions: DataFrame, draws: DataFrame) -> DataFrame:
    """Saved tickets (series, method, saved_on, ticket) of any number of dates, each with the first draw after its date
    (draw_date, numbers) and its hits; NULL where no later draw is held.

    Both sides are laid into one order of time per series, the draws of a day before its tickets, and every ticket looks
    ahead to the next draw: one shuffle, whatever the number of dates."""
    tickets = predictions.select("series", F.col("saved_on").alias("at"), F.lit(1).alias("kind"), "method", "ticket")
    held = draws.select("series", F.col("draw_date").alias("at"), F.lit(0).alias("kind"), F.struct("draw_date", "numbers").alias("draw"))
    ahead = Window.partitionBy("series").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = tickets.unionByName(held, allowMissingColumns=True).withColumn("next", F.last("draw", ignorenulls=True).over(ahead))
    return both.filter("kind = 1").select("series", "method", F.col("at").alias("saved_on"), "ticket", "next.draw_date", "next.numbers").withColumn(
        "hit_count", F.when(F.col("draw_date").isNotNull(), overlap(F.col("ticket"), F.col("numbers"))))


def bonus_flags(tickets: DataFrame) -> DataFrame:
    """Hits of single-game tickets with bonus and superstar flags (ticket, numbers, bonus, superstar)."""
    return tickets.select("*", overlap(F.col("ticket"), F.col("numbers")).alias("hit_count"),
                          F.array_contains("ticket", F.col("bonus")).alias("bonus_hit"),
                          F.array_contains("ticket", F.col("superstar")).alias("superstar_hit"))
