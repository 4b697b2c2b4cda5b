"""Whole experiments: from validated draws to one result document per series, ready for a JSON sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.functions import sky
from drawstat.functions.columns import chi_square_tail
from drawstat.operators import backtest as bt
from drawstat.operators import frequency as fq
from drawstat.operators import montecarlo as mc
from drawstat.operators.draws import (coverage, dedup_by_date, require_coverage, require_no_conflict, require_valid,
                                      with_index, with_violations)
from drawstat.operators.shifts import shift_list, shifted_totals
from drawstat.operators.stats import holm
from drawstat.settings import (BINNED_MODELS, HISTORY_WINDOW, NULL_REPLICATES, SHIFT_REPLICATES, SHIFT_SEED,
                               SHRINKAGE_DRAWS, SINGLE_GAME, Game)

BINNED_METHODS = (*BINNED_MODELS, "frequency")


def prepared(raw: DataFrame, game: Game = SINGLE_GAME, keep: str = "first", series: str = "all", bonus_required: bool = True, **recorded) -> DataFrame:
    """Validate, deduplicate, check coverage against recorded values and index raw archive rows. Unless ``bonus_required``
    an empty bonus is valid; one that is there must be valid in any case."""
    checked = with_violations(raw, game, "date_text" if "date_text" in raw.columns else None, "bonus" in raw.columns)
    if not bonus_required and "bonus" in raw.columns:
        checked = checked.withColumn("violations", F.when(F.col("bonus").isNull(), F.array_remove("violations", "bonus")).otherwise(F.col("violations")))
    valid = require_valid(checked)
    compare = ("numbers", "bonus") if "bonus" in raw.columns else ("numbers",)
    unique = dedup_by_date(valid, keep, compare)
    require_coverage(coverage(unique), **recorded)
    named = require_no_conflict(unique).withColumn("series", F.when(F.col("draw_date").isNotNull(), F.lit(series)))
    return with_index(named)


def sizes_of(indexed: DataFrame, skip: int = 0) -> DataFrame:
    """(series, draws, observed): simulated series have the length of the observed ones; nothing observed yet."""
    return indexed.groupBy("series").agg((F.count("*") - skip).cast("int").alias("draws"), F.lit(0.0).alias("observed"))


def fit_sizes(indexed: DataFrame, game: Game) -> DataFrame:
    """Series length with the observed Pearson statistic, from one pass over the draws."""
    fit = fq.uniformity(fq.number_counts(indexed, game))
    return fit.select("series", (F.col("n_numbers") / game.pick).cast("int").alias("draws"), F.col("pearson").alias("observed"))


def pair_sizes(indexed: DataFrame, game: Game) -> DataFrame:
    """Series length with the observed largest pair count, from one pass over the draws."""
    return fq.pair_summary(indexed, game).select("series", F.col("draws").cast("int").alias("draws"),
                                                 F.col("max_pair_count").cast("double").alias("observed"))


def null_summary(null: DataFrame, value: str) -> DataFrame:
    """Quantiles of a replicate statistic and the empirical tails of the observed one, per series.

    The simulation is read once: the replicates of a series, whose number is a parameter, become one sorted
    array, and quantiles and tails are looked up in it."""
    gathered = null.groupBy("series", "observed").agg(F.sort_array(F.collect_list(value)).alias("sorted"))
    n = F.size("sorted")

    def quantile(p: float) -> Column:
        return F.get("sorted", F.floor((n - 1) * p).cast("int"))

    lower = (F.size(F.filter("sorted", lambda v: v <= F.col("observed") + 1e-12)) + 1) / (n + 1)
    upper = (F.size(F.filter("sorted", lambda v: v >= F.col("observed") - 1e-12)) + 1) / (n + 1)
    return gathered.select("series", "observed", n.alias("replicates"), lower.alias("lower_p"), upper.alias("upper_p"),
                           F.least(F.lit(1.0), 2 * F.least(lower, upper)).alias("two_sided_p"),
                           quantile(0.05).alias("p05"), quantile(0.5).alias("median"), quantile(0.95).alias("p95"))


def audit_tests(indexed: DataFrame, game: Game = SINGLE_GAME) -> DataFrame:
    """The marginal test (approximate chi-square tail) and the serial test (exact) of a series with Holm correction."""
    fit = fq.uniformity(fq.number_counts(indexed, game))
    marginal = fit.select("series", F.lit("marginal_frequency").alias("test"), F.col("pearson").alias("statistic"),
                          chi_square_tail(F.col("pearson"), game.pool - 1).alias("raw_p"))
    serial = fq.serial_test(indexed, game).select(
        "series", F.lit("serial_overlap").alias("test"), F.col("pairs_at_least_two").cast("double").alias("statistic"), "raw_p")
    return holm(marginal.unionByName(serial), ["series"])


def binned_tests(indexed: DataFrame, game: Game = SINGLE_GAME, replicates: int = SHIFT_REPLICATES, seed: int = SHIFT_SEED,
                 distinct: bool = True, pooled: bool = False, models: dict[str, tuple[str, ...]] = BINNED_MODELS,
                 window: int = HISTORY_WINDOW, prior: int = SHRINKAGE_DRAWS, features: DataFrame | None = None) -> DataFrame:
    """Exact and circular-shift upper p of every date-conditioned model, Holm-corrected together.

    ``pooled`` adds the series of a replicate up before testing; otherwise each series is its own family.
    Observed totals are replicate 0 of the same evaluation, so the backtest runs once."""
    featured = bt.attach_features(indexed, sky.date_bins(indexed) if features is None else features)
    keys = ["model"] if pooled else ["series", "model"]
    totals = shifted_totals(featured, game, replicates, seed, distinct, models, window, prior)
    totals = totals.groupBy(*keys, "replicate").agg(F.sum("trials").alias("trials"), F.sum("total_hits").alias("total_hits"))
    # one small array of replicate totals per model, bounded by the number of replicates
    grouped = totals.groupBy(*keys).agg(
        F.max("trials").alias("trials"), F.max(F.when(F.col("replicate") == 0, F.col("total_hits"))).alias("total_hits"),
        F.collect_list(F.when(F.col("replicate") > 0, F.col("total_hits"))).alias("shifted"))
    at_least = F.size(F.filter("shifted", lambda t: t >= F.col("total_hits")))
    # without shifts, in a series too short for them, there is no empirical p
    shift_p = F.when(F.size("shifted") > 0, (1 + at_least) / (F.size("shifted") + 1))
    counted = grouped.filter(F.col("trials") > 0).withColumn("shift_p", shift_p)
    tested = counted.withColumn("tails", bt.hit_tails(F.col("trials"), F.col("total_hits"), game))
    tests = tested.select(*keys, "trials", "total_hits", F.explode(F.array(
        F.struct(F.lit("exact_uniform_upper").alias("test"), F.col("tails.upper_p").alias("raw_p")),
        F.struct(F.lit("circular_shift_upper").alias("test"), F.col("shift_p").alias("raw_p")))).alias("t")).select(
        *keys, "trials", "total_hits", "t.*").filter("raw_p IS NOT NULL")
    return holm(tests, [] if pooled else ["series"])


def archive_null_summary(indexed: DataFrame, game: Game = SINGLE_GAME, replicates: int = NULL_REPLICATES, seed: int = SHIFT_SEED,
                         window: int = HISTORY_WINDOW) -> DataFrame:
    """Mean and 5-95 % band of total hits over simulated series."""
    null = mc.archive_null(sizes_of(indexed, window), game, replicates, seed, offset=SHIFT_REPLICATES)
    gathered = null.groupBy("series").agg(F.sort_array(F.collect_list("total_hits")).alias("sorted"), F.avg("total_hits").alias("mean"))
    n = F.size("sorted")

    def quantile(p: float) -> Column:
        return F.get("sorted", F.floor(n * p).cast("int"))

    return gathered.select("series", n.alias("replicates"), F.col("mean").alias("mean_total_hits"),
                           quantile(0.05).alias("p05"), quantile(0.95).alias("p95"))


def walk_forward_document(indexed: DataFrame, game: Game = SINGLE_GAME, warmup: int = HISTORY_WINDOW) -> DataFrame:
    """Coverage, evaluation, model, methods, next ticket and rows of the walk-forward experiment, one document
    per series. ``rows`` holds one entry per draw, bounded by the calendar."""
    methods = (*bt.WALK_METHODS, "random")
    rows = bt.walk_forward(indexed, game, warmup)
    tested = bt.method_tests(bt.method_totals(rows, methods, game), game)
    by_series = tested.groupBy("series").agg(F.sort_array(F.collect_list(F.struct(
        "method", "total_hits", "mean_hits", "expected_hits", "lower_p", "upper_p", "two_sided_p", "holm_p"))).alias("methods"))
    listed = rows.groupBy("series").agg(F.sort_array(F.collect_list(F.struct(
        F.col("draw_date").alias("date"), *[c for m in methods for c in (f"{m}_ticket", f"{m}_hits")], "actual"))).alias("rows"),
        F.struct(F.count("*").alias("testedDraws"), F.min("draw_date").alias("firstTestDate"),
                 F.max("draw_date").alias("lastTestDate")).alias("evaluation"))
    covered = indexed.groupBy("series").agg(F.struct(F.min("draw_date").alias("firstDate"), F.max("draw_date").alias("lastDate"),
                                                     F.count("*").alias("draws")).alias("coverage"))
    upcoming = bt.next_tickets(indexed, game, warmup).select("series", F.col("integrated_ticket").alias("nextPrediction"))
    model = F.struct(F.array(*map(F.lit, bt.HORIZONS)).alias("windows"), F.lit(game.cap).alias("decadeCap"),
                     F.lit(False).alias("lookAhead"), F.lit(False).alias("midTestParameterChanges"))
    return covered.join(by_series, "series").join(listed, "series").join(upcoming, "series").withColumn("model", model)


def shifts_of(indexed: DataFrame, replicates: int, seed: int, distinct: bool) -> DataFrame:
    """The shift values of each series in stream order."""
    lengths = indexed.select("series", "n_draws").distinct()
    return lengths.select("series", F.posexplode(shift_list(F.col("n_draws"), replicates, seed, distinct)).alias("position", "shift"))
