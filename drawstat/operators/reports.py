"""Dashboard aggregates over draws (series, draw_idx, draw_date, numbers) and method totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawstat.functions.columns import chi_square_tail, overlap
from drawstat.operators.draws import drawn_numbers
from drawstat.operators.frequency import number_counts, uniformity
from drawstat.settings import Game


def last_draws(indexed: DataFrame, n: int) -> DataFrame:
    """The last ``n`` draws of every series, the latest included."""
    return indexed.filter(F.col("draw_idx") >= F.col("n_draws") - n)


def latest_draw(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("series").agg(F.max_by(F.struct("draw_date", "numbers"), "draw_idx").alias("latest")).select(
        "series", "latest.draw_date", "latest.numbers")


def frequency_list(indexed: DataFrame, window: int, limit: int) -> DataFrame:
    """Most frequent numbers of the last draws with the bar width relative to the first."""
    counts = drawn_numbers(last_draws(indexed, window)).groupBy("series", "number").agg(F.count("*").alias("occurrences"))
    by_rank = Window.partitionBy("series").orderBy(F.desc("occurrences"), "number")
    ranked = counts.withColumn("position", F.row_number().over(by_rank)).withColumn(
        "bar_width", F.round(100 * F.col("occurrences") / F.max("occurrences").over(Window.partitionBy("series"))).cast("int"))
    return ranked.filter(F.col("position") <= limit)


def number_check(indexed: DataFrame, game: Game, recent: int = 12) -> DataFrame:
    """Per number: occurrences, occurrences in the last draws and last date, for every number of the pool."""
    is_recent = F.col("draw_idx") >= F.col("n_draws") - recent
    seen = drawn_numbers(indexed).groupBy("series", "number").agg(
        F.count("*").alias("times"), F.count_if(is_recent).alias("recent"), F.max("draw_date").alias("last_date"))
    per_series = seen.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct(
        "number", F.struct("times", "recent", "last_date").alias("facts")))).alias("facts"))
    dense = per_series.select("series", "facts", F.explode(F.sequence(F.lit(1), F.lit(game.pool))).alias("number"))
    fact = F.try_element_at("facts", F.col("number"))
    return dense.select("series", "number", F.coalesce(fact["times"], F.lit(0)).cast("bigint").alias("times"),
                        F.coalesce(fact["recent"], F.lit(0)).cast("bigint").alias("recent"), fact["last_date"].alias("last_date"))


def ticket_check(checks: DataFrame, tickets: DataFrame) -> DataFrame:
    """The checks of the numbers on each series' ticket (series, ticket)."""
    wanted = tickets.select("series", F.explode("ticket").alias("number"))
    return checks.join(wanted, ["series", "number"])


def stats_cards(indexed: DataFrame, game: Game, recent: int = 52) -> DataFrame:
    """Distinct numbers, mean sum, mean evens and mean consecutive overlap of the last draws, and the
    uniformity of the whole series with an approximate chi-square p."""
    window = F.sort_array(F.collect_list(F.when(
        F.col("draw_idx") >= F.col("n_draws") - recent, F.struct("draw_idx", "numbers"))))["numbers"]
    last = indexed.groupBy("series").agg(F.count("*").alias("draws"), window.alias("last"))  # at most ``recent`` arrays
    numbers = F.flatten("last")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    shared = F.transform(F.sequence(F.lit(1), F.size("last") - 1), lambda i: overlap(F.get("last", i), F.get("last", i - 1)))
    shape = last.select(
        "series", "draws", F.size("last").alias("recent_draws"), F.size(F.array_distinct(numbers)).cast("bigint").alias("distinct_numbers"),
        total(numbers).alias("total"), F.size(F.filter(numbers, lambda n: F.pmod(n, F.lit(2)) == 0)).alias("evens"),
        F.when(F.size("last") > 1, total(shared)).otherwise(0).alias("shared"))
    fit = uniformity(number_counts(indexed, game))
    return shape.join(fit, "series").select(
        "series", "draws", "distinct_numbers", (F.col("total") / F.col("recent_draws")).alias("mean_sum"),
        F.lit(game.pick * (game.pool + 1) / 2).alias("expected_sum"),
        (F.col("evens") / F.col("recent_draws")).alias("mean_evens"),
        (F.col("shared") / F.greatest(F.lit(1), F.col("recent_draws") - 1)).alias("mean_overlap"),
        F.col("pearson").alias("chi_square"), chi_square_tail(F.col("pearson"), game.pool - 1).alias("approximate_p"),
        "min_count", "max_count")


def leaderboard(tested: DataFrame, order: list[str]) -> DataFrame:
    """Methods by total hits (ties in the given order) with the surplus over expectation and a bar width."""
    rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("total_hits"), F.array_position(F.array(*map(F.lit, order)), F.col("method")))
    bar = F.least(F.lit(100.0), F.col("total_hits") / (F.col("expected_hits") * 1.08) * 100)
    # one row per method
    return tested.select("method", "total_hits", "expected_hits", (F.col("total_hits") - F.col("expected_hits")).alias("surplus"),
                         "holm_p", bar.alias("bar_width"), F.row_number().over(rank).alias("position"))
