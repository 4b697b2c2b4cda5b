"""Draw series derived from order and line tables.

``l_partkey % 90 + 1`` is the number of a line. The lines of an order are reduced to their set of at
most 90 numbers before the only large shuffle, so an order that owns a third of the table still sends
one small row per map task, and the join reuses that shuffle. Everything after the join is keyed by (series, date, number) and pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawstat.operators.draws import HALF, unpacked
from drawstat.settings import SINGLE_GAME, WHEEL_GAME, Game


NO_PRIORITY = "(none)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: key, customer, date, priority and the set of its numbers as two bit masks, which
    are combined in fixed memory before the shuffle."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 90).alias("n"))
    one = F.lit(1).cast("bigint")
    sets = lines.groupBy("l_orderkey").agg(
        F.bit_or(F.when(F.col("n") < HALF, F.call_function("shiftleft", one, F.col("n").cast("int")))).alias("low"),
        F.bit_or(F.when(F.col("n") >= HALF, F.call_function("shiftleft", one, (F.col("n") - HALF).cast("int")))).alias("high"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("order_date"))
    none = F.lit(0).cast("bigint")
    return orders.join(sets, orders.o_orderkey == sets.l_orderkey).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "order_date", F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high"))


def order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_masks`` with the sorted distinct numbers instead of masks."""
    rows = order_masks(spark, sf_dir)
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority", "order_date", unpacked(F.col("low"), F.col("high")).alias("numbers"))


def packed_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_announcements`` with the numbers as masks, for what reduces them before anyone reads the numbers."""
    return order_masks(spark, sf_dir).select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("source_ord"), F.col("order_date").alias("draw_date"), "low", "high",
        (F.col("o_custkey") % 90 + 1).cast("int").alias("bonus"))


def raw_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row per order, as unvalidated sources would report them: several per date, some conflicting,
    many with a wrong count of numbers."""
    rows = packed_announcements(spark, sf_dir)
    return rows.select("source", "source_ord", "draw_date", unpacked(F.col("low"), F.col("high")).alias("numbers"), "bonus")


def _draws(numbers: DataFrame, series: Column, day: Column, game: Game) -> DataFrame:
    firsts = (numbers.select(series.alias("series"), day.alias("draw_date"), "o_orderkey",
                             F.explode("numbers").alias("number"))
              .groupBy("series", "draw_date", "number").agg(F.min("o_orderkey").alias("first_key")))
    # at most 90 rows per date, whatever the size of the input
    by_date = firsts.groupBy("series", "draw_date").agg(
        F.sort_array(F.collect_list(F.struct("first_key", "number"))).alias("seen"))
    return by_date.filter(F.size("seen") >= game.pick).select(
        "series", "draw_date",
        F.array_sort(F.transform(F.slice("seen", 1, game.pick), lambda s: s["number"])).alias("numbers"),
        F.try_element_at("seen", F.lit(game.pick + 1))["number"].alias("bonus"))


def single_series(spark: SparkSession, sf_dir: str, game: Game = SINGLE_GAME) -> DataFrame:
    """One draw per order date: the six numbers seen first, the seventh as bonus."""
    # not a literal: a constant series would be folded away and could no longer serve as a shuffle key
    series = F.when(F.col("order_date").isNotNull(), F.lit("all"))
    return _draws(order_numbers(spark, sf_dir), series, F.col("order_date"), game)


def priority_series(spark: SparkSession, sf_dir: str, game: Game = WHEEL_GAME) -> DataFrame:
    """One series per order priority (orders without one make up a series of their own) and one draw per week;
    weeks that lack a series are left out."""
    draws = _draws(order_numbers(spark, sf_dir), F.coalesce(F.col("o_orderpriority"), F.lit(NO_PRIORITY)),
                   F.date_trunc("week", F.col("order_date")).cast("date"), game)
    return complete_dates(draws)


def order_days(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Distinct order days (or the Mondays of their weeks) from one pruned column, the calendar the features
    are computed for. Cheaper than deriving the draws a second time just for their dates."""
    day = F.date_trunc(unit, F.col("o_orderdate")).cast("date")
    return table(spark, sf_dir, "orders").select(day.alias("draw_date")).distinct()


def complete_dates(draws: DataFrame) -> DataFrame:
    """Keep the dates on which every series that has a draw at all has one."""
    series_count = draws.select("series").distinct().agg(F.count("*").alias("n_series"))  # one row
    present = F.count("*").over(Window.partitionBy("draw_date"))
    counted = draws.withColumn("n_present", present)
    return counted.join(F.broadcast(series_count), counted.n_present == series_count.n_series).drop("n_present", "n_series")
