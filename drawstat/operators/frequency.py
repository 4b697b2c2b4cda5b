"""Marginal, pair and lag-overlap counts. All groups are bounded: 90 numbers and 4,005 pairs per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawstat.functions.columns import choose, overlap, overlap_at_least_two
from drawstat.functions.exact import binomial_two_sided
from drawstat.settings import Game


def number_counts(draws: DataFrame, game: Game) -> DataFrame:
    """Dense occurrence counts per series with the expected count and the deviation from it.
    Arrays are spread before counting, so the shuffle carries at most 90 partial rows per series and task;
    numbers never drawn come from the pool itself."""
    counted = draws.select("series", F.explode("numbers").alias("number")).groupBy("series", "number").agg(
        F.count("*").alias("n"))
    counts = counted.groupBy("series").agg(
        F.map_from_entries(F.collect_list(F.struct("number", "n"))).alias("counts"), F.sum("n").alias("drawn"))
    dense = counts.select("series", "drawn", "counts", F.explode(F.sequence(F.lit(1), F.lit(game.pool))).alias("number"))
    expected = F.col("drawn") / game.pool
    return dense.select(
        "series", "number",
        F.coalesce(F.try_element_at("counts", F.col("number")), F.lit(0)).cast("bigint").alias("occurrences"),
        expected.alias("expected")).withColumn("deviation", F.col("occurrences") - F.col("expected"))


def uniformity(counts: DataFrame) -> DataFrame:
    """Counted numbers, Pearson statistic, largest deviation and range of a dense count table. The sum runs over an array
    in number order, which fixes its floating-point value."""
    per_series = counts.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("number", "occurrences", "expected"))).alias("cells"))
    pearson = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + (c["occurrences"] - c["expected"])
                          * (c["occurrences"] - c["expected"]) / c["expected"])
    return per_series.select(
        "series", F.aggregate("cells.occurrences", F.lit(0).cast("bigint"), lambda acc, c: acc + c).alias("n_numbers"),
        pearson.alias("pearson"),
        F.array_max(F.transform("cells", lambda c: F.abs(c["occurrences"] - c["expected"]))).alias("max_deviation"),
        F.array_min("cells.occurrences").alias("min_count"), F.array_max("cells.occurrences").alias("max_count"))


def extreme_numbers(counts: DataFrame, k: int = 10, largest: bool = True) -> DataFrame:
    """Top or bottom ``k`` numbers of each series; ties go to the smaller number."""
    order = F.desc("occurrences") if largest else F.asc("occurrences")
    rank = Window.partitionBy("series").orderBy(order, "number")
    return counts.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= k)


def pair_counts(draws: DataFrame) -> DataFrame:
    """Co-occurrence counts of unordered pairs a < b that occur."""
    ordered = F.array_sort("numbers")
    pairs = F.flatten(F.transform(ordered, lambda a: F.transform(
        F.filter(ordered, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return draws.select("series", F.explode(pairs).alias("pair")).groupBy(
        "series", F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).agg(F.count("*").alias("occurrences"))


def all_pairs(pairs: DataFrame, game: Game) -> DataFrame:
    """Dense pair table: pairs of the pool that never occurred count 0 (4,005 per series)."""
    found = pairs.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct("a", "b").alias("pair"), "occurrences"))).alias("found"))
    low = found.select("series", "found", F.explode(F.sequence(F.lit(1), F.lit(game.pool - 1))).alias("a"))
    both = low.select("series", "found", "a", F.explode(F.sequence(F.col("a") + 1, F.lit(game.pool))).alias("b"))
    return both.select("series", "a", "b", F.coalesce(
        F.try_element_at("found", F.struct("a", "b")), F.lit(0)).cast("bigint").alias("occurrences"))


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    rank = Window.partitionBy("series").orderBy(F.desc("occurrences"), "a", "b")
    return pairs.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= k)


def pair_summary(draws: DataFrame, game: Game) -> DataFrame:
    """Draws, possible pairs, observed pair occurrences, expectation per pair and the largest count."""
    per_draw = choose(game.pick, 2)
    candidates = choose(game.pool, 2)
    totals = pair_counts(draws).groupBy("series").agg(
        F.max("occurrences").alias("max_pair_count"), F.sum("occurrences").alias("pair_occurrences"))
    return totals.select(
        "series", (F.col("pair_occurrences") / per_draw).cast("bigint").alias("draws"),
        candidates.cast("bigint").alias("candidate_pairs"), "pair_occurrences",
        (F.col("pair_occurrences") / candidates).alias("expected_per_pair"), "max_pair_count")


def serial_overlaps(indexed: DataFrame) -> DataFrame:
    """Numbers shared with the previous draw; the first draw of a series has none to compare."""
    previous = F.lag("numbers").over(Window.partitionBy("series").orderBy("draw_idx"))
    return indexed.withColumn("previous", previous).filter("previous IS NOT NULL").select(
        "series", "draw_idx", "draw_date", overlap(F.col("numbers"), F.col("previous")).alias("shared"))


def serial_test(indexed: DataFrame, game: Game) -> DataFrame:
    """Lag-1 overlap totals and the exact two-sided binomial p of 'at least two shared numbers'."""
    totals = serial_overlaps(indexed).groupBy("series").agg(
        F.count("*").alias("adjacent_pairs"), F.sum("shared").alias("overlap_total"),
        F.avg("shared").alias("mean_overlap"), F.count_if(F.col("shared") >= 2).alias("pairs_at_least_two"))
    with_null = totals.withColumn("null_probability", overlap_at_least_two(game))
    return with_null.select(
        "*", (F.col("adjacent_pairs") * F.col("null_probability")).alias("expected_pairs"),
        binomial_two_sided(F.col("pairs_at_least_two"), F.col("adjacent_pairs"), F.col("null_probability")).alias("raw_p"))
