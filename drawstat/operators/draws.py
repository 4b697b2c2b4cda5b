"""Validation, deduplication, coverage and indexing of draws.

A draw is (series, draw_date, numbers, bonus). Raw rows may repeat a date any number of times and are
only ever reduced with map-side combinable aggregates. After deduplication a series holds at most one
draw per calendar day, which bounds every per-series window below (36,525 rows a century).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawstat.functions.columns import valid_bonus, valid_date, valid_numbers, whole_in_range
from drawstat.settings import Game


class DataError(ValueError):
    """Input refused; nothing has been written."""


# ------------------------------------------------------------------ validation


def with_violations(raw: DataFrame, game: Game, date_text: str | None = None, check_bonus: bool = True) -> DataFrame:
    """Add ``violations``, the array of rules a row breaks (empty for a valid row). Numbers may be an array or masks."""
    if "numbers" in raw.columns:
        rules = [("numbers", valid_numbers(F.col("numbers"), game)), ("bonus", valid_bonus(F.col("bonus"), F.col("numbers"), game) if check_bonus else None)]
    else:
        rules = packed_violations(game)
    if date_text is not None:
        rules.insert(1, ("date", valid_date(F.col(date_text))))
    rules = [(name, ok) for name, ok in rules if check_bonus or name != "bonus"]
    flags = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules])
    return raw.withColumn("violations", F.array_compact(flags))


def violation_counts(checked: DataFrame) -> DataFrame:
    """Rows per broken rule plus the number of rows that break any."""
    broken = checked.filter(F.size("violations") > 0)
    kinds = broken.select(F.explode(F.concat(F.array(F.lit("any")), F.col("violations"))).alias("violation"))
    return kinds.groupBy("violation").agg(F.count("*").alias("n_rows"))


def require_valid(checked: DataFrame) -> DataFrame:
    """Raise when a row breaks a rule, else return the rows without the flag column."""
    counts = {r["violation"]: r["n_rows"] for r in violation_counts(checked).collect()}  # at most four rows
    if counts:
        raise DataError(f"invalid rows: {counts}")
    return checked.drop("violations")


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that break no rule, and the others as a side table with the broken rules as one text."""
    rules = F.array_join(F.array_sort("violations"), ",")
    return (checked.filter(F.size("violations") == 0).drop("violations"),
            checked.filter(F.size("violations") > 0).withColumn("rules", rules).drop("violations"))


def between_dates(draws: DataFrame, first: str, last: str) -> DataFrame:
    """Inclusive date range; reaches the scan of a stored table as a pushed filter."""
    return draws.filter(F.col("draw_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


# --------------------------------------------------------------- deduplication


HALF = 45  # numbers in the lower of two bit masks; a set of 1..90 is two bigints


def packed(raw: DataFrame) -> DataFrame:
    """Replace ``numbers`` by the masks ``low`` and ``high`` and by ``odd``, which holds the array itself where it is not an
    ascending set of 1..90 (and is NULL otherwise). Rows that have masks already only lack ``odd``."""
    if "numbers" not in raw.columns:
        return raw.withColumn("odd", F.lit(None).cast("array<int>"))
    regular = F.coalesce(F.forall("numbers", lambda n: n.between(1, 2 * HALF)) & (F.array_sort(F.array_distinct("numbers")) == F.col("numbers")), F.lit(False))

    def mask(first: int) -> Column:
        inside = F.filter("numbers", lambda n: n.between(first, first + HALF - 1))
        return F.when(regular, F.aggregate(inside, F.lit(0).cast("bigint"), lambda m, n: m.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), (n - first).cast("int")))))

    return raw.select(*[c for c in raw.columns if c != "numbers"], mask(1).alias("low"), mask(1 + HALF).alias("high"),
                      F.when(~regular, F.col("numbers")).alias("odd"))


def unpacked(low: Column, high: Column) -> Column:
    """The ascending numbers of two masks."""
    def listed(mask: Column, first: int) -> Column:
        # a narrow loop over the bits; one expression per bit would outgrow what the JVM compiles
        held = F.filter(F.sequence(F.lit(first), F.lit(first + HALF - 1)), lambda n: F.getbit(mask, n - first) == 1)
        return F.coalesce(held, F.array().cast("array<int>"))

    return F.concat(listed(low, 1), listed(high, 1 + HALF))


def packed_violations(game: Game) -> list[tuple[str, Column]]:
    """The rules for numbers and bonus on masks."""
    held = F.coalesce(F.bit_count("low"), F.lit(0)) + F.coalesce(F.bit_count("high"), F.lit(0))
    drawn = F.when(F.col("bonus") <= HALF, F.getbit("low", F.col("bonus") - 1)).otherwise(F.getbit("high", F.col("bonus") - 1 - HALF))
    # outside 1..90 there is no bit to look at
    free = F.when(F.col("bonus").between(1, 2 * HALF), F.coalesce(drawn, F.lit(0).cast("tinyint")) == 0).otherwise(F.lit(True))
    return [("numbers", held == game.pick), ("bonus", whole_in_range(F.col("bonus"), game.pool) & F.coalesce(free, F.lit(False)))]


def dedup_by_date(raw: DataFrame, keep: str = "first", compare: tuple[str, ...] = ("numbers", "bonus"),
                  keys: tuple[str, ...] = ("draw_date",)) -> DataFrame:
    """One row per key: the first or last row in ``source_ord`` order, with the number of raw rows and
    whether they disagree on the ``compare`` columns.

    Numbers travel as masks, texts as grouping keys, everything else as single values next to their order, so the raw
    rows pass only through aggregates of fixed size that are hashed and combined before the shuffle; a date
    holding a third of all rows is a few rows per task. What is left, one row per key and text, is compared as
    rows. An order that is no single value (a place in a file) takes the rows there as they are."""
    columns = [c if c not in ("low", "high") else "numbers" for c in raw.columns if c != "high"]
    payload = [c for c in columns if c not in keys]
    pick, ends = (F.min_by, F.min) if keep == "first" else (F.max_by, F.max)
    rows = packed(raw)
    fixed = {c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz", "boolean", "double", "float")}
    parts = [c for c in compare for c in (("low", "high", "odd") if c == "numbers" else (c,))]
    values = [c for c in rows.columns if c in fixed and c not in keys and c != "source_ord"]
    others = [c for c in rows.columns if c not in fixed and c not in keys and c != "source_ord"]
    if "source_ord" in fixed:
        mine = [c for c in parts if c in fixed]
        rows = rows.groupBy(*keys, *others).agg(
            F.count("*").alias("_n"), *[pick(c, "source_ord").alias(c) for c in values],
            *[f(c).alias(f"_{n}_{c}") for c in mine for n, f in (("min", F.min), ("max", F.max), ("held", F.count))], ends("source_ord").alias("source_ord"))
        differ = [(F.min(f"_min_{c}") < F.max(f"_max_{c}")) | (F.sum(f"_held_{c}").between(1, F.sum("_n") - 1)) for c in mine]
    else:
        rows, differ = rows.withColumn("_n", F.lit(1).cast("bigint")), []
        mine = []
    rest = [c for c in parts if c not in mine]
    whole = [F.min(F.struct(c)) != F.max(F.struct(c)) for c in rest]
    conflict = reduce(Column.__or__, [F.coalesce(d, F.lit(False)) for d in (*differ, *whole)])
    kept = rows.groupBy(*keys).agg(pick(F.struct("source_ord", *values, *others), F.col("source_ord")).alias("kept"), F.sum("_n").alias("n_rows"),
                                   conflict.alias("conflict"))
    numbers = F.when(F.col("kept.odd").isNotNull(), F.col("kept.odd")).when(
        F.col("kept.low").isNotNull() | F.col("kept.high").isNotNull(), unpacked(F.col("kept.low"), F.col("kept.high")))
    return kept.select(*keys, *[(numbers if c == "numbers" else F.col(f"kept.{c}")).alias(c) for c in payload], "n_rows", "conflict")


def require_no_conflict(deduped: DataFrame) -> DataFrame:
    conflicts = deduped.filter("conflict").agg(F.count("*").alias("n"), F.min("draw_date").alias("first")).first()
    if conflicts["n"]:
        raise DataError(f"{conflicts['n']} dates with conflicting sources, first {conflicts['first']}")
    return deduped.drop("conflict", "n_rows")


def coverage(deduped: DataFrame) -> DataFrame:
    """First and last date, draws, raw and duplicate rows, conflicting dates."""
    return deduped.agg(
        F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"),
        F.count("*").alias("draws"), F.sum("n_rows").alias("raw_rows"),
        (F.sum("n_rows") - F.count("*")).alias("duplicate_rows"),
        F.count_if("conflict").alias("conflicting_dates"))


def require_coverage(summary: DataFrame, minimum: int = 2, **expected) -> DataFrame:
    """Compare a one-row coverage summary with recorded values (and a minimum of draws)."""
    row = summary.first()
    if row["draws"] < minimum:
        raise DataError(f"only {row['draws']} draws")
    wrong = {k: (row[k], v) for k, v in expected.items() if row[k] != v}
    if wrong:
        raise DataError(f"coverage differs from the record: {wrong}")
    return summary


# ---------------------------------------------------------------------- layout


def with_index(draws: DataFrame) -> DataFrame:
    """Dense position per series (``draw_idx`` from 0) and the series length ``n_draws``.
    Partitioned by series, where rows are bounded by the calendar."""
    by_date = Window.partitionBy("series").orderBy("draw_date")
    whole = Window.partitionBy("series").orderBy("draw_date").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return draws.withColumn("draw_idx", F.row_number().over(by_date) - 1).withColumn(
        "n_draws", F.count("*").over(whole).cast("int"))


def with_next_draw(indexed: DataFrame) -> DataFrame:
    """Append to every series the draw not yet held: next index, no date, no numbers. The last row emits
    it, so the draws are not read twice."""
    last = F.col("draw_idx") == F.col("n_draws") - 1
    steps = F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    keep = F.col("step") == 0
    others = [c for c in indexed.columns if c not in ("series", "draw_idx", "n_draws")]
    return indexed.withColumn("step", steps).select(
        "series", (F.col("draw_idx") + F.col("step")).alias("draw_idx"), "n_draws",
        *[F.when(keep, F.col(c)).alias(c) for c in others])


def drawn_numbers(draws: DataFrame) -> DataFrame:
    """Long form: one row per drawn number."""
    keep = [c for c in draws.columns if c not in ("numbers", "bonus")]
    return draws.select(*keep, F.explode("numbers").alias("number"))


def spread(rows: DataFrame, *keys: str, per_slot: int = 1) -> DataFrame:
    """Shuffle by keys into a fixed number of partitions. For stages that work far harder per row than their
    byte size shows, so that the adaptive coalescing by size must not merge them. With few heavy keys several
    partitions ``per_slot`` even out how they hash."""
    spark = rows.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * per_slot)
    return rows.repartition(slots, *keys)


def number_grid(indexed: DataFrame, game: Game) -> DataFrame:
    """Dense form: every number of the pool for every draw, with ``hit`` 0/1. A narrow generator."""
    keep = [c for c in indexed.columns if c not in ("numbers", "number")]
    return indexed.select("*", F.explode(F.sequence(F.lit(1), F.lit(game.pool))).alias("number")).select(
        *keep, "number",
        F.coalesce(F.array_contains("numbers", F.col("number")), F.lit(False)).cast("int").alias("hit"))
