"""CSV draw archives: a date column, one column per number and an optional bonus column, no quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawstat.operators.draws import DataError
from drawstat.settings import ARCHIVE_BONUS, ARCHIVE_DATE, SINGLE_GAME, Game


def archive_columns(game: Game = SINGLE_GAME, bonus: bool = True) -> list[str]:
    numbers = [f"n{i}" for i in range(1, game.pick + 1)]
    return [ARCHIVE_DATE, *numbers, *([ARCHIVE_BONUS] if bonus else [])]


def to_draws(rows: DataFrame, game: Game = SINGLE_GAME, bonus: bool = True) -> DataFrame:
    """Text columns of an archive to draws. Unreadable values become NULL and are left to validation;
    a value that is no whole number is refused there too, so the cast to int happens only for whole ones."""
    def number(name: str) -> Column:
        value = F.expr(f"try_cast(`{name}` as double)")
        return F.when(value == F.floor(value), value.try_cast("int"))

    columns = [F.col(ARCHIVE_DATE).alias("date_text"), F.try_to_date(F.col(ARCHIVE_DATE), "yyyy-MM-dd").alias("draw_date"),
               F.array(*[number(f"n{i}") for i in range(1, game.pick + 1)]).alias("numbers")]
    if bonus:
        columns.append(number(ARCHIVE_BONUS).alias("bonus"))
    kept = [c for c in rows.columns if c in ("source", "source_ord", *_PLACE)]
    return rows.select(*kept, *columns)


# Where a row stands in its file, whatever the split into tasks: file, start of the block, row within the block.
_PLACE = ("_place_file", "_place_block", "_place_row")


def read_archive(spark: SparkSession, path: str, game: Game = SINGLE_GAME, strict: bool = True, bonus: bool = True) -> DataFrame:
    """One archive as text rows turned into draws. Columns are matched by header name, a byte-order mark is
    ignored. ``strict`` refuses a missing column at once and a row of the wrong width when it is read."""
    options = {"header": True, "quote": "", "mode": "FAILFAST" if strict else "PERMISSIVE", "enforceSchema": False}
    header = spark.read.options(header=True, quote="").csv(path)
    names = [c.replace("﻿", "") for c in header.columns]
    missing = [c for c in archive_columns(game, bonus) if c not in names]
    if strict and missing:
        raise DataError(f"{path} lacks columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    read = spark.read.options(**options).schema(schema).csv(path)
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = read.select(*[F.col(f"`{c.name}`") for c in schema], *[p.alias(n) for p, n in zip(place, _PLACE)]).toDF(*names, *_PLACE)
    for name in missing:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return to_draws(rows.withColumn("source", F.lit(path)), game, bonus)


def read_archives(spark: SparkSession, paths: list[str], game: Game = SINGLE_GAME, strict: bool = True, bonus: bool = True) -> DataFrame:
    """Concatenate archives. ``source_ord`` orders the rows by the position of their file in ``paths``, then by
    their place in the file, and so decides which duplicate wins."""
    parts = [read_archive(spark, p, game, strict, bonus).withColumn(
        "source_ord", F.struct(F.lit(i).alias("source"), *[F.col(c) for c in _PLACE])).drop(*_PLACE) for i, p in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parse_lines(lines: DataFrame, header: str, game: Game = SINGLE_GAME, bonus: bool = True) -> DataFrame:
    """Archive lines already held in a column ``line`` (any other columns named source/source_ord are kept)."""
    names = header.removeprefix("﻿").split(",")
    missing = [c for c in archive_columns(game, bonus) if c not in names]
    if missing:
        raise DataError(f"header lacks columns {missing}")
    fields = F.split(F.rtrim(F.col("line")), ",", -1)
    kept = [c for c in lines.columns if c != "line"]
    checked = F.when(F.size(fields) == len(names), fields).otherwise(
        F.raise_error(F.concat(F.lit("malformed archive line: "), F.col("line"))))
    split = lines.select(*kept, checked.alias("fields"))
    return to_draws(split.select(*kept, *[F.col("fields")[i].alias(n) for i, n in enumerate(names)]), game, bonus)


def lax_lines(lines: DataFrame, header: str, game: Game = SINGLE_GAME, bonus: bool = True) -> DataFrame:
    """Archive lines in a column ``line`` without any check of their width: fields that are missing are NULL, further ones are
    ignored. The line itself stays as ``source``, for whoever reads the rejects."""
    names = header.removeprefix("\ufeff").split(",")
    fields = F.split(F.rtrim(F.col("line")), ",", -1)
    rows = lines.select(F.col("line").alias("source"), *[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)])
    for name in archive_columns(game, bonus):
        if name not in names:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return to_draws(rows, game, bonus)


def to_lines(draws: DataFrame) -> DataFrame:
    """Draws back to archive lines (date, numbers, bonus). A missing bonus is an empty field, read back as NULL."""
    return draws.withColumn("line", F.concat_ws(",", F.date_format("draw_date", "yyyy-MM-dd"),
                                                 F.array_join(F.col("numbers").cast("array<string>"), ","),
                                                 F.coalesce(F.col("bonus").cast("string"), F.lit(""))))
