"""HTML pages with draw tables, staged as files (one per fetched page)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawstat.functions.columns import clean_html, iso_from_slashes
from drawstat.settings import PAGE_LINK, PAGE_SERIES


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per staged page: path, whole text and its SHA-256 as lineage."""
    pages = spark.read.text(paths, wholetext=True).withColumnRenamed("value", "html")
    return pages.select(F.input_file_name().alias("path"), "html", F.sha2("html", 256).alias("sha256"))


def extract_cells(html: Column, row_tag: str, cell_tag: str) -> Column:
    """Rows of cleaned cells: every ``<row_tag>`` block, split into its ``<cell_tag>`` contents."""
    blocks = F.regexp_extract_all(html, F.lit(f"(?is)<{row_tag}>.*?</{row_tag}>"), 0)
    return F.transform(blocks, lambda block: F.struct(block.alias("block"), F.transform(
        F.regexp_extract_all(block, F.lit(f"(?is)<{cell_tag}[^>]*>(.*?)</{cell_tag}>"), 1), lambda cell: clean_html(cell)).alias("cells")))


def parse_draw_tables(pages: DataFrame, link: str = PAGE_LINK, names: Sequence[str] = PAGE_SERIES) -> DataFrame:
    """Long draws (series, draw_date, contest, numbers) from table rows that link to a draw and show a date.
    Cell 0 holds the contest, cell 1 the date, the next ones the numbers of each series."""
    rows = pages.select(F.explode(extract_cells(F.col("html"), "tr", "td")).alias("row")).filter(
        F.contains("row.block", F.lit(link)) & F.col("row.block").rlike(r"\d{2}/\d{2}/\d{4}"))

    def digits(cell: Column) -> Column:
        return F.transform(F.regexp_extract_all(cell, F.lit(r"(\d+)"), 1), lambda d: d.cast("int"))

    series = F.explode(F.array(*[F.struct(F.lit(name).alias("series"), F.lit(i + 2).alias("cell"))
                                 for i, name in enumerate(names)]))
    cells = F.col("row.cells")
    dated = rows.select(iso_from_slashes(cells[1]).alias("draw_date"),
                        F.regexp_extract(cells[0], r"(\d+)", 1).cast("int").alias("contest"), cells.alias("cells"),
                        series.alias("s"))
    return dated.select("s.series", "draw_date", "contest",
                        digits(F.try_element_at("cells", F.col("s.cell") + 1)).alias("numbers"))
