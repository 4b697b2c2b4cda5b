"""Helpers shared by the operators: tables, written intermediates, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawstat.streaming.storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``rows`` below ``spark.checkpoint.dir`` and read them back. It cuts the lineage: a lost executor
    costs the tasks it ran, never the steps before."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def byte_slices(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text (one row at least), so that what a task holds does not depend
    on the size of its batches."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)))
        yield at, to
        at = to


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id but not their text."""
    return F.xxhash64(text)


def numbered(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """``rows`` written with ``at``, the place from 0 within ``group`` by ``order`` (nulls first), and ``size``, the rows
    of the group. The whole order is cut into ranges, so a group of any size is spread over the tasks; only
    one row per group and task is summed by group. Rows alike in the whole order take neighbouring places."""
    by = (group, *order, "_read")
    ranged = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(slots(rows.sparkSession), *by).sortWithinPartitions(*by)
    placed = keep(ranged.drop("_read").withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)  # the task that wrote the row
    cells = placed.groupBy(group, part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = keep(cells.select(F.col(group).alias("_group"), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(inside).alias("size")), "cells")
    found = placed.join(cells, (F.col(group) == F.col("_group")) & (part == F.col("_part")))
    return keep(found.select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("at"), "size"), "numbered")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set: equal for equal sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of long ids: (node, component) for every node with an edge that is not the
    smallest of its component; ``component`` is that smallest id.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest of
    its neighbourhood, until the edges are stars. The edge set never grows, each round is two keyed
    minima (combined before they move) and two joins between written tables, so that a hub with a third of
    all edges is split by the adaptive join. Only a count and a checksum reach the driver."""
    current = keep(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.select(F.col("lo").alias("node"), F.col("lo").alias("m")).unionAll(
            current.select("hi", "lo")).unionAll(current.select("lo", "hi"))
        least = keep(both.groupBy("node").agg(F.min("m").alias("m")), "least")
        large = keep(current.join(least, F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo"))
                     .filter("hi <> lo").distinct(), "large")
        low = keep(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "low")
        small = large.join(low, F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        current = keep(small.unionAll(low.select("node", "m")).distinct(), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
