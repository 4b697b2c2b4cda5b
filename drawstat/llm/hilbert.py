"""Sharding along a Hilbert curve over document metadata.

Each dimension is cut into 2**bits cells at quantiles of all rows, texts in the order of the whole text; cells of all dimensions give a position on
the curve, rows are sorted by it, and shards are equal runs of that order. Neighbours on the curve are near in
every dimension, so the minima and maxima of a shard's files are narrow in each of them and a filter on any
dimension skips files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawstat.llm.common import keep, slots, text_key

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
SHARDS = 24


def is_number(rows: DataFrame, name: str) -> bool:
    return isinstance(rows.schema[name].dataType, T.NumericType)


def cut_points(rows: DataFrame, dimensions: tuple[str, ...], bits: int) -> dict[str, list[float]]:
    """Inner quantiles of every number among the dimensions over all rows, from one aggregate that combines before it moves."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = rows.agg(*[F.percentile_approx(F.col(f"`{d}`").cast("double"), steps, 10_000).alias(f"c{i}") for i, d in enumerate(dimensions)]).first()
    return {d: sorted(set(row[f"c{i}"] or [])) for i, d in enumerate(dimensions)}


def text_cells(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, cell) of every distinct text of a dimension: how many of 2**bits equal shares of the rows come before it, in the
    order of whole texts. Values are counted before they move, sorted by ranges, and their counts summed up in
    that order: within a task from the sum of the tasks before."""
    values = rows.groupBy(F.col(f"`{name}`").cast("string").alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")
    ranged = values.repartitionByRange(slots(rows.sparkSession), "value").sortWithinPartitions("value")
    placed = keep(ranged.withColumn("place", F.monotonically_increasing_id()), "values").withColumn("part", F.shiftright("place", 33))
    before, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # one row per task
    parts = placed.groupBy("part").agg(F.sum("n").alias("held")).select(
        "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(every).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("inside", inside).join(F.broadcast(parts), "part")
    return keep(ranked.select("value", F.expr(f"(start + inside) * {1 << bits} div total").cast("int").alias("cell")), "value-cells")


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows, dimensions): undo the rotations from the highest bit
    down, Gray-decode across the dimensions, then interleave the bits."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        top, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            flip = (x[i] & top) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        carry = np.where((x[n - 1] >> np.uint64(b)) & one, carry ^ ((one << np.uint64(b)) - one), carry)
    x ^= carry
    index = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << one | x[i] >> np.uint64(b) & one
    return index.astype(np.int64)


def with_curve(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, name: str = "curve") -> DataFrame:
    """Written ``rows`` with their position on the curve. A null takes the lowest cell of its dimension."""
    cuts = cut_points(rows, tuple(d for d in dimensions if is_number(rows, d)), bits) if any(is_number(rows, d) for d in dimensions) else {}
    placed, width = rows, len(rows.columns)
    for i, d in enumerate(dimensions):
        if d in cuts:
            above = [F.when(F.col(f"`{d}`").cast("double") > c, 1).otherwise(0) for c in cuts[d]]
            placed = placed.withColumn(f"{name}_{i}", sum(above, F.lit(0)).cast("int"))
        else:
            cells = text_cells(rows, d, bits).select(F.col("value").alias(f"{name}_value"), F.col("cell").alias(f"{name}_{i}"))
            placed = placed.join(cells, F.col(f"`{d}`").cast("string") == F.col(f"{name}_value"), "left").drop(f"{name}_value")
            placed = placed.withColumn(f"{name}_{i}", F.coalesce(f"{name}_{i}", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([np.asarray(c) for c in batch.columns[width:]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(curve_index(grid, bits))], [*batch.schema.names[:width], name])

    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def shard_rows(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """(doc_id, text_key, size, text_crc32, dimensions, curve, shard, slot) of every row of ``docs`` (doc_id, text and
    the dimensions; other columns are ignored).

    Rows are sorted by curve, checksum of the text (equal texts with equal metadata are neighbours) and id; the
    order is cut into ``shards`` runs whose counts are at most one apart. Size is the UTF-8 bytes of
    the text plus 8, 8 for null. Rows alike in all of this get neighbouring slots in any order. A cell of any
    size is spread over many tasks, as the whole sort key divides the rows. An empty table gives no rows."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
                         (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                         *[F.col(f"`{d}`") for d in dimensions])
    order = ("curve", "text_crc32", "doc_id", "text_key")
    placed = keep(with_curve(keep(narrow, "metadata"), dimensions, bits), "curve")
    sorted_rows = placed.repartitionByRange(slots(spark), *order).sortWithinPartitions(*order)
    # the written place of a row: its task in the high bits, its position there in the low 33
    written = keep(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "ordered")
    part, position = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    counts = written.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = written.withColumn("part", part).join(F.broadcast(counts), "part").withColumn("rank", F.col("before") + position)
    shard = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select(
        "doc_id", "text_key", "size", "text_crc32", *dimensions, "curve", F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> None:
    """Write ``docs`` as one folder per shard, rows in curve order, so that file statistics prune in all dimensions.
    Rows that repeat an id and its text are written as often as they occur."""
    planned = keep(shard_rows(docs, shards, dimensions, bits).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "shard", "slot").groupBy("_id", "_key").agg(
        F.min(F.struct("shard", "slot")).alias("_place")), "plan")
    key = text_key(docs["text"])
    placed = docs.join(planned, docs["doc_id"].cast("bigint").eqNullSafe(planned["_id"]) & (key == planned["_key"]))
    rows = placed.select(*[docs[f"`{c}`"] for c in docs.columns], planned["_place.shard"].alias("shard"), planned["_place.slot"].alias("_slot"))
    spread = rows.repartitionByRange(max(shards, slots(docs.sparkSession)), "shard", "_slot").sortWithinPartitions("shard", "_slot")
    spread.drop("_slot").write.partitionBy("shard").parquet(path)
