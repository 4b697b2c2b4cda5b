"""Best-fit packing under conflicts.

Pieces of documents are packed into bins of a fixed size so that no bin holds two pieces of the
same source or of the same duplicate cluster. Open bins are ordered by the room they have left; a piece
takes the first bin at or after its own length whose bitmaps of sources and clusters are free of it, that is the tightest compatible bin.

Packing is sequential by nature, so documents are dealt by a hash of their id to groups of bounded size
that are packed independently; the number of groups follows the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import keep, slots, text_key

CAPACITY = 8192
GROUP_ROWS = 4096


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of every piece (length, source, cluster), -1 for no source or cluster; pieces are placed in the
    given order. Bins are numbered as they are opened."""
    order: list[tuple[int, int]] = []   # (room left, bin), sorted
    sources: list[int] = []             # bitmaps
    clusters: list[int] = []
    placed = []
    for length, source, cluster in pieces:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1  # successor search
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= s
        clusters[number] |= c
        if room > length:
            insort(order, (room - length, number))
        placed.append(number)
    return placed


def _pieces(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(row, piece, start, length) of every document, longest pieces first; equal ones keep the order of the rows."""
    cut = []
    for row, length in enumerate(lengths):
        full = length // capacity
        cut += [(row, i, i * capacity, capacity) for i in range(full)]
        if length % capacity or not length:
            cut.append((row, full, full * capacity, length % capacity))
    return sorted(cut, key=lambda p: -p[3])


def pack(docs: DataFrame, length: str = "length", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (what the document holds before it), length, bin (group
    times 2**32 plus its number there) and slot (position in the bin from 0).

    ``docs`` has doc_id and the named columns; others are ignored. A document longer than ``capacity`` is cut
    into pieces of that length and a rest. Longest pieces first, ties by id, source, cluster and piece.
    A null or negative length counts as 0; a document of length 0 is one empty piece. Null sources and
    clusters conflict with nothing. Repeated rows are packed as documents of their own; should they fill a
    group beyond twice its size, it is packed in parts. An empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0)).alias("length"),
                       F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    rows = keep(rows, "lengths")
    groups = rows.count() // group_rows + 1
    # all columns take part, so that rows without an id spread as well
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster"), F.lit(groups)))

    def packed(grp: int, part: list[tuple], first_bin: int) -> tuple[pa.RecordBatch, int]:
        codes: dict[str, dict] = {"source": {}, "cluster": {}}

        def code(kind: str, value) -> int:
            return -1 if value is None else codes[kind].setdefault(value, len(codes[kind]))

        marks = [(code("source", r[2]), code("cluster", r[3])) for r in part]
        cut = _pieces([r[1] for r in part], capacity)
        bins = best_fit([(n, *marks[row]) for row, _, _, n in cut], capacity)
        fill: dict[int, int] = {}
        slots_in = []
        for b in bins:
            slots_in.append(fill.get(b, 0))
            fill[b] = slots_in[-1] + 1
        base = (grp << 32) + first_bin
        columns = [[part[row][0] for row, *_ in cut], [i for _, i, _, _ in cut], [a for _, _, a, _ in cut], [n for *_, n in cut],
                   [base + b for b in bins], slots_in]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "bin", "slot"])
        return batch, first_bin + len(fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, part, first_bin = None, [], 0
        for batch in batches:
            for g, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if part and (g != grp or len(part) >= 2 * group_rows):
                    out, first_bin = packed(grp, part, first_bin)
                    yield out
                    part = []
                if g != grp:
                    grp, first_bin = g, 0
                part.append(tuple(row))
        if part:
            yield packed(grp, part, first_bin)[0]

    spread = dealt.select("grp", "doc_id", "length", "source", "cluster").repartition(max(slots(spark), groups // 8), "grp")
    ordered = spread.sortWithinPartitions("grp", F.desc("length"), "doc_id", "source", "cluster")
    return ordered.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, bin bigint, slot int")


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, clusters: DataFrame | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source) by UTF-8 bytes, the tokens of a byte-level model. Texts with one label in
    ``clusters`` (text_key, label) are one duplicate cluster, and so are equal texts that it does not name. A null text
    has length 0 and no cluster."""
    rows = docs.select("doc_id", "source", F.octet_length("text").alias("length"), F.sha2("text", 256).alias("cluster"), text_key(F.col("text")).alias("text_key"))
    if clusters is not None:
        # one row a text; both sides are written, so that a text of many rows is split
        named = keep(clusters.groupBy("text_key").agg(F.min("label").cast("string").alias("label")), "clusters")
        rows = keep(rows, "texts").join(named, "text_key", "left").withColumn(
            "cluster", F.when(F.col("cluster").isNotNull(), F.coalesce("label", "cluster")))
    return pack(rows, capacity=capacity, group_rows=group_rows)
