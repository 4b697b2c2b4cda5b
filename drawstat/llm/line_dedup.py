"""Line dedup over overlapping windows of three lines.

Every three consecutive lines are hashed. A window that occurs more than once in the corpus keeps its first
occurrence (smallest doc_id, then the first line); the lines that later occurrences cover are merged and taken
out. By induction over the order of occurrences every distinct line that is taken out survives somewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from drawstat.llm.common import keep, text_key

WINDOW = 3
_LAST = (1 << 63) - 1  # order of rows without an id: after all others


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, text_key, h1, h2, pos, first): the windows of every text with a 128-bit hash. ``first`` tells the
    first occurrence within the text. Windows of blank lines only are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_key", "h1", "h2", "pos", "first"]
        for batch in batches:
            for ident, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                lines = (text.as_py() or b"").split(b"\n")
                if len(lines) < window:
                    continue
                digests, where = [], []
                for i in range(len(lines) - window + 1):
                    joined = b"\n".join(lines[i:i + window])
                    if not joined.isspace() and joined:
                        digests.append(hashlib.blake2b(joined, digest_size=16).digest())
                        where.append(i)
                if not where:
                    continue
                seen, first = set(), []
                for d in digests:
                    first.append(d not in seen)
                    seen.add(d)
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                n = len(where)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ident.as_py(), np.int64)), pa.array(np.full(n, key.as_py(), np.int64)),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(where, pa.int32()), pa.array(first)], names)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"),
                       text_key(F.col("text")).alias("text_key"), F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(run, "id bigint, text_key bigint, h1 bigint, h2 bigint, pos int, first boolean")


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, text_key, starts): per text the first lines of its later occurrences, sorted."""
    windows = keep(line_windows(docs, window), "windows")
    repeated = keep(windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("owner"))
                    .filter("n > 1").drop("n"), "repeated")
    later = windows.join(repeated, ["h1", "h2"]).filter("id > owner OR NOT first")
    # per text at most one entry a line
    return later.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``, plus the number of lines before and of lines
    removed, named by ``counts``.

    Lines end at a line feed and are compared exactly. Texts of fewer than ``window`` lines, null and empty
    texts come back unchanged (0 lines for null). Rows that share a doc_id are never later than each other;
    rows without one come last. Other columns pass through (columns of the names in ``counts`` are replaced)."""
    covered = keep(covered_lines(docs, window), "covered")
    ident = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(_LAST))
    # a merge join at every size: the covered lines grow with the corpus, so they are never sent whole to every task
    joined = docs.join(covered.hint("merge"), (ident == covered["id"]) & (text_key(docs["text"]) == covered["text_key"]), "left")
    lines = F.when(docs["text"].isNull(), 0).otherwise(F.size(F.split(docs["text"], "\n")))
    passed = [docs[f"`{c}`"] for c in docs.columns if c not in ("text", *counts)]
    rows = joined.select(*passed, docs["text"].alias("text"), lines.alias(counts[0]), covered["starts"].alias(counts[1]))
    at = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, starts in zip(batch.column(at), batch.column(at + 2)):
                text, starts = text.as_py(), starts.as_py()
                if not starts:
                    texts.append(text)
                    removed.append(0)
                    continue
                lines = text.split("\n")
                gone = np.zeros(len(lines) + 1, np.int64)
                np.add.at(gone, np.array(starts), 1)
                np.add.at(gone, np.array(starts) + window, -1)
                gone = np.cumsum(gone)[:-1] > 0  # merged
                texts.append("\n".join(line for line, g in zip(lines, gone) if not g))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(texts, pa.string()), batch.column(at + 1), pa.array(removed, pa.int32())],
                [f.name for f in batch.schema])

    schema = rows.schema
    schema[at + 2].dataType = IntegerType()
    order = [*[c for c in docs.columns if c not in counts], *counts]
    return rows.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in order])


def clean_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its own columns, the covered lines taken out of ``text`` and n_chars, if there, counted anew
    for the texts that changed."""
    before, removed = (f"_{'_'.join(docs.columns)}_{kind}" for kind in ("before", "removed"))  # no clash with any column
    cleaned = dedup_lines(docs, window, (before, removed))
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col(f"`{removed}`") > 0, F.char_length("text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[c.alias(n) for n, c in own.items()])
