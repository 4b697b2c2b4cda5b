"""Token counts by section from one encoding of the whole document.

Every document is encoded once as a whole; the byte lengths of its tokens give their character spans, and a
merge of the sorted token spans with the sorted section spans attributes every token. A token that crosses
a section boundary goes to one section by an explicit rule: ``most`` (the section with most of its
characters, ties to the first), ``start`` (its first character) or ``end`` (its last character).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawstat.llm.tokens import rank_encoder

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("most", "start", "end")
COUNTS = "doc_id bigint, section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint"


def line_sections(text: str) -> np.ndarray:
    """Character spans of the lines of a text, each with its line feed; none for an empty text."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array([[0, *ends[:-1]], ends], np.int64).T if text else np.empty((0, 2), np.int64)


def token_spans(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Character spans of consecutive tokens given by their byte lengths. A token that holds part of a
    character spans the whole character."""
    char_of = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return np.stack([char_of[ends - sizes], char_of[ends - 1] + 1], axis=1) if len(sizes) else np.empty((0, 2), np.int64)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Section of every token (-1: outside all sections), and per section the tokens that also touch another one.
    Sections are sorted and disjoint; both lists are sorted, so the join is two binary searches."""
    if not len(sections):
        return np.full(len(spans), -1), np.zeros(0, np.int64)
    first = np.searchsorted(sections[:, 1], spans[:, 0], side="right")       # first section that ends after the token starts
    last = np.searchsorted(sections[:, 0], spans[:, 1], side="left") - 1     # last section that starts before it ends
    owner = np.where(first <= last, last if rule == "end" else first, -1)
    crossing = np.flatnonzero(first < last)
    if rule == "most":
        for t in crossing:
            touched = sections[first[t]:last[t] + 1]
            shared = np.minimum(touched[:, 1], spans[t, 1]) - np.maximum(touched[:, 0], spans[t, 0])
            owner[t] = first[t] + int(shared.argmax())
    steps = np.zeros(len(sections) + 1, np.int64)
    np.add.at(steps, first[crossing], 1)
    np.add.at(steps, last[crossing] + 1, -1)
    return owner, np.cumsum(steps)[:-1]


def count_sections(docs: DataFrame, rule: str = "most", tokenizer: str = VOCABULARY, sections: str | None = None) -> DataFrame:
    """One row per section of every row of ``docs`` (doc_id, text; other columns are ignored): doc_id, section (from
    0), char_start, char_end, n_tokens and n_crossing (tokens that touch the section and another one).

    ``sections`` names a column array<struct<start, end>> of character spans; without it the lines are the
    sections. Spans may be in any order but must not overlap. Tokens outside all sections make up a row with
    section -1 and null spans. A null or empty text without sections gives no rows; null spans are skipped.
    Rows that repeat an id each give their own rows."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    given = sections is not None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       *([F.col(sections).alias("sections")] if given else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = rank_encoder(tokenizer)
        names = [c.split()[0] for c in COUNTS.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            for at, (ident, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = text.as_py()
                if given:
                    spans = [tuple(s.values()) for s in batch.column(2)[at].as_py() or [] if s and None not in s.values()]
                    parts = np.array(sorted(spans), np.int64).reshape(-1, 2)
                    if (parts[1:, 0] < parts[:-1, 1]).any():
                        raise ValueError(f"sections of document {ident} overlap")
                else:
                    parts = line_sections(text)
                spans = token_spans(text.encode(), sizes[np.array(encoding.encode_ordinary(text), np.int64)])
                owner, crossed = attribute(spans, parts, rule)
                counts = np.bincount(owner[owner >= 0], minlength=len(parts))
                n = len(parts)
                out.append((np.full(n, ident if ident is not None else 0), np.arange(n), parts[:, 0], parts[:, 1], counts, crossed, ident is None))
                if (outside := int((owner < 0).sum())):
                    out.append((np.array([ident or 0]), np.array([-1]), np.array([-1]), np.array([-1]), np.array([outside]), np.array([0]), ident is None))
            if out:
                columns = [np.concatenate([o[k] for o in out]) for k in range(6)]
                no_id = np.concatenate([np.full(len(o[0]), o[6]) for o in out])
                outside = columns[1] < 0
                masks = [no_id, None, outside, outside, None, None]
                yield pa.RecordBatch.from_arrays([pa.array(c, t, mask=m) for c, t, m in zip(columns, types, masks)], names)

    return rows.mapInArrow(run, COUNTS)
