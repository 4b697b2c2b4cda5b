"""Alignment of two tokenizers over the same bytes, by interval coalescing.

Every token is an interval of bytes. All intervals of both sides are sorted by start and the running maximum of
their ends is taken; a group breaks where a start reaches that maximum, so groups lie between the places where
tokens of both sides end. Within a group every pair of overlapping intervals is a link. Many texts are laid end
to end and coalesced at once, since the end of a text is always such a place.

How often two ids are linked in the whole corpus needs a second look at every text, without encoding it
again: texts are worked on in blocks of bounded size, a block keeps its distinct pairs in a dictionary and each text the
places of its pairs there. Only dictionaries are counted and answered by Spark's joins; the answers come back
once per block, not once per link.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import byte_slices, keep
from drawstat.llm.tokens import Encoder, vocabulary

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20     # of text in one dictionary
BLOCK_ROWS = 1 << 16
ENTRIES = 1 << 16         # pairs in one row of a dictionary
CACHED = 300_000          # chunks a worker remembers for each vocabulary
_SPACE = "▁"


def byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A vocabulary: ids of texts, bytes of ids, and decimal ids with the mark that may follow them."""

    def __init__(self, token_bytes: list[bytes], marks: bytes):
        self.size = len(token_bytes)
        self.tokens = np.array([*token_bytes, None], object)[:-1]
        self.lengths = np.array(list(map(len, token_bytes)), np.int64)
        self.written = np.array([[b"%d%c" % (i, m) for i in range(self.size)] for m in marks], object)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class ByteSide(Side):
    """Byte-level BPE of the tokenizers library over a space and the text; names of special tokens are plain text."""

    def __init__(self, path: str):
        self._encoder = Encoder(path, CACHED)
        self._encoder._tokenizer.encode_special_tokens = True
        of = byte_level()
        names = {i: t for t, i in self._encoder._tokenizer.get_vocab().items()}
        # an added token may hold characters that stand for no byte; it is written as it is
        plain = [bytes(of[c] for c in names[i]) if i in names and all(c in of for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        super().__init__(plain, b",|")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self._encoder.encode(pa.array([" " + t for t in texts], pa.large_string()))
        return ids.astype(np.int64), counts


class PieceSide(Side):
    """SentencePiece BPE, which puts the space itself. No piece holds a space after another character, so no token
    crosses the beginning of a run of spaces, and equal chunks between these are encoded once."""

    def __init__(self, path: str):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._known: dict[str, bytes] = {}
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self._space = self._model.piece_to_id(_SPACE)  # a chunk that is one space, at the end of a text
        self._chunks = self._space != self._model.unk_id() and all(_SPACE not in p.lstrip(_SPACE) for p in pieces)
        super().__init__([bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)], b",;")

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self._chunks:
            ids = self._encode_all(texts)
            return np.fromiter((i for x in ids for i in x), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))
        texts = [t.replace(_SPACE, " ") for t in texts]  # the model takes one for the other
        data = "".join([" " + t for t in texts]).encode()
        ends = np.cumsum([1 + len(t.encode()) for t in texts])
        raw = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (raw[1:] == 32) & (raw[:-1] != 32)
        cut[0] = True
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        words = chunks.dictionary.to_pylist()
        if len(self._known) > CACHED:
            self._known.clear()
        fresh = [w for w in words if w not in self._known]
        for w, ids in zip(fresh, self._encode_all([w[1:] for w in fresh])):
            self._known[w] = np.array([self._space] if w == " " else ids, np.uint32).tobytes()
        found = [self._known[w] for w in words]
        flat = np.frombuffer(b"".join(found), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = chunks.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        until = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(until[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - until[:-1], lengths)
        return flat[at], np.diff(until[np.searchsorted(cuts, np.concatenate([[0], ends]))])


_SIDES: dict[str, Side] = {}


def side(name: str) -> Side:
    """One per worker process, by the kind of file."""
    path = vocabulary(name)
    if path not in _SIDES:
        _SIDES[path] = (ByteSide if path.endswith(".json") else PieceSide)(path)
    return _SIDES[path]


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group of every interval, counted from 0 in order of start: a group breaks where a start reaches the running
    maximum of the ends."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def expand(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all overlapping pairs of two ascending runs of intervals, in order of A."""
    first = np.searchsorted(b_ends, a_starts, side="right")
    many = np.searchsorted(b_starts, a_ends, side="left") - first
    total = np.cumsum(many)
    in_a = np.repeat(np.arange(len(a_starts)), many)
    return in_a, np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - many), many)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, which may be 0."""
    until = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return until[ends] - until[ends - counts]


class Aligned:
    """Texts of one slice: counts per text, written groups, and the id pair of every link."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links, self.digests = (*(np.zeros(n, np.int64) for _ in range(4)), [""] * n)
        self.pairs = np.empty(0, np.int64)
        rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        if not len(rows):
            return
        given = [texts[i] for i in rows]
        (a_ids, a_counts), (b_ids, b_counts) = a.encode(given), b.encode(given)
        same = self._same_bytes(given, a, a_ids, a_counts) & self._same_bytes(given, b, b_ids, b_counts)
        if not same.all():
            a_ids, b_ids = a_ids[np.repeat(same, a_counts)], b_ids[np.repeat(same, b_counts)]
            rows, a_counts, b_counts = rows[same], a_counts[same], b_counts[same]
            if not len(rows):
                return
        a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
        a_starts, b_starts = a_ends - a.lengths[a_ids], b_ends - b.lengths[b_ids]
        group = coalesce(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]))
        in_a, in_b = expand(a_starts, a_ends, b_starts, b_ends)
        self.pairs = a_ids[in_a] * b.size + b_ids[in_b]
        a_group, b_group = group[:len(a_ids)], group[len(a_ids):]
        self.n_a[rows], self.n_b[rows] = a_counts, b_counts
        self.n_links[rows] = _sums(np.bincount(in_a, minlength=len(a_ids)), a_counts)
        a_last = np.cumsum(a_counts) - 1
        self.n_groups[rows] = np.diff(a_group[a_last], prepend=-1)
        for i, text in zip(rows.tolist(), self._written(a, a_ids, a_group, a_counts, b, b_ids, b_group, b_counts)):
            self.digests[i] = sha256(text).hexdigest()

    @staticmethod
    def _same_bytes(texts: list[str], side: Side, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text are its bytes after a space."""
        wanted = [(" " + t).encode() for t in texts]
        tokens = side.tokens[ids].tolist()
        equal = _sums(side.lengths[ids], counts) == np.fromiter(map(len, wanted), np.int64, len(wanted))
        if not equal.all() or b"".join(tokens) != b"".join(wanted):
            ends = np.cumsum(counts)
            equal = np.array([b"".join(tokens[e - n:e]) == w for w, e, n in zip(wanted, ends.tolist(), counts.tolist())])
        return equal

    @staticmethod
    def _written(a: Side, a_ids: np.ndarray, a_group: np.ndarray, a_counts: np.ndarray, b: Side, b_ids: np.ndarray, b_group: np.ndarray,
                 b_counts: np.ndarray) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text. In a group the ids of A come first; each carries the mark after it."""
        groups = int(a_group[-1]) + 1
        a_before = np.searchsorted(a_group, np.arange(groups + 1))
        b_before = np.searchsorted(b_group, np.arange(groups + 1))
        parts = np.empty(len(a_ids) + len(b_ids), object)
        a_mark, b_mark = np.ones(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)
        a_mark[:-1], b_mark[:-1] = np.diff(a_group), np.diff(b_group)
        parts[np.arange(len(a_ids)) + b_before[a_group]] = a.written[a_mark, a_ids]
        parts[np.arange(len(b_ids)) + a_before[b_group + 1]] = b.written[b_mark, b_ids]
        listed, ends = parts.tolist(), np.cumsum(a_counts + b_counts)
        return (b"".join(listed[e - n:e])[:-1] for e, n in zip(ends.tolist(), (a_counts + b_counts).tolist()))


_BLOCKS = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, "
           "first int, pairs array<bigint>, seen array<bigint>")
_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
                     ("places", pa.binary()), ("times", pa.binary()), ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64()))])


def _batch(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _block(number: int, ids: list, parts: list[Aligned]) -> Iterator[pa.RecordBatch]:
    """The rows of a finished block: its dictionary in rows of bounded size, then its texts with their distinct pairs."""
    n_links = np.concatenate([p.n_links for p in parts])
    place, distinct = pd.factorize(np.concatenate([p.pairs for p in parts]))
    seen = np.bincount(place, minlength=len(distinct))
    starts = np.arange(0, len(distinct), ENTRIES)
    if len(starts):
        yield _batch(len(starts), block=pa.array(np.full(len(starts), number)), first=pa.array(starts.astype(np.int32)),
                     pairs=pa.array([distinct[s:s + ENTRIES] for s in starts], pa.list_(pa.int64())),
                     seen=pa.array([seen[s:s + ENTRIES] for s in starts], pa.list_(pa.int64())))
    width = max(1, len(distinct))
    keyed, times = np.unique(np.repeat(np.arange(len(ids)), n_links) * width + place, return_counts=True)
    cuts = np.searchsorted(keyed, np.arange(len(ids) + 1) * width)
    places, times = (keyed % width).astype(np.uint32), times.astype(np.uint32)
    cut = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    yield _batch(len(ids), block=pa.array(np.full(len(ids), number)), doc_id=pa.array(ids, pa.int64()), n_links=pa.array(n_links),
                 **{c: pa.array(np.concatenate([getattr(p, c) for p in parts])) for c in ("n_a", "n_b", "n_groups")},
                 groups_sha256=pa.array([d for p in parts for d in p.digests]),
                 places=pa.array([places[s:e].tobytes() for s, e in cut], pa.binary()), times=pa.array([times[s:e].tobytes() for s, e in cut], pa.binary()))


def encode_blocks(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written blocks of ``docs`` (doc_id, text): one row per text, and the dictionary of every block. A number of a block
    is that of its task and its place in it, so it is the same when a lost task runs again."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, number = side(a), side(b), TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for at, to in byte_slices(texts, 1 << 20):
                given = texts.slice(at, to - at).to_pylist()
                parts.append(Aligned(given, left, right))
                ids += batch.column(0).slice(at, to - at).to_pylist()
                held += int(parts[-1].n_links.sum()) * 3 + 1  # a link takes about three bytes of text
                if held >= block_bytes or len(ids) >= BLOCK_ROWS:
                    yield from _block(number, ids, parts)
                    ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield from _block(number, ids, parts)

    return keep(rows.mapInArrow(run, _BLOCKS), "alignment-blocks")


def entries(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, seen): the dictionaries, one row per pair of a block."""
    listed = blocks.filter("first IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("pairs", "seen")).alias("step", "e"))
    return listed.select("block", (F.col("first") + F.col("step")).alias("place"), F.col("e.pairs").alias("pair"), F.col("e.seen").alias("seen"))


def lexicon(blocks: DataFrame, b_size: int) -> DataFrame:
    """(pair, a_id, b_id, n, best): how many links of the corpus hold the pair, and whether no pair of its B id has more.
    An id has at most as many partners as the other vocabulary has ids, and counts are combined before they move."""
    counted = keep(entries(blocks).groupBy("pair").agg(F.sum("seen").alias("n")).select(
        "pair", F.expr(f"pair div {b_size}").alias("a_id"), F.expr(f"pair % {b_size}").alias("b_id"), "n"), "pairs")
    highest = counted.groupBy("b_id").agg(F.max("n").alias("highest"))
    return keep(counted.join(highest, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best")), "lexicon")


_RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _answer(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of a block with the sums over their links."""
    size = answers.num_rows
    n, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    if size:
        place = answers.column("place").to_numpy()
        n[place], best[place] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
    joined = [np.frombuffer(b"".join(texts.column(c).to_pylist()), np.uint32).astype(np.int64) for c in ("places", "times")]
    counts = np.fromiter(map(len, texts.column("places").to_pylist()), np.int64, texts.num_rows) // 4
    out = {c: texts.column(c) for c in _RESULT if c in texts.column_names}
    out["n_best"] = pa.array(_sums(best[joined[0]] * joined[1], counts))
    out["count_sum"] = pa.array(_sums(n[joined[0]] * joined[1], counts))
    return pa.table({c: out[c] for c in _RESULT})


def align(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose pair no other pair of its B id outnumbers in the corpus), count_sum (of the corpus-wide
    numbers of its links) and groups_sha256.

    A null or empty text, and one whose tokens are not the bytes of a space and the text on both sides, has zeros and
    an empty digest, and its links count nowhere. Rows that repeat are aligned, and count, as often as they occur. A
    text of any length is aligned whole, in one block of its own if need be. An empty table gives no rows."""
    blocks = encode_blocks(docs, a, b, block_bytes)
    found = lexicon(blocks, side(b).size).select("pair", "n", "best")
    answers = keep(entries(blocks).select("block", "place", "pair").join(found, "pair").select("block", "place", "n", "best"), "answers")
    texts = blocks.filter("first IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in _RESULT)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer, schema)
