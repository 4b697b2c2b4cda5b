"""Token ids as one wavelet matrix per shard.

Plane l holds bit l (from the top) of every id, in the order in which the planes above have sorted the ids: zeros
first, then ones. With counts of ones at every 512th position the planes answer access, count and
occurrence queries without the ids themselves. A shard is one file: a header, then separately compressed
sections (document ids, their lengths, and per plane its bits and counts).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawstat.llm.common import byte_slices, keep, slots, text_key
from drawstat.llm.tokens import Encoder
from drawstat.streaming.storage import shared_folder

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 1 << 20
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
_SLICE_BYTES = 1 << 23


class WaveletMatrix:
    """Succinct sequence of integers below 2**bits."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int], ones_before: list[np.ndarray]):
        self.size, self.planes, self.zeros, self.ones_before = size, planes, zeros, ones_before

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        row, planes, zeros, ones_before = values.astype(kind), [], [], []
        for level in range(bits):
            bit = (row >> kind(bits - 1 - level)) & kind(1) != 0
            packed = np.packbits(bit, bitorder="little")
            full = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            full[:len(packed)] = packed
            counts = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed)
            ones_before.append((np.cumsum(counts, dtype=np.uint32) - counts).astype(np.uint32))
            zeros.append(int(len(row) - counts.sum()))
            row = np.concatenate([row[~bit], row[bit]])
        return cls(len(values), planes, zeros, ones_before)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i."""
        if i >= self.size:
            return self.size - self.zeros[level]
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8:i >> 3]
        tail = int(self.planes[level][i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ones_before[level][block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def access(self, i: int) -> int:
        """The value at position i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position i."""
        low, high = self._range(value, 0, i)
        return high - low

    def count(self, value: int, first: int, last: int) -> int:
        """Occurrences of ``value`` in [first, last)."""
        low, high = self._range(value, first, last)
        return high - low

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        bits = len(self.planes)
        if value >> bits or value < 0:
            return 0, 0
        low, high = max(0, min(low, self.size)), max(0, min(high, self.size))
        for level in range(bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, max(low, high)

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k (from 0) of ``value``, or -1."""
        low, high = self._range(value, 0, self.size)
        if not 0 <= k < high - low:
            return -1
        i, bits = low + k, len(self.planes)
        for level in reversed(range(bits)):
            if value >> (bits - 1 - level) & 1:
                i = self._find(level, i - self.zeros[level], True)
            else:
                i = self._find(level, i, False)
        return i

    def _find(self, level: int, k: int, one: bool) -> int:
        """Position of one (or zero) number k of a plane: the block by binary search, then its bits."""
        before = self.ones_before[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")[:self.size - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def occurrences(self, value: int) -> list[int]:
        """All positions of ``value``."""
        return [self.select(value, k) for k in range(self.rank(value, self.size))]

    def decode(self) -> np.ndarray:
        """The whole sequence: planes undone from the last to the first."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        row = np.zeros(self.size, kind)
        for level in reversed(range(bits)):
            bit = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            out = np.empty(self.size, kind)
            out[~bit] = row[:self.zeros[level]]
            out[bit] = row[self.zeros[level]:] | kind(1 << (bits - 1 - level))
            row = out
        return row

    def sections(self) -> list[bytes]:
        return [x.tobytes() for pair in zip(self.planes, self.ones_before) for x in pair]


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """One shard file."""
    none = [i for i, d in enumerate(doc_ids) if d is None]
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    packer = zstandard.ZstdCompressor(level=1)
    sections = [packer.compress(s) for s in [ids.tobytes(), lengths.astype(np.uint64).tobytes(), *matrix.sections()]]
    head = json.dumps({"size": matrix.size, "docs": len(ids), "bits": len(matrix.planes), "zeros": matrix.zeros, "no_id": none,
                       "sections": [len(s) for s in sections]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(sections)


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    (n,) = struct.unpack("<I", data[4:8])
    head, at, parts = json.loads(data[8:8 + n]), 8 + n, []
    for size in head["sections"]:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at:at + size]))
        at += size
    ids: list[int | None] = np.frombuffer(parts[0], np.int64).tolist()
    for i in head["no_id"]:
        ids[i] = None
    planes = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
    ones = [np.frombuffer(p, np.uint32) for p in parts[3::2]]
    return ids, np.frombuffer(parts[1], np.uint64).astype(np.int64), WaveletMatrix(head["size"], planes, head["zeros"], ones)


SHARDS = "part int, shard int, path string, n_docs bigint, n_tokens bigint"


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer: str = VOCABULARY, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order, ``end_id`` after each,
    and write shards of about ``shard_tokens`` ids below ``folder``. Returns the committed list of shards with
    ``start``, the number of ids before them.

    A null or empty text is its end id alone. Rows without an id come first; rows that share one are ordered
    by their text key. A document is never cut, so one longer than a shard fills one of its own."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "wavelet")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    ordered = rows.repartitionByRange(slots(spark), "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = Encoder.shared(tokenizer), TaskContext.get().partitionId(), 0
        bits = max(encoder.size - 1, end_id).bit_length()
        ids, lengths, parts, held = [], [], [], 0
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path)

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wvm"
            matrix = WaveletMatrix.build(np.concatenate(parts), bits)
            store, path = pa.fs.FileSystem.from_uri(name)
            with store.open_output_stream(path, compression=None) as out:
                out.write(to_bytes(ids, np.array(lengths), matrix))
            values = ([part], [shard], [name], [len(ids)], [held])
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], [c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            texts = batch.column(2)
            for at, to in byte_slices(texts, _SLICE_BYTES):
                tokens, counts = encoder.encode(texts.slice(at, to - at))
                ends = np.cumsum(counts)
                for i, n, end in zip(range(at, to), counts.tolist(), ends.tolist()):
                    parts += [tokens[end - n:end], np.array([end_id], np.uint32)]
                    ids.append(batch.column(0)[i].as_py())
                    lengths.append(n + 1)
                    held += n + 1
                    if held >= shard_tokens:
                        yield flush()
                        ids, lengths, parts, held, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    shards = keep(ordered.mapInArrow(run, SHARDS), "wavelet-shards")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(parts_before), F.lit(0)).alias("before"))
    inside = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inside.join(totals, "part").select("part", "shard", "path", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def _open(path: str) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    store, inner = pa.fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as file:
        return from_bytes(file.read())


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document of the shards read back: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers)."""
    spark = shards.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, lengths, matrix = _open(path)
                data, ends = matrix.decode().astype("<u4").tobytes(), np.cumsum(lengths)
                crcs = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.select("path", "start").repartition(slots(spark), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def count_tokens(shards: DataFrame, values: list[int]) -> DataFrame:
    """(token, n): occurrences of the given ids, from the planes alone."""
    spark = shards.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                matrix = _open(path)[2]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([matrix.rank(v, matrix.size) for v in values], pa.int64())],
                                                 ["token", "n"])

    found = shards.select("path").repartition(slots(spark), "path").mapInArrow(run, "token bigint, n bigint")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def find_token(shards: DataFrame, value: int) -> DataFrame:
    """(doc_id, position): every occurrence of an id and its place in the document."""
    spark = shards.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                ids, lengths, matrix = _open(path)
                places, ends = np.array(matrix.occurrences(value), np.int64), np.cumsum(lengths)
                owner = np.searchsorted(ends, places, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([ids[o] for o in owner], pa.int64()), pa.array(places - (ends - lengths)[owner])],
                                                 ["doc_id", "position"])

    return shards.select("path").repartition(slots(spark), "path").mapInArrow(run, "doc_id bigint, position bigint")
