"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart meet if each walks half of the way. With h = radius // 2, every
fingerprint emits all variants within h flips. For an odd radius the remaining bit is walked by one side
only: fingerprints at an odd distance differ in parity, so those of even parity emit variants with h + 1
flips as well; of any 2h + 1 differing bits h + 1 lie in the same 32-bit half, so flips inside one half are enough.

All fingerprints that reach a variant lie in a ball around it, so a group has a bound that no input can
exceed (2,081 for radius 3). Those within h flips of the variant (the core) are at most ``radius`` from every
other member; linking all members to the smallest core member keeps every link's two ends connected and
emits no pair outside the radius. Edges are linear in the members, never all pairs.

Variants travel packed: one row per (batch, bucket) instead of one row each. They are mixed by an odd factor,
sorted and laid out byte by byte, so that their leading bytes and the walk numbers compress.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawstat.llm.common import components, keep, slots, text_key

BITS = 64
SEED = 42
RADIUS = 3
SHINGLE = 3
# shingles hashed before their bits are added up, and variants a task of the meeting stage holds
_CHUNK = 1 << 18
_VARIANTS_PER_TASK = 2_000_000
_FINGERPRINTS_PER_BATCH = 4096
_FACTOR = 0x9E3779B97F4A7C15  # odd, so mixing can be undone


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text as a signed integer; zero without words. ASCII letters are lowered and
    words end at ASCII white space; bytes.lower and bytes.split do exactly that."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64).view(np.int64)[0])
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    first, last = starts[: len(words) - words_per_shingle + 1], ends[words_per_shingle - 1:] - 1
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(first), _CHUNK):
        a, b = first[i:i + _CHUNK].tolist(), last[i:i + _CHUNK].tolist()
        hashes = np.fromiter((digest(plain[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or b"", words_per_shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())],
                                             ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"),
                       F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def _flips(count: int, positions: range) -> list[int]:
    return [sum(1 << p for p in chosen) for chosen in itertools.combinations(positions, count)]


def flip_masks(radius: int) -> tuple[np.ndarray, int]:
    """Masks of all walks, and how many of them make up the core. Masks beyond the core are for even parity."""
    half = radius // 2
    core = [m for n in range(half + 1) for m in _flips(n, range(BITS))]
    extra = []
    if radius % 2:
        extra = _flips(half + 1, range(BITS // 2)) + _flips(half + 1, range(BITS // 2, BITS))
    return np.array(core + extra, dtype=np.uint64), len(core)


def _pack(mixed: np.ndarray, codes: np.ndarray) -> bytes:
    planes = mixed.view(np.uint8).reshape(-1, 8).T.tobytes() + codes.view(np.uint8).reshape(-1, 2).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(10, -1)
    return np.ascontiguousarray(planes[:8].T).view(np.uint64)[:, 0], np.ascontiguousarray(planes[8:].T).view(np.uint16)[:, 0]


def ball_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) edges among distinct fingerprints ``fp`` whose components are those of the links within ``radius``."""
    spark = distinct.sparkSession
    masks, core = flip_masks(radius)
    parts = max(slots(spark), distinct.count() * len(masks) // _VARIANTS_PER_TASK + 1)
    shift, most = np.uint64(32), np.uint64(parts)
    factor, back = np.uint64(_FACTOR), np.uint64(pow(_FACTOR, -1, 1 << 64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for i in range(0, len(every), _FINGERPRINTS_PER_BATCH):
                fps = every[i:i + _FINGERPRINTS_PER_BATCH]
                even = fps[np.bitwise_count(fps) % 2 == 0]
                variants = np.concatenate([(fps[:, None] ^ masks[None, :core]).ravel(), (even[:, None] ^ masks[None, core:]).ravel()])
                codes = np.concatenate([np.tile(np.arange(core, dtype=np.uint16), len(fps)),
                                        np.tile(np.arange(core, len(masks), dtype=np.uint16), len(even))])
                mixed = variants * factor
                order = np.argsort(mixed)
                mixed, codes = mixed[order], codes[order]
                bucket = ((mixed >> shift) * most) >> shift  # in the order of the mixed variants
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                blobs = [_pack(mixed[a:b], codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, c = [np.empty(0, np.uint64)], [np.empty(0, np.uint16)]
        for batch in batches:
            for value in batch.column(1):
                mixed, codes = _unpack(value.as_py())
                z.append(mixed)
                c.append(codes)
        z, c = np.concatenate(z), np.concatenate(c)
        order = np.argsort(z)
        z = z[order]
        same = z[1:] == z[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(z) else np.empty(0, bool)
        z, c = z[shared], c[order[shared]]
        if not len(z):
            return
        fps = ((z * back) ^ masks[c]).view(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(z)) + 1])
        none = np.iinfo(np.int64).max
        centre = np.minimum.reduceat(np.where(c < core, fps, none), starts)
        has_core = np.logical_or.reduceat(c < core, starts)
        sizes = np.diff(np.concatenate([starts, [len(z)]]))
        centre, has_core = np.repeat(centre, sizes), np.repeat(has_core, sizes)
        near = np.bitwise_count(fps.view(np.uint64) ^ centre.view(np.uint64)) <= radius  # the verification
        links = has_core & near & (fps != centre)
        pairs = np.unique(np.stack([fps[links], centre[links]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    packed = distinct.select("fp").repartition(slots(spark), "fp").mapInArrow(emit, "bucket int, blob binary")
    return packed.repartitionById(parts, F.col("bucket")).mapInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, text_key, fp, label and
    component_id, the smallest doc_id reachable over links of at most ``radius`` differing bits. ``label``
    names the component by a fingerprint.

    A null or empty text has fingerprint zero and links like any other. A null doc_id never is the smallest
    unless its component has no other. Rows that repeat an id stay separate rows. An empty table gives no rows."""
    prints = keep(fingerprints(docs, words_per_shingle), "fingerprints")
    # equal fingerprints, a third of all rows or more, become one row before anything is compared
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(keep(ball_edges(distinct, radius), "links"))
    labelled = distinct.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label"))
    labelled = keep(labelled, "labelled")
    smallest = keep(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    members = keep(labelled.select("fp", "label").join(smallest, "label"), "members")
    return prints.join(members, "fp").select("doc_id", "text_key", "fp", "label", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words_per_shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one row left of every group: the one with the smallest doc_id (of several
    rows with that id, the one with the smallest text key, once). All columns of ``docs`` come back."""
    groups = near_duplicates(docs, radius, words_per_shingle)
    chosen = keep(groups.filter("doc_id <=> component_id").groupBy("label").agg(
        F.min("text_key").alias("kept_key"), F.min("component_id").alias("kept_id")).drop("label"), "chosen")
    key = text_key(docs["text"])
    rows = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["kept_id"]) & (key == chosen["kept_key"]), "left_semi")
    rows = keep(rows, "survivors")
    if rows.count() == chosen.count():
        return rows
    # rows that repeat an id and its text: equal rows collapse before they move, then one of the rest stays
    rows, nth = rows.dropDuplicates(), "_" + "_".join(docs.columns)
    once = Window.partitionBy("doc_id", text_key(F.col("text"))).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    return rows.withColumn(nth, F.row_number().over(once)).filter(F.col(f"`{nth}`") == 1).drop(nth)
