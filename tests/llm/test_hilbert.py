"""Hilbert shards: the curve, the law of rows, pruning, odd rows."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from drawstat.llm import hilbert

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def corpus(n=400):
    rng = np.random.default_rng(1)
    return [(i, "same" if i % 3 == 0 else f"text {i} é" * int(rng.integers(1, 9)), ["en", "de", None][int(rng.integers(3))], f"src{int(rng.integers(9))}",
             int(rng.integers(1, 5000)) if i % 50 else None) for i in range(n)]


def test_rows_law(spark):
    docs = corpus() + [(1000, None, None, None, None), (None, "", "en", "s", 1)]
    rows = spark.createDataFrame([(*d, 5) for d in docs], SCHEMA + ", shard int")
    found = hilbert.shard_rows(rows.repartition(7), shards=24).collect()
    assert len(found) == len(docs)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append((r.slot, r.curve))
    for held in slots.values():
        assert [s for s, _ in sorted(held)] == list(range(len(held))) and [c for _, c in sorted(held)] == sorted(c for _, c in held)
    ends = [(min(c for _, c in slots[k]), max(c for _, c in slots[k])) for k in range(24)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    by_id = {r.doc_id: r for r in found}
    for i, text, *_ in docs:
        data = (text or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 8, zlib.crc32(data))
    again = hilbert.shard_rows(rows.repartition(3), shards=24).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in again} == {r.doc_id: (r.shard, r.slot) for r in found}


def plain_cells(values, bits, numeric):
    """Quantile cells by sorting all values: texts by the rows before them, numbers by the cut points they exceed."""
    held = sorted((v for v in values if v is not None), key=(lambda v: v) if numeric else (lambda v: v.encode()))
    if numeric:
        cuts = {held[math.ceil(i / (1 << bits) * len(held)) - 1] for i in range(1, 1 << bits)} if held else set()
        return {v: sum(v > c for c in cuts) if v is not None else 0 for v in set(values)}
    first = {v: i for i, v in reversed(list(enumerate(held)))}
    return {v: 0 if v is None else first[v] * (1 << bits) // len(held) for v in set(values)}


def test_curve_equals_sort_and_cut(spark):
    """Sources that share a long prefix, one of them a third of all rows."""
    rng = np.random.default_rng(6)
    docs = [(i, f"t{i}", ["en", "de", "fr", None][i % 4], "https://example.org/very/long/prefix/" + ("hot" if i % 3 == 0 else str(int(rng.integers(200)))),
             int(rng.integers(1, 9000)) if i % 40 else None) for i in range(3000)]
    cells = [plain_cells([d[k] for d in docs], hilbert.BITS, k == 4) for k in (2, 3, 4)]
    grid = np.array([[c[d[k]] for c, k in zip(cells, (2, 3, 4))] for d in docs])
    expected = dict(zip([d[0] for d in docs], hilbert.curve_index(grid, hilbert.BITS).tolist()))
    found = hilbert.shard_rows(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()
    assert {r.doc_id: r.curve for r in found} == expected
    assert len({c for v, c in cells[1].items()}) > 15  # the shared prefix does not hide the dimension
    order = sorted(docs, key=lambda d: (expected[d[0]], zlib.crc32(d[1].encode()), d[0]))
    sizes = [len(docs) // 24 + (k < len(docs) % 24) for k in range(24)]
    assert Counter(r.shard for r in found) == {k: n for k, n in Counter(r.shard for r in found).items() if n in set(sizes)}
    assert [d[0] for d in order] == [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]


def test_files_prune_in_every_dimension(spark, tmp_path):
    rows = spark.createDataFrame([d for d in corpus(2000) if d[2] and d[4]], SCHEMA)
    hilbert.write_shards(rows, str(tmp_path / "s"), shards=24)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, rows.collect()))
    seen = defaultdict(list)
    for r in back.collect():
        seen[r.shard].append(r)
    for value in (lambda r: r.source == "src4", lambda r: 100 < r.n_chars < 300):
        assert sum(any(map(value, rows_in)) for rows_in in seen.values()) <= 14
    span = lambda rs: (min(r.n_chars for r in rs), max(r.n_chars for r in rs))
    assert np.mean([b - a for a, b in map(span, seen.values())]) < 2500


def test_few_rows_and_empty_table(spark):
    rows = spark.createDataFrame(corpus(3) + corpus(1), SCHEMA)
    assert sorted(r.slot for r in hilbert.shard_rows(rows).collect()) == [0, 0, 0, 0]
    assert hilbert.shard_rows(rows.limit(0)).count() == 0
