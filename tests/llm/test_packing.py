"""Best-fit packing: a plain version, invariants, odd rows."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from drawstat.llm import packing, queries, simhash


def plain_best_fit(pieces, capacity):
    bins, placed = [], []
    for length, s, c in pieces:
        fits = [(capacity - sum(p[0] for p in b) - length, k) for k, b in enumerate(bins)
                if 0 <= capacity - sum(p[0] for p in b) - length and capacity > sum(p[0] for p in b)
                and not any(s >= 0 and p[1] == s or c >= 0 and p[2] == c for p in b)]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[k].append((length, s, c))
        placed.append(k)
    return placed


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(-1, 3), st.integers(-1, 5)), max_size=40))
@settings(max_examples=150, deadline=None)
def test_best_fit_equals_plain_version(pieces):
    assert packing.best_fit(pieces, 20) == plain_best_fit(pieces, 20)


def test_pack_keeps_every_byte_and_no_conflict(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([0, 3, 50, 99, 100, 101, 250]) if i % 5 else rng.randint(0, 400), "hot" if i % 3 == 0 else f"s{i % 7}", f"c{i % 40}")
            for i in range(600)] + [(None, None, None, None), (700, -5, "a", None)]
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, length int, source string, cluster string, bin int")
    found = packing.pack(rows, capacity=100, group_rows=64).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    marks = {d: (s, c) for d, _, s, c in docs}
    for r in found:
        by_doc[r.doc_id].append(r)
        by_bin[r.bin].append(r)
    for ident, length, *_ in docs:
        parts = sorted(by_doc[ident], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == max(0, length or 0) and [r.start for r in parts] == [100 * k for k in range(len(parts))]
    for rows_in in by_bin.values():
        assert sum(r.length for r in rows_in) <= 100 and sorted(r.slot for r in rows_in) == list(range(len(rows_in)))
        for k in (0, 1):
            held = [marks[r.doc_id][k] for r in rows_in if marks[r.doc_id][k] is not None]
            assert len(held) == len(set(held))
    again = packing.pack(rows.repartition(3), capacity=100, group_rows=64).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_groups_equal_the_plain_version(spark):
    rng = random.Random(8)
    docs = sorted(((i, rng.randint(1, 100), f"s{i % 5}", f"c{i % 9}") for i in range(80)), key=lambda d: (-d[1], d[0]))
    rows = spark.createDataFrame(docs, "doc_id bigint, length int, source string, cluster string")
    found = {r.doc_id: r.bin for r in packing.pack(rows, capacity=100, group_rows=1000).collect()}
    expected = plain_best_fit([(n, int(s[1:]), int(c[1:])) for _, n, s, c in docs], 100)
    assert [found[d[0]] for d in docs] == expected


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "same text", "s")] * 50, "doc_id bigint, text string, source string")
    found = packing.pack_texts(rows, group_rows=8).collect()
    assert len(found) == 50 and len({r.bin for r in found}) == 50
    assert packing.pack_texts(rows.limit(0)).count() == 0


def test_near_copies_of_several_sources_never_share_a_bin(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("ron", "lim", "tas", "ver", "nok", "pul")]
    docs = []
    for i in range(20):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(4):  # one other word at the end each
            docs.append((10 * i + k, " ".join([*base, f"end{k}"]), f"s{i}-{k}"))
    docs += [(500, docs[0][1], "other"), (501, None, "a"), (502, None, "b"), (503, "", "c")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect() if r.doc_id < 501}
    found = queries.op6_best_fit(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == sorted(d[0] for d in docs) and len(set(component.values())) < len(component) - 20

    def shared(packed):
        held = defaultdict(list)
        for r in packed:
            if r.doc_id in component:
                held[r.bin].append(component[r.doc_id])
        return sum(len(c) - len(set(c)) for c in held.values())

    assert shared(found) == 0 < shared(packing.pack_texts(rows).collect())
    assert [r.length for r in found if r.doc_id > 500] == [0, 0, 0]
