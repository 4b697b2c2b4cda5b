"""SimHash against brute force over all pairs."""

import random

import pytest
import xxhash

from drawstat.llm import simhash


def plain_fingerprint(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace(
        "\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_ball_edges_find_all_links(spark, radius):
    rng, prints = random.Random(radius), set()
    for _ in range(12):  # chains and clouds around random centres
        centre = rng.getrandbits(64)
        for _ in range(12):
            p = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p - (1 << 64) if p >> 63 else p)
    rows = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = simhash.ball_edges(rows, radius).collect()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(apart(e.a, e.b) <= radius for e in edges)
    assert plain_components(prints, lambda a, b: apart(a, b) <= radius) == plain_components(
        prints, lambda a, b: (a, b) in {(e.a, e.b) for e in edges} | {(e.b, e.a) for e in edges})


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = words(rng, 400)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(40)] + [base] * 30
    texts += [base + " " + words(rng, 1) for _ in range(10)] + ["", None, " \t\n", "A b", "a B", "É x y z", "é x y z", "one"]
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark):
    docs = corpus()
    prints = {i: plain_fingerprint(t) for i, t in docs}
    expected = plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    rows = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in docs], "doc_id bigint, text string, fp string, label int, component_id int")
    found = simhash.near_duplicates(rows.repartition(5)).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == expected
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_repeated_ids_nulls_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "q r s t u"), (None, "a b c d"), (None, "only here now"), (2, None)], schema)
    found = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(rows).collect())
    assert len(found) == 6 and [f for f in found if f[0] == "None"][0][2] in ("1", "None")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(rows).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d"), (1, "q r s t u"), (None, "only here now"), (2, None)], key=str)
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_long_text_is_hashed_whole():
    long = " ".join(str(i) for i in range(simhash._CHUNK + 10))
    assert simhash.fingerprint(long.encode()) == simhash.fingerprint((long + " ").encode())
    part = long[: len(long) // 40]
    assert simhash.fingerprint(part.encode()) & (1 << 64) - 1 == plain_fingerprint(part)
