"""Merkle manifest against a plain recursive version: sizes around powers, ties, nulls, tampering, other arities."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from drawstat.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **new):
    fields = dict(zip(("doc_id", "source", "lang", "n_chars", "text"), row)) | new
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields.values()])


def levels_of(nodes, arity):
    """All levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(levels, i, arity):
    """(left, right) of node i level by level."""
    way = []
    for level in levels[:-1]:
        run = i - i % arity
        way.append(("".join(level[run:i]), "".join(level[i + 1:run + arity])))
        i //= arity
    return way


def brute(rows, arity=3, tamper=True):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for name, mine in trees.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        grown[name] = levels_of([leaf_of(r) for r in mine], arity)
    upper = levels_of([grown[n][-1][0] for n in names], arity)
    root, out = upper[-1][0] if names else None, []
    for k, name in enumerate(names):
        for i, r in enumerate(trees[name]):
            way = siblings(grown[name], i, arity) + siblings(upper, k, arity)
            node = leaf_of(r)
            if tamper and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                node = leaf_of(r, text=r[4].replace("\n", ""))
            for left, right in way:
                node = h(left, node, right)
            out.append((r[0], leaf_of(r), grown[name][-1][0], root, h(*[a + b for a, b in way]), node, node == root))
    return sorted(out, key=str)


def corpus():
    rng, rows = random.Random(4), []
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 9, "hot": 90, None: 10, "": 28, "Z": 27, "\U0001f600": 5, "￮": 6}
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "no line feed", "one\n", "a\nb\n\nc é", "x\r\ny"])
            rows.append((rng.choice([None, len(rows), rng.randrange(40), -i]), source, rng.choice([None, "", "en"]), rng.choice([None, 0, -5, 10 ** 12]), text))
    return rows + rows[:60:3] + [(7, "a", "en", 1, "long\n" * 300_000)]


def found(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, at int")
    frame.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op12_merkle(spark, str(tmp_path))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_query_equals_plain_version(spark, tmp_path):
    rows = corpus()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found(spark, tmp_path, rows).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "s", "en", 1, "a\n"), (2, "t", "en", 1, "a\n")]])
def test_few_rows(spark, tmp_path, rows):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found(spark, tmp_path, rows).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("arity", [2, 5])
def test_other_arities(spark, arity):
    rows = [r for r in corpus() if r[1] in ("hot", "d", "a", None)]
    made = merkle.verified(merkle.manifest(spark.createDataFrame(rows, SCHEMA), arity=arity)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in made), key=str) == brute(rows, arity, tamper=False)
    assert all(r.verified and r.altered is None for r in made)


def test_any_changed_field_is_seen(spark):
    rows = [(i, "s", "en", i, f"text {i}\n") for i in range(11)]
    root = brute(rows)[0][3]
    assert all(brute([*rows[:4], changed, *rows[5:]])[0][3] != root
               for changed in [(4, "s", "de", 4, "text 4\n"), (4, "s", "en", 5, "text 4\n"), (4, "s", "en", 4, "text 4"), (4, "s", None, 4, "text 4\n")])
    made = merkle.verified(merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.lit("other")))
    assert {(r.root == root, r.verified) for r in made.collect()} == {(True, False)}
