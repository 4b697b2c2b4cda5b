"""Spaced seeds: plan, planted overlaps, both joins, odd rows."""

import contextlib
import io
import itertools
import random

from drawstat.llm import decontaminate


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def brute(docs, items):
    """Best aligned window over every diagonal of every pair of a text and an item, whatever the masks."""
    split = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split()]
    out = set()
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v, best = split(item), None
            c = min(20, len(v))
            for g in range(-len(v) + 1, len(w)) if set(v) & set(w) else ():
                same = [0 <= q + g < len(w) and w[q + g] == x for q, x in enumerate(v)]
                k = max(sum(same[a:a + c]) for a in range(len(v) - c + 1)) if sum(same) >= 0.8 * c else 0
                if k >= 0.8 * c and (best is None or k > best[1]):
                    best = (g, k, c)
            if best:
                out.add((d, i, *best))
    return out


def corpus():
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([14, 14, 20, 35, 5, 3, 8, 1, 2, 4, 6, 7, 9, 10, 12, 13])]
    docs = [(i, " ".join(words(rng, 60))) for i in range(10)]
    for k, (i, item) in enumerate(items):
        w = item.split()
        for subs in range(0, 5):
            changed = list(w)
            for p in rng.sample(range(len(w)), min(subs, len(w))):
                changed[p] = "other"
            docs.append((100 + 10 * k + subs, " ".join(words(rng, 7) + changed + words(rng, 5)).upper().replace(" ", ", ")))
    docs += [(900, " ".join(items[3][1].split()[5:27])), (901, None), (902, ""), (903, items[0][1] + " " + items[0][1])]
    return docs, items + [(50, None), (51, ""), (52, items[0][1])]


def test_overlaps_equal_brute_force_on_both_joins(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 0, "c") for i, t in docs + docs[:3]], "doc_id bigint, text string, item_id int, words string")
    i = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    expected = brute(docs, items)
    for few in (decontaminate.BROADCAST_SEEDS, 0):
        found = decontaminate.overlaps(d, i, broadcast_seeds=few).collect()
        assert {(r.doc_id, r.item_id, r.doc_start, r.matched, r.compared) for r in found} == expected
        assert len(found) == len(expected)
    whole = {r[0] for r in expected}
    # short items: copied whole they are found from one token on, with one replaced from five on, with two from ten on
    assert {140 + 10 * k for k in range(12)} <= whole and {141, 161, 201, 211, 221, 231, 241, 251, 232, 242, 252} <= whole
    assert not whole & {151, 171, 181, 191, 142, 162}
    # every item of 14 tokens or more is found with up to two tokens replaced, none in the clean documents
    assert {100, 101, 102, 110, 111, 112, 120, 121, 122, 130, 131, 132, 140, 900, 903} <= whole and not whole & set(range(10))
    kept = decontaminate.without_overlaps(d, i)
    assert kept.columns == d.columns and sorted({r.doc_id for r in kept.collect()}) == sorted({x for x, _ in docs} - whole)


def test_no_python_in_the_plan(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        decontaminate.overlaps(read("documents"), read("benchmark")).explain("formatted")
    assert "Arrow" not in text.getvalue() and "Python" not in text.getvalue() and "Cartesian" not in text.getvalue()


def test_null_ids_and_empty_tables(spark):
    passage = " ".join(words(random.Random(2), 20))
    d = spark.createDataFrame([(None, passage), (1, passage), (None, "clean words only")], "doc_id bigint, text string")
    i = spark.createDataFrame([(0, passage)], "item_id bigint, text string")
    assert sorted((str(r.doc_id), r.matched) for r in decontaminate.overlaps(d, i).collect()) == [("1", 20), ("None", 20)]
    assert [r.text for r in decontaminate.without_overlaps(d, i).collect()] == ["clean words only"]
    assert decontaminate.overlaps(d.limit(0), i).count() == 0 and decontaminate.without_overlaps(d, i.limit(0)).count() == 3


def test_runs_leave_no_allowed_difference_out():
    """Every way to replace as many tokens as the similarity allows leaves one run of a short item whole."""
    for length in range(1, decontaminate.SPACED_TOKENS):
        lost = length - next(k for k in range(length + 1) if k >= 0.8 * length - 1e-9)
        for replaced in itertools.combinations(range(length), lost):
            assert any(not set(replaced) & set(range(a, a + n)) for a, n in decontaminate.parts(length, 0.8))


def test_very_long_text(spark):
    rng = random.Random(8)
    item, text = words(rng, 15), words(rng, 120_000)
    text[100_000:100_015] = item
    d = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:99_000]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(text[50_000:50_003]))], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.matched) for r in decontaminate.overlaps(d, i).collect()) == [
        (1, 0, 100_000, 15), (1, 1, 50_000, 3), (2, 1, 50_000, 3)]
