"""Line dedup against a sequential version."""

import random

from drawstat.llm import line_dedup


def brute(docs):
    """(id, text) in order -> text and removed lines."""
    first, gone = {}, {}
    for i, (ident, text) in enumerate(docs):
        lines = (text or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if "".join(w).strip(" \t\r\x0b\x0c"):
                if w in first:
                    gone.setdefault(i, set()).update({p, p + 1, p + 2})
                first.setdefault(w, (ident, p))
    return [(ident, text if i not in gone else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone[i]), len(gone.get(i, ())))
            for i, (ident, text) in enumerate(docs)]


def corpus():
    rng, pool = random.Random(1), [f"line number {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool[:12] if i % 3 else pool) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    passage = "\n".join(pool[:7])
    docs += [(60 + i, f"own {i}\n{passage}\nown too {i}") for i in range(20)]
    return docs + [(90, None), (91, ""), (92, "\n\n\n\n\n"), (93, "a\na\na\na\na"), (94, "x\ny"), (95, "x\ny")]


def test_equals_sequential_version(spark):
    docs = corpus()
    rows = spark.createDataFrame([(i, t, -1, 7, "k") for i, t in docs], "doc_id bigint, text string, n_removed int, id int, starts string")
    found = line_dedup.dedup_lines(rows.repartition(6)).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in found if r.text is not None) == sorted(b for b in brute(docs) if b[1] is not None)
    assert [(r.n_lines, r.n_removed) for r in found if r.text is None] == [(0, 0)]
    assert {r.id for r in found} == {7} and {r.starts for r in found} == {"k"}
    # every distinct line survives somewhere
    lines = lambda texts: {x for t in texts if t for x in t.split("\n") if x}
    assert lines(r.text for r in found) == lines(t for _, t in docs)


def test_repeated_ids_count_as_one_place(spark):
    text = "a one\nb two\nc three"
    rows = spark.createDataFrame([(5, text), (5, text), (6, text), (None, text + "\nmore")], "doc_id bigint, text string")
    found = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(rows).collect()), key=str)
    assert found == sorted([(5, text), (5, text), (6, ""), (None, "more")], key=str)


def test_clean_lines_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", 5, "x"), (2, "a\nb\nc\nd", 7, "y")], "doc_id bigint, text string, n_chars bigint, n_lines string")
    found = line_dedup.clean_lines(rows)
    assert found.dtypes == rows.dtypes
    assert sorted(map(tuple, found.collect())) == [(1, "a\nb\nc", 5, "x"), (2, "d", 1, "y")]
    assert line_dedup.clean_lines(rows.limit(0)).count() == 0
