"""Token attribution against a loop over characters."""

import pytest
from tokenizers import Tokenizer

from drawstat.llm import token_counts
from drawstat.llm.tokens import vocabulary

TEXTS = ["one\ntwo three\n\n\nfour", "", None, "éà \U0001f600\n\n\nx", "no line", "\n", "tail\n", "a\r\nb" * 40]


def brute(text, sections, rule):
    """Sections of every token from the offsets of another library."""
    offsets = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).offsets
    counts, crossing = [0] * len(sections), [0] * len(sections)
    outside = 0
    for a, b in offsets:
        touched = [k for k, (x, y) in enumerate(sections) if x < b and y > a]
        if not touched:
            outside += 1
            continue
        size = lambda k: min(b, sections[k][1]) - max(a, sections[k][0])
        counts[{"start": touched[0], "end": touched[-1], "most": max(touched, key=lambda k: (size(k), -k))}[rule]] += 1
        for k in touched if len(touched) > 1 else ():
            crossing[k] += 1
    return counts, crossing, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines(spark, rule):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, section int")
    found = token_counts.count_sections(rows, rule).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        spans, at = [], 0
        for line in (text or "").split("\n"):
            spans.append((at, min(at + len(line) + 1, len(text or ""))))
            at += len(line) + 1
        spans = [s for s in spans if s[0] < s[1]]
        counts, crossing, _ = brute(text or "", spans, rule)
        assert [(r.char_start, r.char_end, r.n_tokens, r.n_crossing) for r in mine] == [(*s, c, x) for s, c, x in zip(spans, counts, crossing)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_given_sections(spark, rule):
    text = "alphabet soup, and more éè words"
    sections = [(9, 14), (0, 5), (20, 27)]
    rows = spark.createDataFrame([(1, text, [*sections, None]), (None, text, None), (3, text, [])],
                                 "doc_id bigint, text string, parts array<struct<start: int, end: int>>")
    found = token_counts.count_sections(rows, rule, sections="parts").collect()
    counts, crossing, outside = brute(text, sorted(sections), rule)
    mine = {r.section: (r.n_tokens, r.n_crossing) for r in found if r.doc_id == 1}
    assert mine == {**{k: (c, x) for k, (c, x) in enumerate(zip(counts, crossing))}, -1: (outside, 0)}
    assert {(r.section, r.char_start) for r in found if r.doc_id != 1} == {(-1, None)} and sum(r.doc_id is None for r in found) == 1


def test_refusals_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "abcdef", [(0, 3), (2, 5)])], "doc_id bigint, text string, parts array<struct<start: int, end: int>>")
    with pytest.raises(Exception, match="overlap"):
        token_counts.count_sections(rows, sections="parts").collect()
    with pytest.raises(ValueError, match="rule"):
        token_counts.count_sections(rows, "half")
    assert token_counts.count_sections(rows.limit(0)).count() == 0
