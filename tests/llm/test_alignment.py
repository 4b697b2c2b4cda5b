"""Two tokenizers over the same bytes: against character-wise loops with whole-text encoding, and interval properties."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from drawstat.llm import alignment

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(a, b, text):
    """[(id, start, end)] of both sides, or None where the bytes differ."""
    of, out = alignment.byte_level(), []
    names = {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    for ids, token in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(of[c] for c in names[i])), (b.encode(text), piece)):
        at, listed = 0, []
        for i in ids:
            listed.append((i, at, at + len(token(i))))
            at = listed[-1][2]
        if b"".join(map(token, ids)) != (" " + text).encode():
            return None
        out.append(listed)
    return out


def brute(a, b, docs):
    aligned, count = [], Counter()
    for doc, text in docs:
        both = spans(a, b, text) if text else None
        if both is None:
            aligned.append((doc, 0, 0, 0, [], ""))
            continue
        left, right = both
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        links = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e]
        groups = [",".join(str(i) for i, s, e in left if p <= s < q) + "|" + ",".join(str(i) for i, s, e in right if p <= s < q) for p, q in zip([0, *cuts], cuts)]
        count.update(links)
        aligned.append((doc, len(left), len(right), len(cuts), links, sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return sorted(((d, na, nb, g, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sha)
                   for d, na, nb, g, links, sha in aligned), key=str)


def corpus():
    rng = random.Random(2)
    odd = ["", None, " ", "  ", "a", "\n", " lead", "trail  ", "a   b    c", "▁", "x▁y z", "<|endoftext|> and <s> </s> <unk> <0x41>", "é ü　漢字かな ",
           "\U0001f600\U0001f468‍\U0001f469 ok", "tab\tand\r\nline", "\u0000zero", "1234567890 3.14", "don't we'll I'M", "é combining", "....!!!???", "Ǆ ﬁ ① ²", "word" * 400,
           " \u0085 wide", "﻿mark", "a▁", "�"]
    texts = odd + ["".join(rng.choices("ab \n.é漢<0x>" + "▁" * (k % 9 == 0), k=rng.randrange(60))) for k in range(120)]
    texts += [" ".join(rng.choices(["the", "ention", "über", "Haus,", "re", "<s>", "  "], k=rng.randrange(90))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 200])
def test_alignment_equals_loops(spark, encoders, block_bytes):
    docs = corpus()
    docs += [(None, "the the"), *docs[30:40], (5, "another text of one id")]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, block string, n int")
    found = alignment.align(rows.repartition(5), block_bytes=block_bytes)
    assert found.columns == list(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == brute(*encoders, docs)


def test_chunks_equal_whole_texts(encoders):
    a, b = encoders
    texts = [t for _, t in corpus() if t]
    left, right = alignment.side(alignment.BYTE_VOCABULARY), alignment.side(alignment.PIECE_VOCABULARY)
    for side, whole in ((left, [a.encode(" " + t, add_special_tokens=False).ids for t in texts]), (right, b.encode(texts))):
        for _ in range(2):  # the second time from the cache
            ids, counts = side.encode(texts)
            assert ids.tolist() == [i for x in whole for i in x] and counts.tolist() == list(map(len, whole))


def test_very_long_text(spark, encoders):
    text = "the same ention über " * 60_000
    found = alignment.align(spark.createDataFrame([(1, text), (2, "the same")], "doc_id bigint, text string")).collect()
    ids = encoders[0].encode(" " + text, add_special_tokens=False).ids
    assert {r.doc_id: r.n_a for r in found}[1] == len(ids)
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in found)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), min_size=1, max_size=30))
def test_groups_are_connected_runs(pairs):
    """Intervals in any order and with gaps: two that overlap share a group, and groups do not touch."""
    starts = np.array([s for s, _ in pairs])
    ends = np.array([s + n for s, n in pairs])
    group = alignment.coalesce(starts, ends)
    for i in range(len(pairs)):
        for j in range(len(pairs)):
            if starts[i] < ends[j] and starts[j] < ends[i]:
                assert group[i] == group[j]
            if group[i] < group[j]:
                assert ends[i] <= starts[j]
    assert sorted(set(group.tolist())) == list(range(group.max() + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.lists(st.integers(1, 5), min_size=1, max_size=20), st.integers(0, 6))
def test_expand_finds_every_overlap(a, b, gap):
    a_ends, b_ends = np.cumsum(a), np.cumsum(b) + gap
    a_starts, b_starts = a_ends - a, b_ends - b
    found = set(zip(*(x.tolist() for x in alignment.expand(a_starts, a_ends, b_starts, b_ends))))
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if a_starts[i] < b_ends[j] and b_starts[j] < a_ends[i]}
