"""Wavelet shards: structure, files, tokens, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawstat.llm import wavelet
from drawstat.llm.tokens import Encoder


@given(st.lists(st.integers(0, 70_000), max_size=60) | st.lists(st.integers(0, 3), min_size=500, max_size=1500))
@settings(max_examples=60, deadline=None)
def test_matrix_equals_the_list(values):
    array = np.array(values, np.uint32)
    data = wavelet.to_bytes([1, None], np.array([len(values), 0]), wavelet.WaveletMatrix.build(array, 17))
    ids, lengths, matrix = wavelet.from_bytes(data)
    assert ids == [1, None] and lengths.tolist() == [len(values), 0]
    assert matrix.decode().tolist() == values
    n = len(values)
    for i in {0, 1, n // 3, n // 2, n - 1} & set(range(n)):
        assert matrix.access(i) == values[i]
    for v in [*sorted(set(values))[:4], 5, 99_999, 1 << 20]:
        places = [i for i, x in enumerate(values) if x == v]
        assert matrix.rank(v, n) == len(places) and matrix.rank(v, n // 2) == sum(p < n // 2 for p in places)
        assert matrix.count(v, n // 4, n // 2) == sum(n // 4 <= p < n // 2 for p in places)
        assert matrix.occurrences(v) == places and matrix.select(v, len(places)) == -1
    with pytest.raises(IndexError):
        matrix.access(n)


TEXTS = ["", "a", "  a  b ", "x y z ", "\n\n foo\t\tbar  ", "a <|endoftext|> q", "é à  ñ　 b", "it's we'll  12 34,5!", "no" * 500, "Wort für Wort, Wort"]


@given(st.lists(st.text(alphabet=" \n\t'aéZ19.,! €\U0001f600<|>", max_size=25) | st.sampled_from(TEXTS), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_whole_texts(texts):
    encoder = Encoder.shared(wavelet.VOCABULARY)
    ids, counts = encoder.encode(pa.array([*texts, None], pa.string()))
    whole = encoder.whole([*texts, ""])
    assert counts.tolist() == list(map(len, whole)) and ids.tolist() == [i for t in whole for i in t]


def test_documents_read_back(spark, tmp_path):
    docs = [(i * 3, t) for i, t in enumerate(TEXTS * 4)] + [(500, None), (None, "no id")]
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, start int").repartition(4)
    shards = wavelet.write_shards(rows, str(tmp_path / "w"), shard_tokens=200)
    found = {r.doc_id: r for r in wavelet.read_documents(shards).collect()}
    encoder, start, all_ids = Encoder.shared(wavelet.VOCABULARY), 0, {}
    for ident, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        ids = all_ids[ident] = encoder.whole([text or ""])[0] + [2]
        r = found.pop(ident)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not found and shards.count() > 3
    token = all_ids[9][0]
    places = {(d, p) for d, ids in all_ids.items() for p, x in enumerate(ids) if x == token}
    assert {tuple(r) for r in wavelet.find_token(shards, token).collect()} == places
    assert {tuple(r) for r in wavelet.count_tokens(shards, [token, 2]).collect()} == {(token, len(places)), (2, len(docs))}


def test_repeated_ids_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b b"), (1, "b b"), (1, "a")], "doc_id bigint, text string")
    found = wavelet.read_documents(wavelet.write_shards(rows, str(tmp_path / "a"))).collect()
    assert len(found) == 3 and sorted(r.start for r in found)[0] == 0
    assert wavelet.read_documents(wavelet.write_shards(rows.limit(0), str(tmp_path / "b"))).count() == 0
