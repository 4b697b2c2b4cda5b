"""Pipeline stages against brute force, and the registered queries against their SQL."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from drawstat.llm import queries, toxicity
from tests.llm.test_decontaminate import brute as brute_overlaps
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.test_queries import engine_on, ordered


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage on the smallest tables, written and read again."""
    folder, kept = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        kept.append((docs, out))
        docs = out
    return kept


def ids(rows):
    return sorted(r.doc_id for r in rows.select("doc_id").collect())


def test_columns(stages):
    for docs, out in stages[:-1]:
        assert out.dtypes == docs.dtypes


def test_toxicity_stage(spark, stages):
    docs, out = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.collect()
    scores = toxicity.score_texts(model, model.responses(), pa.array([r.text for r in rows]))
    assert ids(out) == sorted(r.doc_id for r, s in zip(rows, scores) if s < model.thresholds.get(r.lang, 0.5))


def test_line_stage(stages):
    docs, out = stages[1]
    expected = brute_lines(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, t) for i, t, _ in expected}
    changed = {i for i, _, n in expected if n}
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id in changed)


def test_simhash_stage(stages):
    docs, out = stages[2]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert ids(out) == sorted(set(plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3).values()))


def test_decontamination_stage(spark, stages):
    docs, out = stages[3]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {d for d, *_ in brute_overlaps([(r.doc_id, r.text) for r in docs.collect()], items)}
    assert ids(out) == [i for i in ids(docs) if i not in dirty]


def test_packing_stage(stages):
    docs, out = stages[4]
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    held, bins = dict.fromkeys(sizes, 0), {}
    for r in out.collect():
        held[r.doc_id] += r.length
        bins[r.bin] = bins.get(r.bin, 0) + r.length
    assert held == sizes and max(bins.values()) <= 8192


def test_run_gives_the_last_stage(spark, stages):
    assert ordered(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == ordered(map(tuple, stages[-1][1].collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    relation = engine_on(sf_dir).sql(queries.ORACLE[name])
    columns = sorted(relation.columns)
    expected = ordered(tuple(row[relation.columns.index(c)] for c in columns) for row in relation.fetchall())
    result = contract.queries()[name](spark, sf_dir)
    assert sorted(result.columns) == columns
    assert ordered(tuple(row[c] for c in columns) for row in result.collect()) == expected


def test_registered():
    registered = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registered if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in registered and [n for n, _ in corpus_pipeline.STAGES] and set(queries.ORACLE) < set(contract.oracle_sql())


def test_queries_cover_their_tables(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents").count()
    for name in ("op2_wavelet", "op5_simhash", "op7_toxicity", "op9_hilbert", "op12_merkle", "op13_alignment"):
        found = queries.QUERIES[name](spark, sf_dir)
        assert found.count() == docs == found.select("doc_id").distinct().count()
    scores = [r.score for r in queries.QUERIES["op7_toxicity"](spark, sf_dir).collect()]
    assert 0 <= min(scores) <= max(scores) <= 1 and not np.isnan(scores).any()
