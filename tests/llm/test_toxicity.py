"""Toxicity classifier: held-out accuracy, what enters a score, odd rows."""

import re
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from drawstat.llm import toxicity

SMALL = toxicity.Settings(per_class=300, fewest_steps=150)


@pytest.fixture(scope="module")
def learned(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(learned):
    docs, labels, model = learned
    scored = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))), model).collect()
    toxic = np.array([r.toxic for r in scored]) == 1
    score = np.array([r.score for r in scored])
    assert toxic.sum() > 50 and ((score >= 0.5) == toxic).mean() > 0.97
    assert (score[toxic] >= 0.5).mean() > 0.9 and (score[~toxic] >= 0.5).mean() < 0.02
    flagged = np.array([r.score >= r.threshold for r in scored])
    assert (flagged == toxic).mean() > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in scored)


def test_only_the_text_enters_a_score(spark, learned):
    _, _, model = learned
    rows = spark.createDataFrame([(1, "some stupid words", "en", "a", 0.0), (2, "some stupid words", "fr", "b", 9.0), (3, None, None, None, None),
                                  (4, "", "en", "a", 1.0)], "doc_id bigint, text string, lang string, source string, score double")
    found = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    assert found[1].score == found[2].score and found[3].score == found[4].score and 0 <= found[4].score <= 1
    assert toxicity.score(rows.drop("lang"), model).first().threshold == 0.5
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_blocks_do_not_change_a_score(learned):
    docs, _, model = learned
    texts = [r.text for r in docs.limit(40).collect()] + ["", " ", "clown " * 300]
    table = model.responses()
    whole = toxicity.score_texts(model, table, pa.array(texts))
    assert np.allclose(whole, toxicity.score_texts(model, table, pa.array(texts), block=37), atol=1e-4)
    for i in range(0, len(texts), 7):
        assert np.allclose(whole[i], toxicity.score_texts(model, table, pa.array(texts[i:i + 1]))[0], atol=1e-4)


def test_training_is_repeatable_and_ignores_held_out_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["sun", "sea", "tree", "rock"], 12)) + (" awful" if i % 4 == 0 else ""), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = [(i, int(i % 4 == 0)) for i, *_ in rows] + [(None, 1), (3, None)]
    flipped = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(docs.repartition(k), spark.createDataFrame(x, "doc_id bigint, toxic int"), SMALL) for k, x in ((2, labels), (5, flipped)))
    assert np.allclose(a.embedding, b.embedding) and a.thresholds == b.thresholds
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows if i % 4}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id bigint, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"), SMALL)
    assert toxicity.score(docs, model).first().score == 0.5
    assert toxicity.threshold([0.1, 0.2, 0.9], [0, 0, 1], 1) == pytest.approx(0.55)
    assert toxicity.threshold([0.1, 0.9], [0, 1], 5) == 0.5


def test_thresholds_cover_all_labelled_rows(spark):
    """Rows beyond the training sample decide the cut, and a language with few labels follows the pooled one."""
    rng = np.random.default_rng(1)

    def text(i, lang):
        mild = " meh" if i % 10 == 3 else " awful" if i % 10 == 6 else ""  # of two sorts of toxic rows, one is mostly clean
        return " ".join(rng.choice(["sun", "sea", "tree", "rock", "sky"], 12)) + mild + f" w{i}"

    rows = [(i, text(i, lang), lang) for i, lang in enumerate(["en"] * 3000 + ["xx"] * 10)]
    labels = [(i, int(i % 10 == 6 or (i % 10 == 3 and i % 40 == 3))) for i, *_ in rows]
    docs, given = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    s = toxicity.Settings(per_class=60, fewest_steps=150)
    model, fitted = toxicity._learn(docs, given, s)
    assert 0 < fitted.count() <= 96
    toxicity._calibrate(model, toxicity._narrow(toxicity._scored(docs, model), s), given, fitted)
    learned = {r.text_key for r in fitted.collect()}
    scored = toxicity._narrow(toxicity._scored(docs, model), s).join(given, "doc_id").filter(~toxicity.held_out(F.col("doc_id"))).collect()
    en = [(r.score, r.toxic) for r in scored if r.lang == "en" and r.text_key not in learned]
    errors = lambda c: sum((x >= c) != (y == 1) for x, y in en)
    # no cut is better than the chosen one on all rows left out of the training
    assert len(en) > 2200 and errors(model.thresholds["en"]) <= min(errors(c) for c in np.linspace(0, 1, 401)) + 2
    assert model.thresholds["xx"] == model.pooled != 0.5
    unknown = spark.createDataFrame([(1, "sun", "zz"), (2, "sun", None)], "doc_id bigint, text string, lang string")
    assert {r.threshold for r in toxicity.score(unknown, model).collect()} == {model.pooled}


def test_thresholds_keep_natural_shares():
    s = toxicity.Settings(fewest_for_threshold=1)
    # (language, bin, label, short, rows, rows not learned from): the 20 toxic rows left stand for 100, more than the 60 others
    counts = [("en", 0, 0, True, 90, 90), ("en", 8, 1, True, 100, 20), ("en", 8, 0, True, 60, 60)]
    assert toxicity.thresholds(counts, s)[1] == pytest.approx((1 / (1 + np.exp(-1 / 16)) + 1 / (1 + np.exp(-0.5))) / 2)
    assert toxicity.thresholds([("en", 0, 1, True, 5, 1)], s) == ({}, 0.5)


def plain_score(model, text):
    """The forward pass word by word: embedding sums, every filter at every place, largest answer, logistic."""
    s, words = model.settings, [w for w in re.split(r"\s+", (text or "").lower())]
    place = {int(k): i for i, k in enumerate(model.known)}
    cells = []
    for w in words:
        w = regex.sub(r"^[^\pL\pN]+|[^\pL\pN]+$", "", w)
        pieces = [zlib.crc32(w.encode()) + 1] if w else []
        pieces += [(zlib.crc32(w[:n].encode(), n) + 1) | 1 << 33 for n in s.prefixes if len(w) > n]
        cells.append(sum((model.embedding[place[p]].astype(float) for p in pieces if p in place), np.zeros(s.width)))
    pooled = []
    for i, kernel in enumerate(model.kernels):
        for f in range(s.filters):
            answers = [max(0.0, sum(float(cells[at + k] @ kernel[k][:, f]) for k in range(len(kernel)) if at + k < len(cells))
                           + float(model.bias[i * s.filters + f])) for at in range(len(cells))]
            pooled.append(max(answers, default=0.0))
    return 1 / (1 + np.exp(-(np.array(pooled) @ np.asarray(model.out, float) + float(model.out_bias))))


def test_scores_equal_a_plain_forward_pass(learned):
    docs, labels, model = learned
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").orderBy("doc_id").limit(8).collect()
    texts = [r.text for r in [*docs.orderBy("doc_id").limit(8).collect(), *toxic] if len(r.text) < 20_000] + ["clown", "  stupid, clown!! ", "one two"]
    found = toxicity.score_texts(model, model.responses(), pa.array(texts, pa.large_string()))
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=1e-4)
    assert found.min() < 0.5 < found.max()  # texts of both kinds are among them


def test_training_lowers_the_loss_and_stops_at_its_optimum(learned):
    """The output layer of a trained model is near a stationary point: along its gradient the loss of the sample does not fall
    by more than a trifle, while the untrained one falls."""
    docs, labels, _ = learned
    rows = [(i, "", int(r.toxic), r.text) for i, r in enumerate(docs.join(labels, "doc_id").filter("length(text) < 3000").orderBy("doc_id").limit(400).collect())]
    few, many = (toxicity.train(rows, toxicity.Settings(fewest_steps=n, epochs=1))[0] for n in (1, 400))
    fit = [r for i, r in enumerate(sorted(rows, key=lambda r: (r[0], r[2], r[3]))) if i % 5]
    texts, y = pa.array([r[3] for r in fit], pa.large_string()), np.array([r[2] for r in fit])

    def loss(model, step=0.0):
        p = np.clip(toxicity.score_texts(model, model.responses(), texts), 1e-6, 1 - 1e-6)
        weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).mean()), float(((p - y) * weight).mean())

    (before, _), (after, slope) = loss(few), loss(many)
    assert after < 0.5 * before
    eps = 1e-3  # the numeric slope along the output bias equals the analytic one
    up, down = (loss(replace(many, out_bias=many.out_bias + d))[0] for d in (eps, -eps))
    assert (up - down) / (2 * eps) == pytest.approx(slope, abs=1e-4)
