"""Toxicity by a small convolutional text classifier trained in numpy.

Words are hashed to embeddings, each the sum of those of the word and of its beginnings, so that an inflected
form shares what its stem has shown; filters one to three words wide slide over a whole text, each keeps its
largest response (max pooling), and a logistic unit joins them. It is trained on a bounded sample of
labelled rows in one task; scoring runs in every task over whole texts. Thresholds are calibrated by
language on the scores of all labelled rows that the training left out, and never enter a score.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from drawstat.llm.common import byte_slices, keep, text_key

FOLDS = 5
BINS = 16     # score bins a unit of log odds
SURE = 1e-9   # scores this close to 0 or 1 share the outermost bins


@dataclass(frozen=True)
class Settings:
    """``per_class`` and ``longest`` bound the training sample: so many distinct texts of each label at most,
    drawn by hash from all labelled rows, none of more than ``longest`` words (a longer one is left out as a
    whole; scoring has no such bound). Word pieces in fewer than ``known_in`` texts of the sample stay neutral.
    For its threshold a language shares the rows of all languages, counted as ``fewest_for_threshold`` of the rarer label."""

    per_class: int = 4000
    longest: int = 2000
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    width: int = 16
    filters: int = 8
    spans: tuple[int, ...] = (1, 2, 3)
    known_in: int = 5
    epochs: int = 6
    fewest_steps: int = 400
    batch: int = 64
    rate: float = 0.005
    decay: float = 1e-4
    seed: int = 7
    fewest_for_threshold: int = 20


@dataclass
class Model:
    settings: Settings
    known: np.ndarray                  # hashes of word pieces with an embedding, sorted
    embedding: np.ndarray              # (known, width)
    kernels: list[np.ndarray]          # per span: (span, width, filters)
    bias: np.ndarray                   # of all filters
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    pooled: float = 0.5                # threshold of languages without labels

    def responses(self) -> np.ndarray:
        """Response of every filter position to every known piece, row 0 for all others: a convolution becomes a
        sum of looked-up rows."""
        table = np.zeros((len(self.known) + 1, sum(self.settings.spans) * self.settings.filters), np.float32)
        table[1:] = np.concatenate([self.embedding @ kernel for k in self.kernels for kernel in k], axis=1)
        return table


def words_of(texts: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as numbers of distinct words, the offsets of the texts, and per distinct word the
    hashes of its pieces: the word itself and its beginnings of the given lengths (0: no such piece). Words
    are lower case without punctuation around them. Null is empty."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    encoded = lists.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(encoded.dictionary, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    crc, columns = zlib.crc32, []
    listed = [w.encode() for w in plain.to_pylist()]
    columns.append(np.fromiter((crc(w) + 1 if w else 0 for w in listed), np.int64, len(listed)))
    lengths = pc.utf8_length(plain).to_numpy(zero_copy_only=False)
    for n in prefixes:
        heads = pc.utf8_slice_codeunits(plain, 0, n).dictionary_encode()
        hashed = np.array([(crc(h.encode(), n) + 1) | 1 << 33 for h in heads.dictionary.to_pylist()], np.int64)
        columns.append(np.where(lengths > n, hashed[heads.indices.to_numpy(zero_copy_only=False)], 0) if len(hashed) else np.zeros(0, np.int64))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return encoded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], np.stack(columns, axis=1)


def _rows(pieces: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Row of every piece in a table whose row 0 stands for what is not known."""
    at = np.searchsorted(known, pieces)
    at[at == len(known)] = 0
    return np.where(known[at] == pieces, at + 1, 0).astype(np.int32) if len(known) else np.zeros(pieces.shape, np.int32)


def score_texts(model: Model, table: np.ndarray, texts: pa.Array, block: int = 1 << 17) -> np.ndarray:
    """Scores of whole texts. Works in blocks of words, so a text of any length needs bounded memory."""
    s, reach = model.settings, max(model.settings.spans) - 1
    words, offsets, pieces = words_of(texts, s.prefixes)
    rows = _rows(pieces, model.known)
    of_word = np.zeros((len(rows), table.shape[1]), np.float32)
    for column in rows.T:
        some = np.flatnonzero(column)
        of_word[some] += table[column[some]]
    n_docs = len(offsets) - 1
    pooled = np.zeros((n_docs, len(s.spans) * s.filters), np.float32)
    doc_of = np.repeat(np.arange(n_docs), np.diff(offsets))
    for a in range(0, len(words), block):
        b = min(a + block, len(words))
        c = min(b + reach, len(words))
        total = np.zeros((b - a, len(s.spans) * s.filters), np.float32)
        cells, docs, at = of_word[words[a:c]], doc_of[a:c], 0
        for i, span in enumerate(s.spans):
            part = total[:, i * s.filters:(i + 1) * s.filters]
            for k in range(span):
                n = min(b - a, len(docs) - k)
                # a window that runs over the end of its text meets nothing there
                inside = (docs[k:k + n] == docs[:n])[:, None]
                part[:n] += cells[k:k + n, at:at + s.filters] * inside
                at += s.filters
        total = np.maximum(total + model.bias, 0)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(docs[: b - a])) + 1])
        here = docs[cuts]
        pooled[here] = np.maximum(pooled[here], np.maximum.reduceat(total, cuts, axis=0))
    return 1 / (1 + np.exp(-(pooled.astype(np.float64) @ model.out + model.out_bias)))


def _evidence(texts: list[np.ndarray], labels: np.ndarray, known: int) -> np.ndarray:
    """How surely a piece marks a label: its smoothed log odds over their standard error, less what chance alone
    explains. A start for the embeddings that keeps rare pieces near zero."""
    counts = np.full((2, known + 1), 0.5)
    for rows, label in zip(texts, labels):
        counts[label, rows] += 1
    odds = np.log(counts[1] / (labels.sum() + 1)) - np.log(counts[0] / ((1 - labels).sum() + 1))
    z = (odds / np.sqrt(1 / counts[0] + 1 / counts[1]))[1:]
    return np.sign(z) * np.maximum(np.abs(z) - 2, 0)


def train(rows: list[tuple], s: Settings) -> tuple[Model, list[int]]:
    """Fit on rows (order, text key, label, text); a fifth, by position, is left out for calibration. Also returns the
    keys of the texts it was fit on."""
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    fit = [r for i, r in enumerate(rows) if i % 5]
    rng = np.random.default_rng(s.seed)
    words, offsets, pieces = words_of(pa.array([r[3] for r in fit], pa.large_string()), s.prefixes)
    texts = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    distinct = [np.unique(pieces[np.unique(t)]) for t in texts]
    found, seen = np.unique(np.concatenate(distinct or [np.empty(0, np.int64)]), return_counts=True)
    known = found[(seen >= s.known_in) & (found > 0)]
    rows_of = np.concatenate([_rows(pieces, known), np.zeros((1, 1 + len(s.prefixes)), np.int32)])  # the last word is padding
    labels, n_out = np.array([r[2] for r in fit], int), len(s.spans) * s.filters
    params = {"embedding": rng.normal(0, 0.02, (len(known) + 1, s.width)), "out": rng.normal(0.5, 0.1, n_out), "bias": np.zeros(n_out),
              "out_bias": np.zeros(1)} | {f"k{i}": rng.normal(0, (s.width * span) ** -0.5, (span, s.width, s.filters)) for i, span in enumerate(s.spans)}
    params["embedding"][1:, 0] = _evidence([_rows(d, known) for d in distinct], labels, len(known)) / 4
    params["embedding"][0] = 0
    for i in range(len(s.spans)):
        params[f"k{i}"][:, 0] += 0.5
    params = {k: v.astype(np.float32) for k, v in params.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    reach, step, half = max(s.spans) - 1, 0, len(fit) / 2
    weight = np.where(labels == 1, half / max(1, labels.sum()), half / max(1, (1 - labels).sum()))
    pads = np.full(reach, len(rows_of) - 1)
    for _ in range(max(s.epochs, -(-s.fewest_steps * s.batch // len(fit))) if len(known) else 0):
        order = rng.permutation(len(fit))
        for at in range(0, len(fit), s.batch):
            chosen = order[at:at + s.batch]
            parts = [np.concatenate([texts[i], pads]) for i in chosen]
            ends = np.cumsum([len(p) for p in parts])
            here, back_to = np.unique(np.concatenate([*parts, pads]), return_inverse=True)
            mine = rows_of[here]
            vectors = sum(params["embedding"][mine[:, p]] for p in range(mine.shape[1]))
            kernels = np.concatenate([k for i in range(len(s.spans)) for k in params[f"k{i}"]], axis=1)
            conv = _convolve((vectors @ kernels)[back_to], s.spans, s.filters) + params["bias"]
            starts = np.concatenate([[0], ends[:-1]])
            peak = np.stack([a + conv[a:max(b - reach, a + 1)].argmax(axis=0) for a, b in zip(starts, ends)])
            pooled = np.maximum(np.take_along_axis(conv, peak, axis=0), 0)
            p = 1 / (1 + np.exp(-(pooled @ params["out"] + params["out_bias"])))
            error = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads = {k: s.decay * v for k, v in params.items() if k != "embedding"}
            grads["out"] = grads["out"] + pooled.T @ error
            grads["out_bias"] = grads["out_bias"] + error.sum()
            back = error[:, None] * params["out"] * (pooled > 0)
            grads["bias"] = grads["bias"] + back.sum(axis=0)
            grads["embedding"] = np.zeros_like(params["embedding"])
            for i, span in enumerate(s.spans):
                f = slice(i * s.filters, (i + 1) * s.filters)
                for k in range(span):
                    at_peak = back_to[peak[:, f] + k]
                    grads[f"k{i}"][k] += np.einsum("bfw,bf->wf", vectors[at_peak], back[:, f])
                    moved = back[:, f, None] * params[f"k{i}"][k].T[None]
                    for column in mine[at_peak].transpose(2, 0, 1):
                        np.add.at(grads["embedding"], column, moved)
            grads["embedding"][0] = 0
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    trained = len(known) and len(fit)
    model = Model(s, known, params["embedding"][1:], [params[f"k{i}"] for i in range(len(s.spans))], params["bias"],
                  params["out"].astype(np.float64) if trained else np.zeros(n_out), float(params["out_bias"][0]))
    return model, [r[1] for r in fit]


def _convolve(cells: np.ndarray, spans: tuple[int, ...], filters: int) -> np.ndarray:
    """Sum the looked-up parts of every filter: row t of the result is the window that starts at t."""
    out, at = [], 0
    n = len(cells)
    for span in spans:
        total = cells[:, at:at + filters].copy()
        for k in range(1, span):
            at += filters
            total[: n - k] += cells[k:, at:at + filters]
        at += filters
        out.append(total)
    return np.concatenate(out, axis=1)


def cut(low: np.ndarray, high: np.ndarray, negative: np.ndarray, positive: np.ndarray) -> float:
    """Cut with the fewest errors between ascending groups of scores, from ``low`` to ``high`` with so many rows of each
    label, in the middle of the widest gap."""
    errors = np.concatenate([[0], np.cumsum(positive)]) + np.concatenate([np.cumsum(negative[::-1])[::-1], [0]])
    left, right = np.concatenate([[0.0], high]), np.concatenate([low, [1.0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9 * (negative.sum() + positive.sum()))  # counts are weighted
    best = best[np.argmax((right - left)[best])]
    return float((left[best] + right[best]) / 2)


def threshold(scores, labels, fewest: int) -> float:
    """Cut with the fewest errors; 0.5 with too few rows of a label."""
    x, y = np.array(scores), np.array(labels)
    if min((y == 1).sum(), (y == 0).sum()) < fewest:
        return 0.5
    levels, at = np.unique(x, return_inverse=True)
    return cut(levels, levels, *[np.bincount(at[y == label], minlength=len(levels)) for label in (0, 1)])


def thresholds(counts: list[tuple[str, int, int, bool, int, int]], s: Settings) -> tuple[dict[str, float], float]:
    """Cuts by language, and the pooled one, from (language, score bin, label, short enough to learn from, rows, rows not
    learned from). Only rows not learned from have a say; they stand for all rows of their label and kind, so that the
    shares of the labels are those of the data. Every language adds the rows of all languages, weighted down to
    ``fewest_for_threshold`` of the rarer label: with few labels it follows the pooled cut, with many its own. Without
    rows of both labels the cut is 0.5."""
    sums: dict[tuple, list[int]] = {}
    for _, _, label, short, every, left in counts:
        total = sums.setdefault((label, short), [0, 0])
        total[0] += every
        total[1] += left
    bins = np.unique([b for _, b, _, _, _, left in counts if left])
    pooled, own = np.zeros((2, len(bins))), {lang: np.zeros((2, len(bins))) for lang, *_ in counts}
    for lang, b, label, short, _, left in counts:
        if left:
            every, out = sums[label, short]
            own[lang][label, np.searchsorted(bins, b)] += left * every / out
    for lang in sorted(own):
        pooled += own[lang]
    rarer = pooled.sum(axis=1).min()
    if not rarer:
        return {}, 0.5
    low, high = (1 / (1 + np.exp(-(bins + k) / BINS)) for k in (0, 1))
    shared = pooled * (s.fewest_for_threshold / rarer)
    return {lang: cut(low, high, *(mine + shared)) for lang, mine in sorted(own.items())}, cut(low, high, *pooled)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divisible by five, or no id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def _usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, place): labels that may be learned from, one row an id, in hash order by ``place``."""
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return usable.withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))


def _short(s: Settings) -> Column:
    """Whether ``text`` may be in the training sample; so few letters hold no more words."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return F.coalesce((F.length("text") <= 2 * s.longest) | (words <= s.longest), F.lit(False))


def _learn(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[Model, DataFrame]:
    """A model without thresholds, and the keys of the texts it was fit on (text_key)."""
    usable = _usable(labels)
    picked = [usable.filter(F.col("toxic") == label).orderBy("place", "doc_id").limit(s.per_class) for label in (0, 1)]
    # at most 2 * per_class narrow rows
    sample = keep(picked[0].unionAll(picked[1]), "sample")
    joined = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    texts = joined.groupBy(text_key(F.col("text")).alias("text_key")).agg(
        F.min("place").alias("place"), F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys = train([(r["place"], r["text_key"], r["toxic"], r["text"]) for b in batches for r in b.to_pylist()], s)
        learned = {k: v for k, v in vars(model).items() if k != "settings"}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned)], pa.binary()), pa.array([keys], pa.list_(pa.int64()))], ["model", "fitted"])

    small = texts.filter(_short(s)).select("place", "text_key", F.col("toxic").cast("int"), "text")
    learned = keep(small.repartition(1).mapInArrow(learn, "model binary, fitted array<bigint>"), "model")
    found = learned.select("model").first()
    return Model(s, **pickle.loads(found["model"])) if found else train([], s)[0], learned.select(F.explode("fitted").alias("text_key"))


def _narrow(scored: DataFrame, s: Settings) -> DataFrame:
    """What the calibration needs of scored documents: (doc_id, lang, score, text_key, short)."""
    return scored.select("doc_id", "lang", "score", text_key(F.col("text")).alias("text_key"), _short(s).alias("short"))


def _calibrate(model: Model, narrow: DataFrame, labels: DataFrame, fitted: DataFrame) -> None:
    """Set the thresholds of ``model`` from the scores of all labelled rows whose texts it was not fit on."""
    labelled = narrow.join(_usable(labels).filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int")), "doc_id")
    marked = labelled.join(F.broadcast(fitted.withColumn("learned", F.lit(True))), "text_key", "left")
    sure = F.least(F.greatest("score", F.lit(SURE)), F.lit(1 - SURE))
    counts = marked.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.log(sure / (1 - sure)) * BINS).alias("bin"), "toxic", "short").agg(
        F.count("*").alias("rows"), F.count_if(F.col("learned").isNull()).alias("left"))
    # a few hundred bins a language
    model.thresholds, model.pooled = thresholds([tuple(r) for r in counts.collect()], model.settings)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on ``docs`` (doc_id, text, lang) labelled by ``labels`` (doc_id, toxic). Held-out ids, null ids and
    null labels are not learned from; an id labelled twice takes the larger label. Without usable rows the
    model scores every text 0.5."""
    model, fitted = _learn(docs, labels, settings)
    labelled = docs.select("doc_id", "text", "lang").join(_usable(labels).select("doc_id"), "doc_id", "left_semi")
    _calibrate(model, _narrow(_scored(labelled, model), settings), labels, fitted)
    return model


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` appended."""
    rows = docs.drop("score", "threshold")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.responses()
        for batch in batches:
            texts = batch.column(at)
            scores = np.concatenate([score_texts(model, table, texts.slice(a, b - a)) for a, b in byte_slices(texts)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def _with_threshold(scored: DataFrame, model: Model) -> DataFrame:
    if "lang" not in scored.columns:
        return scored.withColumn("threshold", F.lit(0.5))
    lang = F.coalesce("lang", F.lit(""))
    return scored.withColumn("threshold", F.coalesce(*[F.when(lang == name, F.lit(t)) for name, t in sorted(model.thresholds.items())], F.lit(model.pooled)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (probability that a text is toxic) and ``threshold`` of its language appended
    (columns of these names are replaced). Only the text enters the score; null and empty texts score as
    the bias alone says."""
    return _with_threshold(_scored(docs, model), model)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, lang, score, threshold) of every row of ``docs``, by a model fit on them. Every text is scored once."""
    model, fitted = _learn(docs, labels, settings)
    narrow = keep(_narrow(_scored(docs.select("doc_id", "text", "lang"), model), settings), "scores")
    _calibrate(model, narrow, labels, fitted)
    return _with_threshold(narrow.drop("text_key", "short"), model)


def without_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below the threshold of their language. Every text is scored once."""
    model, fitted = _learn(docs, labels, settings)
    scored = keep(_scored(docs, model), "scores")
    _calibrate(model, _narrow(scored, settings), labels, fitted)
    return _with_threshold(scored, model).filter("score < threshold").select(*[F.col(f"`{c}`") for c in docs.columns])
