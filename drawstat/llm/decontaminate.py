"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask selects some of the next few token positions; the others may differ. The hash of the selected tokens is
computed at every position of every text for every mask and joined with the same hashes of the benchmark
items. A hit fixes how item and text lie on each other (the diagonal); there the whole item is compared
token by token, and a window of it that agrees in at least ``similarity`` of its tokens is an overlap. Items too
short for the masks are cut into runs of neighbouring tokens, of which one is whole however the allowed differences fall.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.llm.common import keep, text_key

# Selected offsets. Chosen by search: any 14 tokens with two substitutions keep one of them whole, and of random
# substitutions of a fifth of all tokens 96 % (14 tokens), 99 % (20) and all but 1 in 1,000 (40) are hit.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 5, 6, 8), (0, 3, 5, 7, 8), (0, 1, 4, 6, 7))
SIMILARITY = 0.8
WINDOW = 20
# Items below this many tokens are too short for the masks: their seeds are runs of neighbours, see ``parts``.
SPACED_TOKENS = 14
# A benchmark with at most this many seeds (about 50 MB as a hash table) is sent to every task; a larger one is joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of a whole text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def parts(length: int, similarity: float) -> list[tuple[int, int]]:
    """(start, tokens) of the runs a short item is cut into: one more than the tokens it may lose, so that one run at least
    is whole wherever item and text differ."""
    runs = length - ceil(similarity * length - 1e-9) + 1
    cuts = [i * length // runs for i in range(runs + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _run(tokens: int) -> tuple[int, ...]:
    return tuple(range(tokens))


def _seeds(rows: DataFrame, masks: dict[int, tuple[int, ...]], *keep_columns: str) -> DataFrame:
    """(keep_columns, pos, seed) for every numbered mask at every position of ``words`` where it fits."""
    def seed(number: int, mask: tuple[int, ...]) -> Column:
        words = [F.get("words", F.col("pos") + offset) for offset in mask]
        return F.when(F.col("pos") + mask[-1] < F.size("words"), F.xxhash64(F.lit(number), *words))

    placed = rows.filter(F.size("words") > 0).select(*keep_columns, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("pos"))
    hashed = F.array(*[seed(i, m) for i, m in masks.items()])
    return placed.select(*keep_columns, "pos", F.explode(hashed).alias("seed")).filter("seed IS NOT NULL")


def _short_seeds(sources: DataFrame, similarity: float) -> DataFrame:
    """(item_id, item_pos, seed) of the runs of items too short for the masks. A run of n tokens has the number -n."""
    def of(length: int) -> Column:
        return F.array(*[F.struct(F.lit(start).alias("item_pos"), F.xxhash64(F.lit(-n), *[F.get("words", F.lit(start + i)) for i in range(n)]).alias("seed"))
                         for start, n in parts(length, similarity)])

    chosen = F.when(F.size("words") == 1, of(1))
    for length in range(2, SPACED_TOKENS):
        chosen = chosen.when(F.size("words") == length, of(length))
    return sources.filter(F.size("words").between(1, SPACED_TOKENS - 1)).select("item_id", F.inline(chosen))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, similarity: float = SIMILARITY,
             window: int = WINDOW, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row per text of ``docs`` (doc_id, text) and item of ``items`` (item_id, text) that overlap: doc_id,
    text_key, item_id, doc_start (token of the text under the item's first token, may be negative), matched
    (equal tokens in the best window), compared (its length: ``window``, or the item if shorter). Of several
    places the one with most matches counts, then the first.

    Items of fewer than 14 tokens overlap wherever they agree in ``similarity`` of their tokens, which below five tokens
    means all of them; longer items where a spaced seed hits too. Null and empty texts and items overlap with
    nothing. Rows that repeat an id and its text give one row; other columns are ignored; an empty table on either side
    gives no rows."""
    sources = keep(items.select(F.col("item_id"), tokens(F.col("text")).alias("words")).distinct(), "items")
    spaced = dict(enumerate(masks))
    long_items = sources.filter(F.size("words") >= SPACED_TOKENS)
    seeds = keep(_seeds(long_items, spaced, "item_id").select("item_id", F.col("pos").alias("item_pos"), "seed").unionAll(
        _short_seeds(sources, similarity)), "seeds")
    few = seeds.count() <= broadcast_seeds
    # the lengths of the short items decide which runs are hashed at every position of the texts: thirteen numbers at most
    lengths = [r[0] for r in sources.filter(F.size("words").between(1, SPACED_TOKENS - 1)).select(F.size("words")).distinct().collect()]
    runs = {n for length in lengths for _, n in parts(length, similarity)}
    wanted_masks = spaced | {-n: _run(n) for n in sorted(runs)}

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    texts = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"), tokens(F.col("text")).alias("words"))
    found = _seeds(texts, wanted_masks, "doc_id", "text_key").join(small(seeds), "seed")
    hits = keep(found.select("doc_id", "text_key", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")

    # only texts with a hit are read as tokens again
    wanted = hits.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    raw = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    touched = raw.join(wanted.select("hit_id", "hit_key").distinct(),
                       F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left_semi")
    placed = touched.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", tokens(F.col("text")).alias("words")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    aligned = placed.join(small(sources.withColumnsRenamed({"item_id": "source_id", "words": "item_words"})),
                          F.col("item_id") == F.col("source_id"))
    length = F.size("item_words")
    equal = F.transform(F.sequence(F.lit(0), length - 1), lambda q: F.when(
        (q + F.col("diagonal") >= 0) & (F.get("words", q + F.col("diagonal")) == F.get("item_words", q)), 1).otherwise(0))
    compared = F.least(length, F.lit(window))
    sums = F.transform(F.sequence(F.lit(1), length - F.col("compared") + 1), lambda start: F.aggregate(
        F.slice("equal", start, F.col("compared")), F.lit(0), lambda a, b: a + b))
    scored = aligned.select("doc_id", "text_key", "item_id", "diagonal", equal.alias("equal"), compared.alias("compared"), "item_words")
    scored = scored.withColumn("matched", F.array_max(sums)).filter(F.col("matched") >= F.col("compared") * F.lit(similarity))
    best = F.max(F.struct("matched", (-F.col("diagonal")).alias("first"), "compared")).alias("best")
    return scored.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", (-F.col("best.first")).alias("doc_start"), "best.matched", "best.compared")


def without_overlaps(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, all columns kept."""
    found = keep(overlaps(docs, items, **options).select("doc_id", "text_key").distinct(), "overlaps")
    key = text_key(docs["text"])
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (key == found["text_key"]), "left_anti")
