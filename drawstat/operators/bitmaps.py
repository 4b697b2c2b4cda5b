"""Position bitmaps: the draws of a series as bits, 64 to a word.

For every number the draws that hold it, and for every feature and bin the draws that fall into it, are bitmaps over
the positions of the series. The last W draws before a position are then W consecutive bits, cut out of a few
words; how often a number came up among those of one bin is the number of common bits of two such cuts.
Bitmaps of the bins are laid out twice in a row, so a cut may begin before the series and goes on at its end:
turning the features against the draws by any shift is reading the cut of another position.

The draws of a series, bounded by the calendar, are written once, as several tables are made of them.
Words are gathered by OR in fixed memory; everything after that is expressions on one row per position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawstat.operators.draws import spread
from drawstat.settings import HISTORY_WINDOW, MOST_BINS, Game
from drawstat.streaming.storage import stored

WORD = 64


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % WORD).cast("int"))


def _words(window: int) -> int:
    return -(-window // WORD)


def _word_table(moves: DataFrame, window: int) -> DataFrame:
    """(series, word, ``w0``, ``w1``, ...): for every word of a series the bits of all slots in it and in the next words, as
    many as a cut that begins in it can touch. ``moves`` (series, word, slot, bits) hold every slot of every word."""
    # all steps stay in one partitioning by series, whose draws are bounded by the calendar
    gathered = moves.repartition("series").groupBy("series", "word", "slot").agg(F.bit_or("bits").alias("bits"))
    rows = gathered.groupBy("series", "word").agg(F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("slots")).select(
        "series", "word", F.transform("slots", lambda s: s["bits"]).alias("bits"))
    by_word = Window.partitionBy("series").orderBy("word")  # one row per 64 positions
    return rows.select("series", "word", *[F.lead("bits", k).over(by_word).alias(f"w{k}") if k else F.col("bits").alias("w0")
                                           for k in range(_words(window) + 1)])


def _cut(words: Sequence[str], first: str, window: int) -> list[str]:
    """The ``window`` bits from position ``first`` on, lowest bit first, in as few words as they need. Expressions are texts
    here, since a cut for every feature and word is much to build piece by piece."""
    offset, out = f"cast(({first}) % {WORD} AS int)", []
    for k in range(_words(window)):
        word, after = f"coalesce({words[k]}, 0L)", f"coalesce({words[k + 1]}, 0L)"
        bits = f"if({offset} = 0, {word}, shiftrightunsigned({word}, {offset}) | shiftleft({after}, {WORD} - {offset}))"
        left = window - k * WORD
        out.append(bits if left >= WORD else f"({bits}) & {(1 << left) - 1}L")
    return out


def _bits(words: Sequence[str]) -> str:
    return "(" + " + ".join(f"bit_count({w})" for w in words) + ")"


def number_cuts(indexed: DataFrame, game: Game, window: int = HISTORY_WINDOW) -> DataFrame:
    """Every draw past the warm-up (series, draw_idx, n_draws, draw_date, numbers) with ``cuts``: for each number of the pool
    its cut of the ``window`` draws before and how many of them hold it."""
    at = F.col("draw_idx")
    drawn = F.transform("numbers", lambda n: F.struct(n.alias("slot"), _bit(at).alias("bits")))
    # the first draw of a word brings the numbers that do not come up in it
    whole = F.transform(F.sequence(F.lit(1), F.lit(game.pool)), lambda n: F.struct(n.alias("slot"), F.lit(0).cast("bigint").alias("bits")))
    moves = indexed.select("series", F.expr(f"draw_idx div {WORD}").alias("word"), F.inline(F.when(at % WORD == 0, F.concat(whole, drawn)).otherwise(drawn)))
    table = _word_table(moves, window)
    tested = indexed.filter(at >= window).select("series", "draw_idx", "n_draws", "draw_date", "numbers", F.expr(f"(draw_idx - {window}) div {WORD}").alias("word"))
    words = [f"w{k}[n]" for k in range(_words(window) + 1)]
    named = ", ".join(f"{cut} AS c{k}" for k, cut in enumerate(_cut(words, f"draw_idx - {window}", window)))
    cut = tested.join(table, ["series", "word"]).select("series", "draw_idx", "n_draws", "draw_date", "numbers", F.expr(
        f"transform(sequence(0, {game.pool - 1}), n -> struct({named}))").alias("cuts"))
    held = [f"c.c{k}" for k in range(_words(window))]
    return cut.withColumn("cuts", F.expr(f"transform(cuts, c -> struct({', '.join(held)}, {_bits(held)} AS frequency))"))


def bin_cuts(featured: DataFrame, features: Sequence[str], window: int = HISTORY_WINDOW, bins: int = MOST_BINS) -> DataFrame:
    """Every position of a series longer than the window (series, position) with, for each feature, the cut of the ``window``
    positions before, around the end of the series if need be, that share the position's bin (``<feature>_0``, ...), and
    their number (``<feature>_size``). Bins are 0 to ``bins`` - 1; another one stops the job."""
    long = featured.filter(F.col("n_draws") > window)
    own = [F.when(F.col(f).between(0, bins - 1), F.col(f)).otherwise(F.raise_error(F.lit(f"{f}: no bin of 0 to {bins - 1}")).cast("int"))
           for f in features]
    rows = long.select("series", "draw_idx", "n_draws", F.array(*own).alias("own"))
    twice = rows.select("series", "own", F.explode(F.array("draw_idx", F.col("draw_idx") + F.col("n_draws"))).alias("at"))
    held = F.transform("own", lambda b, f: F.struct((f * bins + b).alias("slot"), _bit(F.col("at")).alias("bits")))
    whole = F.transform(F.sequence(F.lit(0), F.lit(len(features) * bins - 1)), lambda n: F.struct(n.alias("slot"), F.lit(0).cast("bigint").alias("bits")))
    moves = twice.select("series", F.expr(f"at div {WORD}").alias("word"), F.inline(F.when(F.col("at") % WORD == 0, F.concat(whole, held)).otherwise(held)))
    table = _word_table(moves, window)
    first = F.col("draw_idx") + F.col("n_draws") - window
    placed = rows.withColumn("first", first).withColumn("word", F.expr(f"first div {WORD}")).join(table, ["series", "word"])
    cuts = [f"{c} AS {name}_{k}" for f, name in enumerate(features)
            for k, c in enumerate(_cut([f"w{j}[{f * bins} + own[{f}]]" for j in range(_words(window) + 1)], "first", window))]
    cut = placed.selectExpr("series", "draw_idx AS position", *cuts)
    return cut.selectExpr("*", *[f"{_bits([f'{f}_{k}' for k in range(_words(window))])} AS {f}_size" for f in features])


def cell_scores(cuts: DataFrame, models: dict[str, tuple[str, ...]], window: int, prior: int, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``scores``: per number of the pool the mean of its shrunk feature scores for each model and
    ``frequency``, its count in the window. A feature's score is
    (occurrences in the bin + prior * frequency / window) / (draws in the bin + prior); terms are added in model
    order, so that equal scores stay equal."""
    def term(feature: str) -> str:
        common = _bits([f"n.c{k} & {feature}_{k}" for k in range(_words(window))])
        return f"({common} + {prior} * n.frequency / {window}) / ({feature}_size + {prior})"

    means = [f"(0D + {' + '.join(map(term, names))}) / {len(names)} AS {m}" for m, names in models.items()]
    return cuts.select(*keep, F.expr(f"transform(cuts, n -> struct({', '.join(means)}, cast(n.frequency AS double) AS frequency))").alias("scores"))


def pooled_ticket(ranked: str, game: Game) -> Column:
    """The capped ticket of an array with one (cost, number) per number of the pool in ascending order: the least cost, ties
    to the smaller number, at most ``cap`` of a decade."""
    decades = ", ".join(f"slice(array_sort(slice({ranked}, {at + 1}, {game.decade})), 1, {game.cap})" for at in range(0, game.pool, game.decade))
    return F.expr(f"array_sort(slice(array_sort(concat({decades})), 1, {game.pick}).number)")


def with_tickets(scored: DataFrame, methods: Sequence[str], game: Game) -> DataFrame:
    """Replace ``scores`` by one ticket per method."""
    kept = [c for c in scored.columns if c != "scores"]
    ranked = scored.selectExpr(*kept, *[f"transform(scores, (s, i) -> struct(-s.{m} AS cost, i + 1 AS number)) AS ranked_{m}" for m in methods])
    return ranked.select(*kept, *[pooled_ticket(f"ranked_{m}", game).alias(f"{m}_ticket") for m in methods])


def binned_tickets(featured: DataFrame, game: Game, models: dict[str, tuple[str, ...]], window: int, prior: int) -> DataFrame:
    """(series, draw_idx, draw_date, actual) and the ticket of every model and of ``frequency`` for the draws past the warm-up."""
    features = tuple(dict.fromkeys(f for names in models.values() for f in names))
    featured = stored(featured.select("series", "draw_idx", "n_draws", "draw_date", "numbers", *features), "featured-draws")
    cuts = number_cuts(featured, game, window).join(bin_cuts(featured, features, window).withColumnRenamed("position", "draw_idx"), ["series", "draw_idx"])
    # one row is worth thousands of common bits, which its size in bytes does not tell
    scored = cell_scores(spread(cuts, "series", "draw_idx"), models, window, prior, ("series", "draw_idx", "draw_date", "numbers"))
    return with_tickets(scored.withColumnRenamed("numbers", "actual"), (*models, "frequency"), game)


def shifted_hits(featured: DataFrame, shifts: DataFrame, game: Game, models: dict[str, tuple[str, ...]], window: int, prior: int) -> DataFrame:
    """(series, replicate, shift, model, trials, total_hits) of the backtest with the features turned against the draws, for
    every (series, replicate, shift) of ``shifts``.

    A draw meets the bins of the position ``shift`` later, by one join on the position. Replicates are many rows, so their
    common bits and tickets are counted on whole Arrow batches; only sums per series, replicate and model are
    shuffled. A series without a tested draw has none."""
    features = tuple(dict.fromkeys(f for names in models.values() for f in names))
    turns = shifts.groupBy("series").agg(F.collect_list(F.struct("replicate", "shift")).alias("turns"))  # as many as replicates
    numbers = spread(number_cuts(featured, game, window), "series", "draw_idx").join(turns, "series")
    turned = numbers.select("series", "draw_idx", "n_draws", "numbers", "cuts", F.inline("turns")).withColumn(
        "position", F.pmod(F.col("draw_idx") + F.col("shift"), F.col("n_draws")))
    met = turned.join(bin_cuts(featured, features, window), ["series", "position"])
    words, names = _words(window), list(models)
    plan = [[features.index(f) for f in models[m]] for m in names]

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cuts = column["cuts"].flatten()
            drawn = np.stack([cuts.field(f"c{k}").to_numpy() for k in range(words)]).view(np.uint64).reshape(words, batch.num_rows, -1)
            cells = [np.stack([column[f"{f}_{k}"].to_numpy() for k in range(words)]).view(np.uint64) for f in features]
            sizes = [column[f"{f}_size"].to_numpy() for f in features]
            frequency = cuts.field("frequency").to_numpy().reshape(batch.num_rows, -1)
            actual = column["numbers"].flatten().to_numpy().reshape(batch.num_rows, -1)
            hits = _hits(drawn, cells, sizes, prior * frequency / window, actual, plan, prior, game)
            yield pa.RecordBatch.from_arrays([column["series"], column["replicate"], column["shift"], *map(pa.array, hits)], ["series", "replicate", "shift", *names])

    kept = met.select("series", "replicate", "shift", "numbers", "cuts", *[f"{f}_{k}" for f in features for k in [*range(words), "size"]])
    hits = kept.mapInArrow(evaluate, "series string, replicate int, shift int, " + ", ".join(f"`{m}` bigint" for m in names))
    sums = hits.groupBy("series", "replicate", "shift").agg(F.count("*").alias("trials"), *[F.sum(m).alias(m) for m in names])
    return sums.unpivot(["series", "replicate", "shift", "trials"], names, "model", "total_hits").select(
        "series", "replicate", "shift", "model", "trials", "total_hits")


def _hits(drawn: np.ndarray, cells: list[np.ndarray], sizes: list[np.ndarray], shrunk: np.ndarray, actual: np.ndarray, plan: Sequence[Sequence[int]],
          prior: int, game: Game) -> list[np.ndarray]:
    """Hits of each model's ticket per row: the scores of ``cell_scores`` and the choice of ``pooled_ticket`` on whole batches.
    ``drawn`` (words, rows, numbers) and ``cells`` (words, rows) are cuts."""
    terms = [(np.bitwise_count(drawn & cell[:, :, None]).sum(axis=0, dtype=np.int64) + shrunk) / (size[:, None] + prior) for cell, size in zip(cells, sizes)]
    rows, blocks = len(shrunk), -(-game.pool // game.decade)
    padded, out = np.full((rows, blocks * game.decade), np.inf), []
    member = np.zeros((rows, game.pool), np.int64)
    member[np.arange(rows)[:, None], actual - 1] = 1
    for features in plan:
        score = np.zeros_like(shrunk)
        for f in features:
            score += terms[f]
        padded[:, :game.pool] = -score / len(features)
        # the first of equals is the smaller number, in a decade and then among the candidates in ascending order
        best = np.sort(np.argsort(padded.reshape(rows, blocks, -1), axis=2, kind="stable")[:, :, :game.cap], axis=2)
        candidates = (best + np.arange(blocks)[None, :, None] * game.decade).reshape(rows, -1)
        chosen = np.argsort(np.take_along_axis(padded, candidates, axis=1), axis=1, kind="stable")[:, :game.pick]
        out.append(np.take_along_axis(member, np.minimum(np.take_along_axis(candidates, chosen, axis=1), game.pool - 1), axis=1).sum(axis=1))
    return out
