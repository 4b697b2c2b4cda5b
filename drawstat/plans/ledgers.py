"""Stored ledgers derived from the order tables, and bad announcements for every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawstat.functions.prng import random_ticket
from drawstat.operators.advance import advance, result_of
from drawstat.operators.backtest import WALK_METHODS, bonus_flags, horizon_scores, match_saved
from drawstat.operators.draws import dedup_by_date, with_index, with_violations
from drawstat.operators.tickets import capped_tickets
from drawstat.settings import BASELINE_WINDOW, FORWARD_SEED, FORWARD_TARGET, HISTORY_WINDOW, HORIZONS, SINGLE_GAME
from drawstat.sources.documents import BASELINE_LEDGER, INTEGRATED_RESULT, LEDGER, LIVE_DRAW, RESULT, as_struct, predictions_long
from drawstat.sources.sinks import create_json
from drawstat.sources.tables import NO_PRIORITY, packed_announcements, table
from drawstat.streaming.storage import shared_folder, stored

SHORTEST = HISTORY_WINDOW + 2  # a warm-up, a draw that is processed already and the new one
SHORT = "HISTORY_SHORT"        # outcome of a shorter series

#: Variant -> outcome; the first eight change the draw, the next the documents, the last the history.
VARIANTS = {
    "number_repeated": "INVALID_DRAW", "jolly_drawn": "INVALID_DRAW", "superstar_missing": "INVALID_DRAW", "no_calendar_day": "INVALID_DRAW",
    "known_equal": "ALREADY_PROCESSED", "known_changed": "CONFLICT", "contest_skipped": "CONTEST", "date_early": "ALIGNMENT",
    "counter_off": "COUNTERS", "target_reached": "COUNTERS", "windows_changed": "PROTOCOL", "look_ahead": "PROTOCOL",
    "ticket_changed": "PREDICTIONS", "copy_changed": "PREDICTIONS", "random_changed": "RANDOM", "history_short": "ALIGNMENT",
}


def _document(fields: dict[str, Column], schema: str) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(as_struct(schema))


def valid_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid draw of every date per priority, indexed and written."""
    raw = packed_announcements(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(NO_PRIORITY)))
    valid = with_violations(raw, SINGLE_GAME).filter(F.size("violations") == 0).drop("violations")
    unique = dedup_by_date(valid, "first", keys=("source", "draw_date")).withColumnRenamed("source", "series")
    indexed = with_index(unique.select("series", "draw_date", "numbers", "bonus", (F.col("source_ord") % 90 + 1).cast("int").alias("superstar")))
    return stored(indexed, "ledger-draws")


def ledgers_and_rest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``stored_ledgers`` and the priorities too short for one: (series, draws)."""
    indexed = valid_draws(spark, sf_dir)
    counts = indexed.groupBy("series").agg(F.count("*").alias("draws"))
    names = table(spark, sf_dir, "orders").select(F.coalesce("o_orderpriority", F.lit(NO_PRIORITY)).alias("series")).distinct()
    short = names.join(counts, "series", "left").select("series", F.coalesce("draws", F.lit(0)).cast("bigint").alias("draws"))
    return *_ledgers(indexed.filter(F.col("n_draws") >= SHORTEST)), stored(short.filter(F.col("draws") < SHORTEST), "short-series")


def stored_ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per priority with enough valid draws: the ledgers after all draws past the warm-up but the last (in a long series
    they start later, so that the last one reaches the target), the draws before it, and the last one as a live
    document. Draws and documents are written to shared storage, as ledgers are."""
    return ledgers_and_rest(spark, sf_dir)[:3]


def with_short(rows: DataFrame, short: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Add the series that have no ledger, with an outcome of their own and nothing else."""
    return rows.unionByName(short.select("series", F.lit(SHORT).alias(outcome)), allowMissingColumns=True)


def _ledgers(indexed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    first = F.greatest(F.lit(HISTORY_WINDOW), F.col("n_draws") - FORWARD_TARGET)
    held_draws = F.col("n_draws") - 1 - first
    source = F.lit(None).cast("struct<type: string, path: string, officialVerification: string, officialQuota: double>")
    draw = _document({"date": F.date_format("draw_date", "yyyy-MM-dd"), "contest": F.col("draw_idx") + 1, "numbers": F.col("numbers"),
                      "jolly": F.col("bonus"), "superstar": F.col("superstar"), "source": source}, LIVE_DRAW)
    documents = indexed.filter(F.col("draw_idx") >= first).select("series", "draw_idx", draw.alias("draw"))
    history = indexed.filter(F.col("draw_idx") < F.col("n_draws") - 1).select("series", "draw_date", "numbers")
    scored = horizon_scores(indexed.filter(F.col("draw_idx") >= first - HISTORY_WINDOW), SINGLE_GAME).filter(F.col("draw_idx") >= first)
    tickets = capped_tickets(scored, WALK_METHODS, SINGLE_GAME, carry=("draw_date", "n_draws")).withColumn(
        "random_ticket", random_ticket(FORWARD_SEED, F.col("draw_idx") - first, SINGLE_GAME))
    rows = tickets.join(documents, ["series", "draw_idx"])
    position, one, d = F.col("draw_idx") - first, F.lit(1), F.col("draw")
    frequency, random = result_of(F.col("frequency52_ticket"), one, d), result_of(F.col("random_ticket"), one, d)
    own = result_of(F.col("integrated_ticket"), one, d).withField("comparators", F.struct(frequency.alias("frequency52"), random.alias("random")))
    held, new = position < held_draws, position == held_draws

    def listed(result: Column, kind: str) -> Column:
        entries = F.sort_array(F.collect_list(F.when(held, F.struct(position.alias("at"), result.cast(kind).alias("r")))))
        return F.transform(entries, lambda e: e["r"])

    # one row per series, at most as many draws as the target
    grouped = rows.groupBy("series").agg(
        listed(own, INTEGRATED_RESULT).alias("own"), listed(frequency, RESULT).alias("other"),
        *[F.max(F.when(new, F.col(f"{m}_ticket"))).alias(m) for m in ("integrated", "frequency52", "random")],
        F.max(F.when(position == held_draws - 1, d["date"])).alias("last"), F.max_by("draw", "draw_idx").alias("draw"))
    number, text, no = (lambda v: F.lit(v).cast("int")), F.lit("derived"), F.lit(False)
    integrated = _document({
        "status": F.lit("ACTIVE"), "createdAt": text, "startsAfterDrawDate": text, "protocolRevision": number(1), "targetDraws": number(FORWARD_TARGET),
        "processedDraws": F.size("own"), "stakePerCombination": number(1), "stakeIsSimulated": F.lit(True),
        "model": F.struct(text.alias("name"), F.array(*map(F.lit, HORIZONS)).alias("windows"), text.alias("scoring"), text.alias("optimizer"),
                          text.alias("pairFeatures"), no.alias("lookAhead"), no.alias("midTestParameterChanges"), text.alias("tieBreak")),
        "comparators": F.struct(
            F.struct(text.alias("name"), text.alias("existingProtocolPath"), F.col("frequency52").alias("nextPrediction")).alias("activeBaseline"),
            F.struct(text.alias("name"), text.alias("generator"), F.lit(FORWARD_SEED).cast("bigint").alias("seed"),
                     F.col("random").alias("nextPrediction")).alias("randomBaseline"), text.alias("multiplicity")),
        "nextPrediction": F.col("integrated"), "results": F.col("own"), "lastProcessedDraw": F.col("last"),
        "acceptanceCriteria": F.struct(F.lit(0.4).alias("referenceMeanHitsPerCombination"), text.alias("equalBudget"),
                                       F.lit(True).alias("noMidTestParameterChanges"), text.alias("pairedComparison"), text.alias("interpretation"))}, LEDGER)
    baseline = _document({
        "status": F.lit("ACTIVE"), "startedAt": text, "protocolRevision": number(1), "revisionReason": text, "targetDraws": number(FORWARD_TARGET),
        "processedDraws": F.size("other"), "lastProcessedDraw": F.col("last"), "stakePerCombination": number(1),
        "strategy": F.struct(text.alias("name"), number(BASELINE_WINDOW).alias("frequencyWindow"),
                             F.struct(number(SINGLE_GAME.cap).alias("maxNumbersPerDecade")).alias("constraints"), text.alias("selection"),
                             no.alias("lookAhead"), no.alias("midTestParameterChanges")),
        "nextPrediction": F.col("frequency52"), "results": F.col("other"),
        "acceptanceCriteria": F.struct(F.lit(0.4).alias("referenceMeanHits"), F.lit(1.0).alias("referenceStakeReturn"), text.alias("interpretation"))},
        BASELINE_LEDGER)
    documents = stored(grouped.select("series", integrated.alias("integrated"), baseline.alias("baseline"), "draw"), "ledgers")
    return documents.drop("draw"), history, documents.select("series", "draw")


def bad_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every variant for every series; a variant of a series is a series of its own."""
    ledgers, history, draws, rest = ledgers_and_rest(spark, sf_dir)
    names = F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant")
    key = F.concat_ws("#", "variant", "series").alias("series")
    cases = ledgers.join(draws, "series").select("*", names)
    d, i, b = F.col("draw"), F.col("integrated"), F.col("baseline")
    known, numbers, other = F.element_at(i["results"], -1), d["numbers"], F.array(*[F.lit(n) for n in range(1, 7)])
    repeated = F.array_sort(F.concat(F.slice(numbers, 1, 5), F.slice(numbers, 1, 1)))
    equal = d
    for field, name in (("date", "drawDate"), ("contest", "contest"), ("numbers", "draw"), ("jolly", "jolly"), ("superstar", "superstar")):
        equal = equal.withField(field, known[name])
    changes = {
        "draw": (d, {"number_repeated": d.withField("numbers", repeated), "jolly_drawn": d.withField("jolly", numbers[0]),
                     "superstar_missing": d.withField("superstar", F.lit(None).cast("int")), "no_calendar_day": d.withField("date", F.lit("2023-02-30")),
                     "known_equal": equal, "known_changed": equal.withField("superstar", known["superstar"] % 90 + 1),
                     "contest_skipped": d.withField("contest", d["contest"] + 1), "date_early": d.withField("date", F.lit("1900-01-01"))}),
        "integrated": (i, {"counter_off": i.withField("processedDraws", i["processedDraws"] + 1),
                           "windows_changed": i.withField("model.windows", F.array(F.lit(12), F.lit(52))), "ticket_changed": i.withField("nextPrediction", other),
                           "copy_changed": i.withField("comparators.activeBaseline.nextPrediction", other),
                           "random_changed": i.withField("comparators.randomBaseline.nextPrediction", other)}),
        "baseline": (b, {"target_reached": b.withField("targetDraws", b["processedDraws"]), "look_ahead": b.withField("strategy.lookAhead", F.lit(True))}),
    }

    def changed(column: Column, variants: dict[str, Column]) -> Column:
        for name, value in variants.items():
            column = F.when(F.col("variant") == name, value).otherwise(column)
        return column

    bad = cases.select(key, *[changed(*c).alias(n) for n, c in changes.items()])
    latest = history.groupBy("series").agg(F.max("draw_date").alias("latest"))
    short = history.join(latest, "series").select("*", names).filter((F.col("variant") != "history_short") | (F.col("draw_date") < F.col("latest")))
    out = advance(bad.drop("draw"), short.select(key, "draw_date", "numbers"), bad.select("series", "draw"))
    parts = F.split("series", "#", 2)
    return with_short(out.select(parts[1].alias("series"), parts[0].alias("variant"), "outcome"), rest)


def saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickets that the stored ledgers froze, saved as one document, read back and compared with the draw that
    came after them, bonus and superstar included."""
    ledgers, _, draws, short = ledgers_and_rest(spark, sf_dir)
    i = F.col("integrated")
    tickets = F.create_map(F.lit("integrated"), i["nextPrediction"], F.lit("frequency52"), F.col("baseline.nextPrediction"),
                           F.lit("random"), i["comparators"]["randomBaseline"]["nextPrediction"])
    by_series = F.map_from_entries(F.collect_list(F.struct("series", tickets.alias("tickets"))))  # one entry per priority
    path = shared_folder(spark, "predictions")
    create_json(ledgers.agg(by_series.alias("predictionsByWheel")), path)
    saved = predictions_long(spark.read.schema("predictionsByWheel map<string, map<string, array<int>>>").json(path))
    actual = draws.select("series", "draw.numbers", F.col("draw.jolly").alias("bonus"), "draw.superstar")
    matched = bonus_flags(match_saved(saved, actual).drop("hit_count")).drop("bonus", "superstar")
    return with_short(matched.withColumn("outcome", F.lit("MATCHED")), short)


def ledger_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stored ledger: draws before it, progress towards its target, and the method with most hits so far
    (ties to the first)."""
    ledgers, history, _, short = ledgers_and_rest(spark, sf_dir)
    i = F.col("integrated")

    def total(hits) -> Column:
        return F.aggregate(i["results"], F.lit(0), lambda n, r: n + hits(r))

    totals = {"integrated": total(lambda r: r["mainHits"]), "frequency52": total(lambda r: r["comparators"]["frequency52"]["mainHits"]),
              "random": total(lambda r: r["comparators"]["random"]["mainHits"])}
    ranked = F.array(*[F.struct(t.alias("hits"), F.lit(-n).alias("rank"), F.lit(m).alias("method")) for n, (m, t) in enumerate(totals.items())])
    held = history.groupBy("series").agg(F.count("*").alias("draws"))
    cards = ledgers.select("series", i["processedDraws"].alias("processed"), i["targetDraws"].alias("target"), F.array_max(ranked).alias("best"))
    none = short.select("series", "draws", F.lit(f"0/{FORWARD_TARGET}").alias("progress"))
    return cards.join(held, "series").select(
        "series", "draws", F.concat_ws("/", F.col("processed").cast("string"), F.col("target").cast("string")).alias("progress"),
        F.col("best.method").alias("best_method"), F.col("best.hits").alias("best_hits")).unionByName(none, allowMissingColumns=True)
