"""Forward ledger as a Structured Streaming operator.

Announcements are judged with column rules and equal ones counted before anything is kept; what keeps no rule comes
out at once. Only distinct valid contents reach the keyed state of a series: a value for its head, a list of
the draws that the longest horizon reaches, and a map from the day of every accepted draw to its content. A late, skipped
or conflicting announcement is not dropped but comes out with its outcome, and an equal repetition changes nothing.
Every accepted draw, the warm-up included, is recognised again as REPEATED or CONFLICT whatever its age. Within a run
the order of files does not matter; a draw before the last accepted one of an earlier run is OUT_OF_ORDER.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from drawstat.functions.columns import valid_bonus, valid_numbers, whole_in_range
from drawstat.functions.prng import uniforms_at
from drawstat.settings import BASELINE_WINDOW, FORWARD_SEED, FORWARD_TARGET, HISTORY_WINDOW, HORIZONS, SINGLE_GAME, Game
from drawstat.streaming.storage import stored

OUTPUT = ("series string, draw_date date, contest int, outcome string, times bigint, method string, prediction array<int>, "
          "actual array<int>, bonus int, main_hits int, processed_draws int, status string")

@dataclass(frozen=True)
class LedgerRules:
    """``warmup`` draws are history only; the next ``target`` draws are scored. ``consecutive`` also asks
    every contest number to follow the one before."""

    game: Game = SINGLE_GAME
    windows: Sequence[int] = HORIZONS
    baseline: int = BASELINE_WINDOW
    warmup: int = HISTORY_WINDOW
    target: int = FORWARD_TARGET
    seed: int = FORWARD_SEED
    consecutive: bool = True


def capped_ticket(scores: np.ndarray, game: Game) -> list[int]:
    """Best numbers (ties to the smaller one) with at most ``cap`` per decade."""
    order = np.argsort(-scores, kind="stable")
    decades = order // game.decade
    rank_in_decade = np.zeros(len(order), dtype=int)
    for decade in np.unique(decades):
        rank_in_decade[decades == decade] = np.arange((decades == decade).sum())
    return sorted((order[rank_in_decade < game.cap][: game.pick] + 1).tolist())


def predictions(history: np.ndarray, processed: int, rules: LedgerRules) -> dict[str, list[int]]:
    """The three tickets frozen before the next draw."""
    game = rules.game

    def counts(window: int) -> np.ndarray:
        return np.bincount(history[-window:].ravel() - 1, minlength=game.pool)

    score, p = np.zeros(game.pool), game.hit_probability
    for w in rules.windows:
        score = score + (counts(w) - w * p) / (w * p * (1 - p)) ** 0.5 / len(rules.windows)
    chosen: list[int] = []
    for u, top in zip(uniforms_at(rules.seed, processed * game.pick + np.arange(game.pick)), range(game.pool - game.pick, game.pool)):
        candidate = int(u * (top + 1))
        chosen.append(top if candidate in chosen else candidate)
    return {"integrated": capped_ticket(score, game), "frequency52": capped_ticket(counts(rules.baseline).astype(float), game),
            "random": sorted(n + 1 for n in chosen)}


CONTENT = ("series", "draw_date", "contest", "numbers", "bonus", "superstar")
VALID = "series string, draw_date date, contest int, numbers array<int>, bonus int, superstar int, first_ord bigint, times bigint"


def counted(announcements: DataFrame, rules: LedgerRules) -> DataFrame:
    """Distinct announcements with how often and since which source order they came, and whether they keep the rules for
    dates and numbers. One aggregate that combines before it moves, so repetitions never reach the state."""
    game = rules.game
    valid = (F.col("draw_date").isNotNull() & valid_numbers(F.col("numbers"), game) & valid_bonus(F.col("bonus"), F.col("numbers"), game)
             & whole_in_range(F.col("superstar"), game.pool))
    contents = announcements.groupBy(*CONTENT).agg(F.min("source_ord").cast("bigint").alias("first_ord"), F.count("*").alias("times"))
    return contents.withColumn("valid", valid)


def refused(contents: DataFrame) -> DataFrame:
    """The outcome rows of contents that keep no rule."""
    known = {"outcome": F.lit("INVALID"), "actual": F.coalesce("numbers", F.array().cast("array<int>"))}
    wanted = [c.split() for c in OUTPUT.split(", ")]
    return contents.select(*[known.get(n, F.col(n) if n in contents.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


class LedgerProcessor(StatefulProcessor):
    """The ledger of one series: its head, the draws that a horizon still reaches, and every accepted draw by its day."""

    def __init__(self, rules: LedgerRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "held int, last_day int, last_contest int")
        self.recent = handle.getListState("recent", "numbers array<int>")
        self.known = handle.getMapState("known", "day int", "contest int, numbers array<int>, bonus int, superstar int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rules, out = self.rules, []
        held, last_day, last_contest = self.head.get() if self.head.exists() else (0, 0, None)
        before = [list(r[0]) for r in self.recent.get()] if self.recent.exists() else []
        history = np.array(before, dtype=int).reshape(-1, rules.game.pick)
        reach, start = max(*rules.windows, rules.baseline), held

        def report(row, outcome, times, method=None, ticket=None, hits=None, processed=None):
            status = None if processed is None else ("COMPLETE" if processed >= rules.target else "ACTIVE")
            out.append((row.series, row.draw_date, row.contest, outcome, times, method, ticket, row.numbers, row.bonus, hits, processed, status))

        contents = pd.concat(list(rows))
        contents["numbers"] = [list(map(int, n)) for n in contents["numbers"]]
        contents["contest"] = [None if pd.isna(c) else int(c) for c in contents["contest"].astype(object)]
        for row in contents.sort_values(["draw_date", "first_ord"]).astype({"contest": object}).itertuples():
            day, processed = pd.Timestamp(row.draw_date).toordinal(), max(0, held - rules.warmup)
            contest = None if row.contest is None or pd.isna(row.contest) else int(row.contest)
            row = row._replace(contest=contest)
            mine, times = (contest, row.numbers, int(row.bonus), int(row.superstar)), int(row.times)
            if self.known.containsKey((day,)):
                there = self.known.getValue((day,))
                report(row, "REPEATED" if (there[0], list(there[1]), there[2], there[3]) == mine else "CONFLICT", times)
            elif day <= last_day:
                report(row, "OUT_OF_ORDER", times)
            elif processed >= rules.target:
                report(row, "TARGET_REACHED", times)
            elif rules.consecutive and last_contest is not None and contest != last_contest + 1:
                report(row, "CONTEST_GAP", times)
            else:
                if held >= rules.warmup:
                    for method, ticket in predictions(history, processed, rules).items():
                        report(row, "SCORED", times, method, ticket, len(set(ticket) & set(row.numbers)), processed + 1)
                else:
                    report(row, "HISTORY", times)
                if times > 1:
                    report(row, "REPEATED", times - 1)
                history = np.vstack([history, np.array(row.numbers, dtype=int)])[-reach:]
                held, last_day, last_contest = held + 1, day, contest
                self.known.updateValue((day,), mine)  # at most warmup + target entries
        if held > start:
            self.head.update((held, last_day, last_contest))
            self.recent.put([(n,) for n in history.tolist()])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def ledger_stream(contents: DataFrame, rules: LedgerRules = LedgerRules()) -> DataFrame:
    """Distinct valid contents (``VALID``) as a stream -> outcome and result rows. The contents of a trigger are processed by
    date and source order; the state changes by the accepted draws alone."""
    return contents.groupBy("series").transformWithStateInPandas(LedgerProcessor(rules), OUTPUT, "append", "none")


def run_ledger(announcements: DataFrame, folder: str, rules: LedgerRules = LedgerRules()) -> DataFrame:
    """Take in what the source holds (series, draw_date, contest, numbers, bonus, superstar, source_ord) and return the whole
    outcome table below ``folder``.

    Two queries, each with a checkpoint of its own, so a restarted run goes on where the last one committed: the intake
    counts and judges contents with columns, one overwritten folder per trigger, so that a trigger done twice leaves
    one result; the ledger reads the valid ones into its state."""
    spark = announcements.sparkSession

    def intake(batch: DataFrame, number: int) -> None:
        contents = stored(counted(batch, rules), "contents")
        contents.filter("valid").drop("valid").write.mode("overwrite").parquet(f"{folder}/valid/trigger={number}")
        refused(contents.filter("NOT valid")).write.mode("overwrite").parquet(f"{folder}/refused/trigger={number}")

    query = (announcements.writeStream.foreachBatch(intake).option("checkpointLocation", f"{folder}/intake").trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        accepted = spark.readStream.schema(VALID).parquet(f"{folder}/valid/*")
        provider = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(provider)
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what keyed states need
        try:
            run_available(ledger_stream(accepted, rules), f"{folder}/results", f"{folder}/ledger")
        finally:
            spark.conf.set(provider, before)
        return spark.read.schema(OUTPUT).parquet(f"{folder}/results").unionByName(spark.read.schema(OUTPUT).parquet(f"{folder}/refused/*"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], OUTPUT)  # nothing has ever arrived


def run_available(results: DataFrame, path: str, checkpoint: str) -> None:
    """Process what the source holds and append it to a Parquet table; progress lives in ``checkpoint``, so a
    restarted run goes on where the last one committed."""
    query = (results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def scored(results: DataFrame) -> DataFrame:
    return results.filter(F.col("outcome") == "SCORED").drop("outcome", "times")
