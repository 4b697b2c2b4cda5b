"""Advance stored forward ledgers by one draw.

A series has two stored documents, the integrated and the baseline ledger, with the tickets frozen for the next
draw. The new draw is checked against both in a fixed order of rules; the first rule it breaks is the outcome
and nothing changes. Otherwise the frozen tickets are scored, the results appended, the counters moved on
and the next tickets frozen. Every series is one row; the tickets are rebuilt from its history by windows, so
any number of series advances in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawstat.functions.columns import (gross_return, net_profit, overlap, payout_status, prize_category, valid_bonus, valid_date, valid_numbers,
                                        whole_in_range)
from drawstat.functions.prng import random_ticket
from drawstat.operators.backtest import next_tickets
from drawstat.operators.draws import with_index
from drawstat.operators.ledger import status_after
from drawstat.settings import BASELINE_WINDOW, HISTORY_WINDOW, HORIZONS, SINGLE_GAME, Game
from drawstat.sources.documents import INTEGRATED_RESULT, RESULT

DONE, REPEATED = "PROCESSED", "ALREADY_PROCESSED"
#: Outcomes of refused draws in the order in which the rules are tried.
VIOLATIONS = ("INVALID_DRAW", "CONFLICT", "COUNTERS", "CONTEST", "PROTOCOL", "ALIGNMENT", "PREDICTIONS", "RANDOM")
_NOW, _AFTER = "now/", "after/"


def valid_superstar(number: Column, game: Game = SINGLE_GAME) -> Column:
    """Drawn from its own pool, so it may repeat a drawn number."""
    return whole_in_range(number, game.pool)


def valid_contest(contest: Column) -> Column:
    return F.coalesce(contest == F.floor(contest), F.lit(False))


def valid_draw(draw: Column, game: Game = SINGLE_GAME) -> Column:
    """All rules for a live draw (date, contest, numbers, jolly, superstar)."""
    return (valid_numbers(draw["numbers"], game) & valid_bonus(draw["jolly"], draw["numbers"], game) & valid_superstar(draw["superstar"], game)
            & valid_contest(draw["contest"]) & valid_date(draw["date"]))


def result_of(prediction: Column, stake: Column, draw: Column) -> Column:
    """One ticket scored against a draw, as a row of a ledger."""
    hits = overlap(prediction, draw["numbers"])
    fields = {"drawDate": draw["date"], "contest": draw["contest"], "prediction": prediction, "draw": draw["numbers"], "jolly": draw["jolly"],
              "superstar": draw["superstar"], "mainHits": hits, "category": prize_category(hits, prediction, draw["jolly"]), "stake": stake,
              "grossReturn": gross_return(hits), "netProfit": net_profit(hits, stake), "payoutStatus": payout_status(hits), "source": draw["source"]}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(RESULT)


def _rebuilt(history: DataFrame, draws: DataFrame, game: Game) -> DataFrame:
    """Tickets that follow from the history, without and with the new draw: one pass over both."""
    held = history.select(F.concat(F.lit(_NOW), "series").alias("series"), "draw_date", "numbers")
    fine = draws.filter(valid_draw(F.col("draw"), game)).select(
        F.concat(F.lit(_AFTER), "series").alias("series"), F.to_date("draw.date").alias("draw_date"), "draw.numbers")
    with_new = history.select(F.concat(F.lit(_AFTER), "series").alias("series"), "draw_date", "numbers").unionByName(fine)
    tickets = next_tickets(with_index(held.unionByName(with_new)), game, warmup=0)
    name, now = F.regexp_replace("series", f"^({_NOW}|{_AFTER})", ""), F.col("series").startswith(_NOW)
    return tickets.groupBy(name.alias("series")).agg(*[
        F.max(F.when(condition, F.col(f"{m}_ticket"))).alias(f"{side}_{m}")
        for side, condition in (("now", now), ("after", ~now)) for m in ("integrated", "frequency52")])


def advance(ledgers: DataFrame, history: DataFrame, draws: DataFrame, game: Game = SINGLE_GAME) -> DataFrame:
    """(series, outcome, integrated, baseline) after one draw a series.

    ``ledgers``: series, integrated, baseline (documents); ``history``: series, draw_date, numbers, all draws before the
    new one; ``draws``: series, draw (a live draw document). A series without a draw does not come out."""
    last = history.groupBy("series").agg(F.max("draw_date").alias("last_held"))
    reach = max(*HORIZONS, BASELINE_WINDOW, HISTORY_WINDOW)
    recent = with_index(history).filter(F.col("draw_idx") >= F.col("n_draws") - reach).select("series", "draw_date", "numbers")
    rows = ledgers.join(draws, "series").join(last, "series", "left").join(_rebuilt(recent, draws, game), "series", "left")
    i, b, draw = F.col("integrated"), F.col("baseline"), F.col("draw")
    own, other = F.coalesce(i["results"], F.array()), F.coalesce(b["results"], F.array())

    def same(result: Column) -> Column:
        return (result["draw"].eqNullSafe(draw["numbers"]) & result["jolly"].eqNullSafe(draw["jolly"])
                & result["superstar"].eqNullSafe(draw["superstar"]) & result["contest"].eqNullSafe(draw["contest"]))

    def known(results: Column) -> Column:
        return F.get(F.filter(results, lambda r: r["drawDate"] == draw["date"]), 0)

    found, twin = known(own), known(other)
    counters = ((i["processedDraws"] == F.size(own)) & (b["processedDraws"] == F.size(other))
                & (i["processedDraws"] < i["targetDraws"]) & (b["processedDraws"] < b["targetDraws"]))
    follows = draw["contest"] == F.try_element_at(other, F.lit(-1))["contest"] + 1
    frozen = (~i["model"]["lookAhead"] & ~i["model"]["midTestParameterChanges"] & (i["model"]["windows"] == F.array(*map(F.lit, HORIZONS)))
              & (b["strategy"]["frequencyWindow"] == BASELINE_WINDOW) & (b["strategy"]["constraints"]["maxNumbersPerDecade"] == game.cap)
              & ~b["strategy"]["lookAhead"] & ~b["strategy"]["midTestParameterChanges"])
    before = F.coalesce(i["lastProcessedDraw"], i["startsAfterDrawDate"])
    aligned = (before == b["lastProcessedDraw"]) & (F.date_format("last_held", "yyyy-MM-dd") == before) & (draw["date"] > before)
    rebuilt = ((F.col("now_integrated") == i["nextPrediction"]) & (F.col("now_frequency52") == b["nextPrediction"])
               & (b["nextPrediction"] == i["comparators"]["activeBaseline"]["nextPrediction"]))
    seed, stored = i["comparators"]["randomBaseline"]["seed"], i["comparators"]["randomBaseline"]["nextPrediction"]
    drawn = random_ticket(seed, i["processedDraws"], game) == stored

    def broken(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    rules = (counters, follows, frozen, aligned, rebuilt, drawn)
    outcome = F.when(broken(valid_draw(draw, game)), F.lit(VIOLATIONS[0])).when(
        found.isNotNull(), F.when(twin.isNotNull() & same(found) & same(twin), F.lit(REPEATED)).otherwise(F.lit(VIOLATIONS[1])))
    for name, rule in zip(VIOLATIONS[2:], rules):
        outcome = outcome.when(broken(rule), F.lit(name))
    judged = rows.withColumn("outcome", outcome.otherwise(F.lit(DONE)))

    stake, baseline_stake = i["stakePerCombination"], b["stakePerCombination"]
    mine = result_of(i["nextPrediction"], stake, draw)
    compared = F.struct(result_of(b["nextPrediction"], baseline_stake, draw).alias("frequency52"), result_of(stored, stake, draw).alias("random"))
    row = mine.withField("comparators", compared).cast(INTEGRATED_RESULT)

    def moved(document: Column, results: Column, new: Column) -> Column:
        count = F.size(results) + 1
        return (document.withField("results", F.concat(results, F.array(new))).withField("processedDraws", count)
                .withField("lastProcessedDraw", draw["date"]).withField("status", status_after(count, document["targetDraws"])))

    next_baseline = moved(b, other, result_of(b["nextPrediction"], baseline_stake, draw)).withField("nextPrediction", F.col("after_frequency52"))
    next_integrated = (moved(i, own, row).withField("nextPrediction", F.col("after_integrated"))
                       .withField("comparators.activeBaseline.nextPrediction", F.col("after_frequency52"))
                       .withField("comparators.randomBaseline.nextPrediction", random_ticket(seed, F.size(own) + 1, game)))
    done = F.col("outcome") == DONE
    return judged.select("series", "outcome", F.when(done, next_integrated).otherwise(i).alias("integrated"),
                         F.when(done, next_baseline).otherwise(b).alias("baseline"))
