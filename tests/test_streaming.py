from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from drawstat.operators import ledger as lg
from drawstat.settings import SINGLE_GAME
from drawstat.streaming.ledger_stream import LedgerRules, run_ledger, scored
from tests import reference_forms as rf

SCHEMA = "series string, draw_date date, contest int, numbers array<int>, bonus int, superstar int, source_ord bigint"
START = date(2023, 1, 1)


def announcement(i, numbers, series="s", contest=None, bonus=None, order=None):
    free = next(n for n in range(1, 91) if n not in numbers)
    return (series, START + timedelta(days=i), i + 1 if contest is None else contest, list(numbers), free if bonus is None else bonus, 7,
            i if order is None else order)


@pytest.fixture
def run(spark, tmp_path):
    """Write one file per call and let the stream process it from its checkpoint."""
    source = tmp_path / "in"
    source.mkdir()

    def step(rows, rules=LedgerRules()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        return run_ledger(stream, str(tmp_path / "ledger"), rules)

    return step


def outcomes(table):
    return {(r["draw_date"], r["contest"]): (r["outcome"], r["times"]) for r in table.filter("outcome not in ('HISTORY', 'SCORED')").collect()}


def test_stream_equals_batch_ledger_across_restarts(spark, run, make_draws):
    draws = rf.random_draws(216, seed=4)
    rows = [announcement(i, d) for i, d in enumerate(draws)]
    run(rows[:209])
    run(rows[209:212])
    table = run(rows[212:])
    got = {(r["draw_date"] - START, r["method"]): (r["prediction"], r["main_hits"], r["processed_draws"]) for r in scored(table).collect()}
    indexed = make_draws(draws, start=START).withColumn("bonus", F.lit(None).cast("int"))
    expected = {(r["draw_date"] - START, r["method"]): (r["prediction"], r["main_hits"], r["processed_draws"])
                for r in lg.ledger(indexed, SINGLE_GAME, 208).collect()}
    assert got == expected and len(got) == 24


def test_violations_come_out_and_repetitions_change_nothing(spark, run):
    rules = LedgerRules(windows=(2,), baseline=2, warmup=2, target=2)
    draws = rf.random_draws(8, seed=6)
    run([announcement(i, d) for i, d in enumerate(draws[:3])], rules)
    table = run([
        announcement(2, draws[2]), announcement(2, draws[2]),                      # equal repetition, twice
        announcement(1, draws[5]),                                                 # other content for a known date
        announcement(3, [5, 5, 28, 41, 56, 66]),                                   # repeated number
        announcement(4, draws[4], contest=9),                                      # skipped contest
        announcement(-1, draws[6], contest=4),                                     # before the series
        announcement(5, draws[5], contest=4),                                      # the right next one
        announcement(6, draws[6], contest=5),                                      # beyond the target
    ], rules)
    seen = outcomes(table)
    day = lambda i: START + timedelta(days=i)
    assert seen == {(day(2), 3): ("REPEATED", 2), (day(1), 2): ("CONFLICT", 1), (day(3), 4): ("INVALID", 1),
                    (day(4), 9): ("CONTEST_GAP", 1), (day(-1), 4): ("OUT_OF_ORDER", 1), (day(6), 5): ("TARGET_REACHED", 1)}
    last = scored(table).filter(F.col("draw_date") == day(5)).collect()
    assert {r["processed_draws"] for r in last} == {2} and {r["status"] for r in last} == {"COMPLETE"} and len(last) == 3


def test_missing_numbers_are_invalid_and_stop_nothing(spark, run):
    rules = LedgerRules(windows=(2,), baseline=2, warmup=2, target=5)
    draws = rf.random_draws(3, seed=8)
    bad = (*announcement(1, draws[1])[:3], [1, None, 3, 4, 5, 6], None, None, 7)
    table = run([announcement(0, draws[0]), bad, announcement(2, draws[2], contest=2), (*announcement(3, draws[1])[:3], None, 5, 6, 8)], rules)
    assert sorted(r["outcome"] for r in table.collect()) == ["HISTORY", "HISTORY", "INVALID", "INVALID"]


def test_old_draws_are_recognised_after_the_target(spark, run):
    """A repetition of the first draw is REPEATED like one of the last, whatever the length of the warm-up."""
    rules = LedgerRules(windows=(2,), baseline=2, warmup=6, target=1)
    draws = rf.random_draws(7, seed=3)
    run([announcement(i, d) for i, d in enumerate(draws)], rules)
    table = run([announcement(0, draws[0]), announcement(6, draws[6]), announcement(1, draws[5])], rules)
    assert outcomes(table) == {(START, 1): ("REPEATED", 1), (START + timedelta(days=6), 7): ("REPEATED", 1),
                               (START + timedelta(days=1), 2): ("CONFLICT", 1)}


def test_conflicting_bonus_is_a_conflict(spark, run):
    rules = LedgerRules(windows=(2,), baseline=2, warmup=2, target=5)
    draws = rf.random_draws(3, seed=8)
    run([announcement(i, d) for i, d in enumerate(draws)], rules)
    other = next(n for n in range(50, 91) if n not in draws[2])
    assert outcomes(run([announcement(2, draws[2], bonus=other)], rules)) == {(START + timedelta(days=2), 3): ("CONFLICT", 1)}


def test_files_out_of_order_and_a_hot_series(spark, tmp_path):
    """One series owns most announcements, all of them repeated; its files hold later draws first."""
    source = tmp_path / "in"
    source.mkdir()
    rules = LedgerRules(windows=(2,), baseline=2, warmup=2, target=50)
    draws = rf.random_draws(12, seed=5)
    hot = [announcement(i, d, "hot", order=100 * i) for i, d in enumerate(draws)]
    for part in (hot[8:], hot[:8] + [announcement(i, d, "cold") for i, d in enumerate(draws[:3])]):
        spark.createDataFrame(part * 40, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    table = run_ledger(spark.readStream.schema(SCHEMA).parquet(str(source)), str(tmp_path / "ledger"), rules)
    counts = {(r["series"], r["outcome"]): (r["n"], r["times"]) for r in table.groupBy("series", "outcome").agg(
        F.count("*").alias("n"), F.sum("times").alias("times")).collect()}
    assert counts == {("hot", "HISTORY"): (2, 80), ("hot", "SCORED"): (30, 1200), ("hot", "REPEATED"): (12, 468),
                      ("cold", "HISTORY"): (2, 80), ("cold", "SCORED"): (3, 120), ("cold", "REPEATED"): (3, 117)}


def test_nothing_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run_ledger(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "ledger")).count() == 0
