"""Stored ledgers: one step, idempotence, documents that keep every field."""

import json

import pytest
from pyspark.sql import functions as F

from drawstat.operators.advance import VIOLATIONS, advance, valid_contest, valid_superstar
from drawstat.plans.ledgers import VARIANTS, stored_ledgers
from drawstat.sources.documents import BASELINE_LEDGER, LEDGER, RECEIPT, as_struct, read_document
from drawstat.sources.sinks import append_receipt, create_json
from tests import reference_forms as rf


@pytest.fixture(scope="module")
def step(spark):
    ledgers, history, draws = stored_ledgers(spark, "/root/testdata/sf0.01")
    first = advance(ledgers, history, draws)
    return (ledgers, history, draws, spark.createDataFrame(first.collect(), first.schema))


def test_frozen_tickets_are_scored_before_rolling_forward(step):
    ledgers, history, draws, first = step
    before = {r["series"]: r for r in ledgers.collect()}
    draw = {r["series"]: r["draw"] for r in draws.collect()}
    held = {s: [r["numbers"] for r in history.filter(F.col("series") == s).orderBy("draw_date").collect()] for s in before}
    assert before
    for r in first.collect():
        old, new, d = before[r["series"]]["integrated"], r["integrated"], draw[r["series"]]
        row = new["results"][-1]
        assert r["outcome"] == "PROCESSED" and new["processedDraws"] == old["processedDraws"] + 1 == len(new["results"])
        assert row["prediction"] == old["nextPrediction"] == rf.horizon_ticket(held[r["series"]])
        assert row["mainHits"] == len(set(row["prediction"]) & set(d["numbers"])) and row["draw"] == d["numbers"]
        assert new["nextPrediction"] == rf.horizon_ticket([*held[r["series"]], d["numbers"]])
        assert new["results"][:-1] == old["results"] and new["model"] == old["model"] and r["baseline"]["results"][:-1] == before[r["series"]]["baseline"]["results"]
        assert new["acceptanceCriteria"] == old["acceptanceCriteria"] and new["lastProcessedDraw"] == d["date"]


def test_a_repeated_draw_changes_nothing(step):
    _, history, draws, first = step
    moved = draws.select("series", F.to_date("draw.date").alias("draw_date"), "draw.numbers")
    again = advance(first.drop("outcome"), history.unionByName(moved), draws)
    rows, done = ({r["series"]: r for r in f.collect()} for f in (again, first))
    assert {r["outcome"] for r in rows.values()} == {"ALREADY_PROCESSED"}
    assert all((rows[s]["integrated"], rows[s]["baseline"]) == (done[s]["integrated"], done[s]["baseline"]) for s in done)
    other = draws.withColumn("draw", F.col("draw").withField("jolly", F.col("draw.jolly") % 90 + 1))
    outcomes = {r["outcome"] for r in advance(first.drop("outcome"), history, other).select("outcome").collect()}
    assert outcomes <= {"CONFLICT", "INVALID_DRAW"} and "CONFLICT" in outcomes


def test_every_rule_has_a_variant():
    assert set(VIOLATIONS) == set(VARIANTS.values()) - {"ALREADY_PROCESSED"}


def test_superstar_and_contest_rules(spark):
    rows = spark.createDataFrame([(1, 1), (90, None), (91, 7), (0, -3), (None, 0)], "superstar int, contest int")
    found = rows.select(valid_superstar(F.col("superstar")).alias("s"), valid_contest(F.col("contest")).alias("c")).collect()
    assert [r["s"] for r in found] == [True, True, False, False, False] and [r["c"] for r in found] == [True, False, True, True, True]


def test_receipts_and_ledgers_keep_every_field(spark, step, tmp_path):
    *_, first = step
    one = first.limit(1)
    create_json(one.select("integrated.*"), str(tmp_path / "integrated"))
    back = spark.read.schema(LEDGER).json(str(tmp_path / "integrated"))
    assert back.first() == one.select("integrated.*").first()
    create_json(one.select("baseline.*"), str(tmp_path / "baseline"))
    assert spark.read.schema(BASELINE_LEDGER).json(str(tmp_path / "baseline")).first() == one.select("baseline.*").first()
    update = F.struct(F.col("integrated").cast(as_struct(LEDGER)).alias("integrated"), F.col("baseline").cast(as_struct(BASELINE_LEDGER)).alias("baseline"),
                      F.lit(False).alias("alreadyProcessed"))
    before = F.struct(F.to_json("integrated").alias("integrated"), F.to_json("baseline").alias("baseline"))
    receipt = one.select(F.lit("now").alias("recordedAt"), F.lit("derived").alias("sourceStatus"), before.alias("before"), update.alias("update"))
    for _ in range(2):
        append_receipt(receipt, str(tmp_path / "receipts"))
    kept = spark.read.schema(RECEIPT).json(str(tmp_path / "receipts"))
    assert kept.count() == 2 and kept.first() == receipt.first()
    (tmp_path / "one.json").write_text(json.dumps(json.loads(receipt.select(F.to_json(F.struct("*"))).first()[0]), indent=1))
    assert read_document(spark, str(tmp_path / "one.json"), RECEIPT).first()["update"] == receipt.first()["update"]
