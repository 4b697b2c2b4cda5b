import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from drawstat.operators.draws import DataError, dedup_by_date, require_valid, with_violations
from drawstat.settings import SINGLE_GAME
from drawstat.sources.archive import parse_lines, read_archive, read_archives, to_lines
from drawstat.sources.documents import LEDGER, LIVE_DRAW, PROTOCOL, RECEIPT, nested_document, predictions_long, read_document, snapshot
from drawstat.sources.pages import parse_draw_tables, read_pages
from drawstat.sources.sinks import create_json, file_hashes, overwrite_json, require_recorded_hashes, same_document, save_experiment, summary_lines

HEADER = "data,n1,n2,n3,n4,n5,n6,jolly"


def test_archive_by_header_name_with_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("﻿jolly,data,n1,n2,n3,n4,n5,n6\r\n9,2024-01-01,1,2,3,4,5,6\r\n").encode())
    (tmp_path / "b.csv").write_text(f"{HEADER}\n2024-01-01,1,2,3,4,5,6,9\n2024-01-02,1,2,3,4,5,x,9\n")
    rows = read_archives(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    first = rows.filter("source_ord.source = 0").first()
    assert (first["draw_date"], first["numbers"], first["bonus"]) == (date(2024, 1, 1), [1, 2, 3, 4, 5, 6], 9)
    bad = with_violations(rows, SINGLE_GAME, "date_text").filter(F.size("violations") > 0).collect()
    assert [(r["date_text"], r["violations"]) for r in bad] == [("2024-01-02", ["numbers"])]
    unique = dedup_by_date(rows.filter("draw_date = '2024-01-01'")).first()
    assert unique["n_rows"] == 2 and not unique["conflict"]


def test_strict_archive_refuses(spark, tmp_path):
    (tmp_path / "missing.csv").write_text("data,n1\n2024-01-01,1\n")
    with pytest.raises(DataError, match="lacks columns"):
        read_archive(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "short.csv").write_text(f"{HEADER}\n2024-01-01,1,2,3\n")
    with pytest.raises(Exception):
        read_archive(spark, str(tmp_path / "short.csv")).collect()
    lax = read_archive(spark, str(tmp_path / "missing.csv"), strict=False).first()
    assert lax["numbers"] == [1, None, None, None, None, None] and lax["bonus"] is None
    with pytest.raises(DataError):
        require_valid(with_violations(read_archive(spark, str(tmp_path / "missing.csv"), strict=False), SINGLE_GAME, "date_text"))
    no_bonus = read_archive(spark, str(tmp_path / "short.csv"), strict=False, bonus=False)
    assert "bonus" not in no_bonus.columns


def test_lines_roundtrip_and_malformed(spark):
    lines = spark.createDataFrame([("2024-01-01,1,2,3,4,5,6,9",)], "line string")
    draws = parse_lines(lines, HEADER)
    assert to_lines(draws).first()["line"] == "2024-01-01,1,2,3,4,5,6,9"
    with pytest.raises(Exception, match="malformed"):
        parse_lines(spark.createDataFrame([("2024-01-01,1",)], "line string"), HEADER).collect()


def test_pages_with_draw_tables(spark, tmp_path):
    row = ("<tr>\n<td><a href='/estrazione.php?id=1'>n.&nbsp;159</a></td><td> 03/10/2026 </td>"
           "<td><b>13</b> 60&#160;19 29 56</td><td>19 68 31 7 26</td></tr>")
    noise = "<tr><td>03/10/2026</td></tr><tr><td>estrazione.php</td></tr><tr class='x'><td>estrazione.php</td><td>03/10/2026</td></tr>"
    (tmp_path / "p1.html").write_text(f"<html><table>{noise}{row}</table></html>")
    pages = read_pages(spark, str(tmp_path))
    assert len(pages.first()["sha256"]) == 64
    draws = {r["series"]: r for r in parse_draw_tables(pages, names=("Bari", "Cagliari")).collect()}
    assert draws["Bari"]["numbers"] == [13, 60, 19, 29, 56] and draws["Cagliari"]["numbers"] == [19, 68, 31, 7, 26]
    assert draws["Bari"]["contest"] == 159 and draws["Bari"]["draw_date"] == date(2026, 10, 3)


def test_documents_and_nested_strings(spark, tmp_path):
    ledger = {"status": "READY", "processedDraws": 0, "targetDraws": 100, "nextPrediction": [1, 2, 3, 4, 5, 6], "results": [],
              "model": {"name": "m", "windows": [12, 52], "lookAhead": False}}
    (tmp_path / "receipt.json").write_text(json.dumps({"recordedAt": "x", "before": {"integrated": json.dumps(ledger), "baseline": "{}"}}, indent=2))
    receipt = read_document(spark, str(tmp_path / "receipt.json"), RECEIPT)
    inner = receipt.select(nested_document(F.col("before.integrated"), LEDGER).alias("l")).first()["l"]
    assert inner["model"]["windows"] == [12, 52] and inner["results"] == [] and inner["processedDraws"] == 0
    (tmp_path / "draw.json").write_text(json.dumps({"date": "2024-02-29", "contest": 12, "numbers": [3, 9, 27, 31, 62, 81], "jolly": 1,
                                                    "superstar": 2, "source": {"type": "t", "officialQuota": None}}))
    draw = read_document(spark, str(tmp_path / "draw.json"), LIVE_DRAW).first()
    assert draw["numbers"][-1] == 81 and draw["source"]["officialQuota"] is None
    (tmp_path / "protocol.json").write_text(json.dumps({"historyWindow": 208, "models": [{"name": "a", "features": ["Sun"], "bins": 12}], "seed": 1}))
    assert read_document(spark, str(tmp_path / "protocol.json"), PROTOCOL).first()["models"][0]["features"] == ["Sun"]
    saved = spark.createDataFrame([({"Bari": {"m": [1, 2]}, "Roma": {"m": [3, 4]}},)], "predictionsByWheel map<string,map<string,array<int>>>")
    assert {(r["series"], tuple(r["ticket"])) for r in predictions_long(saved).collect()} == {("Bari", (1, 2)), ("Roma", (3, 4))}


def test_snapshot_of_missing_path_is_empty(spark, tmp_path):
    assert snapshot(spark, str(tmp_path / "none")).count() == 0


def documents(spark, processed=0, windows=(5, 21), ticket=(1, 2), hits=1):
    evaluation = spark.createDataFrame([("t", {"draws": 31}, list(ticket), [{"date": "d", "hits": hits}])],
                                       "generatedAt string, coverage map<string,int>, nextPrediction array<int>, rows array<struct<date:string,hits:int>>")
    forward = spark.createDataFrame([("READY", processed, "2024-02-29", (list(windows),), list(ticket))],
                                    "status string, processedDraws int, startsAfterDrawDate string, model struct<windows:array<int>>, nextPrediction array<int>")
    return evaluation, forward


def paths_in(folder):
    return {k: str(folder / k) for k in ("evaluation", "forward", "baseline_forward", "rerun")}


def test_rerun_preserves_saved_documents(spark, tmp_path):
    paths = paths_in(tmp_path)
    evaluation, forward = documents(spark)
    overwrite_json(spark.createDataFrame([("ACTIVE", 1)], "status string, processedDraws int"), paths["baseline_forward"])
    first = save_experiment(spark, evaluation, forward, paths)
    assert first["integrated_protocol"] == "initialized" and first["historical_results_match"] is None
    before = {k: file_hashes(spark, paths[k]) for k in ("evaluation", "forward", "baseline_forward")}
    again = save_experiment(spark, evaluation.withColumn("generatedAt", F.lit("later")), forward, paths)
    assert again["integrated_protocol"] == "preserved" and again["historical_results_match"] is True and again["output"] == paths["rerun"]
    assert {k: file_hashes(spark, paths[k]) for k in before} == before
    report = spark.read.json(paths["rerun"]).first()
    assert report["generatedAt"] == "later" and len(report["preservation"]["fileHashes"]) == len(again["file_hashes"])
    changed, _ = documents(spark, hits=2)
    assert save_experiment(spark, changed, forward, paths)["historical_results_match"] is False


def test_changed_model_or_ticket_is_refused_before_any_write(spark, tmp_path):
    paths = paths_in(tmp_path)
    evaluation, forward = documents(spark)
    create_json(forward, paths["forward"])
    for other in (documents(spark, windows=(5, 22))[1], documents(spark, ticket=(3, 4))[1]):
        with pytest.raises(DataError):
            save_experiment(spark, evaluation, other, paths)
    assert not (tmp_path / "evaluation").exists() and not (tmp_path / "rerun").exists()
    with pytest.raises(Exception):
        create_json(forward, paths["forward"])


def test_active_ledger_may_have_moved_on(spark, tmp_path):
    paths = paths_in(tmp_path)
    evaluation, forward = documents(spark)
    create_json(documents(spark, processed=2, ticket=(5, 6))[1], paths["forward"])
    before = file_hashes(spark, paths["forward"])
    assert save_experiment(spark, evaluation, forward, paths)["integrated_protocol"] == "preserved"
    assert file_hashes(spark, paths["forward"]) == before


@pytest.mark.parametrize("keep, bonus", [("first", 40), ("last", 59)])
@pytest.mark.parametrize("block", ["64", "1g"])
def test_a_date_repeated_inside_one_file_keeps_its_place(spark, tmp_path, keep, bonus, block):
    """Twenty rows of one date in one file, read whole or in many blocks: the place in the file decides."""
    (tmp_path / "a.csv").write_text(HEADER + "\n" + "".join(f"2024-01-01,1,2,3,4,5,6,{40 + i}\n" for i in range(20)))
    (tmp_path / "b.csv").write_text(f"{HEADER}\n2024-01-02,1,2,3,4,5,6,9\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = read_archives(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
        unique = {r["draw_date"]: r for r in dedup_by_date(rows, keep).collect()}
        narrow = {r["draw_date"]: r["conflict"] for r in dedup_by_date(rows, keep, compare=("numbers",)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    row = unique[date(2024, 1, 1)]
    assert (row["bonus"], row["n_rows"], row["conflict"]) == (bonus, 20, True) and not unique[date(2024, 1, 2)]["conflict"]
    assert narrow == {date(2024, 1, 1): False, date(2024, 1, 2): False}


def test_documents_of_several_series_are_compared_row_by_row(spark, tmp_path):
    schema, path = "series string, rows array<int>, model string", str(tmp_path / "d")
    saved = [("a", [1, 2], "m"), ("b", [2], "m"), (None, [3], None)]
    create_json(spark.createDataFrame(saved, schema), path)

    def same(rows):
        return same_document(spark, path, spark.createDataFrame(rows, schema), ("rows", "model", "absent"))

    assert same(saved[::-1]) == {"rows": True, "model": True}
    assert same([saved[0], ("b", [999], "m"), saved[2]]) == {"rows": False, "model": True}
    assert same(saved[:2]) == {"rows": False, "model": False} == same([*saved, ("c", [1], "m")])
    assert same([*saved, saved[0]]) == {"rows": False, "model": False}


def test_lines_without_bonus_come_back(spark):
    draws = parse_lines(spark.createDataFrame([("2024-01-01,1,2,3,4,5,6,",)], "line string"), HEADER)
    assert draws.first()["bonus"] is None and to_lines(draws).first()["line"] == "2024-01-01,1,2,3,4,5,6,"


def test_recorded_hashes_are_required(spark, tmp_path):
    create_json(spark.createDataFrame([(1,)], "a int").coalesce(1), str(tmp_path / "d"))
    recorded = {p.rsplit("/", 1)[-1]: h for p, h in file_hashes(spark, str(tmp_path / "d")).items()}
    require_recorded_hashes(spark, str(tmp_path / "d"), recorded)
    for wrong in ({k: "0" * 64 for k in recorded}, {}, {**recorded, "more.json": "0" * 64}):
        with pytest.raises(DataError, match="differs from the record"):
            require_recorded_hashes(spark, str(tmp_path / "d"), wrong)


def test_summary_lines_keep_nulls(spark):
    line = summary_lines(spark.createDataFrame([(1, None)], "a int, b string")).first()["line"]
    assert json.loads(line) == {"a": 1, "b": None}
