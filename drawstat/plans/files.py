"""Queries that write draws and documents to shared storage and read them back: archives, pages, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawstat.operators.advance import advance
from drawstat.operators.draws import DataError, dedup_by_date, require_valid, split_rejects, with_violations
from drawstat.plans.experiments import prepared
from drawstat.plans.ledgers import ledgers_and_rest, with_short
from drawstat.settings import ARCHIVE_BONUS, ARCHIVE_DATE, SINGLE_GAME
from drawstat.sources.archive import archive_columns, lax_lines, read_archives
from drawstat.sources.documents import BASELINE_LEDGER, LEDGER, nested_document
from drawstat.sources.pages import parse_draw_tables, read_pages
from drawstat.sources.sinks import append_receipt, create_json, file_hashes, require_recorded_hashes, same_document, save_experiment
from drawstat.streaming.storage import shared_folder, stored


def write_archive(draws: DataFrame, path: str) -> None:
    """Draws as CSV archives with a header, several files."""
    numbers = [F.col("numbers")[i].alias(f"n{i + 1}") for i in range(len(archive_columns()) - 2)]
    draws.select(F.date_format("draw_date", "yyyy-MM-dd").alias(ARCHIVE_DATE), *numbers, F.col("bonus").alias(ARCHIVE_BONUS)).write.option(
        "header", True).csv(path)


def archive_files(draws: DataFrame) -> DataFrame:
    """Two archives, the second one a supplement that repeats the draws of even years with another bonus, read back,
    validated, deduplicated (the first archive wins) and indexed; conflicts are counted before they are dropped."""
    spark, folder = draws.sparkSession, shared_folder(draws.sparkSession, "archives")
    write_archive(draws, f"{folder}/archive")
    other = F.when(F.array_contains("numbers", F.lit(90)) | (F.col("bonus") == 90), F.col("bonus")).otherwise(90)
    write_archive(draws.filter(F.year("draw_date") % 2 == 0).withColumn("bonus", other), f"{folder}/supplement")
    unique = dedup_by_date(read_archives(spark, [f"{folder}/archive", f"{folder}/supplement"]), "first")
    return unique.select("draw_date", "numbers", "bonus", "n_rows", "conflict")


def prepared_archive(draws: DataFrame) -> DataFrame:
    """One archive read, validated, checked for coverage and indexed, as an experiment starts."""
    spark, path = draws.sparkSession, shared_folder(draws.sparkSession, "archive")
    write_archive(draws, path)
    return prepared(read_archives(spark, [path]), bonus_required=False).select("series", "draw_idx", "n_draws", "draw_date", "numbers", "bonus")


#: What is broken in the line of every eleventh draw, by its remainder, and the rules such a line breaks.
BROKEN = {3: "numbers", 5: "date", 7: "numbers", 9: "bonus,numbers"}


def broken_lines(draws: DataFrame) -> DataFrame:
    """Archive lines of indexed ``draws``, of which some hold a word instead of a number, a day that does not exist, a number
    twice, or only half of their fields."""
    number = [F.col("numbers")[i].cast("string") for i in range(SINGLE_GAME.pick)]
    kind, day = F.col("draw_idx") % 11, F.date_format("draw_date", "yyyy-MM-dd")
    fields = [F.when(kind == 5, F.concat(F.date_format("draw_date", "yyyy-MM-"), F.lit("32"))).otherwise(day), number[0],
              F.when(kind == 7, number[0]).otherwise(number[1]), F.when(kind == 3, F.lit("x")).otherwise(number[2]), *number[3:],
              F.coalesce(F.col("bonus").cast("string"), F.lit(""))]
    return draws.select(F.when(kind == 9, F.concat_ws(",", *fields[:4])).otherwise(F.concat_ws(",", *fields)).alias("line"))


def archive_rejects(draws: DataFrame) -> DataFrame:
    """An archive with broken lines read without any check of their width: rows per set of broken rules, none for the
    accepted ones, and whether the strict step refuses the archive with the same counts."""
    spark, path = draws.sparkSession, shared_folder(draws.sparkSession, "broken-archive")
    broken_lines(draws.filter("bonus IS NOT NULL")).write.text(path)
    rows = lax_lines(spark.read.text(path).withColumnRenamed("value", "line"), ",".join(archive_columns()))
    checked = stored(with_violations(rows, SINGLE_GAME, "date_text"), "checked")
    accepted, rejects = split_rejects(checked)
    try:
        require_valid(checked)
        refused = ""
    except DataError as error:
        refused = str(error)
    counts = rejects.groupBy("rules").agg(F.count("*").alias("n_rows")).unionByName(accepted.agg(F.lit("").alias("rules"), F.count("*").alias("n_rows")))
    total = F.sum(F.when(F.col("rules") != "", F.col("n_rows")).otherwise(0)).over(Window.partitionBy(F.lit(0)))  # a handful of rows
    return counts.select("rules", "n_rows", F.contains(F.lit(refused), F.concat(F.lit("'any': "), total.cast("string"))).alias("refused"))


def archive_without_bonus(draws: DataFrame) -> DataFrame:
    """An archive that has no bonus column at all, read, validated, deduplicated and indexed without one."""
    spark, path = draws.sparkSession, shared_folder(draws.sparkSession, "plain-archive")
    numbers = [F.col("numbers")[i].alias(f"n{i + 1}") for i in range(SINGLE_GAME.pick)]
    draws.select(F.date_format("draw_date", "yyyy-MM-dd").alias(ARCHIVE_DATE), *numbers).write.option("header", True).csv(path)
    return prepared(read_archives(spark, [path], bonus=False)).select("series", "draw_idx", "n_draws", "draw_date", "numbers")


AUDIT = "first_date date, last_date date, draws bigint, duplicate_rows bigint"


def coverage_audit(draws: DataFrame) -> DataFrame:
    """The coverage of an archive against an audit document stored before, and against one whose count is off by one."""
    spark, folder = draws.sparkSession, shared_folder(draws.sparkSession, "audit")
    write_archive(draws, f"{folder}/archive")
    found = draws.agg(F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"), F.count("*").alias("draws"),
                      F.lit(0).cast("bigint").alias("duplicate_rows"))
    create_json(found, f"{folder}/recorded")
    create_json(found.withColumn("draws", F.col("draws") + 1), f"{folder}/changed")
    rows = []
    for name in ("recorded", "changed"):
        audit = spark.read.schema(AUDIT).json(f"{folder}/{name}").first().asDict()
        try:
            held = prepared(read_archives(spark, [f"{folder}/archive"]), bonus_required=False, **audit).count()
            rows.append((name, "ACCEPTED", audit["first_date"], audit["last_date"], audit["draws"], held))
        except DataError:
            rows.append((name, "REFUSED", audit["first_date"], audit["last_date"], audit["draws"], None))
    return spark.createDataFrame(rows, "audit string, outcome string, first_date date, last_date date, recorded_draws bigint, held_draws bigint")


def page_hashes(pages: DataFrame) -> DataFrame:
    """Pages (page, html) staged one a file, against hashes recorded from the pages themselves before anything was written;
    then once more after the last page has changed by one character."""
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession, "staged")
    pages = stored(pages, "pages")
    create_json(pages.select("page", F.sha2(F.concat("html", F.lit("\n")), 256).alias("sha256")), f"{folder}/record")
    last = pages.agg(F.max("page").alias("last"))
    other = F.when(F.col("page") == F.col("last"), F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    changed = pages.join(F.broadcast(last)).select("page", other.alias("html"))  # one row
    compared = spark.read.schema("page int, sha256 string").json(f"{folder}/record")
    for name, rows in (("staged", pages), ("changed", changed)):
        rows.repartition("page").write.partitionBy("page").text(f"{folder}/{name}")
        read = read_pages(spark, f"{folder}/{name}/*").select(F.regexp_extract("path", r"/page=(\d+)/", 1).cast("int").alias("page"), F.col("sha256").alias("found"))
        compared = compared.join(read, "page", "full").withColumn(f"{name}_as_recorded", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False))).drop("found")
    return compared


def update_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw processed and announced again: both updates appended to the audit table of receipts, what was read before
    each included, and read back."""
    ledgers, history, draws, short = ledgers_and_rest(spark, sf_dir)
    path, moved = shared_folder(spark, "receipts"), draws.select("series", F.to_date("draw.date").alias("draw_date"), "draw.numbers")
    before = ledgers
    for position, held in enumerate((history, history.unionByName(moved))):
        after = stored(advance(before, held, draws), "updates")
        told = before.select("series", F.to_json("integrated").alias("before"))
        append_receipt(after.select("series", "outcome", F.lit(position).alias("position"), F.to_json("integrated").alias("update")).join(told, "series"), path)
        before = after.drop("outcome")
    back = spark.read.schema("series string, outcome string, position int, before string, update string").json(path)

    def count(document: str):
        return nested_document(F.col(document), LEDGER)["processedDraws"]

    return with_short(back.select("series", "position", "outcome", count("before").alias("processed_before"), count("update").alias("processed_after"),
                                  (F.col("before") == F.col("update")).alias("unchanged")), short)


def page_files(pages: DataFrame, names: list[str]) -> DataFrame:
    """HTML rows written as page files and scraped from them; the files must carry the recorded hashes."""
    spark, path = pages.sparkSession, shared_folder(pages.sparkSession, "pages")
    pages.select("html").write.text(path)
    require_recorded_hashes(spark, path, {p.rsplit("/", 1)[-1]: h for p, h in file_hashes(spark, path).items()})
    return parse_draw_tables(read_pages(spark, path), names=names)


def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers and a receipt as JSON documents, read back with their schemas and advanced."""
    ledgers, history, draws, short = ledgers_and_rest(spark, sf_dir)
    folder = shared_folder(spark, "ledger-files")
    receipt = ledgers.select("series", F.struct(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in ("integrated", "baseline")]).alias("before"))
    create_json(receipt, f"{folder}/receipt")
    back = spark.read.schema("series string, before struct<integrated: string, baseline: string>").json(f"{folder}/receipt")
    read = back.select("series", nested_document(F.col("before.integrated"), LEDGER).alias("integrated"),
                       nested_document(F.col("before.baseline"), BASELINE_LEDGER).alias("baseline"))
    out = advance(read, history, draws)
    return with_short(out.select("series", "outcome", F.col("integrated.processedDraws").alias("processed_draws"),
                                 F.aggregate("integrated.results", F.lit(0), lambda n, r: n + r["mainHits"]).alias("hits_so_far"),
                                 F.col("integrated.nextPrediction").alias("next_integrated")), short)


def experiment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment saved, saved again unchanged and once more with one changed series: the preservation report."""
    ledgers, _, _, short = ledgers_and_rest(spark, sf_dir)
    folder = shared_folder(spark, "experiment")
    paths = {k: f"{folder}/{k}" for k in ("evaluation", "forward", "baseline_forward", "rerun")}
    forward = ledgers.select("series", "integrated.*")
    evaluation = forward.select("series", F.lit("first").alias("generatedAt"), F.struct(F.size("results").alias("draws")).alias("coverage"),
                                "model", "nextPrediction", F.col("results").alias("rows"))
    create_json(ledgers.select("series", "baseline.*"), paths["baseline_forward"])
    first = save_experiment(spark, evaluation, forward, paths)
    hashes = file_hashes(spark, paths["forward"])
    again = save_experiment(spark, evaluation.withColumn("generatedAt", F.lit("again")), forward, paths)
    least = evaluation.agg(F.min("series").alias("least"))
    # one row, so the join is a lookup
    other = evaluation.join(F.broadcast(least)).withColumn("nextPrediction", F.when(F.col("series") == F.col("least"), F.array(F.lit(0))).otherwise(
        F.col("nextPrediction"))).drop("least")
    changed = same_document(spark, paths["evaluation"], other, ("coverage", "nextPrediction"))
    rows = [(first["integrated_protocol"], again["integrated_protocol"], again["baseline_protocol"], again["historical_results_match"],
             changed["coverage"], changed["nextPrediction"], file_hashes(spark, paths["forward"]) == hashes)]
    report = spark.createDataFrame(rows, "first_run string, second_run string, baseline string, history_matches boolean, same_coverage boolean, "
                                         "same_tickets boolean, files_unchanged boolean")
    saved = spark.read.schema(evaluation.schema).json(paths["rerun"]).select(
        "series", F.col("generatedAt").alias("rerun_of"), "coverage.draws", F.aggregate("rows", F.lit(0), lambda n, r: n + r["mainHits"]).alias("hits"))
    return with_short(saved.join(F.broadcast(report)), short, "first_run")  # one row
