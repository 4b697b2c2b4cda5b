"""Registered queries over the order, line, event, document and page tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawstat.functions import sky
from drawstat.functions.columns import clean_html, decade_of, draw_instant, ticket_text, valid_date
from drawstat.functions.exact import null_pmf
from drawstat.functions.prng import random_ticket, uniform_at
from drawstat.operators import backtest as bt
from drawstat.operators import draws as dr
from drawstat.operators import frequency as fq
from drawstat.operators import ledger as lg
from drawstat.operators import reports as rp
from drawstat.operators import stats as st
from drawstat.operators.advance import advance
from drawstat.plans import experiments as ex
from drawstat.plans import files, ledgers
from drawstat.plans.ledgers import bad_announcements
from drawstat.settings import (AUDIT_SEED, BINNED_MODELS, HISTORY_WINDOW, SHIFT_REPLICATES, SHIFT_SEED,
                               SINGLE_GAME, WHEEL_GAME, WHEEL_SHIFT_REPLICATES, WHEEL_SHIFT_SEED)
from drawstat.sources import sinks
from drawstat.sources.archive import parse_lines, to_lines
from drawstat.sources.documents import nested_document
from drawstat.sources.pages import extract_cells, parse_draw_tables
from drawstat.sources.tables import order_days, packed_announcements, priority_series, raw_announcements, single_series, table
from drawstat.streaming.ledger_stream import LedgerRules, run_ledger
from drawstat.streaming.storage import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WALK = (*bt.WALK_METHODS, "random")
BINNED = ex.BINNED_METHODS
LEDGER_START = HISTORY_WINDOW


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to a fixed number of digits and arrays to text, for comparison across engines."""
    def shown(name: str, kind: str) -> Column:
        if kind == "double":
            return F.round(F.col(name), digits).alias(name)
        if kind.startswith("array"):
            return ticket_text(F.col(name)).alias(name)
        return F.col(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.with_index(single_series(spark, sf_dir))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.with_index(priority_series(spark, sf_dir))


def featured_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.attach_features(daily(spark, sf_dir), sky.date_bins(order_days(spark, sf_dir)))


def featured_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.attach_features(weekly(spark, sf_dir), sky.date_bins(order_days(spark, sf_dir, "week")))


# ------------------------------------------------- ingest, validation, duplicates


@register
def draw_series(spark, sf_dir):
    return rounded(daily(spark, sf_dir).select("series", "draw_idx", "n_draws", "draw_date", "numbers", "bonus"))


@register
def draw_series_weekly(spark, sf_dir):
    return rounded(weekly(spark, sf_dir).select("series", "draw_idx", "n_draws", "draw_date", "numbers"))


@register
def announcement_checks(spark, sf_dir):
    checked = dr.with_violations(raw_announcements(spark, sf_dir), SINGLE_GAME)
    return rounded(checked.select("source", "source_ord", "numbers", "violations"))


@register
def announcement_violations(spark, sf_dir):
    return dr.violation_counts(dr.with_violations(packed_announcements(spark, sf_dir), SINGLE_GAME))


@register
def date_texts(spark, sf_dir):
    """Date texts built from ship dates and order keys; many name no calendar day."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    text = F.concat_ws("-", F.date_format("l_shipdate", "yyyy-MM"), F.lpad((F.col("l_orderkey") % 34).cast("string"), 2, "0"))
    return lines.select(text.alias("date_text")).groupBy("date_text").agg(F.count("*").alias("n_rows")).withColumn(
        "valid", valid_date(F.col("date_text")))


@register
def draws_between(spark, sf_dir):
    return rounded(dr.between_dates(single_series(spark, sf_dir), "1995-06-01", "1996-12-31"))


@register
def dedup_first(spark, sf_dir):
    return rounded(dr.dedup_by_date(packed_announcements(spark, sf_dir), "first"))


@register
def dedup_last(spark, sf_dir):
    return rounded(dr.dedup_by_date(packed_announcements(spark, sf_dir), "last"))


@register
def dedup_last_numbers_only(spark, sf_dir):
    return rounded(dr.dedup_by_date(packed_announcements(spark, sf_dir), "last", compare=("numbers",), keys=("source", "draw_date")))


@register
def coverage(spark, sf_dir):
    return dr.coverage(dr.dedup_by_date(packed_announcements(spark, sf_dir), "last"))


@register
def announcement_intake(spark, sf_dir):
    return rounded(lg.intake(dr.with_violations(packed_announcements(spark, sf_dir), SINGLE_GAME)))


# -------------------------------------------------------------------- frequencies


@register
def number_frequencies(spark, sf_dir):
    return rounded(fq.number_counts(single_series(spark, sf_dir), SINGLE_GAME))


@register
def uniformity(spark, sf_dir):
    return rounded(fq.uniformity(fq.number_counts(single_series(spark, sf_dir), SINGLE_GAME)).drop("n_numbers"))


@register
def uniformity_weekly(spark, sf_dir):
    return rounded(fq.uniformity(fq.number_counts(priority_series(spark, sf_dir), WHEEL_GAME)).drop("n_numbers"))


@register
def top_numbers(spark, sf_dir):
    return rounded(fq.extreme_numbers(fq.number_counts(single_series(spark, sf_dir), SINGLE_GAME)))


@register
def bottom_numbers(spark, sf_dir):
    return rounded(fq.extreme_numbers(fq.number_counts(single_series(spark, sf_dir), SINGLE_GAME), largest=False))


@register
def pair_counts(spark, sf_dir):
    return fq.all_pairs(fq.pair_counts(single_series(spark, sf_dir)), SINGLE_GAME)


@register
def top_pairs(spark, sf_dir):
    return fq.top_pairs(fq.all_pairs(fq.pair_counts(single_series(spark, sf_dir)), SINGLE_GAME))


@register
def pair_summary(spark, sf_dir):
    return rounded(fq.pair_summary(single_series(spark, sf_dir), SINGLE_GAME).drop("draws"))


@register
def serial_overlaps(spark, sf_dir):
    return fq.serial_overlaps(daily(spark, sf_dir))


@register
def serial_test(spark, sf_dir):
    return rounded(fq.serial_test(daily(spark, sf_dir), SINGLE_GAME))


# -------------------------------------------------------------------- walk-forward


@register
def horizon_scores(spark, sf_dir):
    scores = bt.horizon_scores(daily(spark, sf_dir), SINGLE_GAME)
    return rounded(scores.select("series", "draw_idx", "number", "hit", "integrated", "frequency52"))


@register
def walk_forward(spark, sf_dir):
    return rounded(bt.walk_forward(daily(spark, sf_dir), SINGLE_GAME))


@register
def next_tickets(spark, sf_dir):
    return rounded(bt.next_tickets(daily(spark, sf_dir), SINGLE_GAME))


@register
def method_tests(spark, sf_dir):
    totals = bt.method_totals(bt.walk_forward(daily(spark, sf_dir), SINGLE_GAME), WALK, SINGLE_GAME)
    return rounded(bt.method_tests(totals, SINGLE_GAME))


@register
def exact_null(spark, sf_dir):
    """Every possible total of hits over the tested draws with its exact probability."""
    trials = daily(spark, sf_dir).filter(F.col("draw_idx") >= HISTORY_WINDOW).groupBy("series").agg(F.count("*").alias("trials"))
    pmf = trials.withColumn("pmf", null_pmf(F.col("trials"), SINGLE_GAME))
    totals = pmf.select("series", "pmf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("trials") * SINGLE_GAME.pick)).alias("total_hits"))
    position = F.col("total_hits") - F.col("pmf.first_total")
    inside = (position >= 0) & (position < F.size("pmf.masses"))
    return rounded(totals.select("series", "total_hits", F.when(
        inside, F.get("pmf.masses", position.cast("int"))).otherwise(F.lit(0.0)).alias("probability")))


# ------------------------------------------------------------------ date-conditioned


@register
def draw_instants(spark, sf_dir):
    return order_days(spark, sf_dir).select("draw_date", draw_instant(F.col("draw_date")).alias("utc"))


@register
def sky_angles(spark, sf_dir):
    return rounded(sky.angles(order_days(spark, sf_dir)), 6)


@register
def sky_bins(spark, sf_dir):
    """Feature bins of the draw dates."""
    return sky.date_bins(order_days(spark, sf_dir)).join(single_series(spark, sf_dir), "draw_date", "left_semi")


@register
def binned_backtest(spark, sf_dir):
    return rounded(bt.long_rows(bt.binned_backtest(featured_daily(spark, sf_dir), SINGLE_GAME), BINNED))


@register
def binned_totals(spark, sf_dir):
    """Totals of every model, their difference from the trailing-frequency baseline and the exact tests."""
    totals = bt.method_totals(bt.binned_backtest(featured_daily(spark, sf_dir), SINGLE_GAME), BINNED, SINGLE_GAME)
    baseline = F.max(F.when(F.col("method") == "frequency", F.col("total_hits"))).over(Window.partitionBy("series"))
    models = totals.withColumn("baseline", baseline).withColumn("difference", F.col("total_hits") - F.col("baseline"))
    return rounded(bt.method_tests(models.filter(F.col("method") != "frequency"), SINGLE_GAME))


@register
def rotated_totals(spark, sf_dir):
    """The backtest with every feature taken 37 draws later in the cycle."""
    rotated = bt.rotate_features(featured_daily(spark, sf_dir), 37)
    return rounded(bt.method_totals(bt.binned_backtest(rotated, SINGLE_GAME), BINNED, SINGLE_GAME))


@register
def shift_values(spark, sf_dir):
    return ex.shifts_of(daily(spark, sf_dir), SHIFT_REPLICATES, SHIFT_SEED, True)


@register
def shift_values_weekly(spark, sf_dir):
    return ex.shifts_of(weekly(spark, sf_dir), WHEEL_SHIFT_REPLICATES, WHEEL_SHIFT_SEED, False)


@register
def shift_tests(spark, sf_dir):
    return rounded(ex.binned_tests(daily(spark, sf_dir), features=sky.date_bins(order_days(spark, sf_dir))))


@register
def shift_tests_weekly(spark, sf_dir):
    return rounded(weekly_tests_joint(spark, sf_dir))


def weekly_tests_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and circular-shift tests of all models over all series, corrected as one family of ten."""
    return ex.binned_tests(weekly(spark, sf_dir), WHEEL_GAME, WHEEL_SHIFT_REPLICATES, WHEEL_SHIFT_SEED, distinct=False, pooled=True,
                           features=sky.date_bins(order_days(spark, sf_dir, "week")))


# ---------------------------------------------------------------------- many series


@register
def weekly_backtest(spark, sf_dir):
    return rounded(bt.long_rows(bt.binned_backtest(featured_weekly(spark, sf_dir), WHEEL_GAME), BINNED))


@register
def weekly_rollup(spark, sf_dir):
    return bt.series_rollup(bt.binned_backtest(featured_weekly(spark, sf_dir), WHEEL_GAME), BINNED)


@register
def weekly_tests(spark, sf_dir):
    backtest = bt.binned_backtest(featured_weekly(spark, sf_dir), WHEEL_GAME)
    totals = bt.method_totals(backtest, tuple(BINNED_MODELS), WHEEL_GAME, by_series=False)
    return rounded(bt.method_tests(totals, WHEEL_GAME, []))


@register
def weekly_last_predictions(spark, sf_dir):
    return bt.last_predictions(bt.binned_backtest(featured_weekly(spark, sf_dir), WHEEL_GAME), tuple(BINNED_MODELS))


@register
def weekly_saved_matches(spark, sf_dir):
    """Saved tickets (those of the last draw) against the drawn numbers, per method and series."""
    indexed = weekly(spark, sf_dir)
    rows = bt.binned_backtest(featured_weekly(spark, sf_dir), WHEEL_GAME)
    saved = bt.last_predictions(rows, tuple(BINNED_MODELS)).withColumn("ticket", F.split("ticket", ",").cast("array<int>"))
    actual = rp.latest_draw(indexed).select("series", "numbers")
    return rounded(bt.match_saved(saved.drop("draw_date"), actual))


# --------------------------------------------------------------------------- reports


@register
def recent_12_top(spark, sf_dir):
    return rp.frequency_list(weekly(spark, sf_dir), 12, 8)


@register
def recent_52_top(spark, sf_dir):
    return rp.frequency_list(weekly(spark, sf_dir), 52, 10)


@register
def latest_draw(spark, sf_dir):
    return rounded(rp.latest_draw(weekly(spark, sf_dir)))


@register
def number_check(spark, sf_dir):
    return rp.number_check(weekly(spark, sf_dir), WHEEL_GAME)


@register
def ticket_check(spark, sf_dir):
    """Checks of the numbers on the next integrated ticket."""
    indexed = daily(spark, sf_dir)
    tickets = bt.next_tickets(indexed, SINGLE_GAME).select("series", F.col("integrated_ticket").alias("ticket"))
    return rp.ticket_check(rp.number_check(indexed, SINGLE_GAME), tickets)


@register
def stats_cards(spark, sf_dir):
    return rounded(rp.stats_cards(weekly(spark, sf_dir), WHEEL_GAME), 8)


@register
def leaderboard(spark, sf_dir):
    """Models by hits; the exact tests are corrected together with the circular-shift tests."""
    exact = weekly_tests_joint(spark, sf_dir).filter("test = 'exact_uniform_upper'").withColumnRenamed("model", "method")
    return rounded(rp.leaderboard(exact.withColumn("expected_hits", F.col("trials") * WHEEL_GAME.expected_hits), list(BINNED_MODELS)))


@register
def header_cards(spark, sf_dir):
    """Draws held, ledger progress and target per series."""
    return daily(spark, sf_dir).groupBy("series").agg(
        F.count("*").alias("draws"), F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"),
        F.least(F.lit(lg.FORWARD_TARGET), F.greatest(F.lit(0), F.count("*") - LEDGER_START)).alias("processed"),
        F.lit(lg.FORWARD_TARGET).alias("target"))


# -------------------------------------------------------------- statistics and streams


@register
def order_statistics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return st.order_statistics(lines, "l_extendedprice", ["l_returnflag"], [0.05, 0.3, 0.5, 0.95])


@register
def empirical_tails(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(st.empirical_tails(lines, F.lit(20000.0), "l_extendedprice", ["l_returnflag"]))


@register
def prng_uniforms(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return events.select("event_id", uniform_at(AUDIT_SEED, F.col("event_id")).alias("uniform"))


@register
def random_tickets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return rounded(orders.select("o_orderkey", random_ticket(AUDIT_SEED, F.col("o_orderkey"), SINGLE_GAME).alias("ticket")))


@register
def audit_tests(spark, sf_dir):
    return rounded(ex.audit_tests(daily(spark, sf_dir)), 7)


# --------------------------------------------------------------------- forward ledger


@register
def forward_ledger(spark, sf_dir):
    return rounded(lg.ledger(daily(spark, sf_dir), SINGLE_GAME, LEDGER_START))


@register
def forward_next(spark, sf_dir):
    """The tickets frozen after the last processed draw, for a ledger that has not reached its target."""
    indexed = daily(spark, sf_dir)
    frozen = lg.frozen_tickets(indexed, SINGLE_GAME, LEDGER_START, target=None)
    return rounded(frozen.filter(F.col("draw_date").isNull()).select(
        "series", "draw_idx", "integrated_ticket", "frequency52_ticket", "random_ticket"))


@register
def ledger_advance(spark, sf_dir):
    """Stored ledgers of every priority advanced by its last draw: result row, counters and next tickets."""
    *stored, short = ledgers.ledgers_and_rest(spark, sf_dir)
    out = advance(*stored)
    i, b = F.col("integrated"), F.col("baseline")
    row = F.element_at(i["results"], -1)
    return rounded(ledgers.with_short(out.select(
        "series", "outcome", i["status"].alias("status"), i["processedDraws"].alias("processed_draws"), F.size(i["results"]).alias("n_results"),
        b["processedDraws"].alias("baseline_processed"), F.size(b["results"]).alias("baseline_results"), i["lastProcessedDraw"].alias("last_processed"),
        row["contest"].alias("contest"), row["prediction"].alias("integrated_ticket"), row["mainHits"].alias("integrated_hits"),
        row["category"].alias("integrated_category"), row["netProfit"].alias("integrated_profit"),
        row["comparators"]["frequency52"]["mainHits"].alias("frequency52_hits"), row["comparators"]["random"]["mainHits"].alias("random_hits"),
        F.aggregate(i["results"], F.lit(0), lambda n, r: n + r["mainHits"]).alias("hits_so_far"),
        i["nextPrediction"].alias("next_integrated"), b["nextPrediction"].alias("next_frequency52"),
        i["comparators"]["activeBaseline"]["nextPrediction"].alias("next_copy"), i["comparators"]["randomBaseline"]["nextPrediction"].alias("next_random")), short))


@register
def saved_predictions(spark, sf_dir):
    return rounded(ledgers.saved_predictions(spark, sf_dir))


@register
def ledger_cards(spark, sf_dir):
    return ledgers.ledger_cards(spark, sf_dir)


@register
def ledger_violations(spark, sf_dir):
    """The rule that stops each kind of bad announcement or changed ledger, for every priority."""
    return bad_announcements(spark, sf_dir)


@register
def stream_ledger(spark, sf_dir):
    """Orders as a stream of announcements per priority, scored by the stateful ledger; the result table is
    what the stream wrote, every outcome included."""
    schema = table(spark, sf_dir, "orders").schema
    # the order numbers are a static side; only the arriving orders are streamed
    numbers = raw_announcements(spark, sf_dir).select(F.col("source_ord").alias("o_orderkey"), "numbers", "bonus")
    # a pattern matches the table whether it is one file or a folder of parts; a plain path must be a folder
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.[p]arquet")
    announced = orders.join(numbers, "o_orderkey").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("draw_date"), F.lit(None).cast("int").alias("contest"),
        "numbers", "bonus", (F.col("o_orderkey") % 90 + 1).cast("int").alias("superstar"), F.col("o_orderkey").alias("source_ord"))
    return rounded(run_ledger(announced, shared_folder(spark, "stream-ledger"), LedgerRules(consecutive=False)))


# ------------------------------------------------------------------- text and documents


@register
def csv_roundtrip(spark, sf_dir):
    """Draws written as archive lines and parsed back, strictly."""
    lines = to_lines(single_series(spark, sf_dir)).select("line")
    return rounded(parse_lines(lines, "data,n1,n2,n3,n4,n5,n6,jolly"))


def series_names(draws: DataFrame) -> list[str]:
    """The columns of a draw table: one per series, as many as the game has wheels."""
    return [r["series"] for r in draws.select("series").distinct().orderBy("series").collect()]


def rendered_rows(draws: DataFrame, names: list[str]) -> DataFrame:
    """Weekly draws as an HTML table row per week."""
    cell = F.array_join(F.transform("numbers", lambda n: F.format_string("<b>%d</b>", n)), "&nbsp;")
    rows = draws.groupBy("draw_date").agg(F.max("draw_idx").alias("idx"), F.map_from_entries(F.collect_list(
        F.struct("series", cell.alias("cell")))).alias("cells"))
    tds = [F.concat(F.lit("<td class='n'>\n"), F.col("cells")[n], F.lit("</td>")) for n in names]
    html = F.concat(F.lit("<table><tr><th>head</th></tr><TR><td><a href='estrazione.php?c="), F.col("idx").cast("string"),
                    F.lit("'>n. "), (F.col("idx") + 1).cast("string"), F.lit("</a></td><td>"),
                    F.date_format("draw_date", "dd/MM/yyyy"), F.lit("</td>"), *tds, F.lit("</TR></table>"))
    return rows.select("idx", html.alias("html"))


@register
def html_draw_tables(spark, sf_dir):
    """Weekly draws rendered as an HTML table row per week and scraped back."""
    draws = weekly(spark, sf_dir)
    names = series_names(draws)
    return rounded(parse_draw_tables(rendered_rows(draws, names), names=names))


@register
def archive_files(spark, sf_dir):
    return rounded(files.archive_files(single_series(spark, sf_dir)))


@register
def prepared_archive(spark, sf_dir):
    return rounded(files.prepared_archive(single_series(spark, sf_dir)))


@register
def archive_rejects(spark, sf_dir):
    return files.archive_rejects(daily(spark, sf_dir))


@register
def archive_without_bonus(spark, sf_dir):
    return rounded(files.archive_without_bonus(single_series(spark, sf_dir)))


@register
def coverage_audit(spark, sf_dir):
    return files.coverage_audit(stored(single_series(spark, sf_dir), "draws"))


@register
def page_hashes(spark, sf_dir):
    draws = weekly(spark, sf_dir)
    return files.page_hashes(rendered_rows(draws, series_names(draws)).select(F.col("idx").alias("page"), "html"))


@register
def update_receipts(spark, sf_dir):
    return files.update_receipts(spark, sf_dir)


@register
def summary_lines(spark, sf_dir):
    """One line of JSON per series of the weekly archive, as printed to a console."""
    held = weekly(spark, sf_dir).groupBy("series").agg(F.count("*").alias("draws"), F.min("draw_date").alias("first"), F.max("draw_date").alias("last"))
    return sinks.summary_lines(held.withColumn("note", F.lit(None).cast("string")))


@register
def dated_predictions(spark, sf_dir):
    """The tickets saved after every draw, and dated ten days earlier, matched with the first later draw."""
    draws = stored(daily(spark, sf_dir), "draws")
    frozen = stored(bt.walk_forward(draws, SINGLE_GAME, include_next=True).select("series", "draw_idx", "integrated_ticket", "frequency52_ticket"), "tickets")
    saved = frozen.join(draws.select("series", (F.col("draw_idx") + 1).alias("draw_idx"), F.col("draw_date").alias("saved_on")), ["series", "draw_idx"])
    long = saved.unpivot(["series", "saved_on"], ["integrated_ticket", "frequency52_ticket"], "method", "ticket")
    early = long.withColumn("saved_on", F.date_sub("saved_on", 10)).withColumn("method", F.concat("method", F.lit("_early")))
    return rounded(bt.match_next(long.unionByName(early), draws))


@register
def page_files(spark, sf_dir):
    draws = weekly(spark, sf_dir)
    names = series_names(draws)
    return rounded(files.page_files(rendered_rows(draws, names), names))


@register
def ledger_files(spark, sf_dir):
    return rounded(files.ledger_files(spark, sf_dir))


@register
def experiment_files(spark, sf_dir):
    return files.experiment_files(spark, sf_dir)


@register
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("text"),
                                                clean_html(F.col("html"), unescape_amp=True).alias("text_amp"))


@register
def html_cells(spark, sf_dir):
    """List items and their links, the table-like blocks of the crawled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(extract_cells(F.col("html"), "li", "a")).alias("row"))
    return rounded(pages.select("page_id", F.col("row.cells").alias("cells")))


@register
def page_lineage(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.sha2("html", 256).alias("sha256"))


@register
def json_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "props")
    parsed = events.select("event_type", nested_document(F.col("props"), "k bigint")["k"].alias("k"))
    return parsed.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


@register
def json_nested(spark, sf_dir):
    """A document that holds another one as a string, read through both levels."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    receipt = F.to_json(F.struct("event_id", F.struct(F.col("props").alias("integrated")).alias("before")))
    outer = events.select(nested_document(receipt, "event_id bigint, before struct<integrated: string>").alias("r"))
    return outer.select("r.event_id", nested_document(F.col("r.before.integrated"), "k bigint")["k"].alias("k"))


@register
def decade_counts(spark, sf_dir):
    """Drawn numbers per decade of the pool, the groups of the ticket cap."""
    numbers = dr.drawn_numbers(single_series(spark, sf_dir))
    return numbers.groupBy("series", decade_of(F.col("number"), SINGLE_GAME).alias("decade")).agg(F.count("*").alias("occurrences"))
