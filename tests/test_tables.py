"""Series from tables stored as folders and with orders that lack a priority, against the SQL."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from drawstat.functions.columns import angle_bin, wrap_degrees
from drawstat.plans.oracle import ORACLE
from drawstat.plans.queries import QUERIES
from tests.test_queries import engine_on, ordered


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """orders as a folder of parts, one priority in seven missing; lineitem as it is."""
    out, given = tmp_path_factory.mktemp("tables"), "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{given}/orders.parquet")
    missing = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    orders.withColumn("o_orderpriority", missing).repartition(5).write.parquet(str(out / "orders.parquet"))
    spark.read.parquet(f"{given}/lineitem.parquet").write.parquet(str(out / "lineitem.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["draw_series_weekly", "html_draw_tables", "number_check", "draw_series", "csv_roundtrip"])
def test_equals_sql(spark, folder, name):
    relation = engine_on(folder, ("orders", "lineitem"), "/*.parquet").sql(ORACLE[name])
    columns = sorted(relation.columns)
    expected = ordered(tuple(row[relation.columns.index(c)] for c in columns) for row in relation.fetchall())
    found = ordered(tuple(row[c] for c in columns) for row in QUERIES[name](spark, folder).collect())
    assert found == expected and len(found) > 1000 - 900 * (name == "number_check")


def test_stream_reads_a_folder(spark, folder):
    assert {r["outcome"] for r in QUERIES["stream_ledger"](spark, folder).select("outcome").distinct().collect()} >= {"HISTORY", "INVALID"}


def test_angles_wrap(spark):
    rows = spark.createDataFrame([(-1e-15,), (0.0,), (360.0,), (-30.0,), (359.999,)], "a double")
    found = rows.select(wrap_degrees(F.col("a")).alias("w")).select("w", angle_bin(F.col("w"), 30).alias("b")).collect()
    assert [r["b"] for r in found] == [0, 0, 0, 11, 11] and all(0 <= r["w"] < 360 for r in found)
    assert rows.select(angle_bin(F.col("a"), 30).alias("b")).collect()[2]["b"] == 0


@pytest.mark.parametrize("name", ["draw_series", "announcement_checks"])
def test_lines_are_reduced_by_hashing(spark, sf_dir, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        QUERIES[name](spark, sf_dir).explain("formatted")
    first = text.getvalue().index("Scan parquet")
    assert "bit_or" in text.getvalue() and "collect_set(number" not in text.getvalue()[first:]


def test_ranges_reach_the_scan(spark, tmp_path):
    from drawstat.operators.draws import between_dates
    path = str(tmp_path / "draws")
    spark.range(20).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS draw_date").write.parquet(path)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        between_dates(spark.read.parquet(path), "2024-01-03", "2024-01-05").explain("formatted")
    assert "GreaterThanOrEqual(draw_date" in text.getvalue()


@pytest.mark.parametrize("name", ["dedup_first", "dedup_last", "dedup_last_numbers_only", "coverage", "announcement_intake"])
def test_raw_announcements_are_hashed_in_fixed_size(spark, sf_dir, name):
    """What stands on the raw rows of an order, up to the second shuffle after the join, sorts nothing and keeps no objects."""
    result = QUERIES[name](spark, sf_dir)
    aggregates = [line for line in result._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    raw = [line for line in aggregates if "l_orderkey" in line or "partial_min(low" in line or name == "announcement_intake"]
    assert len(raw) > 2 and all("HashAggregate" in line and "Object" not in line for line in raw)


def test_numbers_stay_a_narrow_expression(spark, sf_dir):
    """The numbers of an order are one loop over the bits of two masks, not an expression per bit."""
    text = QUERIES["announcement_checks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("getbit") < 20
