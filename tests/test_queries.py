"""Every registered query against its SQL on the given tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from drawstat.plans.oracle import ORACLE, SMALL_ORACLE
from drawstat.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}
SQL = {name: sql for name, sql in (ORACLE | SMALL_ORACLE).items() if name in QUERIES}


# the smallest tables hold two complete weeks, fewer than the warm-up of a weekly backtest
WEEKLY = {"weekly_backtest", "weekly_rollup", "weekly_tests", "weekly_last_predictions", "weekly_saved_matches", "leaderboard",
          "shift_tests_weekly", "page_hashes", "update_receipts", "ledger_advance", "ledger_violations", "ledger_files", "experiment_files", "saved_predictions", "ledger_cards"}


def engine_on(folder, names=TABLES, parts=""):
    connection = duckdb.connect()
    for name in names:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet{parts}'")
    return connection


@pytest.fixture
def folder(sf_dir, name):
    return sf_dir.replace("sf0.001", "sf0.01") if name in WEEKLY else sf_dir


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is not None, str(value)) for value in row])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) - set(SMALL_ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    relation = engine_on(folder).sql(SQL[name])
    columns = sorted(relation.columns)
    expected = ordered(tuple(row[relation.columns.index(c)] for c in columns) for row in relation.fetchall())
    result = QUERIES[name](spark, folder)
    assert sorted(result.columns) == columns
    types = dict(result.dtypes)
    assert {c: TYPES[types[c]] for c in columns} == {c: str(t) for c, t in zip(relation.columns, relation.types)}
    assert ordered(tuple(row[c] for c in columns) for row in result.collect()) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
