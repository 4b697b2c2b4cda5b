import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("drawstat-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="drawstat-tests-"))
               .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make_draws(spark):
    """Indexed draws from a list of number lists, one per day."""
    from datetime import date, timedelta

    from drawstat.operators.draws import with_index

    def build(tickets, series="s", start=date(2024, 1, 1)):
        rows = [(series, start + timedelta(days=i), list(t)) for i, t in enumerate(tickets)]
        return with_index(spark.createDataFrame(rows, "series string, draw_date date, numbers array<int>"))

    return build
