"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors reach")
        base = tempfile.mkdtemp(prefix="drawstat-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` written once to shared storage and read back, for what several steps read."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
