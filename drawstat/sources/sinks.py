"""JSON outputs: overwrite, exclusive create, guarded rerun and receipts.

A document is a one-row DataFrame; it is written by Spark to the storage the path names. Saved documents
are never overwritten by a rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawstat.operators.draws import DataError
from drawstat.sources.documents import snapshot
from drawstat.streaming.storage import stored

HISTORY_KEYS = ("coverage", "evaluation", "model", "methods", "nextPrediction", "rows")


def overwrite_json(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def create_json(document: DataFrame, path: str) -> None:
    """Fails when the path exists."""
    document.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def summary_lines(document: DataFrame) -> DataFrame:
    """One JSON line per row, as printed to a console."""
    return document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def append_receipt(receipt: DataFrame, path: str) -> None:
    """Audit table of updates: what was read before and what the update produced."""
    receipt.write.mode("append").option("ignoreNullFields", False).json(path)


def file_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 per data file of a saved document (a handful of files)."""
    rows = snapshot(spark, path).filter(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "sha256").collect()
    return {r["path"]: r["sha256"] for r in rows}


def same_document(spark: SparkSession, path: str, document: DataFrame, keys: tuple[str, ...]) -> dict[str, bool]:
    """Compare top-level keys of a saved document with a new one, as JSON text of each key. The saved one is
    read with the schema of the new one, so both render alike.

    A document may have a row per series, in any order: rows meet by ``series`` (or by their whole content
    where there is none) and are compared on the cluster; only one boolean per key comes back. A series that is
    missing on one side, or there more often, makes every key differ."""
    saved = spark.read.schema(document.schema).json(path)
    present = [k for k in keys if k in document.columns]

    def rendered(rows: DataFrame, side: str) -> DataFrame:
        texts = [F.to_json(F.struct(F.col(k)), {"ignoreNullFields": "false"}).alias(f"{k}_text") for k in present]
        series = F.col("series").cast("string") if "series" in document.columns else F.lit(None).cast("string")
        # equal rows of a series are counted, so that the order of rows does not matter
        counted = rows.select(series.alias("series"), *texts).groupBy("series", *[f"{k}_text" for k in present]).agg(F.count("*").alias("n"))
        return counted.groupBy("series").agg(
            F.sum("n").alias("n"), *[F.sort_array(F.collect_list(F.struct(f"{k}_text", "n"))).alias(k) for k in present]).select(
            F.col("series").alias(f"{side}_series"), F.lit(True).alias(side), F.col("n").alias(f"{side}_n"), *[F.col(k).alias(f"{side}_{k}") for k in present])

    both = rendered(saved, "before").join(rendered(document, "after"), F.col("before_series").eqNullSafe(F.col("after_series")), "full")
    met = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before_n") == F.col("after_n"))
    row = both.agg(*[F.coalesce(F.bool_and(met & F.col(f"before_{k}").eqNullSafe(F.col(f"after_{k}"))), F.lit(True)).alias(k) for k in present]).first()
    return {k: row[k] for k in present}


def require_recorded_hashes(spark: SparkSession, path: str, recorded: dict[str, str]) -> None:
    """Raise unless the files under ``path`` are exactly those whose SHA-256 was recorded, by file name."""
    found = {p.rsplit("/", 1)[-1]: h for p, h in file_hashes(spark, path).items()}
    wrong = sorted(n for n in {*found, *recorded} if found.get(n) != recorded.get(n))
    if wrong:
        raise DataError(f"{path} differs from the record: {wrong}")


def _require_unchanged(spark: SparkSession, paths: dict[str, str], before: dict[str, dict[str, str]]) -> None:
    for name, hashes in before.items():
        if hashes and file_hashes(spark, paths[name]) != hashes:
            raise DataError(f"{paths[name]} changed during the run")


def save_experiment(spark: SparkSession, evaluation: DataFrame, forward: DataFrame, paths: dict[str, str]) -> dict:
    """Save an evaluation and its forward protocol once; later runs only write a side report.

    A frozen protocol must keep its model and start date, and its first ticket while nothing is processed.
    Every check runs before the first write; files that existed are hashed before and after."""
    before = {name: file_hashes(spark, paths[name]) for name in ("evaluation", "forward", "baseline_forward")}
    # computed once: what is compared is what is written
    evaluation, forward = stored(evaluation, "evaluation"), stored(forward, "forward")
    if before["forward"]:
        same = same_document(spark, paths["forward"], forward, ("model", "startsAfterDrawDate", "nextPrediction"))
        processed = spark.read.schema(forward.schema).json(paths["forward"]).agg(F.max("processedDraws").alias("n")).first()["n"]
        if not (same["model"] and same["startsAfterDrawDate"]):
            raise DataError("the model differs from the frozen protocol; nothing was written")
        if processed == 0 and not same["nextPrediction"]:
            raise DataError("the rebuilt first ticket differs from the frozen one; nothing was written")
    history = None
    if before["evaluation"]:
        history = all(same_document(spark, paths["evaluation"], evaluation, HISTORY_KEYS).values())
    _require_unchanged(spark, paths, before)
    if not before["evaluation"]:
        create_json(evaluation, paths["evaluation"])
    if not before["forward"]:
        create_json(forward, paths["forward"])
    _require_unchanged(spark, paths, before)
    hashed = [(p, h, h) for hashes in before.values() for p, h in hashes.items()]
    rerun = bool(before["evaluation"] or before["forward"])
    report = {
        "integrated_protocol": "preserved" if before["forward"] else "initialized",
        "baseline_protocol": "preserved" if before["baseline_forward"] else "not_present",
        "historical_results_match": history,
        "file_hashes": hashed,
        "output": paths["rerun"] if rerun else paths["evaluation"],
    }
    if rerun:
        schema = ("integratedProtocol string, baselineProtocol string, historicalResultsMatch boolean, "
                  "fileHashes array<struct<path: string, sha256Before: string, sha256After: string>>")
        row = [(report["integrated_protocol"], report["baseline_protocol"], history, hashed)]
        preservation = spark.createDataFrame(row, schema).select(F.struct("*").alias("preservation"))
        overwrite_json(evaluation.join(F.broadcast(preservation)), paths["rerun"])  # one row each
    return report
