"""JSON documents: protocols, ledgers, receipts, live draws, saved predictions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_struct(fields: str) -> str:
    """A schema of a document as the type of a field."""
    return f"struct<{fields}>"


LIVE_DRAW = ("date string, contest int, numbers array<int>, jolly int, superstar int, "
             "source struct<type: string, path: string, officialVerification: string, officialQuota: double>")
_RESULT = ("drawDate: string, contest: int, prediction: array<int>, draw: array<int>, jolly: int, superstar: int, "
           "mainHits: int, category: string, stake: int, grossReturn: int, netProfit: int, payoutStatus: string, "
           "source: struct<type: string, path: string, officialVerification: string, officialQuota: double>")
LEDGER = ("status string, createdAt string, startsAfterDrawDate string, protocolRevision int, targetDraws int, "
          "processedDraws int, stakePerCombination int, stakeIsSimulated boolean, "
          "model struct<name: string, windows: array<int>, scoring: string, optimizer: string, pairFeatures: string, "
          "lookAhead: boolean, midTestParameterChanges: boolean, tieBreak: string>, "
          "comparators struct<activeBaseline: struct<name: string, existingProtocolPath: string, nextPrediction: array<int>>, "
          "randomBaseline: struct<name: string, generator: string, seed: bigint, nextPrediction: array<int>>, multiplicity: string>, "
          "nextPrediction array<int>, "
          f"results array<struct<{_RESULT}, comparators: struct<frequency52: struct<{_RESULT}>, random: struct<{_RESULT}>>>>, "
          "lastProcessedDraw string, "
          "acceptanceCriteria struct<referenceMeanHitsPerCombination: double, equalBudget: string, noMidTestParameterChanges: boolean, "
          "pairedComparison: string, interpretation: string>")
BASELINE_LEDGER = ("status string, startedAt string, protocolRevision int, revisionReason string, targetDraws int, processedDraws int, "
                   "lastProcessedDraw string, stakePerCombination int, "
                   "strategy struct<name: string, frequencyWindow: int, constraints: struct<maxNumbersPerDecade: int>, selection: string, "
                   "lookAhead: boolean, midTestParameterChanges: boolean>, nextPrediction array<int>, "
                   f"results array<struct<{_RESULT}>>, "
                   "acceptanceCriteria struct<referenceMeanHits: double, referenceStakeReturn: double, interpretation: string>")
RESULT = f"struct<{_RESULT}>"
INTEGRATED_RESULT = f"struct<{_RESULT}, comparators: struct<frequency52: struct<{_RESULT}>, random: struct<{_RESULT}>>>"
PROTOCOL = ("revision int, historyWindow int, shrinkageDraws int, ticketSize int, decadeCap int, lookAhead boolean, "
            "models array<struct<name: string, features: array<string>, bins: int>>, circularShiftReplicates int, "
            "nullReplicates int, seed bigint, library struct<name: string, version: string, url: string, sha256: string, documentation: string>, "
            "excluded array<string>")
RECEIPT = (f"recordedAt string, sourceStatus string, before struct<integrated: string, baseline: string>, "
           f"update struct<integrated: {as_struct(LEDGER)}, baseline: {as_struct(BASELINE_LEDGER)}, alreadyProcessed: boolean>")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, read with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def nested_document(text: Column, schema: str) -> Column:
    """A JSON document kept as a string inside another one."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, SHA-256 and text of every file under ``path``; no rows when it does not exist."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint, sha256 string, text string")
    return files.select(
        "path", "length", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def predictions_long(document: DataFrame, by_series: str = "predictionsByWheel") -> DataFrame:
    """``map<series, map<method, ticket>>`` to rows (series, method, ticket)."""
    outer = document.select(F.explode(by_series).alias("series", "methods"))
    return outer.select("series", F.explode("methods").alias("method", "ticket"))
