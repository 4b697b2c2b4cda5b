"""Multiplicity correction, empirical tails and order-statistic quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holm(tests: DataFrame, families: Sequence[str], p: str = "raw_p", out: str = "holm_p") -> DataFrame:
    """Holm step-down within each family: running maximum of min(1, (m - i) * p). A family is the handful
    of tests reported together."""
    family = Window.partitionBy(*families) if families else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(family.orderBy(p)) - 1
    ranked = tests.withColumn("_step", F.least(F.lit(1.0), (F.count("*").over(family) - rank) * F.col(p)))
    so_far = family.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.max("_step").over(so_far)).drop("_step")


def empirical_tails(replicates: DataFrame, observed: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(count + 1) / (n + 1) tails of ``observed`` among replicate values, ties within 1e-12 counted in both."""
    counts = replicates.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) <= observed + 1e-12).alias("below"),
        F.count_if(F.col(value) >= observed - 1e-12).alias("above"))
    lower = (F.col("below") + 1) / (F.col("n") + 1)
    upper = (F.col("above") + 1) / (F.col("n") + 1)
    return counts.select(*keys, F.col("n").alias("replicates"), lower.alias("lower_p"), upper.alias("upper_p"),
                         F.least(F.lit(1.0), 2 * F.least(lower, upper)).alias("two_sided_p"))


RULES = ("n_minus_one", "n")


def order_statistics(values: DataFrame, value: str, keys: Sequence[str], probabilities: Sequence[float],
                     rules: str | Sequence[str] = RULES, accuracy: int = 10_000) -> DataFrame:
    """Exact sorted-array quantiles, one row per key, probability and rule.

    ``n_minus_one`` takes position floor((n-1)*p), ``n`` takes floor(p*n). A wanted position is bracketed by two
    approximate percentiles; one aggregate counts what lies below the bracket, and only the values inside, about
    4 / ``accuracy`` of a group, are counted by value and put in order. Should the counts show that a bracket
    missed its position, all brackets are widened, up to the whole range, so the result is always exact."""
    keys, rules = list(keys), [rules] if isinstance(rules, str) else list(rules)
    clean = values.select(*keys, F.col(value).alias("value")).filter("value IS NOT NULL")
    probabilities, margin = [float(p) for p in probabilities], 2 / accuracy
    while True:
        cuts = [max(0.0, p - margin) for p in probabilities] + [min(1.0, p + margin) for p in probabilities]
        edges = clean.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("value", cuts, accuracy).alias("edges"))
        placed = _join_small(clean, edges, keys)
        low, high = ([F.get("edges", i + k) for i in range(len(probabilities))] for k in (0, len(probabilities)))
        below = placed.groupBy(*keys, "n").agg(*[F.count_if(F.col("value") < e).alias(f"below{i}") for i, e in enumerate(low)],
                                               *[F.count_if(F.col("value") <= e).alias(f"upto{i}") for i, e in enumerate(high)])
        # from here on one row per key, probability and rule
        wanted = below.select(*keys, F.explode(F.array(*[F.struct(
            F.lit(p).alias("probability"), F.lit(r).alias("rule"), F.lit(i).alias("bracket"), F.col(f"below{i}").alias("below"), F.col(f"upto{i}").alias("upto"),
            F.floor((F.col("n") - 1 if r == "n_minus_one" else F.col("n")) * F.lit(p)).cast("bigint").alias("position"))
            for i, p in enumerate(probabilities) for r in rules])).alias("w")).select(*keys, "w.*")
        if margin >= 1 or wanted.filter("NOT (below <= position AND position < upto)").isEmpty():
            break
        margin *= 8
    inside = placed.select(*keys, "value", F.explode(F.array(*[F.when(F.col("value").between(a, b), F.lit(i)) for i, (a, b) in enumerate(zip(low, high))])).alias("bracket"))
    counted = inside.filter("bracket IS NOT NULL").groupBy(*keys, "bracket", "value").agg(F.count("*").alias("c"))
    running = Window.partitionBy(*keys, "bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("seen", F.sum("c").over(running))
    found = ranked.join(wanted, [*keys, "bracket"])
    upto = F.col("below") + F.col("seen")
    return found.filter((upto > F.col("position")) & (upto - F.col("c") <= F.col("position"))).select(
        *keys, "probability", "rule", F.col("value").alias("quantile"))


def _join_small(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one row per key. Without keys it is a single row, so its broadcast has a fixed size; with keys
    the join is left to the optimizer, which knows the size."""
    return rows.join(per_key, keys) if keys else rows.join(F.broadcast(per_key))
