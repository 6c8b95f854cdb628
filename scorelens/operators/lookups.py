"""Joins: metric rows against metric rows, runs against a baseline, two versions on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_comparison(reference: DataFrame, current: DataFrame) -> DataFrame:
    """``(metric, value)`` on both sides; a metric absent from one side drops out."""
    ref = reference.select("metric", F.col("value").alias("reference"))
    cur = current.select("metric", F.col("value").alias("current"))
    return ref.join(cur, "metric")


def versus_baseline(
    runs: DataFrame, model: str, baseline: str, throughput: str, latency: str
) -> DataFrame:
    """Each model against the named baseline, from one aggregate row of the baseline.

    A divisor under 1 counts as 1.
    """
    base = (
        runs.filter(F.col(model) == baseline)
        .agg(F.struct(F.max(throughput).alias("t"), F.max(latency).alias("l")).alias("b"))
        .scalar()
    )
    one = F.lit(1.0)
    return runs.select(
        model,
        throughput,
        latency,
        (F.col(throughput) / F.greatest(base["t"], one)).alias("throughput_vs_baseline"),
        (base["l"] / F.greatest(F.col(latency), one)).alias("latency_vs_baseline"),
    )


def extra_columns(reference: DataFrame, current: DataFrame) -> tuple[set[str], set[str]]:
    """Columns only in current, and columns only in reference. Reads no rows."""
    ref, cur = set(reference.columns), set(current.columns)
    return cur - ref, ref - cur


def unseen_values(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values of current that reference lacks, with their row counts."""
    counts = (
        current.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    known = reference.select(F.col(column).alias("value")).distinct()
    return counts.join(known, "value", "left_anti")


def version_pairs(
    champion: DataFrame, challenger: DataFrame, labels: DataFrame, key: str, score: str, label: str
) -> DataFrame:
    """Both scores beside the label of each row."""
    a = champion.select(key, F.col(score).alias("champion_score"))
    b = challenger.select(key, F.col(score).alias("challenger_score"))
    return a.join(b, key).join(labels.select(key, F.col(label).alias("label")), key)
