"""Windowed statistics, running counters, deduplication, drift and alerts on streams.

Late data: a row older than the watermark is dropped from windows; the delay is an argument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.running import join_keys
from scorelens.operators.drift import bin_number, psi_of_counts
from scorelens.operators.predlog import flag


def tumbling_statistics(
    log: DataFrame, ts: str = "created_at", width: str = "1 hour", delay: str = "1 hour", accuracy: int = 1000
) -> DataFrame:
    """Count, latency and outcome per window, emitted when the watermark passes its end.

    Percentiles come from a sketch of fixed size: an exact one would keep every value in the state.
    """
    grouped = log.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
    out = grouped.agg(
        F.count(F.lit(1)).alias("request_count"),
        F.avg("processing_time_ms").alias("avg_latency"),
        F.percentile_approx("processing_time_ms", F.lit(0.95), accuracy).alias("p95_latency"),
        F.sum(flag(F.col("class") == 1)).alias("bad_predictions"),
    )
    return out.select(F.col("w.start").alias("time_interval"), *[c for c in out.columns if c != "w"])


def running_endpoints(log: DataFrame, endpoint: str = "endpoint", failed: Column | None = None) -> DataFrame:
    """Counters per endpoint since the start, for update mode. The state is one row per endpoint."""
    bad = F.col("class") == 1 if failed is None else failed
    return log.groupBy(F.col(endpoint).alias("endpoint")).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(flag(bad)).alias("errors"),
        F.sum("processing_time_ms").alias("total_ms"),
    )


def running_alerts(
    counters: DataFrame,
    min_requests: int = 10,
    max_mean_ms: float = 1000.0,
    max_error_percent: float = 5.0,
    min_availability: float = 99.9,
) -> DataFrame:
    """Alert flags beside running counters; few requests raise none."""
    enough = F.col("request_count") >= min_requests
    errors = F.col("errors") * 100.0 / F.col("request_count")
    return counters.select(
        "*",
        (enough & (F.col("total_ms") / F.col("request_count") > max_mean_ms)).alias("slow"),
        (enough & (errors > max_error_percent)).alias("failing"),
        (enough & (100.0 - errors < min_availability)).alias("unavailable"),
    )


def idempotent_log(log: DataFrame, key: str = "request_id", ts: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """Each request once, for sources that may deliver a row again within the delay."""
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def alert_stream(
    log: DataFrame,
    condition: Column,
    kind: Column,
    ts: str = "created_at",
    width: str = "1 hour",
    delay: str = "2 hours",
) -> DataFrame:
    """One alert per (type, window), written at the first row that meets the condition."""
    hits = log.withWatermark(ts, delay).filter(condition)
    marked = hits.select(F.window(ts, width)["start"].alias("window_start"), kind.alias("type"), ts)
    return marked.dropDuplicatesWithinWatermark(["type", "window_start"]).select("type", "window_start")


#: The bin of values that a profile does not list by name.
OTHER = "other"


def level_bin(c: str, levels: Sequence[str]) -> Column:
    """The value, ``"value:"`` before it, if it is one of ``levels``, else one bin for all others; NULL stays NULL."""
    text = F.col(c).cast("string")
    listed = F.array_contains(F.array(*[F.lit(x) for x in levels]), text) if levels else F.lit(False)
    return F.when(text.isNotNull(), F.when(listed, F.concat(F.lit("value:"), text)).otherwise(F.lit(OTHER)))


def profile_bins(edges: Mapping[str, Sequence[float]], levels: Mapping[str, Sequence[str]]) -> list[Column]:
    numbers = [bin_number(c, e).cast("string").alias(c) for c, e in edges.items()]
    return numbers + [level_bin(c, x).alias(c) for c, x in levels.items()]


def frequent_levels(reference: DataFrame, columns: Sequence[str], most: int = 100) -> dict[str, list[str]]:
    """Per column the ``most`` values that come most often (ties by value), which bounds profile and stream state."""
    text = reference.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = text.unpivot([], list(columns), "column", "value").filter("value IS NOT NULL").groupBy("column", "value").count()
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    kept = counts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most)
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in kept.select("column", "value").collect():
        found[row["column"]].append(row["value"])
    return {c: sorted(x) for c, x in found.items()}


def reference_profile(
    reference: DataFrame, edges: Mapping[str, Sequence[float]], levels: Mapping[str, Sequence[str]] = {}
) -> DataFrame:
    """(column, bin, n_ref) of the reference: a row per bin and column."""
    long = reference.select(*profile_bins(edges, levels)).unpivot([], [*edges, *levels], "column", "bin")
    return long.filter("bin IS NOT NULL").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n_ref"))


def drift_counts(
    current: DataFrame,
    edges: Mapping[str, Sequence[float]],
    levels: Mapping[str, Sequence[str]] = {},
    ts: str = "created_at",
    width: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Rows per window, column and reference bin: the whole state is windows x columns x bins.

    ``levels`` has the named values of text columns; a value it lacks adds to one bin, however many there are.
    """
    wide = current.withWatermark(ts, delay).select(ts, *profile_bins(edges, levels))
    long = wide.unpivot([ts], [*edges, *levels], "column", "bin").filter("bin IS NOT NULL")
    counts = long.groupBy(F.window(ts, width).alias("w"), "column", "bin").agg(F.count(F.lit(1)).alias("n_cur"))
    return counts.select(F.col("w.start").alias("window_start"), "column", "bin", "n_cur")


def window_psi(counts: DataFrame, profile: DataFrame, limit: float = 0.2) -> DataFrame:
    """PSI of each closed window against the reference profile ``(column, bin, n_ref)``."""
    windows = counts.select("window_start", "column").distinct()
    keys = ["window_start", "column", "bin"]
    expected = join_keys(windows, profile, ["column"]).select(*keys, "n_ref")
    both = (
        expected.select(*keys, "n_ref", F.lit(0).cast("long").alias("n_cur"))
        .unionByName(counts.select(*keys, F.lit(0).cast("long").alias("n_ref"), "n_cur"))
        .groupBy(*keys)
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    psi = psi_of_counts(both, ["window_start", "column"])
    return psi.withColumn("drift_detected", F.col("psi") > limit)


def arrivals(batch: DataFrame, min_rows: int = 1000) -> DataFrame:
    """Size of a batch of new data and whether it is worth a retraining."""
    n = F.count(F.lit(1))
    return batch.agg(n.alias("new_rows"), (n >= min_rows).alias("new_data"))
