"""Aggregates over the prediction log and over request, run and query logs.

A prediction log has: request_id, created_at, processing_time_ms, probability, class, model_version.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.columns import col, guarded_ratio, since
from scorelens.functions.quantiles import grouped_quantiles
from scorelens.functions.running import join_keys
from scorelens.session import pin_small

# Reporting interval names and their truncation units.
INTERVALS = {"1h": "hour", "1d": "day", "1w": "week"}


def flag(cond: Column) -> Column:
    """1/0 for an aggregate; NULL counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("long")


def extract_result(log: DataFrame, result: str = "prediction_result") -> DataFrame:
    """Parse the JSON result once and expose ``probability`` and ``class`` as typed columns."""
    parsed = F.from_json(F.col(result), "probability DOUBLE, class INT")
    return log.withColumn("_r", parsed).select(
        *log.columns, F.col("_r.probability").alias("probability"), F.col("_r.class").alias("class")
    )


def flatten_features(
    log: DataFrame, features: str, schema: str, result: str = "prediction_result", default: float = 0.5
) -> DataFrame:
    """JSON features as columns plus ``prediction``; a result without a probability gives the default."""
    return log.select(
        F.from_json(F.col(features), schema).alias("_f"),
        F.from_json(F.col(result), "probability DOUBLE").alias("_p"),
    ).select("_f.*", F.coalesce(F.col("_p.probability"), F.lit(default)).alias("prediction"))


def prediction_stats(
    log: DataFrame, as_of: datetime, hours: int = 24, model_version: str | None = None
) -> DataFrame:
    recent = since(log, "created_at", as_of, hours=hours)
    if model_version:
        recent = recent.filter(F.col("model_version") == model_version)
    return recent.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
        F.min("processing_time_ms").alias("min_processing_time"),
        F.max("processing_time_ms").alias("max_processing_time"),
        F.avg("probability").alias("avg_probability"),
        F.sum(flag(F.col("class") == 1)).alias("bad_predictions"),
        F.sum(flag(F.col("class") == 0)).alias("good_predictions"),
    )


def hourly_distribution(log: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    return (
        since(log, "created_at", as_of, hours=hours)
        .groupBy(F.hour("created_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("predictions_count"))
        .orderBy("hour")
    )


def performance_by_interval(
    log: DataFrame, as_of: datetime, interval: str = "1h", days: int = 7, approximate: bool = False
) -> DataFrame:
    """Latency and outcome per hour, day or week. An unknown interval means the hour.

    ``good_rate`` is the share of requests that were not classified as bad.
    """
    unit = INTERVALS.get(interval, "hour")
    recent = since(log, "created_at", as_of, days=days).select(
        F.date_trunc(unit, "created_at").alias("time_interval"), "processing_time_ms", "class"
    )
    totals = recent.groupBy("time_interval").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.avg("processing_time_ms").alias("avg_latency"),
        F.sum(flag(F.col("class") == 1)).alias("bad_predictions"),
    )
    tails = grouped_quantiles(
        recent,
        ["time_interval"],
        "processing_time_ms",
        {"p95_latency": 0.95, "p99_latency": 0.99},
        approximate=approximate,
    )
    good = (F.col("request_count") - F.col("bad_predictions")) / F.col("request_count") * 100
    return join_keys(totals, tails, ["time_interval"], "left").select(
        "time_interval",
        "request_count",
        "avg_latency",
        "p95_latency",
        "p99_latency",
        "bad_predictions",
        good.alias("good_rate"),
    ).orderBy("time_interval")


def performance_by_version(
    log: DataFrame,
    as_of: datetime,
    days: int = 7,
    version: str | None = None,
    name_prefix: str | None = None,
) -> DataFrame:
    recent = since(log, "created_at", as_of, days=days)
    if version:
        recent = recent.filter(F.col("model_version") == version)
    elif name_prefix:
        recent = recent.filter(F.col("model_version").startswith(name_prefix))
    totals = recent.groupBy("model_version").agg(
        F.avg("processing_time_ms").alias("avg_latency"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("probability").alias("avg_score"),
        F.stddev_samp("probability").alias("score_stddev"),
    )
    tails = grouped_quantiles(
        recent, ["model_version"], "processing_time_ms", {"p95_latency": 0.95, "p99_latency": 0.99}
    )
    return join_keys(totals, tails, ["model_version"], "left")


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Counts and shares per value; the total runs over the counted values, not over the rows."""
    src = df.filter(F.col(column).isNotNull()) if dropna else df
    counts = src.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    counts = pin_small(counts)  # so that the total adds up the counts and no second scan is made
    total = counts.agg(F.sum("count").alias("n")).scalar()
    return counts.select("value", "count", (F.col("count") / total).alias("share"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Smallest over largest class, and for two classes the gap of their percentages."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    gap = (F.max("n") - F.min("n")) * 100.0 / F.sum("n")
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        (F.min("n") / F.max("n")).alias("class_ratio"),
        F.when(F.count(F.lit(1)) == 2, gap).alias("class_imbalance"),
    )


def query_stats(
    stats: DataFrame,
    last: int | None = None,
    query: str = "query",
    seconds: str = "execution_time",
    success: str = "success",
    ts: str = "timestamp",
    prefix: int = 100,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Roll statements up by the start of their text, most total time first; with ``last`` only the newest ones."""
    if last is not None:
        stats = stats.orderBy(F.col(ts).desc(), *tie).limit(last)
    return (
        stats.groupBy(F.substring(query, 1, prefix).alias("query_pattern"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(seconds).alias("total_time"),
            F.avg(seconds).alias("avg_time"),
            F.sum(flag(~F.col(success))).alias("errors"),
            F.max(ts).alias("last_executed"),
        )
        .orderBy(F.col("total_time").desc(), "query_pattern")
    )


def endpoint_summary(
    requests: DataFrame, endpoint: str = "endpoint", ms: str = "processing_time_ms", success: str = "success"
) -> DataFrame:
    """Per endpoint and, in the row whose endpoint is NULL, over all of them."""
    n, ok = F.count(F.lit(1)), F.sum(flag(F.col(success)))
    return (
        requests.withColumn("endpoint", F.col(endpoint))
        .rollup("endpoint")
        .agg(
            F.grouping("endpoint").cast("int").alias("is_total"),
            n.alias("request_count"),
            F.round(F.avg(ms), 2).alias("average_response_time_ms"),
            F.round((n - ok) * 100.0 / n, 2).alias("error_rate_percent"),
            F.round(ok * 100.0 / n, 2).alias("availability_percent"),
        )
        .select(
            F.when(F.col("is_total") == 1, F.lit("overall")).otherwise(F.col("endpoint")).alias("endpoint"),
            "is_total",
            "request_count",
            "average_response_time_ms",
            "error_rate_percent",
            "availability_percent",
        )
    )


def load_test_summary(
    runs: DataFrame,
    keys: Sequence[str],
    duration_sec: str | Column,
    ms: str = "latency_ms",
    success: str = "success",
) -> DataFrame:
    """Success rate, throughput and latency of the successful requests per run."""
    keys = list(keys)
    ok = F.col(success)
    lat = F.when(ok, F.col(ms))
    named = runs.withColumn("_d", col(duration_sec).cast("double"))
    totals = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(flag(ok)).alias("successful_requests"),
        F.avg(flag(ok)).alias("success_rate"),
        (F.count(F.lit(1)) / F.max("_d")).alias("_rps"),
        F.avg(lat).alias("latency_avg_ms"),
        F.min(lat).alias("latency_min_ms"),
        F.max(lat).alias("latency_max_ms"),
    )
    tails = grouped_quantiles(
        runs.filter(ok), keys, ms, {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
    )
    out = join_keys(totals, tails, keys, "left")
    return out.select(
        *keys,
        "total_requests",
        "successful_requests",
        (F.col("total_requests") - F.col("successful_requests")).alias("failed_requests"),
        "success_rate",
        F.when(F.col("successful_requests") > 0, F.col("_rps")).otherwise(0.0).alias("throughput_rps"),
        "latency_avg_ms",
        "latency_p50_ms",
        "latency_p95_ms",
        "latency_p99_ms",
        "latency_min_ms",
        "latency_max_ms",
    )


def latency_percentiles(
    runs: DataFrame, keys: Sequence[str], ms: str, percents: Sequence[int] = (50, 75, 90, 95, 99)
) -> DataFrame:
    return grouped_quantiles(runs, keys, ms, {f"p{p}": p / 100 for p in percents})


def timing_stats(runs: DataFrame, keys: Sequence[str], ms: str, samples: str | Column) -> DataFrame:
    """Mean, population deviation, p95 and samples per second; ``samples`` is the batch size of a run."""
    keys = list(keys)
    totals = runs.withColumn("_s", col(samples).cast("double")).groupBy(*keys).agg(
        F.avg(ms).alias("mean_ms"),
        F.stddev_pop(ms).alias("std_ms"),
        F.try_divide(F.sum("_s") * 1000.0, F.sum(ms)).alias("throughput"),
    )
    return join_keys(totals, grouped_quantiles(runs, keys, ms, {"p95_ms": 0.95}), keys, "left")


def approval_summary(scored: DataFrame, batch: str, approved: str | Column) -> DataFrame:
    return (
        scored.groupBy(F.col(batch).alias("batch"))
        .agg(F.count(F.lit(1)).alias("total"), F.sum(flag(col(approved))).alias("approved"))
        .select(
            "batch",
            "total",
            "approved",
            (F.col("total") - F.col("approved")).alias("rejected"),
            (F.col("approved") / F.col("total")).alias("approval_rate"),
        )
    )


def batch_outcome(scored: DataFrame, batch: str, error: str, ms: str) -> DataFrame:
    """Processed, successful and failed rows per batch; a row with an error text has failed."""
    return scored.groupBy(F.col(batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("processed"),
        F.sum(flag(F.col(error).isNull())).alias("successful"),
        F.sum(flag(F.col(error).isNotNull())).alias("failed"),
        F.sum(ms).alias("total_time_ms"),
    )


def resource_summary(
    samples: DataFrame,
    keys: Sequence[str],
    cpu: str,
    memory: str,
    predictions: str | Column,
    errors: str | Column,
    seconds: str | Column,
) -> DataFrame:
    """Mean and peak use, throughput, error rate and stability of a measured run."""
    src = samples.select(
        *keys,
        F.col(cpu).alias("cpu"),
        F.col(memory).alias("mem"),
        col(predictions).cast("long").alias("p"),
        col(errors).cast("long").alias("e"),
        col(seconds).cast("double").alias("s"),
    )
    return src.groupBy(*keys).agg(
        F.avg("cpu").alias("avg_cpu_percent"),
        F.max("cpu").alias("max_cpu_percent"),
        F.avg("mem").alias("avg_memory_mb"),
        F.max("mem").alias("max_memory_mb"),
        F.sum("p").alias("total_predictions"),
        F.sum("e").alias("errors"),
        F.try_divide(F.sum("p"), F.sum("s")).alias("throughput_rps"),
        (F.sum("e") / F.greatest(F.sum("p"), F.lit(1))).alias("error_rate"),
        F.when(F.sum("e") == 0, "stable").otherwise("unstable").alias("stability"),
    )


# Component states from worst to best, as they outrank each other.
STATUS_ORDER = ("unhealthy", "warning", "error")


def status_rollup(statuses: DataFrame, status: str = "status", keys: Sequence[str] = ()) -> DataFrame:
    """The worst state decides; ``healthy`` only when every component is healthy."""
    worst = F.when(F.min(F.col(status) == "healthy"), F.lit("healthy")).otherwise(F.lit("unknown"))
    for name in reversed(STATUS_ORDER):
        worst = F.when(F.max(F.col(status) == name), F.lit(name)).otherwise(worst)
    return statuses.groupBy(*keys).agg(worst.alias("overall_status"))


# Upper bounds of the default request-duration buckets, in seconds.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram_buckets(
    df: DataFrame, keys: Sequence[str], value: str | Column, edges: Sequence[float]
) -> DataFrame:
    """Cumulative counts per upper bound ``le``, the last one being infinite.

    One aggregate with a counter per bound: no row is multiplied before the shuffle.
    """
    v = col(value)
    counts = df.groupBy(*keys).agg(
        F.count(v).alias("_all"), *[F.sum(flag(v <= e)).alias(f"_b{i}") for i, e in enumerate(edges)]
    )
    pairs = [
        F.struct(F.lit(float(e)).alias("le"), F.col(f"_b{i}").alias("cumulative_count"))
        for i, e in enumerate(edges)
    ]
    last = F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("cumulative_count"))
    return counts.select(*keys, F.inline(F.array(*pairs, last)))


def quantile_from_buckets(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Interpolate inside the bucket that holds the rank; the last finite bound caps the answer."""
    by_key = Window.partitionBy(*keys)
    ordered = by_key.orderBy("le")
    total = F.max("cumulative_count").over(by_key)
    ranked = buckets.select(
        *keys,
        "le",
        "cumulative_count",
        (total * F.lit(float(q))).alias("rank"),
        F.coalesce(F.lag("le").over(ordered), F.lit(0.0)).alias("lo"),
        F.coalesce(F.lag("cumulative_count").over(ordered), F.lit(0)).alias("below"),
    )
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * F.try_divide(
        F.col("rank") - F.col("below"), F.col("cumulative_count") - F.col("below")
    )
    answer = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)
    hit = (F.col("cumulative_count") >= F.col("rank")) & (F.col("cumulative_count") > 0)
    return ranked.filter(hit).groupBy(*keys).agg(F.min_by(answer, "le").alias("quantile"))


def counts_by(df: DataFrame, labels: Sequence[str | Column], name: str = "count") -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def guarded_coverage(current: str | Column, reference: str | Column) -> Column:
    return guarded_ratio(current, reference) * 100
