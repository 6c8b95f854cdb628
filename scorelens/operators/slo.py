"""Rules over request logs: endpoint alerts, rate and latency rules with a hold time, rollback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.columns import col, micros
from scorelens.functions.quantiles import grouped_quantiles
from scorelens.functions.running import join_keys
from scorelens.operators.lookups import versus_baseline
from scorelens.operators.predlog import flag

# Limits of the endpoint monitor and of the rollback conditions.
MIN_REQUESTS = 10
MAX_MEAN_MS = 1000.0
MAX_ERROR_PERCENT = 5.0
MIN_AVAILABILITY = 99.9


def endpoint_alerts(
    summary: DataFrame,
    min_requests: int = MIN_REQUESTS,
    max_mean_ms: float = MAX_MEAN_MS,
    max_error_percent: float = MAX_ERROR_PERCENT,
    min_availability: float = MIN_AVAILABILITY,
) -> DataFrame:
    """Flags per endpoint of an endpoint summary; endpoints with few requests are left out."""
    mean, err, up = (
        F.col("average_response_time_ms"),
        F.col("error_rate_percent"),
        F.col("availability_percent"),
    )
    return summary.filter((F.col("is_total") == 0) & (F.col("request_count") >= min_requests)).select(
        "endpoint",
        "request_count",
        (mean > max_mean_ms).alias("slow"),
        (err > max_error_percent).alias("failing"),
        (up < min_availability).alias("unavailable"),
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(mean > max_mean_ms, F.format_string("high response time: %.0fms", mean)),
                    F.when(err > max_error_percent, F.format_string("high error rate: %.1f%%", err)),
                    F.when(up < min_availability, F.format_string("low availability: %.1f%%", up)),
                )
            ),
            "; ",
        ).alias("alerts"),
    )


def hopping(
    df: DataFrame, keys: Sequence[str], ts: str, width: int, step: int, sums: dict[str, Column]
) -> DataFrame:
    """Sums over windows of ``width`` seconds that end every ``step`` seconds.

    Rows are summed per step first; only those sums are copied to the windows that contain them.
    ``step`` is the number of the last step in the window.
    """
    if width % step:
        raise ValueError("the window must be a whole number of steps")
    slots = df.groupBy(*keys, F.floor(micros(ts) / (step * 1_000_000)).alias("_slot")).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()]
    )
    ends = F.explode(F.sequence(F.col("_slot"), F.col("_slot") + (width // step - 1))).alias("step")
    return slots.select(*keys, ends, *sums).groupBy(*keys, "step").agg(*[F.sum(n).alias(n) for n in sums])


def held(
    df: DataFrame, keys: Sequence[str], order: str, condition: str | Column, for_steps: int, name: str = "firing"
) -> DataFrame:
    """Whether the condition has been true without a break for ``for_steps`` steps.

    Runs of consecutive steps are islands: step minus row number is constant inside a run. A step
    without a row breaks the run.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    true_rows = df.filter(col(condition)).withColumn("_island", F.col(order) - F.row_number().over(w))
    run = Window.partitionBy(*keys, "_island")
    marked = true_rows.withColumn(name, F.col(order) - F.min(order).over(run) >= for_steps)
    return marked.drop("_island")


def error_rate_rule(
    requests: DataFrame,
    keys: Sequence[str],
    ts: str,
    failed: Column,
    limit: float = 0.05,
    width: int = 300,
    step: int = 60,
    for_seconds: int = 300,
) -> DataFrame:
    """Windows whose error share is above the limit, and whether that has lasted long enough."""
    sums = {"requests": F.lit(1), "errors": flag(failed)}
    windows = hopping(requests, keys, ts, width, step, sums)
    rate = windows.withColumn("error_rate", F.col("errors") / F.col("requests"))
    return held(rate, keys, "step", F.col("error_rate") > limit, for_seconds // step)


def latency_rule(
    requests: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: Column,
    edges: Sequence[float],
    limit: float = 0.5,
    q: float = 0.95,
    width: int = 300,
    step: int = 60,
    for_seconds: int = 300,
) -> DataFrame:
    """Like the error rule, on a quantile read from bucket counters, which add up over steps."""
    sums = {f"b{i}": flag(value <= e) for i, e in enumerate(edges)}
    sums["total"] = F.lit(1)
    windows = hopping(requests, keys, ts, width, step, sums)
    rank = F.col("total") * F.lit(q)
    answer = F.lit(float(edges[-1]))
    lows = [0.0, *[float(e) for e in edges[:-1]]]
    for i in reversed(range(len(edges))):
        below = F.col(f"b{i - 1}") if i else F.lit(0)
        inside = lows[i] + (float(edges[i]) - lows[i]) * F.try_divide(rank - below, F.col(f"b{i}") - below)
        answer = F.when(F.col(f"b{i}") >= rank, inside).otherwise(answer)
    scored = windows.select(*keys, "step", F.col("total").alias("requests"), answer.alias("quantile"))
    return held(scored, keys, "step", F.col("quantile") > limit, for_seconds // step)


def gauge_rule(
    gauges: DataFrame, keys: Sequence[str], step: str, value: str, limit: float = 0.3, for_steps: int = 1
) -> DataFrame:
    return held(gauges, keys, step, F.col(value) > limit, for_steps)


def rollback_conditions(
    requests: DataFrame,
    version: str,
    ms: str,
    failed: Column,
    health_failed: Column,
    max_error_rate: float = 0.05,
    max_p95_ms: float = 500.0,
    max_health_failures: int = 3,
) -> DataFrame:
    """Three conditions per version; any one asks for a rollback."""
    totals = requests.groupBy(version).agg(
        F.avg(flag(failed)).alias("error_rate"), F.sum(flag(health_failed)).alias("health_failures")
    )
    p95 = grouped_quantiles(requests, [version], ms, {"p95_ms": 0.95})
    errors = F.col("error_rate") > max_error_rate
    slow = F.coalesce(F.col("p95_ms") > max_p95_ms, F.lit(False))
    sick = F.col("health_failures") > max_health_failures
    return join_keys(totals, p95, [version], "left").select(
        "*",
        errors.alias("too_many_errors"),
        slow.alias("too_slow"),
        sick.alias("unhealthy"),
        (errors | slow | sick).alias("rollback"),
    )


# The ratios that lead to a class, tested in this order.
STRONG, GOOD, SOME = 1.5, 1.2, 1.0
#: Classes from best to worst.
RECOMMENDATIONS = ("both_better", "throughput", "latency", "slightly_better", "no_gain")


def recommendation(throughput: str | Column, latency: str | Column) -> Column:
    t, s = col(throughput), col(latency)
    both, fast, quick, minor, none = (F.lit(x) for x in RECOMMENDATIONS)
    return (
        F.when((t > STRONG) & (s > STRONG), both)
        .when(t > GOOD, fast)
        .when(s > GOOD, quick)
        .when((t > SOME) & (s > SOME), minor)
        .otherwise(none)
    )


def comparison_table(best: DataFrame, model: str, baseline: str) -> DataFrame:
    """Ratios to the baseline with the recommendation and the best batch size of each model."""
    ratios = versus_baseline(best, model, baseline, "best_throughput_rps", "best_latency_ms")
    sizes = best.select(model, "optimal_batch_size")
    return ratios.join(sizes, model).withColumn(
        "recommendation", recommendation("throughput_vs_baseline", "latency_vs_baseline")
    )
