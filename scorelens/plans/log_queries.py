"""Prediction-log analytics, request-log summaries, rankings and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions import columns as C
from scorelens.operators import predlog as A
from scorelens.operators import ranking as W
from scorelens.operators import rows as P
from scorelens.plans.catalog import query
from scorelens.plans.tidy import r, t, tidy
from scorelens.sources import readers as S
from scorelens.sources.views import AS_OF, LOG_SQL, prediction_log, table

AS = "TIMESTAMP '2024-01-31'"
LOG = f"WITH {LOG_SQL}"


def recent(span: str) -> str:
    return f"created_at >= {AS} - INTERVAL '{span}' AND created_at < {AS}"


def q(expr: str, p: float) -> str:
    return f"quantile_cont({expr}, {p})"


# ---- time-window statistics ------------------------------------------------------------------


@query(
    "a1_prediction_stats",
    f"""{LOG} SELECT count(*) AS total_predictions, {r('avg(processing_time_ms)', 'avg_processing_time')},
    {r('min(processing_time_ms)', 'min_processing_time')}, {r('max(processing_time_ms)', 'max_processing_time')},
    {r('avg(probability)', 'avg_probability')},
    CAST(sum(CASE WHEN class = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_predictions,
    CAST(sum(CASE WHEN class = 0 THEN 1 ELSE 0 END) AS BIGINT) AS good_predictions
    FROM log WHERE {recent('72 hours')} AND model_version = 'v1'""",
)
def a1(spark, d):
    return tidy(A.prediction_stats(prediction_log(spark, d), AS_OF, hours=72, model_version="v1"))


@query(
    "a2_hourly_distribution",
    f"""{LOG} SELECT CAST(extract(hour FROM created_at) AS INTEGER) AS hour, count(*) AS predictions_count
    FROM log WHERE {recent('240 hours')} GROUP BY 1 ORDER BY 1""",
)
def a2(spark, d):
    return A.hourly_distribution(prediction_log(spark, d), AS_OF, hours=240)


def _interval_sql(unit: str, days: int) -> str:
    return f"""{LOG}, b AS (SELECT date_trunc('{unit}', created_at) AS time_interval, * FROM log
      WHERE {recent(f'{days} days')})
    SELECT {t('time_interval', 'time_interval')}, count(*) AS request_count,
    {r('avg(processing_time_ms)', 'avg_latency')}, {r(q('processing_time_ms', 0.95), 'p95_latency')},
    {r(q('processing_time_ms', 0.99), 'p99_latency')}, CAST(sum(class) AS BIGINT) AS bad_predictions,
    {r('(count(*) - sum(class)) / count(*)::DOUBLE * 100', 'good_rate')}
    FROM b GROUP BY b.time_interval ORDER BY b.time_interval"""


@query("a3_performance_by_interval", _interval_sql("hour", 7))
def a3(spark, d):
    return tidy(A.performance_by_interval(prediction_log(spark, d), AS_OF, "1h"))


@query("a3_performance_by_day", _interval_sql("day", 30))
def a3_day(spark, d):
    return tidy(A.performance_by_interval(prediction_log(spark, d), AS_OF, "1d", days=30))


@query("a3_performance_by_week", _interval_sql("week", 31))
def a3_week(spark, d):
    return tidy(A.performance_by_interval(prediction_log(spark, d), AS_OF, "1w", days=31))


@query(
    "a4_performance_by_version",
    f"""{LOG} SELECT model_version, {r('avg(processing_time_ms)', 'avg_latency')}, count(*) AS total_predictions,
    {r('avg(probability)', 'avg_score')}, {r('stddev_samp(probability)', 'score_stddev')},
    {r(q('processing_time_ms', 0.95), 'p95_latency')}, {r(q('processing_time_ms', 0.99), 'p99_latency')}
    FROM log WHERE {recent('14 days')} AND model_version LIKE 'v%' GROUP BY model_version""",
)
def a4(spark, d):
    return tidy(A.performance_by_version(prediction_log(spark, d), AS_OF, days=14, name_prefix="v"))


@query("a5_row_count", "SELECT count(*) AS row_count FROM events WHERE event_type = 'error'")
def a5(spark, d):
    return A.row_count(table(spark, d, "events").filter("event_type = 'error'"))


@query(
    "a6_value_counts",
    f"""SELECT event_type AS value, count(*) AS count, {r('count(*)::DOUBLE / sum(count(*)) OVER ()', 'share')}
    FROM events GROUP BY event_type""",
)
def a6(spark, d):
    return tidy(A.value_counts(table(spark, d, "events"), "event_type"))


@query(
    "a7_class_balance",
    f"""WITH c AS (SELECT class, count(*) AS n FROM (SELECT CAST(event_type = 'error' AS INT) AS class
    FROM events) GROUP BY 1)
    SELECT count(*) AS classes, {r('min(n)::DOUBLE / max(n)', 'class_ratio')},
    {r('CASE WHEN count(*) = 2 THEN (max(n) - min(n)) * 100.0::DOUBLE / sum(n) END', 'class_imbalance')} FROM c""",
)
def a7(spark, d):
    return tidy(A.class_balance(prediction_log(spark, d), "class"))


# ---- request, run and query logs ---------------------------------------------------------------


@query(
    "a17_query_stats",
    f"""WITH s AS (SELECT url AS query, length(html) AS execution_time, page_id % 5 <> 0 AS success, page_id
    FROM pages) SELECT substring(query, 1, 24) AS query_pattern, count(*) AS count,
    CAST(sum(execution_time) AS BIGINT) AS total_time, {r('avg(execution_time)', 'avg_time')},
    CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS errors, max(page_id) AS last_executed
    FROM s GROUP BY 1 ORDER BY total_time DESC, query_pattern""",
)
def a17(spark, d):
    pages = table(spark, d, "pages").select(
        F.col("url").alias("query"),
        F.length("html").alias("execution_time"),
        (F.col("page_id") % 5 != 0).alias("success"),
        F.col("page_id").alias("timestamp"),
    )
    return tidy(A.query_stats(pages, last=None, prefix=24))


@query(
    "a17_query_stats_last_100",
    f"""WITH s AS (SELECT event_type AS query, abs(value) AS execution_time, user_id % 5 <> 0 AS success, ts
    FROM events ORDER BY ts DESC, event_id LIMIT 100)
    SELECT substring(query, 1, 100) AS query_pattern, count(*) AS count, {r('sum(execution_time)', 'total_time')},
    {r('avg(execution_time)', 'avg_time')}, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS errors,
    {t('max(ts)', 'last_executed')} FROM s GROUP BY 1""",
)
def a17_last(spark, d):
    log = table(spark, d, "events").select(
        F.col("event_type").alias("query"),
        F.abs("value").alias("execution_time"),
        (F.col("user_id") % 5 != 0).alias("success"),
        F.col("ts").alias("timestamp"),
        "event_id",
    )
    return tidy(A.query_stats(log, last=100, tie=["event_id"]))


REQUESTS = f"{LOG}, rq AS (SELECT *, class = 0 AND processing_time_ms <= 150 AS success FROM log)"


def requests(spark, d):
    return prediction_log(spark, d).withColumn(
        "success", (F.col("class") == 0) & (F.col("processing_time_ms") <= 150)
    )


@query(
    "a18_endpoint_summary",
    f"""{REQUESTS} SELECT CASE WHEN grouping(endpoint) = 1 THEN 'overall' ELSE endpoint END AS endpoint,
    CAST(grouping(endpoint) AS INTEGER) AS is_total, count(*) AS request_count,
    round(avg(processing_time_ms), 2) AS average_response_time_ms,
    round(sum(CASE WHEN success THEN 0 ELSE 1 END) * 100.0::DOUBLE / count(*), 2) AS error_rate_percent,
    round(sum(CASE WHEN success THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 2) AS availability_percent
    FROM rq GROUP BY ROLLUP(endpoint)""",
)
def a18(spark, d):
    return A.endpoint_summary(requests(spark, d))


def _runs(spark, d):
    return requests(spark, d).withColumn("users", F.col("client") % 6)


LOAD_RUNS = f"""{REQUESTS}, runs AS (
    SELECT client % 6 AS users, count(*) AS total_requests,
    CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful_requests,
    avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate,
    CASE WHEN sum(CASE WHEN success THEN 1 ELSE 0 END) > 0 THEN count(*) / 60.0::DOUBLE ELSE 0 END AS throughput_rps,
    avg(processing_time_ms) FILTER (WHERE success) AS latency_avg_ms,
    quantile_cont(processing_time_ms, 0.5) FILTER (WHERE success) AS latency_p50_ms,
    quantile_cont(processing_time_ms, 0.95) FILTER (WHERE success) AS latency_p95_ms,
    quantile_cont(processing_time_ms, 0.99) FILTER (WHERE success) AS latency_p99_ms,
    min(processing_time_ms) FILTER (WHERE success) AS latency_min_ms,
    max(processing_time_ms) FILTER (WHERE success) AS latency_max_ms
    FROM rq GROUP BY 1)"""


def load_runs(spark, d):
    return A.load_test_summary(_runs(spark, d), ["users"], F.lit(60.0), ms="processing_time_ms")


@query(
    "a19_load_test_summary",
    f"""{LOAD_RUNS} SELECT users, total_requests, successful_requests,
    total_requests - successful_requests AS failed_requests, {r('success_rate', 'success_rate')},
    {r('throughput_rps', 'throughput_rps')}, {r('latency_avg_ms', 'latency_avg_ms')},
    {r('latency_p50_ms', 'latency_p50_ms')}, {r('latency_p95_ms', 'latency_p95_ms')},
    {r('latency_p99_ms', 'latency_p99_ms')}, {r('latency_min_ms', 'latency_min_ms')},
    {r('latency_max_ms', 'latency_max_ms')} FROM runs""",
)
def a19(spark, d):
    return tidy(load_runs(spark, d))


@query(
    "a20_latency_percentiles",
    f"""{LOG} SELECT endpoint, {', '.join(r(q('processing_time_ms', p / 100), f'p{p}') for p in (50, 75, 90, 95, 99))}
    FROM log GROUP BY endpoint""",
)
def a20(spark, d):
    return tidy(A.latency_percentiles(prediction_log(spark, d), ["endpoint"], "processing_time_ms"))


@query(
    "a21_timing_stats",
    f"""{LOG} SELECT endpoint, {r('avg(processing_time_ms)', 'mean_ms')},
    {r('stddev_pop(processing_time_ms)', 'std_ms')},
    {r("sum(client % 6 + 1) * 1000.0::DOUBLE / sum(processing_time_ms)", 'throughput')},
    {r(q('processing_time_ms', 0.95), 'p95_ms')} FROM log GROUP BY endpoint""",
)
def a21(spark, d):
    return tidy(
        A.timing_stats(prediction_log(spark, d), ["endpoint"], "processing_time_ms", F.col("client") % 6 + 1)
    )


@query(
    "a23_approval_summary",
    f"""{LOG} SELECT model_version AS batch, count(*) AS total,
    CAST(sum(CASE WHEN probability <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS approved,
    CAST(sum(CASE WHEN probability <= 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS rejected,
    {r('avg(CASE WHEN probability <= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END)', 'approval_rate')}
    FROM log GROUP BY 1""",
)
def a23(spark, d):
    return tidy(A.approval_summary(prediction_log(spark, d), "model_version", F.col("probability") <= 0.5))


@query(
    "a24_batch_outcome",
    f"""{LOG} SELECT strftime(created_at, '%Y-%m-%d') AS batch, count(*) AS processed,
    CAST(sum(CASE WHEN class = 0 THEN 1 ELSE 0 END) AS BIGINT) AS successful,
    CAST(sum(class) AS BIGINT) AS failed, {r('sum(processing_time_ms)', 'total_time_ms', 4)}
    FROM log GROUP BY 1""",
)
def a24(spark, d):
    log = prediction_log(spark, d).select(
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.when(F.col("class") == 1, F.lit("model error")).alias("error"),
        "processing_time_ms",
    )
    return tidy(A.batch_outcome(log, "day", "error", "processing_time_ms"), 4)


@query(
    "a25_resource_summary",
    f"""{LOG} SELECT endpoint, {r('avg(probability * 100)', 'avg_cpu_percent')},
    {r('max(probability * 100)', 'max_cpu_percent')}, {r('avg(processing_time_ms)', 'avg_memory_mb')},
    {r('max(processing_time_ms)', 'max_memory_mb')}, CAST(sum(client) AS BIGINT) AS total_predictions,
    CAST(sum(class) AS BIGINT) AS errors, {r('sum(client)::DOUBLE / sum(processing_time_ms)', 'throughput_rps')},
    {r('sum(class)::DOUBLE / greatest(sum(client), 1)', 'error_rate')},
    CASE WHEN sum(class) = 0 THEN 'stable' ELSE 'unstable' END AS stability FROM log GROUP BY endpoint""",
)
def a25(spark, d):
    log = prediction_log(spark, d).withColumn("cpu", F.col("probability") * 100)
    return tidy(
        A.resource_summary(
            log, ["endpoint"], "cpu", "processing_time_ms", "client", "class", "processing_time_ms"
        )
    )


@query(
    "a26_status_rollup",
    """WITH s AS (SELECT user_id, CASE WHEN value > 250 THEN 'unhealthy' WHEN value > 150 THEN 'warning'
    WHEN event_type = 'error' AND value > 100 THEN 'error' WHEN value > 5 OR user_id % 2 = 0 THEN 'healthy'
    ELSE 'idle' END AS status FROM events)
    SELECT user_id, CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy'
    WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_or(status = 'error') THEN 'error'
    WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'unknown' END AS overall_status
    FROM s GROUP BY user_id""",
)
def a26(spark, d):
    e = table(spark, d, "events")
    v = F.col("value")
    status = (
        F.when(v > 250, "unhealthy")
        .when(v > 150, "warning")
        .when((F.col("event_type") == "error") & (v > 100), "error")
        .when((v > 5) | (F.col("user_id") % 2 == 0), "healthy")
        .otherwise("idle")
    )
    return A.status_rollup(e.select("user_id", status.alias("status")), "status", ["user_id"])


EDGES = (5, 10, 25, 50, 100, 250, 500)
BUCKETS = f"""{LOG}, e AS (SELECT unnest([5, 10, 25, 50, 100, 250, 500, 'inf'::DOUBLE]) AS le),
    b AS (SELECT endpoint, le, CAST(sum(CASE WHEN processing_time_ms <= le THEN 1 ELSE 0 END) AS BIGINT)
    AS cumulative_count FROM log, e GROUP BY endpoint, le)"""


@query(
    "a27_histogram_buckets",
    f"""{BUCKETS} SELECT endpoint, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS INTEGER) AS VARCHAR) END AS le,
    cumulative_count FROM b""",
)
def a27(spark, d):
    b = A.histogram_buckets(prediction_log(spark, d), ["endpoint"], "processing_time_ms", EDGES)
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string"))
    return b.select("endpoint", le.alias("le"), "cumulative_count")


@query(
    "a27_quantile_from_buckets",
    f"""{BUCKETS}, x AS (SELECT *, 0.95 * max(cumulative_count) OVER (PARTITION BY endpoint) AS rank,
    coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cumulative_count) OVER w, 0) AS below
    FROM b WINDOW w AS (PARTITION BY endpoint ORDER BY le))
    SELECT endpoint, {r('arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (cumulative_count - below) END, le)', 'quantile')}
    FROM x WHERE cumulative_count >= rank GROUP BY endpoint""",
)
def a27_quantile(spark, d):
    b = A.histogram_buckets(prediction_log(spark, d), ["endpoint"], "processing_time_ms", EDGES)
    return tidy(A.quantile_from_buckets(b, ["endpoint"], 0.95))


@query(
    "a28_counters_by_label",
    f"""{LOG} SELECT model_version, CASE WHEN class = 1 THEN 'error' ELSE 'success' END AS status,
    count(*) AS predictions_total FROM log GROUP BY 1, 2""",
)
def a28(spark, d):
    log = prediction_log(spark, d)
    status = F.when(F.col("class") == 1, "error").otherwise("success").alias("status")
    return A.counts_by(log, ["model_version", status], "predictions_total")


# ---- rankings ----------------------------------------------------------------------------------


@query(
    "w1_latest_per_type",
    f"""{LOG} SELECT endpoint, request_id, {t('created_at', 'created_at')}, {r('probability', 'probability')}
    FROM log QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY created_at DESC, request_id DESC) = 1""",
)
def w1(spark, d):
    log = prediction_log(spark, d).select("endpoint", "request_id", "created_at", "probability")
    return tidy(W.latest_per(log, ["endpoint"], "created_at", tie=["request_id"]))


@query(
    "w2_recent_n",
    f"""{LOG} SELECT request_id, endpoint, {t('created_at', 'created_at')} FROM log
    WHERE {recent('7 days')} ORDER BY log.created_at DESC, request_id LIMIT 10""",
)
def w2(spark, d):
    log = P.window_filter(prediction_log(spark, d), "created_at", AS_OF, days=7)
    return tidy(W.recent(log, "created_at", 10, ["request_id"]).select("request_id", "endpoint", "created_at"))


@query(
    "w4_top_k",
    f"""{LOG} SELECT endpoint, request_id, {r('processing_time_ms', 'processing_time_ms')},
    CAST(row_number() OVER (PARTITION BY endpoint ORDER BY processing_time_ms DESC, request_id) AS INTEGER) AS rank
    FROM log QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY processing_time_ms DESC, request_id) <= 5""",
)
def w4(spark, d):
    log = prediction_log(spark, d).select("endpoint", "request_id", "processing_time_ms")
    return tidy(W.top_k(log, ["endpoint"], [F.desc("processing_time_ms"), "request_id"], 5))


@query(
    "w5_best_under_sla",
    f"""{LOAD_RUNS}, f AS (SELECT users AS concurrent_users, * FROM runs), ok AS (
      SELECT * FROM f WHERE success_rate > 0.5 AND latency_p95_ms < 145)
    SELECT (SELECT concurrent_users FROM ok ORDER BY throughput_rps DESC, concurrent_users LIMIT 1)
      AS best_concurrent_users,
    {r('(SELECT max(throughput_rps) FROM ok)', 'best_throughput_rps')},
    {r('(SELECT max(throughput_rps) FROM f WHERE success_rate > 0.5)', 'max_safe_load')},
    coalesce(CAST(floor((SELECT concurrent_users FROM ok ORDER BY throughput_rps DESC, concurrent_users LIMIT 1) * 0.8)
      AS BIGINT), 50) AS recommended_concurrent_users,
    (SELECT count(*) FROM f WHERE latency_p95_ms > 145) AS sla_violations""",
)
def w5(spark, d):
    runs = load_runs(spark, d).withColumnRenamed("users", "concurrent_users")
    return tidy(W.best_under_sla(runs, min_success=0.5, max_p95=145.0))


BATCH_RUNS = f"""{LOG}, runs AS (SELECT endpoint AS model, client % 6 AS batch_size, count(*) / 60.0::DOUBLE AS throughput_rps,
    avg(processing_time_ms) AS avg_latency_ms FROM log GROUP BY 1, 2)"""


def batch_runs(spark, d):
    return (
        prediction_log(spark, d)
        .groupBy(F.col("endpoint").alias("model"), (F.col("client") % 6).alias("batch_size"))
        .agg(
            (F.count(F.lit(1)) / 60.0).alias("throughput_rps"),
            F.avg("processing_time_ms").alias("avg_latency_ms"),
        )
    )


@query(
    "w6_best_batch_size",
    f"""{BATCH_RUNS} SELECT model, {r('max(throughput_rps)', 'best_throughput_rps')},
    {r('min(avg_latency_ms)', 'best_latency_ms')},
    arg_max(batch_size, throughput_rps * 1000 - batch_size * 1e-6) AS optimal_batch_size FROM runs GROUP BY model""",
)
def w6(spark, d):
    return tidy(W.best_batch_size(batch_runs(spark, d)))


@query(
    "w7_trailing_request_count",
    f"""{LOG} SELECT request_id,
    count(*) OVER (PARTITION BY client, endpoint ORDER BY created_at
      RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) - 1 AS prior_day,
    count(*) OVER (PARTITION BY client, endpoint ORDER BY created_at
      RANGE BETWEEN INTERVAL '14399999999 microseconds' PRECEDING AND CURRENT ROW) - 1 AS prior_burst
    FROM log""",
)
def w7(spark, d):
    log = prediction_log(spark, d).select("request_id", "client", "endpoint", "created_at")
    out = W.trailing_counts(
        log, ["client", "endpoint"], "created_at", [86_400, 14_400], ["prior_day", "prior_burst"]
    )
    return out.select("request_id", "prior_day", "prior_burst")


@query(
    "w8_load_level",
    f"""{LOG}, x AS (SELECT created_at, epoch_us(created_at) AS us, count(*) OVER (ORDER BY created_at
      RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE AS rps FROM log),
    i AS (SELECT us, count(*) AS requests, max(rps) AS rps FROM x GROUP BY us)
    SELECT us, requests, {r('rps', 'rps')},
    CASE WHEN rps < 0.003 THEN 'low' WHEN rps < 0.004 THEN 'normal' WHEN rps < 0.006 THEN 'high' ELSE 'critical' END AS load_level,
    CASE WHEN rps < 0.003 THEN 1.5 WHEN rps < 0.004 THEN 1.0 WHEN rps < 0.006 THEN 0.5 ELSE 0.2 END::DOUBLE AS load_factor,
    CAST(floor(60 * CASE WHEN rps < 0.003 THEN 1.5 WHEN rps < 0.004 THEN 1.0 WHEN rps < 0.006 THEN 0.5 ELSE 0.2 END) AS BIGINT) AS adjusted_limit
    FROM i""",
)
def w8(spark, d):
    levels = ((0.003, "low", 1.5), (0.004, "normal", 1.0), (0.006, "high", 0.5))
    return tidy(W.load_levels(prediction_log(spark, d), "created_at", 60, 3600, levels))


@query(
    "w9_empirical_cdf",
    f"""{LOG}, c AS (SELECT endpoint, probability AS value, count(*) AS n FROM log GROUP BY 1, 2)
    SELECT endpoint, {r('value', 'value')}, n, {r('sum(n) OVER (PARTITION BY endpoint ORDER BY value)::DOUBLE / sum(n) OVER (PARTITION BY endpoint)', 'cdf')}
    FROM c""",
)
def w9(spark, d):
    return tidy(W.empirical_cdf(prediction_log(spark, d), ["endpoint"], "probability"))


PROBABILITY_BORDERS = [i / 20 for i in range(1, 20)]


@query(
    "w9_empirical_cdf_binned",
    f"""{LOG}, c AS (SELECT endpoint, len(list_filter({PROBABILITY_BORDERS}, lambda x: probability >= x)) AS b, max(probability) AS value, count(*) AS n
      FROM log WHERE probability IS NOT NULL GROUP BY 1, 2)
    SELECT endpoint, {r('value', 'value')}, n, {r('sum(n) OVER (PARTITION BY endpoint ORDER BY value)::DOUBLE / sum(n) OVER (PARTITION BY endpoint)', 'cdf')}
    FROM c""",
)
def w9_binned(spark, d):
    """One exact point per bin and endpoint."""
    return tidy(W.empirical_cdf(prediction_log(spark, d), ["endpoint"], "probability", borders=PROBABILITY_BORDERS))


@query(
    "w10_violation_examples",
    f"""SELECT l_returnflag, l_orderkey, l_partkey, l_quantity,
    CAST(row_number() OVER w AS INTEGER) AS example FROM lineitem WHERE l_quantity > 45
    WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)
    QUALIFY row_number() OVER w <= 5""",
)
def w10(spark, d):
    items = table(spark, d, "lineitem").filter("l_quantity > 45").select(
        "l_returnflag", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey"
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return W.examples(items, ["l_returnflag"], order).drop("l_linenumber", "l_suppkey")


# ---- sources and row filters -------------------------------------------------------------------


@query("s3_read_any", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s3(spark, d):
    return S.read_any(spark, f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "s5_read_prediction_log",
    f"""{LOG} SELECT request_id, {t('created_at', 'created_at')}, {r('probability', 'probability')}, model_version
    FROM log WHERE {recent('48 hours')}""",
)
def s5(spark, d):
    log = prediction_log(spark, d).select("request_id", "created_at", "probability", "model_version")
    return tidy(S.recent_predictions(log, AS_OF, hours=48))


@query(
    "p14_time_window",
    f"""SELECT count(*) AS rows_in_window, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events WHERE ts >= {AS} - INTERVAL '36 hours' AND ts < {AS}""",
)
def p14(spark, d):
    e = P.window_filter(table(spark, d, "events"), "ts", AS_OF, hours=36)
    return e.agg(
        F.count(F.lit(1)).alias("rows_in_window"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


@query(
    "p15_optional_filters",
    f"{LOG} SELECT request_id, endpoint, model_version FROM log WHERE model_version = 'v2' AND endpoint = 'click'",
)
def p15(spark, d):
    log = prediction_log(spark, d)
    out = P.equal_filters(log, model_version="v2", endpoint="click", client=None)
    return out.select("request_id", "endpoint", "model_version")


@query("p16_prefix_match", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def p16(spark, d):
    return P.prefix_filter(table(spark, d, "part"), "p_brand", "Brand#1").select("p_partkey", "p_brand")


@query(
    "p17_point_lookup",
    f"{LOG} SELECT request_id, {r('probability', 'probability')}, class FROM log WHERE request_id = 77",
)
def p17(spark, d):
    out = P.lookup(prediction_log(spark, d), "request_id", 77)
    return tidy(out.select("request_id", "probability", "class"))


@query(
    "p18_threshold_class",
    f"""{LOG} SELECT request_id, CAST(probability > 0.7 AS INTEGER) AS strict_class,
    CAST(probability >= 0.7 AS INTEGER) AS inclusive_class FROM log""",
)
def p18(spark, d):
    return prediction_log(spark, d).select(
        "request_id",
        C.threshold_class("probability", 0.7).alias("strict_class"),
        C.threshold_class("probability", 0.7, inclusive=True).alias("inclusive_class"),
    )


@query(
    "p19_slow_operations",
    f"{LOG} SELECT request_id, {r('processing_time_ms', 'processing_time_ms')} FROM log WHERE processing_time_ms > 100",
)
def p19(spark, d):
    log = prediction_log(spark, d).select("request_id", "processing_time_ms")
    return tidy(P.slow_operations(log, "processing_time_ms", 100.0))


@query(
    "p20_error_lines",
    """SELECT page_id, length(html) AS size FROM pages WHERE regexp_matches(html, '(?i)div|href')
    ORDER BY page_id DESC LIMIT 5""",
)
def p20(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("size"), "html")
    return P.error_lines(pages, "html", [F.desc("page_id")], pattern="(?i)div|href").drop("html")
