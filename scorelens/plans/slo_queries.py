"""Rules over request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import predlog as A
from scorelens.operators import slo as R
from scorelens.operators.ranking import best_batch_size
from scorelens.plans.catalog import query
from scorelens.plans.log_queries import BATCH_RUNS, LOG, REQUESTS, batch_runs, requests
from scorelens.plans.tidy import r, tidy
from scorelens.sources.views import prediction_log

HOUR = 3600


@query(
    "r1_endpoint_alerts",
    f"""{REQUESTS}, s AS (SELECT endpoint, count(*) AS n, round(avg(processing_time_ms), 2) AS m,
      round(sum(CASE WHEN success THEN 0 ELSE 1 END) * 100.0::DOUBLE / count(*), 2) AS e,
      round(sum(CASE WHEN success THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 2) AS u FROM rq GROUP BY 1)
    SELECT endpoint, n AS request_count, CAST(m > 50 AS INTEGER) AS slow, CAST(e > 5 AS INTEGER) AS failing, CAST(u < 99.9 AS INTEGER) AS unavailable,
    concat_ws('; ', CASE WHEN m > 50 THEN 'high response time: ' || printf('%.0f', m) || 'ms' END,
      CASE WHEN e > 5 THEN 'high error rate: ' || printf('%.1f', e) || '%' END,
      CASE WHEN u < 99.9 THEN 'low availability: ' || printf('%.1f', u) || '%' END) AS alerts FROM s WHERE n >= 10""",
)
def r1(spark, d):
    return tidy(R.endpoint_alerts(A.endpoint_summary(requests(spark, d)), max_mean_ms=50.0))


def _held_sql(windows: str, cond: str, steps: int, cols: str) -> str:
    """``windows`` is a query of (endpoint, step, ...); one row per step where the condition holds."""
    return f"""w AS ({windows}), tr AS (SELECT *, step - row_number() OVER (PARTITION BY endpoint ORDER BY step) AS isl FROM w WHERE {cond})
    SELECT endpoint, step, {cols}, CAST(step - min(step) OVER (PARTITION BY endpoint, isl) >= {steps} AS INTEGER) AS firing FROM tr"""


def _windows(aggs: str) -> str:
    """Five-hour windows that end every hour."""
    return f"""SELECT endpoint, step, {aggs} FROM (SELECT *, unnest(range(CAST(floor(epoch_us(created_at) / 3600000000) AS BIGINT),
      CAST(floor(epoch_us(created_at) / 3600000000) AS BIGINT) + 5)) AS step FROM rq) GROUP BY 1, 2"""


@query(
    "r2_error_rate_rule",
    f"""{REQUESTS}, {_held_sql(_windows("count(*) AS requests, count(*) FILTER (WHERE NOT success) AS errors"), "errors::DOUBLE / requests > 0.2", 3,
    "requests, errors, " + r("errors::DOUBLE / requests", "error_rate"))}""",
)
def r2(spark, d):
    out = R.error_rate_rule(
        requests(spark, d), ["endpoint"], "created_at", ~F.col("success"), 0.2, 5 * HOUR, HOUR, 3 * HOUR
    )
    return tidy(out)


EDGES = (10.0, 25.0, 50.0, 100.0, 250.0)


def _bucket_quantile() -> str:
    counts = ", ".join(f"sum(CASE WHEN processing_time_ms <= {e} THEN 1 ELSE 0 END)::DOUBLE AS b{i}" for i, e in enumerate(EDGES))
    case = "CASE "
    for i, e in enumerate(EDGES):
        lo, below = (EDGES[i - 1], f"b{i - 1}") if i else (0.0, "0")
        case += f"WHEN b{i} >= n * 0.95 THEN {lo} + ({e} - {lo}) * (n * 0.95 - {below}) / (b{i} - {below}) "
    case += f"ELSE {EDGES[-1]} END"
    return f"SELECT endpoint, step, CAST(n AS BIGINT) AS requests, {case} AS quantile FROM ({_windows('count(*)::DOUBLE AS n, ' + counts)})"


@query(
    "r3_latency_rule",
    f"{REQUESTS}, {_held_sql(_bucket_quantile(), 'quantile > 90', 2, 'requests, ' + r('quantile', 'quantile'))}",
)
def r3(spark, d):
    out = R.latency_rule(
        requests(spark, d),
        ["endpoint"],
        "created_at",
        F.col("processing_time_ms"),
        EDGES,
        limit=90.0,
        width=5 * HOUR,
        step=HOUR,
        for_seconds=2 * HOUR,
    )
    return tidy(out)


GAUGE = """SELECT endpoint, CAST(floor(epoch_us(created_at) / 21600000000) AS BIGINT) AS step, avg(probability) AS gauge FROM log GROUP BY 1, 2"""


@query("r4_gauge_rule", f"{LOG}, {_held_sql(GAUGE, 'gauge > 0.5', 2, r('gauge', 'gauge'))}")
def r4(spark, d):
    step = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / (6 * HOUR * 1_000_000))
    gauges = prediction_log(spark, d).groupBy("endpoint", step.alias("step")).agg(F.avg("probability").alias("gauge"))
    return tidy(R.gauge_rule(gauges, ["endpoint"], "step", "gauge", 0.5, 2))


@query(
    "r5_rollback_conditions",
    f"""{LOG}, s AS (SELECT model_version, avg(class) AS e, sum(CASE WHEN processing_time_ms > 300 THEN 1 ELSE 0 END) AS h,
      quantile_cont(processing_time_ms, 0.95) AS p FROM log GROUP BY 1)
    SELECT model_version, {r('e', 'error_rate')}, CAST(h AS BIGINT) AS health_failures, {r('p', 'p95_ms')}, CAST(e > 0.05 AS INTEGER) AS too_many_errors,
    CAST(p > 148 AS INTEGER) AS too_slow, CAST(h > 3 AS INTEGER) AS unhealthy, CAST(e > 0.05 OR p > 148 OR h > 3 AS INTEGER) AS rollback FROM s""",
)
def r5(spark, d):
    return tidy(
        R.rollback_conditions(
            prediction_log(spark, d),
            "model_version",
            "processing_time_ms",
            F.col("class") == 1,
            F.col("processing_time_ms") > 300,
            max_p95_ms=148.0,
        )
    )


TEXT = R.RECOMMENDATIONS


def _recommend(a: str, b: str) -> str:
    return f"""CASE WHEN {a} > 1.5 AND {b} > 1.5 THEN '{TEXT[0]}' WHEN {a} > 1.2 THEN '{TEXT[1]}' WHEN {b} > 1.2 THEN '{TEXT[2]}'
      WHEN {a} > 1.0 AND {b} > 1.0 THEN '{TEXT[3]}' ELSE '{TEXT[4]}' END"""


@query(
    "r6_recommendation",
    f"""SELECT o_orderkey, {_recommend('o_totalprice / 250000', 'o_custkey / 700.0::DOUBLE')} AS recommendation FROM orders""",
)
def r6(spark, d):
    from scorelens.sources.views import table

    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        R.recommendation(F.col("o_totalprice") / 250000, F.col("o_custkey") / 700.0).alias("recommendation"),
    )


@query(
    "r7_comparison_table",
    f"""{BATCH_RUNS}, s AS (SELECT model, max(throughput_rps) AS t, min(avg_latency_ms) AS l,
      arg_max(batch_size, throughput_rps * 1000 - batch_size * 1e-6) AS o FROM runs GROUP BY 1), b AS (SELECT * FROM s WHERE model = 'click'),
    x AS (SELECT s.model, s.t, s.l, s.o, s.t / greatest(b.t, 1) AS a, b.l / greatest(s.l, 1) AS c FROM s, b)
    SELECT model, {r('t', 'best_throughput_rps')}, {r('l', 'best_latency_ms')}, {r('a', 'throughput_vs_baseline')}, {r('c', 'latency_vs_baseline')},
    o AS optimal_batch_size, {_recommend('a', 'c')} AS recommendation FROM x""",
)
def r7(spark, d):
    return tidy(R.comparison_table(best_batch_size(batch_runs(spark, d)), "model", "click"))
