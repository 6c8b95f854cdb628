"""Streams over the event table, run to the end of what is available."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.operators import models as M
from scorelens.operators.drift import fit_edges
from scorelens.operators.ranking import CRITICAL_LOAD
from scorelens.plans.catalog import query
from scorelens.plans.model_queries import monitored_sides
from scorelens.plans.tidy import r, t, tidy
from scorelens.session import pin_small
from scorelens.sources.views import LOG_SQL, log_columns, prediction_log, table
from scorelens.streaming import limiter as L
from scorelens.streaming import runner as S
from scorelens.streaming import windows as W

LOG = f"WITH {LOG_SQL}"

#: Load levels that the sparse event table reaches, in requests per second.
LEVELS = ((0.0035, "low", 1.5), (0.0038, "normal", 1.0), (0.0041, "high", 0.5))


def log_stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return S.event_time(log_columns(S.table_stream(spark, d, "events", S.EVENTS_SCHEMA)), "created_at")


@query("t1_scoring_stream")
def t1(spark, d):
    """Fit on four fifths of the log, score the other fifth as a stream, append to the log."""
    features = VectorAssembler(inputCols=["processing_time_ms", "prior"], outputCol="features")
    past = prediction_log(spark, d).filter("request_id % 5 <> 0").withColumnRenamed("probability", "prior")
    history = features.transform(past).select("features", F.col("class").alias("label"))
    model = M.train(history, "logistic_regression")
    incoming = features.transform(log_stream(spark, d).filter("request_id % 5 = 0").withColumnRenamed("probability", "prior"))
    scored = M.score(incoming, model, ["request_id", "created_at", "model_version"])
    return tidy(S.run_append(scored, "scoring"))


def bounded_log(spark, d) -> S.BoundedStream:
    return S.BoundedStream(log_stream(spark, d), "created_at")


@query(
    "t2_tumbling_statistics",
    f"""{LOG}, b AS (SELECT date_trunc('hour', created_at) AS time_interval, processing_time_ms, class FROM log)
    SELECT {t('time_interval', 'time_interval')}, count(*) AS request_count, {r('avg(processing_time_ms)', 'avg_latency')},
    {r('quantile_disc(processing_time_ms, 0.95)', 'p95_latency')}, CAST(sum(class) AS BIGINT) AS bad_predictions FROM b
    GROUP BY b.time_interval""",
)
def t2(spark, d):
    """All windows, the last ones too. The sketch is exact for windows of fewer rows than its accuracy."""
    log = bounded_log(spark, d)
    return tidy(S.run_append(W.tumbling_statistics(log.rows), "tumbling", log))


def _limiter_sql(requests: str, window: int, burst_window: int) -> str:
    """The limiter as a recursion over the requests of each key, with the accepted times as a list.

    ``requests`` has key, request_id, us, lim and bur.
    """
    w, b = window * 1_000_000, burst_window * 1_000_000
    return f"""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, request_id) AS rn FROM ({requests})),
    s AS (SELECT DISTINCT key, 0::BIGINT AS rn, 0::BIGINT AS request_id, 0::BIGINT AS us, FALSE AS allowed, 0 AS applied_limit,
            0 AS remaining, 0 AS reset_in, []::BIGINT[] AS kept FROM r
      UNION ALL
      SELECT key, rn, request_id, us, ok, CASE WHEN length(old) < lim AND NOT ok THEN bur ELSE lim END,
        CASE WHEN ok THEN lim - length(old) - 1 ELSE 0 END,
        CASE WHEN ok OR length(old) >= lim THEN ({w} - (us - coalesce(old[1], us))) // 1000000
             ELSE ({b} - (us - coalesce(near[1], us))) // 1000000 END,
        CASE WHEN ok THEN list_append(old, us) ELSE old END
      FROM (SELECT *, length(old) < lim AND length(near) < bur AS ok FROM (
        SELECT r.*, list_filter(s.kept, lambda x: r.us - x < {w}) AS old, list_filter(s.kept, lambda x: r.us - x < {b}) AS near
        FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1)))
    SELECT key, request_id, us, CAST(allowed AS INTEGER) AS allowed, CAST(applied_limit AS INTEGER) AS applied_limit,
      CAST(remaining AS INTEGER) AS remaining, CAST(reset_in AS INTEGER) AS reset_in FROM s WHERE rn > 0"""


RECURSIVE_LOG = f"WITH RECURSIVE {LOG_SQL}"


@query(
    "t3_rate_limiter",
    f"{RECURSIVE_LOG}, "
    + _limiter_sql(
        "SELECT concat_ws(':', client, endpoint) AS key, request_id, epoch_us(created_at) AS us, 3 AS lim, 2 AS bur FROM log",
        86_400,
        14_400,
    ),
)
def t3(spark, d):
    log = bounded_log(spark, d)
    requests = log.rows.select("client", "endpoint", "request_id", "created_at")
    out = L.rate_limiter(requests, limit=3, burst=2, window=86_400, burst_window=14_400, slot=3_600)
    return S.run_append(out, "limiter", log).withColumn("allowed", F.col("allowed").cast("int"))


def _factor_sql(rps: str) -> str:
    bands = " ".join(f"WHEN {rps} < {top} THEN {f}" for top, _, f in LEVELS)
    return f"CASE {bands} ELSE {CRITICAL_LOAD[1]} END"


@query(
    "t4_adaptive_limiter",
    f"{RECURSIVE_LOG}, c AS (SELECT date_trunc('hour', created_at) AS step, count(*) AS n FROM log GROUP BY 1), "
    f"f AS (SELECT step, {_factor_sql('rps')} AS f FROM (SELECT step, coalesce(sum(n) OVER (ORDER BY step RANGE BETWEEN "
    "INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING), 0) / 86400 AS rps FROM c)), "
    + _limiter_sql(
        "SELECT concat_ws(':', client, endpoint) AS key, request_id, epoch_us(created_at) AS us, CAST(floor(4 * f) AS INTEGER) AS lim, "
        "CAST(floor(3 * f) AS INTEGER) AS bur FROM log JOIN f ON step = date_trunc('hour', created_at)",
        86_400,
        14_400,
    ),
)
def t4(spark, d):
    log = bounded_log(spark, d)
    requests = log.rows.select("client", "endpoint", "request_id", "created_at")
    out = L.adaptive_limiter(
        requests, limit=4, burst=3, seconds=86_400, burst_window=14_400, step=3_600, levels=LEVELS
    )
    return S.run_append(out, "adaptive", log).withColumn("allowed", F.col("allowed").cast("int"))


@query(
    "t5_circuit_breaker",
    f"""{RECURSIVE_LOG}, r AS MATERIALIZED (SELECT model_version AS service, request_id, epoch_us(created_at) AS us, class = 1 AS failed,
      row_number() OVER (PARTITION BY model_version ORDER BY created_at, request_id) AS rn FROM log),
    s AS (SELECT DISTINCT service, 0::BIGINT AS rn, 0::BIGINT AS request_id, 0::BIGINT AS us, FALSE AS rejected, 'CLOSED' AS state,
            0 AS failures, 0::BIGINT AS last FROM r
      UNION ALL
      SELECT service, rn, request_id, us, now = 'OPEN',
        CASE WHEN now = 'OPEN' OR (failed AND failures + 1 >= 5) THEN 'OPEN' WHEN NOT failed THEN 'CLOSED' ELSE now END,
        CASE WHEN now = 'OPEN' THEN failures WHEN failed THEN failures + 1 WHEN now = 'HALF_OPEN' THEN 0 ELSE failures END,
        CASE WHEN now <> 'OPEN' AND failed THEN us ELSE last END
      FROM (SELECT r.*, s.failures, s.last,
              CASE WHEN s.state = 'OPEN' AND r.us - s.last > 3600000000 THEN 'HALF_OPEN' ELSE s.state END AS now
            FROM s JOIN r ON r.service = s.service AND r.rn = s.rn + 1))
    SELECT service, request_id, us, CAST(rejected AS INTEGER) AS rejected, state, CAST(failures AS INTEGER) AS failures
    FROM s WHERE rn > 0""",
)
def t5(spark, d):
    log = bounded_log(spark, d)
    requests = log.rows.select(
        F.col("model_version").alias("service"), "request_id", "created_at", (F.col("class") == 1).alias("failed")
    )
    out = L.circuit_breaker(requests, threshold=5, reset_seconds=3600, slot=3_600)
    return S.run_append(out, "breaker", log).withColumn("rejected", F.col("rejected").cast("int"))


@query(
    "t7_count_window_stream",
    f"""{LOG}, k AS (SELECT endpoint, model_version, request_id, processing_time_ms AS v, row_number() OVER w AS rn
      FROM log WINDOW w AS (PARTITION BY endpoint, model_version ORDER BY created_at DESC, request_id)),
    n AS (SELECT endpoint, model_version, count(*) AS n_rows, avg(v) AS m FROM k WHERE rn <= 200 GROUP BY ALL HAVING count(*) >= 100)
    SELECT endpoint, model_version, n_rows, {r('m', 'mean_value')}, request_id FROM k JOIN n USING (endpoint, model_version) WHERE rn <= 200""",
)
def t7_stream(spark, d):
    """The newest 200 requests of each key at the end of the stream."""
    windows = L.last_rows_stream(log_stream(spark, d), ["endpoint", "model_version"], "processing_time_ms", n=200)
    last = S.run_updates(windows, "count-window", ["endpoint", "model_version"])
    return tidy(last.select("endpoint", "model_version", "n_rows", "mean_value", F.explode("request_ids").alias("request_id")))


PSI_COLUMNS = ["processing_time_ms", "probability"]
PSI_LEVELS = ["endpoint"]


def _day_psi(c: str) -> str:
    return f"""SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, '{c}' AS "column", round(sum((p - q) * ln(p / q)), 6) AS psi,
      CAST(sum((p - q) * ln(p / q)) > 0.2 AS INTEGER) AS drift_detected FROM (
      SELECT day, b, greatest(coalesce(nr, 0) / max(tr) OVER (), 0.0001) AS p, greatest(coalesce(nc, 0) / sum(coalesce(nc, 0)) OVER (PARTITION BY day), 0.0001) AS q FROM (
        SELECT g.day, g.b, rf.n AS nr, cu.n AS nc, (SELECT sum(n) FROM ref_{c}) AS tr FROM
          (SELECT DISTINCT day, b FROM days, (SELECT b FROM ref_{c} UNION SELECT b FROM cur_{c})) g
          LEFT JOIN ref_{c} rf ON rf.b = g.b LEFT JOIN cur_{c} cu ON cu.b = g.b AND cu.day = g.day)
      WHERE nr IS NOT NULL OR nc IS NOT NULL) GROUP BY day"""


def _psi_ctes() -> str:
    edges = ", ".join(str(i / 10) for i in range(1, 10))
    out = [
        "days AS (SELECT DISTINCT date_trunc('day', created_at) AS day FROM log)"
    ]
    for c in PSI_COLUMNS:
        e = f"(SELECT list_distinct(quantile_cont({c}, [{edges}])) AS e FROM log WHERE created_at < TIMESTAMP '2024-01-21')"
        b = f"len(list_filter(e, lambda x: {c} > x))"
        out.append(
            f"ref_{c} AS (SELECT {b} AS b, count(*)::DOUBLE AS n FROM log, {e} WHERE created_at < TIMESTAMP '2024-01-21' GROUP BY 1)"
        )
        out.append(
            f"cur_{c} AS (SELECT date_trunc('day', created_at) AS day, {b} AS b, count(*)::DOUBLE AS n FROM log, {e} GROUP BY 1, 2)"
        )
    for c in PSI_LEVELS:
        out.append(f"ref_{c} AS (SELECT {c} AS b, count(*)::DOUBLE AS n FROM log WHERE created_at < TIMESTAMP '2024-01-21' GROUP BY 1)")
        out.append(f"cur_{c} AS (SELECT date_trunc('day', created_at) AS day, {c} AS b, count(*)::DOUBLE AS n FROM log GROUP BY 1, 2)")
    return ", ".join(out)


@query("t6_drift_stream", f"{LOG}, {_psi_ctes()} " + " UNION ALL ".join(map(_day_psi, PSI_COLUMNS + PSI_LEVELS)))
def t6(spark, d):
    """Daily PSI of the stream against the bins of the reference period, for numbers and for a text column."""
    reference, _ = monitored_sides(spark, d)
    edges = fit_edges(reference, PSI_COLUMNS)
    levels = W.frequent_levels(reference, PSI_LEVELS)
    profile = pin_small(W.reference_profile(reference, edges, levels))
    log = bounded_log(spark, d)
    counts = W.drift_counts(log.rows, edges, levels)
    schema = T.StructType(
        [
            T.StructField("window_start", T.TimestampType()),
            T.StructField("column", T.StringType()),
            T.StructField("psi", T.DoubleType()),
            T.StructField("drift_detected", T.BooleanType()),
        ]
    )
    out = S.run_each_batch(counts, "drift", lambda b, i: W.window_psi(b, profile), schema, bounded=log)
    return tidy(out.drop("batch"))


@query(
    "t8_running_endpoints",
    f"""{LOG}, s AS (SELECT endpoint, count(*) AS n, CAST(sum(class) AS BIGINT) AS e, sum(processing_time_ms) AS ms FROM log GROUP BY 1)
    SELECT endpoint, n AS request_count, e AS errors, {r('ms', 'total_ms', 4)}, CAST(n >= 10 AND ms / n > 50 AS INTEGER) AS slow,
    CAST(n >= 10 AND e * 100.0 / n > 5 AS INTEGER) AS failing, CAST(n >= 10 AND 100.0 - e * 100.0 / n < 99.9 AS INTEGER) AS unavailable FROM s""",
)
def t8(spark, d):
    counters = S.run_updates(W.running_endpoints(log_stream(spark, d)), "endpoints", ["endpoint"])
    return tidy(W.running_alerts(counters, max_mean_ms=50.0), 4)


@query(
    "t9_alert_stream",
    f"""{LOG} SELECT DISTINCT 'SLOW_' || upper(endpoint) AS type, {t("date_trunc('hour', created_at)", 'window_start')} FROM log
    WHERE processing_time_ms > 100""",
)
def t9(spark, d):
    alerts = W.alert_stream(
        log_stream(spark, d),
        F.col("processing_time_ms") > 100,
        F.concat(F.lit("SLOW_"), F.upper("endpoint")),
    )
    return tidy(S.run_append(alerts, "alerts"))


@query("t10_new_data_arrival", "SELECT count(*) AS new_rows, CAST(count(*) >= 1000 AS INTEGER) AS new_data, 0::BIGINT AS batch FROM orders")
def t10(spark, d):
    schema = table(spark, d, "orders").schema
    stream = S.table_stream(spark, d, "orders", schema)
    out = T.StructType([T.StructField("new_rows", T.LongType()), T.StructField("new_data", T.BooleanType())])
    return tidy(S.run_each_batch(stream, "arrivals", lambda b, i: W.arrivals(b), out))


@query(
    "t11_idempotent_log",
    f"{LOG} SELECT request_id, endpoint, {r('probability', 'probability')} FROM log",
)
def t11(spark, d):
    """The stream carries every event twice; each request is written once."""
    events = log_stream(spark, d)
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = W.idempotent_log(twice).select("request_id", "endpoint", "probability")
    return tidy(S.run_append(out, "dedup"))
