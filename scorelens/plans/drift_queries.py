"""Drift, tests on data, alerts and decisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from scorelens.operators import decisions as D
from scorelens.operators import drift as R
from scorelens.operators import lookups as J
from scorelens.plans.catalog import query
from scorelens.plans.evaluate_queries import LONG, version_metrics
from scorelens.plans.tidy import r, t, tidy
from scorelens.session import pin_small
from scorelens.sources.views import (
    AS_OF,
    LOG_SQL,
    SIDES_SQL,
    SPARSE_SQL,
    drift_sides,
    prediction_log,
    sparse_orders,
    table,
)

SD = f"WITH {SIDES_SQL}"
NUM = ["quantity", "extendedprice", "discount"]
CAT = ["returnflag", "linestatus"]


def ks_sql(c: str, src: str = "sides") -> str:
    return f"""(SELECT max(abs(a / ta - b / tb)) FROM (SELECT sum(r) OVER (ORDER BY v) AS a, sum(k) OVER (ORDER BY v) AS b,
      sum(r) OVER () AS ta, sum(k) OVER () AS tb FROM (SELECT {c} AS v, sum(1 - side)::DOUBLE AS r, sum(side)::DOUBLE AS k FROM {src}
      WHERE {c} IS NOT NULL GROUP BY 1)))"""


def psi_sql(bins: str) -> str:
    """PSI over ``bins``, a query of (b, r, k)."""
    return f"""(SELECT sum((p - q) * ln(p / q)) FROM (SELECT greatest(r / sum(r) OVER (), 0.0001) AS p,
      greatest(k / sum(k) OVER (), 0.0001) AS q FROM ({bins})))"""


def cat_bins(c: str) -> str:
    return f"SELECT {c} AS b, sum(1 - side)::DOUBLE AS r, sum(side)::DOUBLE AS k FROM sides GROUP BY 1"


def num_bins(c: str) -> str:
    edges = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"""SELECT len(list_filter(list_distinct(e), lambda x: {c} > x)) AS b, sum(1 - side)::DOUBLE AS r, sum(side)::DOUBLE AS k
      FROM sides, (SELECT quantile_cont({c}, [{edges}]) AS e FROM sides WHERE side = 0) GROUP BY 1"""


def chi2_sql(c: str) -> str:
    return f"""(SELECT sum((r - er) * (r - er) / er + (k - ek) * (k - ek) / ek) FROM (SELECT r, k,
      (r + k) * sum(r) OVER () / sum(r + k) OVER () AS er, (r + k) * sum(k) OVER () / sum(r + k) OVER () AS ek FROM ({cat_bins(c)})))"""


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def ks_tail_sql(s: str, n: str = "n_ref", m: str = "n_cur") -> str:
    """The asymptotic series of 100 terms."""
    lam = f"({n}::DOUBLE * {m} / ({n} + {m}) * {s} * {s})"
    series = f"list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * {lam})))"
    return f"CASE WHEN {lam} < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * {series})) END"


def gamma_tail_sql(a: str, x: str) -> str:
    """Upper incomplete gamma function: one less the series of the lower one, whose terms are all positive."""
    terms = f"range(0, CAST(3 * ({x}) + 10 * sqrt({a}) + 200 AS BIGINT))"
    series = f"list_sum(list_transform({terms}, lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - {series}) END"


SIZES = """(SELECT count(*) FROM sides WHERE side = 0) AS n_ref, (SELECT count(*) FROM sides WHERE side = 1) AS n_cur"""


@query(
    "d1_ks_drift",
    f"{SD}, ks AS ("
    + _union([f"SELECT '{c}' AS \"column\", {ks_sql(c)} AS s, {SIZES}" for c in NUM])
    + f""") SELECT "column", {r('s', 'statistic')}, {r(ks_tail_sql('s'), 'p_value')}, n_ref, n_cur FROM ks""",
)
def d1(spark, d):
    return tidy(R.ks_drift(*drift_sides(spark, d), NUM))


#: Borders of the bins that both forms are given.
KS_BORDERS = {
    "quantity": [float(x) for x in range(4, 50, 3)],
    "extendedprice": [float(x) for x in range(2_000, 100_000, 1_500)],
    "discount": [0.015, 0.035, 0.055, 0.085],
}


def binned_ks_sql(c: str) -> str:
    bins = f"len(list_filter({KS_BORDERS[c]}, lambda x: {c} >= x))"
    return f"""SELECT '{c}' AS "column", max(abs(a / ta - b / tb)) AS s, max(greatest(r / ta, k / tb)) AS e, CAST(max(ta) AS BIGINT) AS n_ref,
      CAST(max(tb) AS BIGINT) AS n_cur FROM (SELECT r, k, sum(r) OVER (ORDER BY v) AS a, sum(k) OVER (ORDER BY v) AS b, sum(r) OVER () AS ta,
        sum(k) OVER () AS tb FROM (SELECT {bins} AS v, sum(1 - side)::DOUBLE AS r, sum(side)::DOUBLE AS k FROM sides WHERE {c} IS NOT NULL GROUP BY 1))"""


@query(
    "d1_ks_drift_binned",
    f"{SD}, ks AS ("
    + _union([binned_ks_sql(c) for c in NUM])
    + f""") SELECT "column", {r('s', 'statistic')}, {r('e', 'error')}, {r(ks_tail_sql('s'), 'p_value')}, n_ref, n_cur FROM ks""",
)
def d1_binned(spark, d):
    """The distance over counted bins, with the bound of what it may lack."""
    return tidy(R.binned_ks(*drift_sides(spark, d), NUM, borders=KS_BORDERS))


@query(
    "d1_ks_drift_sliced",
    f"{SD} " + _union([f"SELECT '{c}' AS \"column\", {r(ks_sql(c), 'statistic')}" for c in NUM]),
)
def d1_sliced(spark, d):
    """The same statistic over many small slices, which is how large columns run."""
    return tidy(R.ks_drift(*drift_sides(spark, d), NUM, rows_per_slice=5_000).select("column", "statistic"))


@query(
    "d2_psi_drift",
    f"{SD} "
    + _union(
        [f"SELECT '{c}' AS \"column\", {r(psi_sql(num_bins(c)), 'psi')}" for c in NUM]
        + [f"SELECT '{c}', {r(psi_sql(cat_bins(c)), 'psi')}" for c in CAT]
    ),
)
def d2(spark, d):
    return tidy(R.psi_drift(*drift_sides(spark, d), numeric=NUM, categorical=CAT))


@query(
    "d3_chi2_drift",
    f"{SD}, x2 AS ("
    + _union(
        [
            f"SELECT '{c}' AS \"column\", {chi2_sql(c)} AS s, (SELECT count(DISTINCT {c}) - 1 FROM sides) AS degrees, {SIZES}"
            for c in CAT
        ]
    )
    + f""") SELECT "column", {r('s', 'statistic')}, degrees, {r(gamma_tail_sql('(degrees / 2.0::DOUBLE)', '(s / 2)'), 'p_value')}, n_ref, n_cur FROM x2""",
)
def d3(spark, d):
    return tidy(R.chi2_drift(*drift_sides(spark, d), CAT))


@query(
    "d4_proportion_drift",
    f"""{SD}, s AS (SELECT count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur,
      avg(target) FILTER (WHERE side = 0) AS p_ref, avg(target) FILTER (WHERE side = 1) AS p_cur, avg(target) AS p FROM sides)
    SELECT n_ref, n_cur, {r('p_ref', 'p_ref')}, {r('p_cur', 'p_cur')}, {r('zz', 'z')},
    {r(gamma_tail_sql('0.5::DOUBLE', '(zz * zz / 2)'), 'p_value')}
    FROM (SELECT *, (p_cur - p_ref) / sqrt(p * (1 - p) * (1.0::DOUBLE / n_ref + 1.0::DOUBLE / n_cur)) AS zz FROM s)""",
)
def d4(spark, d):
    return tidy(R.proportion_drift(*drift_sides(spark, d), "target"))


REPORT = (
    f"{SD}, rep AS ("
    + _union(
        [
            f"""SELECT '{c}' AS "column", 'numeric' AS kind, 'ks' AS test_name, {ks_sql(c)} AS statistic, {ks_sql(c)} AS drift_score, 0.003 AS lim,
            1 AS degrees"""
            for c in NUM
        ]
        + [
            f"SELECT '{c}', 'categorical', 'chi2', {chi2_sql(c)}, {psi_sql(cat_bins(c))}, 0.0001, (SELECT count(DISTINCT {c}) - 1 FROM sides)"
            for c in CAT
        ]
    )
    + f"""), col AS (SELECT "column", kind, test_name, statistic, drift_score, CAST(drift_score > lim AS INTEGER) AS drift_detected,
      CASE test_name WHEN 'ks' THEN {ks_tail_sql('statistic')}
        ELSE {gamma_tail_sql('(degrees / 2.0::DOUBLE)', '(statistic / 2)')} END AS p_value FROM (SELECT *, {SIZES} FROM rep))"""
)


def report(spark, d):
    """Low limits, since both sides of the test data come from one distribution."""
    return R.column_drift_report(*drift_sides(spark, d), NUM, CAT, ks_limit=0.003, psi_limit=0.0001)


@query(
    "d5_column_drift_report",
    f"""{REPORT} SELECT "column", kind, test_name, {r('statistic', 'statistic')}, {r('p_value', 'p_value')}, {r('drift_score', 'drift_score')},
    drift_detected FROM col""",
)
def d5(spark, d):
    return tidy(report(spark, d))


@query(
    "d5_column_drift_p_values",
    f"""{REPORT} SELECT "column", kind, test_name, {r('statistic', 'statistic')}, {r('p_value', 'p_value')}, {r('drift_score', 'drift_score')},
    CAST(p_value < 1 - 0.95 AS INTEGER) AS drift_detected FROM col""",
)
def d5_p(spark, d):
    """The report with verdicts by tail probability."""
    return tidy(R.column_drift_report(*drift_sides(spark, d), NUM, CAT, confidence=0.95))


DATASET = f"""{REPORT}, ds AS (SELECT count(*) AS total_columns, CAST(sum(drift_detected) AS BIGINT) AS drifted_columns_count,
    CAST(sum(CASE WHEN kind = 'numeric' THEN drift_detected ELSE 0 END) AS BIGINT) AS drifted_numeric,
    CAST(sum(CASE WHEN kind = 'categorical' THEN drift_detected ELSE 0 END) AS BIGINT) AS drifted_categorical,
    sum(drift_detected)::DOUBLE / count(*) AS data_drift_score,
    coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE drift_detected = 1), '') AS drifted_columns,
    CAST(sum(drift_detected)::DOUBLE / count(*) > 0.3 AS INTEGER) AS data_drift_detected FROM col)"""


@query(
    "d6_dataset_drift",
    f"""{DATASET} SELECT total_columns, drifted_columns_count, drifted_numeric, drifted_categorical,
    {r('data_drift_score', 'data_drift_score')}, drifted_columns, data_drift_detected FROM ds""",
)
def d6(spark, d):
    out = R.dataset_drift(report(spark, d))
    return tidy(out.withColumn("drifted_columns", F.array_join("drifted_columns", ",")))


TARGET_PSI = psi_sql(cat_bins("target"))
MOMENTS = ", ".join(
    f"{f}(target) FILTER (WHERE side = {i}) AS {n}_{s}"
    for i, n in ((0, "reference"), (1, "current"))
    for f, s in (("avg", "mean"), ("stddev_samp", "std"))
)


@query(
    "d7_target_drift",
    f"""{SD}, m AS (SELECT {MOMENTS}, {TARGET_PSI} AS s FROM sides)
    SELECT {r('s', 'target_drift_score')}, {r('reference_mean', 'reference_mean')}, {r('reference_std', 'reference_std')},
    {r('current_mean', 'current_mean')}, {r('current_std', 'current_std')}, CAST(s > 0.2 AS INTEGER) AS target_drift_detected FROM m""",
)
def d7(spark, d):
    return tidy(R.target_drift(*drift_sides(spark, d), "target"))


@query("d8_prediction_drift", f"{SD} SELECT {r(ks_sql('prediction'), 'prediction_drift_score')}")
def d8(spark, d):
    return tidy(R.prediction_drift(*drift_sides(spark, d)))


CONCEPT_LIMIT = 0.002


def concept(spark, d):
    sides = drift_sides(spark, d)
    return R.concept_drift(R.target_drift(*sides, "target"), R.prediction_drift(*sides), CONCEPT_LIMIT)


@query(
    "d9_concept_drift",
    f"""{SD}, x AS (SELECT {TARGET_PSI} AS a, {ks_sql('prediction')} AS b)
    SELECT {r('a', 'target_drift_score')}, {r('b', 'prediction_drift_score')}, {r('greatest(a, b)', 'concept_drift_score')},
    CAST(greatest(a, b) > {CONCEPT_LIMIT} AS INTEGER) AS concept_drift_detected FROM x""",
)
def d9(spark, d):
    out = concept(spark, d)
    return tidy(
        out.select("target_drift_score", "prediction_drift_score", "concept_drift_score", "concept_drift_detected")
    )


PAIRS = f"""{LONG}, l AS (SELECT m.version, unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc', 'pr_auc']) AS metric,
    unnest([accuracy, precision, recall, f1, roc_auc, pr_auc]) AS value FROM m JOIN auc ON m.version = auc.version),
  pr AS (SELECT a.metric, a.value AS reference, b.value AS current FROM l a JOIN l b ON a.metric = b.metric WHERE a.version = 'v1' AND b.version = 'v2'),
  dk AS (SELECT *, CASE WHEN reference > 0 THEN (reference - current) / reference * 100 ELSE 0 END AS decay_percent FROM pr)"""


def pairs(spark, d):
    return J.metric_comparison(*version_metrics(spark, d))


@query(
    "d10_performance_decay",
    f"""{PAIRS} SELECT metric, {r('reference', 'reference')}, {r('current', 'current')}, {r('decay_percent', 'decay_percent')},
    CAST(abs(decay_percent) > 10 AS INTEGER) AS significant_decay FROM dk""",
)
def d10(spark, d):
    return tidy(R.performance_decay(pairs(spark, d)))


@query(
    "d11_absolute_decay",
    f"""{PAIRS} SELECT {r('max(reference - current)', 'largest_fall')}, CAST(bool_or(reference - current > 0.05) AS INTEGER) AS decayed
    FROM pr WHERE metric IN ('accuracy', 'roc_auc', 'f1')""",
)
def d11(spark, d):
    return tidy(R.absolute_decay(pairs(spark, d)))


SO_COLS = ["cust_mod", "totalprice", "priority", "target"]


@query(
    "d12_missing_share",
    f"""WITH {SPARSE_SQL}, m AS ({_union([f'SELECT count(*) - count({c}) AS m, count(*) AS n FROM so' for c in SO_COLS])})
    SELECT CAST(sum(m) AS BIGINT) AS missing_cells, {r('sum(m)::DOUBLE / sum(n)', 'missing_share')},
    {r('max(m::DOUBLE / n)', 'worst_column_share')}, CAST(sum(m)::DOUBLE / sum(n) < 0.05 AS INTEGER) AS within_limit FROM m""",
)
def d12(spark, d):
    return tidy(R.missing_share(sparse_orders(spark, d), SO_COLS))


def _summary_sql(c: str) -> str:
    return f"""SELECT CASE WHEN side = 0 THEN 'reference' ELSE 'current' END AS side, '{c}' AS "column", count({c}) AS count,
    count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique", {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')},
    {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std', 5)}, {r(f'quantile_cont({c}, 0.25)', 'p25')}, {r(f'quantile_cont({c}, 0.5)', 'p50')},
    {r(f'quantile_cont({c}, 0.75)', 'p75')} FROM sides GROUP BY side"""


@query("d13_column_summary", f"{SD} " + _union([_summary_sql(c) for c in NUM]))
def d13(spark, d):
    return tidy(R.column_summary(*drift_sides(spark, d), NUM).withColumn("std", F.round("std", 5)))


@query(
    "d14_column_correlations",
    f"{SD} "
    + _union(
        [f"SELECT '{c}' AS \"column\", {r(f'corr(extendedprice, {c})', 'correlation')} FROM sides" for c in ("quantity", "discount", "prediction")]
    ),
)
def d14(spark, d):
    ref, cur = drift_sides(spark, d)
    return tidy(R.column_correlations(ref.union(cur), "extendedprice", ["quantity", "discount", "prediction"]))


@query(
    "d15_value_range_share",
    f"""{SD} SELECT CASE WHEN side = 0 THEN 'reference' ELSE 'current' END AS side,
    {r('avg(CAST(quantity BETWEEN 10 AND 20 AS INTEGER))', 'share_in_range')} FROM sides GROUP BY 1""",
)
def d15(spark, d):
    return tidy(R.value_range_share(*drift_sides(spark, d), "quantity", 10, 20))


@query(
    "d16_column_quantile",
    f"""{SD} SELECT CASE WHEN side = 0 THEN 'reference' ELSE 'current' END AS side,
    {r('quantile_cont(extendedprice, 0.9)', 'value')} FROM sides GROUP BY 1""",
)
def d16(spark, d):
    return tidy(R.column_quantile(*drift_sides(spark, d), "extendedprice", 0.9))


@query(
    "d16_column_quantile_bracketed",
    f"""{SD} SELECT returnflag, {r('quantile_cont(extendedprice, 0.25)', 'q1')}, {r('quantile_cont(extendedprice, 0.95)', 'p95')} FROM sides GROUP BY 1""",
)
def d16_bracketed(spark, d):
    """The bracket-and-refine path, which large groups take, on whole columns."""
    from scorelens.functions.quantiles import grouped_quantiles

    ref, cur = drift_sides(spark, d)
    return tidy(
        grouped_quantiles(
            ref.union(cur), ["returnflag"], "extendedprice", {"q1": 0.25, "p95": 0.95}, exact_below=500, accuracy=200
        )
    )


@query(
    "d17_custom_metrics",
    f"{SD} SELECT 'column_drift' AS metric, 'quantity' AS \"column\", 'both' AS side, {r(ks_sql('quantity'), 'value')}"
    + f""" UNION ALL SELECT 'column_correlations.discount', 'quantity', 'current', {r('corr(quantity, discount)', 'value')} FROM sides WHERE side = 1
    UNION ALL SELECT 'column_value_range', 'discount', CASE WHEN side = 0 THEN 'reference' ELSE 'current' END,
      {r('avg(CAST(discount BETWEEN 0.02 AND 0.05 AS INTEGER))', 'value')} FROM sides GROUP BY side
    UNION ALL SELECT 'column_quantile', 'quantity', CASE WHEN side = 0 THEN 'reference' ELSE 'current' END, {r('quantile_cont(quantity, 0.5)', 'value')} FROM sides GROUP BY side""",
)
def d17(spark, d):
    config = [
        {"type": "column_drift", "column_name": "quantity"},
        {"type": "column_correlations", "column_name": "quantity", "others": ["discount"]},
        {"type": "column_value_range", "column_name": "discount", "left": 0.02, "right": 0.05},
        {"type": "column_quantile", "column_name": "quantity"},
        {"type": "no_such_metric", "column_name": "quantity"},
    ]
    return tidy(R.custom_metrics(*drift_sides(spark, d), config))


TESTS = f"""{DATASET}, cur AS (SELECT * FROM sides WHERE side = 1), tst AS (
    SELECT 'share_of_drifted_columns' AS name, data_drift_score AS value, '<' AS op, 0.3 AS lim, data_drift_score < 0.3 AS passed FROM ds
    UNION ALL SELECT 'number_of_drifted_columns', drifted_columns_count::DOUBLE, '<', 5.0, drifted_columns_count < 5 FROM ds
    UNION ALL SELECT 'drift:quantity', drift_detected::DOUBLE, '<', 1.0, drift_detected < 1 FROM col WHERE "column" = 'quantity'
    UNION ALL SELECT 'share_of_missing_values', 0.0, '<', 0.1, true
    UNION ALL SELECT 'min:quantity', min(quantity), '>', 0.0, min(quantity) > 0 FROM cur
    UNION ALL SELECT 'max:quantity', max(quantity), '<', 50.0, max(quantity) < 50 FROM cur)"""


def tests_of(spark, d):
    _, cur = drift_sides(spark, d)
    return R.drift_tests(
        pin_small(report(spark, d)), cur, NUM, important=["quantity"], bounds={"quantity": (0.0, 50.0)}
    )


@query(
    "d18_drift_tests",
    f"{TESTS} SELECT name, {r('value::DOUBLE', 'value')}, op, lim::DOUBLE AS \"limit\", CAST(passed AS INTEGER) AS passed FROM tst",
)
def d18(spark, d):
    return tidy(tests_of(spark, d))


@query(
    "d18_test_verdict",
    f"""{TESTS} SELECT count(*) AS tests, count(*) FILTER (WHERE NOT passed) AS failed,
    coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT passed), '') AS failed_tests, CAST(bool_and(passed) AS INTEGER) AS all_passed FROM tst""",
)
def d18_verdict(spark, d):
    out = R.test_verdict(tests_of(spark, d))
    return tidy(out.withColumn("failed_tests", F.array_join("failed_tests", ",")))


def state(spark, d):
    """One row of drift state: data drift, concept drift, decay."""
    decay = pin_small(R.performance_decay(pairs(spark, d), limit_percent=1.0))
    one = D.one_row(R.dataset_drift(report(spark, d)), concept(spark, d), D.decay_flag(decay))
    return pin_small(one), decay


SCORES = f"""{DATASET.replace('WITH ', 'WITH ' + PAIRS[5:] + ', ', 1)},
  cc AS (SELECT greatest({TARGET_PSI}, {ks_sql('prediction')}) AS concept_drift_score, {TARGET_PSI} AS target_drift_score),
  st AS (SELECT ds.*, concept_drift_score, CAST(concept_drift_score > {CONCEPT_LIMIT} AS INTEGER) AS concept_drift_detected,
    CAST(target_drift_score > 0.2 AS INTEGER) AS target_drift_detected,
    (SELECT CAST(bool_or(abs(decay_percent) > 1) AS INTEGER) FROM dk) AS significant_decay FROM ds, cc)"""


@query(
    "d19_drift_alerts",
    f"""{SCORES} SELECT CASE WHEN data_drift_score < 0.3 THEN 'WARNING' ELSE 'CRITICAL' END AS level, 'DATA_DRIFT' AS type,
      'inputs moved, distance ' || printf('%.3f', data_drift_score) AS message, '2024-01-31 00:00:00' AS created_at FROM st WHERE data_drift_detected = 1
    UNION ALL SELECT CASE WHEN concept_drift_score < 0.3 THEN 'WARNING' ELSE 'CRITICAL' END, 'CONCEPT_DRIFT',
      'target or scores moved, distance ' || printf('%.3f', concept_drift_score), '2024-01-31 00:00:00' FROM st WHERE concept_drift_detected = 1
    UNION ALL SELECT 'CRITICAL', 'PERFORMANCE_DECAY', 'lost ground: ' || metric || ' ' || printf('%.1f', decay_percent) || '%',
      '2024-01-31 00:00:00' FROM dk WHERE abs(decay_percent) > 1""",
)
def d19(spark, d):
    return tidy(D.drift_alerts(*state(spark, d), AS_OF).drop("details"))


ALERTS = f"""WITH {LOG_SQL}, al AS (SELECT request_id AS id, CASE WHEN processing_time_ms > 150 THEN 'CRITICAL' ELSE 'WARNING' END AS level,
    upper(endpoint) AS type, created_at FROM log WHERE processing_time_ms > 90)"""


def alert_log(spark, d):
    """Slow requests as an alert log."""
    level = F.when(F.col("processing_time_ms") > 150, "CRITICAL").otherwise("WARNING")
    return (
        prediction_log(spark, d)
        .filter(F.col("processing_time_ms") > 90)
        .select(F.col("request_id").alias("id"), level.alias("level"), F.upper("endpoint").alias("type"), "created_at")
    )


@query(
    "d20_alert_listing",
    f"""{ALERTS} SELECT id, level, type, {t('created_at', 'created_at')} FROM al WHERE level = 'CRITICAL'
    AND created_at >= TIMESTAMP '2024-01-24' AND created_at < TIMESTAMP '2024-01-31'""",
)
def d20(spark, d):
    return tidy(D.list_alerts(alert_log(spark, d), AS_OF, level="CRITICAL", tie=["id"]))


@query(
    "d21_alert_acknowledgement",
    f"""{ALERTS}, ack AS (SELECT event_id - event_id % 5 AS id, ts AS acknowledged_at, 'user' || CAST(user_id AS VARCHAR) AS acknowledged_by
      FROM events WHERE event_type = 'click'),
    last AS (SELECT id, max(acknowledged_at) AS acknowledged_at, arg_max(acknowledged_by, acknowledged_at) AS acknowledged_by FROM ack GROUP BY 1)
    SELECT al.id, level, type, {t('created_at', 'created_at')}, acknowledged_by, {t('acknowledged_at', 'acknowledged_at')},
    CAST(acknowledged_at IS NOT NULL AS INTEGER) AS acknowledged FROM al LEFT JOIN last ON al.id = last.id""",
)
def d21(spark, d):
    acks = (
        table(spark, d, "events")
        .filter("event_type = 'click'")
        .select(
            (F.col("event_id") - F.col("event_id") % 5).alias("id"),
            F.col("ts").alias("acknowledged_at"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("acknowledged_by"),
        )
    )
    return tidy(D.acknowledge(alert_log(spark, d), acks))


@query(
    "d22_retrain_decision",
    f"""{SCORES}, x AS (SELECT *, data_drift_detected = 1 AND data_drift_score > 0.5 AS a, concept_drift_detected = 1 AND concept_drift_score > 0.3 AS b,
      significant_decay = 1 AS c FROM st)
    SELECT {r('data_drift_score', 'data_drift_score')}, {r('concept_drift_score', 'concept_drift_score')},
    concat_ws('; ', CASE WHEN a THEN 'data_drift=' || printf('%.3f', data_drift_score) END,
      CASE WHEN b THEN 'concept_drift=' || printf('%.3f', concept_drift_score) END,
      CASE WHEN c THEN 'metric_decay' END) AS reasons, CAST(a OR b OR c AS INTEGER) AS should_retrain FROM x""",
)
def d22(spark, d):
    out = D.retrain_decision(state(spark, d)[0])
    return tidy(
        out.select(
            "data_drift_score", "concept_drift_score", F.array_join("reasons", "; ").alias("reasons"), "should_retrain"
        )
    )


@query(
    "d23_retrain_triggers",
    f"""{SCORES}, n AS (SELECT count(*) AS new_rows FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
    x AS (SELECT true AS a, data_drift_score > 0.5 AS b, significant_decay = 1 AS c, new_rows >= 1000 AS e, new_rows FROM st, n)
    SELECT 1 AS scheduled, CAST(b AS INTEGER) AS data_drift, CAST(c AS INTEGER) AS performance_decay, CAST(e AS INTEGER) AS new_data, new_rows,
    CAST(a OR b OR c OR e AS INTEGER) AS should_retrain FROM x""",
)
def d23(spark, d):
    orders = table(spark, d, "orders")
    cut = F.lit(datetime(1998, 1, 1)).cast(orders.schema["o_orderdate"].dataType)
    st = state(spark, d)[0].withColumnRenamed("significant_decay", "decayed")
    return tidy(
        D.retrain_triggers(
            orders.filter(F.col("o_orderdate") >= cut), st, AS_OF, last_training=datetime(2024, 1, 29)
        )
    )


@query(
    "d25_dashboard",
    f"""{SCORES}, n AS (SELECT count(*) FILTER (WHERE side = 1) AS c, count(*) FILTER (WHERE side = 0) AS b FROM sides)
    SELECT {r('data_drift_score', 'data_drift_score')}, drifted_columns_count, total_columns,
    CASE WHEN data_drift_detected = 1 THEN 'WARNING' ELSE 'OK' END AS data_drift_status, {r('concept_drift_score', 'concept_drift_score')},
    target_drift_detected, CASE WHEN concept_drift_detected = 1 THEN 'WARNING' ELSE 'OK' END AS concept_drift_status,
    c AS current_samples, b AS reference_samples, {r('c::DOUBLE / greatest(b, 1) * 100', 'coverage_percentage')} FROM st, n""",
)
def d25(spark, d):
    ref, cur = drift_sides(spark, d)
    sizes = R.two_sides(ref, cur, ["target"]).agg(
        F.sum("side").alias("n_cur"), F.sum(1 - F.col("side")).alias("n_ref")
    )
    return tidy(D.dashboard(D.one_row(state(spark, d)[0], sizes), "n_cur", "n_ref"))


@query(
    "d26_drift_statistics",
    f"""{ALERTS}, res AS (SELECT ts AS created_at, event_id, '{{"data_drift_score": ' || CAST(user_id AS VARCHAR) || '}}' AS results FROM events WHERE event_type = 'view'),
    last AS (SELECT * FROM res ORDER BY created_at DESC, event_id DESC LIMIT 1)
    SELECT CAST(json_extract_string(results, '$.data_drift_score') AS DOUBLE) AS data_drift_score, 0.0::DOUBLE AS concept_drift_score,
    {t('created_at', 'last_check')}, (SELECT count(*) FROM al WHERE created_at >= TIMESTAMP '2024-01-30' AND created_at < TIMESTAMP '2024-01-31') AS alerts_count FROM last""",
)
def d26(spark, d):
    results = table(spark, d, "events").select(
        F.when(F.col("event_type") == "view", "data_drift").otherwise("other").alias("monitoring_type"),
        F.to_json(F.struct(F.col("user_id").alias("data_drift_score"))).alias("results"),
        F.col("ts").alias("created_at"),
        "event_id",
    )
    return tidy(D.drift_statistics(results, alert_log(spark, d), AS_OF, tie=["event_id"]))


@query(
    "t7_last_rows_window",
    f"""WITH {LOG_SQL}, k AS (SELECT endpoint, model_version, request_id, row_number() OVER w AS rn, least(count(*) OVER (PARTITION BY endpoint, model_version), 200) AS n
      FROM log WINDOW w AS (PARTITION BY endpoint, model_version ORDER BY created_at DESC, request_id))
    SELECT endpoint, model_version, request_id FROM k WHERE rn <= 200 AND n >= 100""",
)
def t7(spark, d):
    log = prediction_log(spark, d).select("endpoint", "model_version", "request_id", "created_at")
    out = R.last_rows(log, ["endpoint", "model_version"], "created_at", 200, 100, tie=["request_id"])
    return out.drop("created_at")
