"""The monitoring jobs over the prediction log, each beside its whole SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import drift as R
from scorelens.operators.decisions import CRITICAL_SCORE, RETRAIN_CONCEPT_DRIFT, RETRAIN_DATA_DRIFT
from scorelens.plans import jobs
from scorelens.plans.catalog import query
from scorelens.plans.drift_queries import cat_bins, ks_sql, psi_sql
from scorelens.plans.model_queries import MONITORED, monitored_sides
from scorelens.plans.tidy import r, tidy
from scorelens.sources.readers import DEFAULT_METRICS, metric_rows
from scorelens.sources.views import AS_OF, LOG_SQL

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def _drift_rows() -> str:
    numbers = [f"SELECT '{c}' AS \"column\", {ks_sql(c)} > {R.KS_LIMIT} AS hit" for c in MONITORED.numeric]
    texts = [f"SELECT '{c}', {psi_sql(cat_bins(c))} > {R.PSI_LIMIT}" for c in MONITORED.categorical]
    return " UNION ALL ".join(numbers + texts)


#: Both sides, drift per column and over the table, and the metrics of the current side.
MEASURED = f"""WITH {LOG_SQL}, sides AS (SELECT processing_time_ms, probability, endpoint, model_version, class AS target,
    probability AS prediction, CAST(created_at >= TIMESTAMP '2024-01-21' AS INTEGER) AS side FROM log),
  cur AS (SELECT * FROM sides WHERE side = 1),
  rep AS ({_drift_rows()}),
  ds AS (SELECT count(*) AS total_columns, count(*) FILTER (WHERE hit) AS drifted_columns_count,
    count(*) FILTER (WHERE hit) / count(*)::DOUBLE AS data_drift_score FROM rep),
  g AS (SELECT prediction AS s, sum(target)::DOUBLE AS pos, sum(1 - target)::DOUBLE AS neg FROM cur
    WHERE target IS NOT NULL AND prediction IS NOT NULL GROUP BY 1),
  w AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn FROM g),
  auc AS (SELECT sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * cp / (cp + cn)) / sum(pos) AS pr_auc FROM w),
  c AS (SELECT count(*) FILTER (WHERE target = 0 AND prediction <= 0.5)::DOUBLE AS tn, count(*) FILTER (WHERE target = 0 AND prediction > 0.5)::DOUBLE AS fp,
    count(*) FILTER (WHERE target = 1 AND prediction <= 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE target = 1 AND prediction > 0.5)::DOUBLE AS tp FROM cur),
  m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, roc_auc, pr_auc FROM c, auc)"""


def _daily_report_sql() -> str:
    features = [*MONITORED.numeric, *MONITORED.categorical]
    missing = [f"count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE" for c in features]
    rows = [f"SELECT 'data_drift' AS section, '{m}' AS metric, {m}::DOUBLE AS value FROM ds" for m in ("data_drift_score", "drifted_columns_count", "total_columns")]
    rows.append(f"SELECT 'data_quality', 'missing_share', ({' + '.join(missing)}) / {len(features)} FROM cur")
    rows.append(f"SELECT 'data_quality', 'worst_column_share', greatest({', '.join(missing)}) FROM cur")
    for c in MONITORED.categorical:
        rows.append(
            f"SELECT 'data_quality', 'new_values.{c}', count(*)::DOUBLE FROM (SELECT {c} FROM cur WHERE {c} IS NOT NULL "
            f"EXCEPT SELECT {c} FROM sides WHERE side = 0)"
        )
    rows += [f"SELECT 'performance', '{x}', {x} FROM m" for x in METRICS]
    return f"{MEASURED} SELECT section, metric, {r('value', 'value')} FROM ({' UNION ALL '.join(rows)})"


@query("d27_daily_report", _daily_report_sql())
def d27(spark, d):
    ref, cur = monitored_sides(spark, d)
    return tidy(jobs.daily_report(ref, cur, MONITORED))


def _monitor_sql() -> str:
    decay = " UNION ALL ".join(
        f"SELECT '{k}' AS metric, ({v} - {k}) / {v} * 100 AS decay_percent FROM m" for k, v in DEFAULT_METRICS.items()
    )
    cells = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in MONITORED.numeric)
    tests = " UNION ALL ".join(
        [
            "SELECT 'share_of_drifted_columns' AS name, data_drift_score < 0.3 AS passed FROM ds",
            "SELECT 'number_of_drifted_columns', drifted_columns_count < 5 FROM ds",
            "SELECT 'drift:probability', NOT hit FROM rep WHERE \"column\" = 'probability'",
            f"SELECT 'share_of_missing_values', ({cells}) / (count(*) * {len(MONITORED.numeric)})::DOUBLE < 0.1 FROM cur",
            "SELECT 'min:probability', min(probability) > 0 FROM cur",
            "SELECT 'max:probability', max(probability) < 1 FROM cur",
        ]
    )
    return f"""{MEASURED}, dk AS (SELECT metric, abs(decay_percent) > {R.DECAY_PERCENT} AS fell FROM ({decay})),
    tst AS ({tests}),
    sc AS (SELECT ds.*, {psi_sql(cat_bins('target'))} AS tds, {ks_sql('prediction')} AS pds, (SELECT count(*) FROM cur) AS n_cur,
      (SELECT count(*) FROM sides WHERE side = 0) AS n_ref, (SELECT count(*) FROM dk WHERE fell) AS n_fell FROM ds),
    st AS (SELECT *, greatest(tds, pds) AS cds, data_drift_score > {R.DATA_DRIFT_LIMIT} AS moved,
      greatest(tds, pds) > {R.CONCEPT_DRIFT_LIMIT} AS turned FROM sc)
    SELECT 'completed' AS status, '2024-01-31 00:00:00' AS checked_at, {r('data_drift_score', 'data_drift_score')}, drifted_columns_count,
      total_columns, CASE WHEN moved THEN 'WARNING' ELSE 'OK' END AS data_drift_status, {r('cds', 'concept_drift_score')},
      CAST(tds > 0.2 AS INTEGER) AS target_drift_detected, CASE WHEN turned THEN 'WARNING' ELSE 'OK' END AS concept_drift_status,
      n_cur AS current_samples, n_ref AS reference_samples, {r('n_cur / greatest(n_ref, 1)::DOUBLE * 100', 'coverage_percentage')},
      (SELECT count(*) FROM tst) AS tests, (SELECT count(*) FROM tst WHERE NOT passed) AS failed,
      (SELECT coalesce(string_agg(name, '; ' ORDER BY name), '') FROM tst WHERE NOT passed) AS failed_tests,
      (SELECT CAST(bool_and(passed) AS INTEGER) FROM tst) AS all_passed,
      CAST(moved AS BIGINT) + CAST(turned AS BIGINT) + n_fell AS alerts,
      CAST(moved AND data_drift_score >= {CRITICAL_SCORE} AS BIGINT) + CAST(turned AND cds >= {CRITICAL_SCORE} AS BIGINT) + n_fell AS critical,
      concat_ws('; ', CASE WHEN moved AND data_drift_score > {RETRAIN_DATA_DRIFT} THEN 'data_drift=' || printf('%.3f', data_drift_score) END,
        CASE WHEN turned AND cds > {RETRAIN_CONCEPT_DRIFT} THEN 'concept_drift=' || printf('%.3f', cds) END,
        CASE WHEN n_fell > 0 THEN 'metric_decay' END) AS reasons,
      CAST((moved AND data_drift_score > {RETRAIN_DATA_DRIFT}) OR (turned AND cds > {RETRAIN_CONCEPT_DRIFT}) OR n_fell > 0 AS INTEGER) AS should_retrain
    FROM st"""


def monitored(spark, d, **kw):
    ref, cur = monitored_sides(spark, d)
    out = jobs.monitor(
        ref,
        cur,
        MONITORED,
        metric_rows(spark, DEFAULT_METRICS),
        AS_OF,
        important=["probability"],
        bounds={"probability": (0.0, 1.0)},
        **kw,
    )
    joined = {c: F.array_join(c, "; ") for c in ("failed_tests", "reasons")}
    return tidy(out.withColumns(joined))


@query("d28_monitor", _monitor_sql())
def d28(spark, d):
    return monitored(spark, d)


@query(
    "d28_monitor_too_few",
    f"""WITH {LOG_SQL} SELECT 'insufficient_data' AS status, '2024-01-31 00:00:00' AS checked_at,
    count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-21') AS current_samples,
    count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-21') AS reference_samples FROM log""",
)
def d28_few(spark, d):
    """Fewer rows than asked for: nothing is measured but the sizes."""
    out = monitored(spark, d, min_samples=10**9)
    return out.select("status", "checked_at", "current_samples", "reference_samples")
