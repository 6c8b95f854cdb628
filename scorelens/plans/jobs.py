"""Batch jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.operators import decisions as D
from scorelens.operators import drift as R
from scorelens.operators import evaluate as M
from scorelens.operators.lookups import metric_comparison, unseen_values
from scorelens.roles import Roles
from scorelens.session import cut_lineage, pin_small


def state_of(
    reference: DataFrame, current: DataFrame, roles: Roles, reference_metrics: DataFrame, score: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row of drift state, the column report and the decay rows; all small and computed once."""
    report = pin_small(R.column_drift_report(reference, current, roles.numeric, roles.categorical))
    target = R.target_drift(reference, current, roles.target)
    concept = R.concept_drift(target, R.prediction_drift(reference, current, score))
    metrics = M.metrics_long(M.evaluation(current, roles.target, score))
    decay = pin_small(R.performance_decay(metric_comparison(reference_metrics, metrics)))
    state = D.one_row(R.dataset_drift(report), concept, D.decay_flag(decay))
    return pin_small(state), report, decay


#: Columns of ``monitor`` and their types, which are the same whether or not anything was measured.
MONITOR_COLUMNS = {
    "status": "string",
    "checked_at": "timestamp",
    "data_drift_score": "double",
    "drifted_columns_count": "bigint",
    "total_columns": "bigint",
    "data_drift_status": "string",
    "concept_drift_score": "double",
    "target_drift_detected": "boolean",
    "concept_drift_status": "string",
    "current_samples": "bigint",
    "reference_samples": "bigint",
    "coverage_percentage": "double",
    "tests": "bigint",
    "failed": "bigint",
    "failed_tests": "array<string>",
    "all_passed": "boolean",
    "alerts": "bigint",
    "critical": "bigint",
    "reasons": "array<string>",
    "should_retrain": "boolean",
}


def monitor(
    reference: DataFrame,
    current: DataFrame,
    roles: Roles,
    reference_metrics: DataFrame,
    as_of: datetime,
    score: str = "prediction",
    min_samples: int = 100,
    important: Sequence[str] = (),
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Drift, tests, alerts, dashboard row and decision for the current table, as one row.

    With fewer than ``min_samples`` rows the status says so and what was not measured is NULL.
    """
    sizes = R.two_sides(reference, current, [roles.target]).agg(
        F.coalesce(F.sum("side"), F.lit(0)).alias("current_samples"),
        F.coalesce(F.sum(1 - F.col("side")), F.lit(0)).alias("reference_samples"),
    )
    sizes = pin_small(sizes)
    if sizes.first()["current_samples"] < min_samples:
        return _not_measured(sizes, as_of)
    state, report, decay = state_of(reference, current, roles, reference_metrics, score)
    tests = R.test_verdict(R.drift_tests(report, current, roles.numeric, important=important, bounds=bounds))
    alerts = D.drift_alerts(state, decay, as_of).agg(
        F.count(F.lit(1)).alias("alerts"), F.sum((F.col("level") == "CRITICAL").cast("long")).alias("critical")
    )
    board = D.dashboard(D.one_row(state, sizes), "current_samples", "reference_samples")
    decision = D.retrain_decision(state).select("reasons", "should_retrain")
    out = D.one_row(board, tests, alerts, decision)
    return out.select(F.lit("completed").alias("status"), F.lit(as_of).alias("checked_at"), "*")


def _not_measured(sizes: DataFrame, as_of: datetime) -> DataFrame:
    known = {"status": F.lit("insufficient_data"), "checked_at": F.lit(as_of)} | {c: F.col(c) for c in sizes.columns}
    return sizes.select(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in MONITOR_COLUMNS.items()])


def daily_report(
    reference: DataFrame, current: DataFrame, roles: Roles, score: str = "prediction"
) -> DataFrame:
    """Drift, missing share, new category values and, where labels exist, metrics: ``(section, metric, value)``."""
    current = cut_lineage(current)

    def section(name: str, one: DataFrame, cols: Sequence[str]) -> DataFrame:
        wide = one.select(*[F.col(c).cast("double").alias(c) for c in cols])
        return wide.unpivot([], list(cols), "metric", "value").select(F.lit(name).alias("section"), "metric", "value")

    drift = R.dataset_drift(R.column_drift_report(reference, current, roles.numeric, roles.categorical))
    out = section("data_drift", drift, ["data_drift_score", "drifted_columns_count", "total_columns"])
    missing = R.missing_share(current, roles.features)
    out = out.unionByName(section("data_quality", missing, ["missing_share", "worst_column_share"]))
    for c in roles.categorical:
        fresh = unseen_values(reference, current, c).agg(F.count(F.lit(1)).alias(f"new_values.{c}"))
        one = fresh.select(F.col(f"`new_values.{c}`").alias("n"))
        out = out.unionByName(
            one.select(
                F.lit("data_quality").alias("section"),
                F.lit(f"new_values.{c}").alias("metric"),
                F.col("n").cast("double").alias("value"),
            )
        )
    if roles.target in current.columns:
        point = M.evaluation(current, roles.target, score)
        out = out.unionByName(
            section("performance", point, ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"])
        )
    return out
