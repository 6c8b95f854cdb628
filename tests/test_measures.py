"""Quantiles, running totals, evaluation, drift, rules and decisions on small tables."""

import math
import random
import re
from datetime import datetime
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.functions import tails
from scorelens.functions.binned import sketched_borders, with_bins
from scorelens.functions.quantiles import grouped_quantiles
from scorelens.functions.running import running_totals
from scorelens.functions.tails import _chi2_tail
from scorelens.operators import decisions as D
from scorelens.operators import drift as R
from scorelens.operators import evaluate as M
from scorelens.operators import predlog as A
from scorelens.operators import ranking as W
from scorelens.operators import slo as L
from scorelens.plans import jobs
from scorelens.plans.model_queries import MONITORED
from scorelens.sources.readers import DEFAULT_METRICS, metric_rows

PROBS = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "hi": 1.0}


def numbers(seed, n):
    rng = random.Random(seed)
    # A third of the rows share one value; the others are heavy-tailed.
    return [7.0 if i % 3 == 0 else round(rng.paretovariate(0.8), 3) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_refined_quantiles_equal_numpy(spark, seed):
    groups = {"a": numbers(seed, 6000), "b": numbers(seed + 10, 900), None: numbers(seed + 20, 4000), "c": [1.5]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(6)
    out = grouped_quantiles(df, ["k"], "v", PROBS, exact_below=1000, accuracy=100)
    got = {r.k: [r[p] for p in PROBS] for r in out.collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, list(PROBS.values())).tolist(), rel=1e-12)


def test_quantiles_without_keys(spark):
    vs = numbers(5, 5000)
    df = spark.createDataFrame([(v,) for v in vs], "v DOUBLE")
    row = grouped_quantiles(df, [], "v", {"m": 0.5, "p": 0.95}, exact_below=100, accuracy=50).first()
    assert [row.m, row.p] == pytest.approx(np.quantile(vs, [0.5, 0.95]).tolist())


def test_running_totals_in_slices(spark):
    df = spark.range(1, 101).select((F.col("id") % 2).alias("k"), "id", (F.col("id") / 10).cast("int").alias("s"))
    plain = running_totals(df, ["k"], ["id"], ["id"]).select("k", "id", "cum_id", "tot_id")
    sliced = running_totals(df, ["k"], ["id"], ["id"], slice_col="s").select("k", "id", "cum_id", "tot_id")
    assert plain.exceptAll(sliced).count() == 0 and sliced.count() == 100


def test_auc_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(400)]
    df = spark.createDataFrame(rows, "y INT, s DOUBLE")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    for size in (10**6, 40):
        row = M.area_metrics(df, "y", "s", rows_per_slice=size).first()
        assert row.roc_auc == pytest.approx(want)
    flipped = df.withColumn("s", 1 - F.col("s"))
    assert M.area_metrics(flipped, "y", "s").first().roc_auc == pytest.approx(1 - want)


def test_metrics_without_positive_calls(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y INT, p INT")
    row = M.classification_metrics(M.confusion_matrix(df, "y", "p")).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def test_challenger_without_champion(spark):
    none = metric_rows(spark, DEFAULT_METRICS).limit(0)
    row = M.champion_challenger(none, metric_rows(spark, DEFAULT_METRICS)).first()
    assert row.is_better and row.deploy
    better = metric_rows(spark, {"accuracy": 0.9, "f1": 0.7})
    assert M.champion_challenger(metric_rows(spark, {"accuracy": 0.88, "f1": 0.8}), better).first().is_better
    assert not M.champion_challenger(metric_rows(spark, {"accuracy": 0.895, "f1": 0.8}), better).first().deploy


def test_identical_tables_do_not_drift(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 4).cast("string").alias("c"))
    report = R.column_drift_report(df, df, ["x"], ["c"]).collect()
    assert all(r.drift_score == pytest.approx(0) and not r.drift_detected and r.p_value > 0.99 for r in report)


def test_shift_is_found(spark):
    ref = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c"))
    cur = ref.select((F.col("x") + 30).alias("x"), F.when(F.col("x") < 90, "0").otherwise("9").alias("c"))
    rows = {r.column: r for r in R.column_drift_report(ref, cur, ["x"], ["c"]).collect()}
    assert rows["x"].statistic == pytest.approx(0.3) and rows["x"].p_value < 1e-6
    assert rows["c"].drift_detected and rows["c"].p_value < 1e-6
    verdict = R.dataset_drift(R.column_drift_report(ref, cur, ["x"], ["c"])).first()
    assert verdict.data_drift_score == 1.0 and verdict.drifted_columns == ["c", "x"]


def test_chi2_tail_values():
    # Known quantiles of the chi-square distribution.
    assert _chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert _chi2_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-8)
    assert _chi2_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
    assert _chi2_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)


def test_proportion_z(spark):
    ref = spark.range(100).select((F.col("id") < 30).cast("int").alias("y"))
    cur = spark.range(200).select((F.col("id") < 90).cast("int").alias("y"))
    row = R.proportion_drift(ref, cur, "y").first()
    p = 120 / 300
    z = (0.45 - 0.30) / math.sqrt(p * (1 - p) * (1 / 100 + 1 / 200))
    assert row.z == pytest.approx(z) and row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_prediction_drift_is_zero_without_the_column(spark):
    assert R.prediction_drift(spark.range(3), spark.range(3)).first()[0] == 0.0


def test_decay_of_a_zero_reference(spark):
    pairs = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.8, 0.6)], "metric STRING, reference DOUBLE, current DOUBLE")
    rows = {r.metric: r for r in R.performance_decay(pairs).collect()}
    assert rows["a"].decay_percent == 0 and rows["b"].decay_percent == pytest.approx(25)


def test_fixed_alert_levels(spark):
    state = spark.createDataFrame(
        [(True, 0.9, ["x"], True, 0.25)],
        "data_drift_detected BOOLEAN, data_drift_score DOUBLE, drifted_columns ARRAY<STRING>, concept_drift_detected BOOLEAN, concept_drift_score DOUBLE",
    )
    none = spark.createDataFrame([], "metric STRING, reference DOUBLE, current DOUBLE, decay_percent DOUBLE, significant_decay BOOLEAN")
    now = datetime(2024, 1, 1)
    assert {r.type: r.level for r in D.drift_alerts(state, none, now).collect()} == {"DATA_DRIFT": "CRITICAL", "CONCEPT_DRIFT": "WARNING"}
    fixed = {r.type: r.level for r in D.drift_alerts(state, none, now, fixed_levels=True).collect()}
    assert fixed == {"DATA_DRIFT": "WARNING", "CONCEPT_DRIFT": "CRITICAL"}


def test_weekly_schedule_never_fires(spark):
    state = spark.createDataFrame([(0.0, False)], "data_drift_score DOUBLE, decayed BOOLEAN")
    now = datetime(2024, 1, 10)
    row = D.retrain_triggers(spark.range(10), state, now, None, schedule="weekly").first()
    assert not row.should_retrain
    assert D.retrain_triggers(spark.range(1000), state, now, now, schedule="weekly").first().new_data
    assert D.retrain_triggers(spark.range(10), state, now, None).first().scheduled


def test_monitor_stops_on_few_rows(spark):
    row = (1.0, 0.5, "e", "v", 0, 0.5)
    schema = "processing_time_ms DOUBLE, probability DOUBLE, endpoint STRING, model_version STRING, class INT, prediction DOUBLE"
    df = spark.createDataFrame([row] * 5, schema)
    out = jobs.monitor(df, df, MONITORED, metric_rows(spark, DEFAULT_METRICS), datetime(2024, 1, 1)).first()
    assert out.status == "insufficient_data" and out.current_samples == 5


def test_trailing_counts_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.randint(0, 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "id INT, k STRING, sec INT").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.id: (r.w60, r.w10) for r in W.trailing_counts(df, ["k"], "ts", [60, 10], ["w60", "w10"]).collect()}
    for i, k, s in rows:
        want = tuple(sum(k2 == k and s - w < s2 <= s for _, k2, s2 in rows) - 1 for w in (60, 10))
        assert got[i] == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trailing_windows_are_running_totals(spark):
    """A frame with a moving lower end is summed anew for every row: the square of a window's rows."""
    rows = [(i, "a", s) for i, s in enumerate((0, 0, 5, 9, 10, 19, 20, 59, 60, 69, 119, 120, 121, 400))]
    df = spark.createDataFrame(rows, "id INT, k STRING, sec INT").withColumn("ts", F.timestamp_seconds("sec"))
    counts = W.trailing_counts(df, ["k"], "ts", [60, 10], ["w60", "w10"])
    rates = W.load_levels(df, "ts", 60, 60)
    for out in (counts, rates):
        assert "RangeFrame" in plan_of(out) and not re.search(r"RangeFrame, -\d", plan_of(out))
    got = {r.us // 1_000_000: (r.requests, round(r.rps * 60)) for r in rates.collect()}
    secs = [s for *_, s in rows]
    assert got == {s: (secs.count(s), sum(s - 60 < x <= s for x in secs)) for s in set(secs)}
    for r in counts.collect():
        assert (r.w60, r.w10) == tuple(sum(r.sec - w < x <= r.sec for x in secs) - 1 for w in (60, 10))


def test_load_bands(spark):
    df = spark.createDataFrame([(9.9,), (10.0,), (99.0,), (100.0,)], "rps DOUBLE")
    level, factor = W.load_bands(F.col("rps"))
    assert [tuple(r) for r in df.select(level, factor).collect()] == [
        ("low", 1.5),
        ("normal", 1.0),
        ("high", 0.5),
        ("critical", 0.2),
    ]


def test_held_needs_an_unbroken_run(spark):
    rows = [(s, s not in (4, 9)) for s in range(12) if s != 6]
    df = spark.createDataFrame(rows, "step INT, bad BOOLEAN").withColumn("k", F.lit("x"))
    out = {r.step: r.firing for r in L.held(df, ["k"], "step", "bad", 2).collect()}
    assert [s for s, f in sorted(out.items()) if f] == [2, 3]


def test_status_precedence(spark):
    rows = [("a", "healthy"), ("a", "error"), ("a", "warning"), ("b", "healthy"), ("c", "healthy"), ("c", "odd")]
    df = spark.createDataFrame(rows, "k STRING, status STRING")
    got = {r.k: r.overall_status for r in A.status_rollup(df, keys=["k"]).collect()}
    assert got == {"a": "warning", "b": "healthy", "c": "unknown"}


def test_extracted_result(spark):
    df = spark.createDataFrame([(1, '{"probability": 0.7, "class": 1}'), (2, "{}")], "id INT, prediction_result STRING")
    rows = A.extract_result(df).orderBy("id").collect()
    assert (rows[0].probability, rows[0]["class"], rows[1].probability) == (0.7, 1, None)


def test_unknown_interval_means_hour(spark):
    at = datetime(2024, 1, 1, 5, 30)
    df = spark.createDataFrame([(at, 1.0, 0)], "created_at TIMESTAMP, processing_time_ms DOUBLE, class INT")
    row = A.performance_by_interval(df, datetime(2024, 1, 2), "5m").first()
    assert row.time_interval == datetime(2024, 1, 1, 5) and row.good_rate == 100.0


def test_monitoring_summary_collects_reasons(spark):
    score = spark.createDataFrame([(0.6,)], "s DOUBLE")
    data, concept = D.alert_flags(score, "s", 0.3, 0.5), D.alert_flags(score, "s", 0.7, 0.8)
    row = D.monitoring_summary(data, concept, spark.createDataFrame([(2,)], "failed BIGINT")).first()
    assert row.should_alert and row.should_retrain and not row.concept_drift_detected
    assert row.reasons == ["data drift", "strong data drift", "failed tests: 2"]


def test_alerts_append(spark):
    from scorelens.session import scratch_path
    from scorelens.sources.writers import append_alerts

    alerts = spark.createDataFrame([("WARNING", "DATA_DRIFT")], "level STRING, type STRING")
    path = scratch_path(spark, "alerts")
    append_alerts(alerts, path)
    assert append_alerts(alerts, path).count() == 2


def poisson_tail(half, shape):
    """Q(shape, half) for a whole shape: a Poisson sum, in decimals."""
    with localcontext() as context:
        context.prec = 60
        term = total = Decimal(1)
        for i in range(1, shape):
            term *= Decimal(half) / i
            total += term
        return float(total * Decimal(-half).exp())


@pytest.mark.parametrize("df", [2, 4, 10, 100, 1_000, 19_998, 20_000, 20_002, 40_000])
def test_chi_square_tail_at_even_degrees_is_the_poisson_sum(df):
    for z in (-6, -2, -0.5, -0.001, 0, 0.001, 0.5, 2, 6):
        x = max(0.01, df + z * math.sqrt(2 * df))
        assert _chi2_tail(x, df) == pytest.approx(poisson_tail(x / 2, df // 2), abs=1e-9)


def test_chi_square_tail_at_odd_degrees_follows_its_recurrence():
    """Q(a + 1, x) = Q(a, x) + x^a e^-x / Gamma(a + 1), from Q(1/2, x) = erfc(sqrt(x))."""
    for x in (0.1, 1.0, 7.5, 40.0, 300.0):
        value, shape = math.erfc(math.sqrt(x)), 0.5
        for df in range(1, 600, 2):
            assert _chi2_tail(2 * x, df) == pytest.approx(value, abs=1e-10)
            value += math.exp(shape * math.log(x) - x - math.lgamma(shape + 1))
            shape += 1


def test_chi_square_tail_takes_no_longer_for_any_degree():
    assert 0.49 < _chi2_tail(3e12, 3_000_000_000_000) < 0.51
    assert _chi2_tail(0.0, 5) == 1.0 == _chi2_tail(3.0, 0) and _chi2_tail(1e6, 5) == 0.0
    # Both forms agree where one takes over from the other.
    for z in (-3, -1, 0, 1, 3):
        x = tails.LARGE_SHAPE + z * math.sqrt(tails.LARGE_SHAPE)
        assert tails._uniform_tail(tails.LARGE_SHAPE, x) == pytest.approx(tails.upper_gamma(tails.LARGE_SHAPE - 1e-9, x), abs=1e-8)


@pytest.fixture(scope="module")
def skewed_sides(spark):
    """Continuous values and one that a third of the rows share; nulls, NaN, and a column that is empty on one side."""
    v = "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 101 = 1 THEN NULL WHEN id % 103 = 1 THEN double('NaN') ELSE {} END AS v"
    base = spark.range(20_000)
    ref = base.selectExpr("id", v.format("exp(3 * rand(1))"), "cast(null AS DOUBLE) AS gone", "rand(5) AS u")
    cur = base.selectExpr("id", v.format("exp(3 * rand(2)) + 0.4"), "1.0D AS gone", "rand(6) AS u")
    return ref, cur


@pytest.mark.parametrize("bins", [2, 10, 200, 5_000])
def test_binned_distance_is_within_its_error(skewed_sides, bins):
    exact = {r.column: r.statistic for r in R.ks_drift(*skewed_sides, ["v", "u", "gone"]).collect()}
    rough = {r.column: r for r in R.ks_drift(*skewed_sides, ["v", "u", "gone"], approximate=bins).collect()}
    assert set(exact) == set(rough) == {"v", "u"}
    for c, row in rough.items():
        assert exact[c] - row.error - 1e-12 <= row.statistic <= exact[c] + 1e-12
    if bins >= 200:  # without frequent values the error is about one bin
        assert rough["u"].error < 3 / bins + 1e-3


def test_approximate_form_reaches_reports_and_scores(skewed_sides):
    ref, cur = (x.withColumn("prediction", F.col("u")).withColumn("t", (F.col("id") % 2).cast("int")) for x in skewed_sides)
    exact = R.prediction_drift(ref, cur).first()[0]
    assert abs(R.prediction_drift(ref, cur, approximate=500).first()[0] - exact) < 0.01
    report = {r.column: r for r in R.column_drift_report(ref, cur, ["u"], ["t"], approximate=500).collect()}
    assert report["u"].test_name == "ks" and report["t"].statistic == 0.0
    concept = R.concept_drift(R.target_drift(ref, cur, "t"), R.prediction_drift(ref, cur, approximate=500)).first()
    assert abs(concept.concept_drift_score - exact) < 0.01


@pytest.mark.parametrize("bins", [2, 20, 1_000])
def test_binned_areas_are_within_their_errors(spark, bins):
    df = spark.range(6_000).selectExpr(
        "id % 2 AS k", "CAST(rand(3) < 0.3 AS INT) AS y", "CASE WHEN id % 5 = 0 THEN 0.5D ELSE rand(4) END AS s"
    ).withColumn("s", F.when(F.col("y") == 1, F.least(F.lit(1.0), F.col("s") + 0.1)).otherwise(F.col("s")))
    exact = {r.k: r for r in M.area_metrics(df, "y", "s", ["k"]).collect()}
    for row in M.area_metrics(df, "y", "s", ["k"], approximate=bins).collect():
        assert abs(row.roc_auc - exact[row.k].roc_auc) <= row.roc_auc_error + 1e-12
        assert abs(row.pr_auc - exact[row.k].pr_auc) <= row.pr_auc_error + 1e-12
    if bins == 1_000:
        assert row.roc_auc_error < 0.05


def test_approximate_distribution_is_part_of_the_exact_one(spark):
    df = spark.range(5_000).selectExpr("id % 3 AS k", "CASE WHEN id % 4 = 0 THEN 0.25D ELSE rand(9) END AS v")
    exact = {(r.k, r.value): r.cdf for r in W.empirical_cdf(df, ["k"], "v").collect()}
    rough = W.empirical_cdf(df, ["k"], "v", approximate=50).collect()
    assert 100 < len(rough) <= 150 and all(exact[r.k, r.value] == r.cdf for r in rough)
    assert {r.k for r in rough if r.cdf == 1.0} == {0, 1, 2} and sum(r.n for r in rough) == 5_000
    assert W.empirical_cdf(df.limit(0), ["k"], "v", approximate=50).collect() == []


def test_bins_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 2), (3.0, 3), (3.0, 4)], "v DOUBLE, i INT")
    assert sketched_borders(df, ["v", "i"], 4) == {"v": [3.0], "i": [1.0, 2.0, 3.0]}
    got = with_bins(df, {"v": [3.0], "i": []}).collect()
    assert [(r.v_bin, r.i_bin) for r in got] == [(None, 0), (None, 0), (1, 0), (1, 0)]
    assert sketched_borders(df.limit(0), ["v"], 4) == {"v": []}


def test_monitor_columns_are_the_same_with_too_few_rows(spark):
    df = spark.range(300).selectExpr(
        "id % 7 * 1.0D AS processing_time_ms", "id % 10 / 10.0D AS probability", "'a' AS endpoint", "'v' AS model_version",
        "CAST(id % 3 = 0 AS INT) AS class", "id % 10 / 10.0D AS prediction",
    )
    full = jobs.monitor(df, df, MONITORED, metric_rows(spark, DEFAULT_METRICS), datetime(2024, 1, 1))
    few = jobs.monitor(df, df.limit(5), MONITORED, metric_rows(spark, DEFAULT_METRICS), datetime(2024, 1, 1))
    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    assert kinds == {f.name: f.dataType.simpleString() for f in few.schema} == jobs.MONITOR_COLUMNS
    assert few.first().asDict() | {"status": None} == dict.fromkeys(kinds) | {
        "checked_at": datetime(2024, 1, 1), "current_samples": 5, "reference_samples": 300
    }


def test_slices_follow_the_count(spark):
    from scorelens.functions.running import value_bounds

    df = spark.range(6000).selectExpr("cast(id * 0.5 AS DOUBLE) AS v")
    assert len(value_bounds(df, "v", rows_per_slice=10)) > 500
    assert value_bounds(df, "v") == []


def test_metrics_and_reports_without_columns_are_empty(spark):
    df = spark.createDataFrame([(1.0, "a")], "x DOUBLE, c STRING")
    assert R.custom_metrics(df, df, [{"type": "unknown", "column_name": "x"}]).collect() == []
    assert R.column_drift_report(df, df, [], []).collect() == []
    assert R.psi_drift(df, df).collect() == []


def test_one_row_tables_with_a_common_name_raise(spark):
    one = spark.sql("SELECT 1 AS a")
    with pytest.raises(ValueError):
        D.one_row(one, one)
