"""Evaluation of given scores and comparison of versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import evaluate as M
from scorelens.operators import lookups as J
from scorelens.operators.decisions import active_versions
from scorelens.operators.explain import absolute_contributions
from scorelens.plans.catalog import query
from scorelens.plans.log_queries import BATCH_RUNS, batch_runs
from scorelens.plans.tidy import r, t, tidy
from scorelens.session import pin_small
from scorelens.sources.views import SCORED_SQL, scored_labels, table

SC = f"WITH {SCORED_SQL}"
CM = f"""{SC}, cm AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND s1 <= 0.5) AS BIGINT) AS tn,
  count(*) FILTER (WHERE label = 0 AND s1 > 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND s1 <= 0.5) AS fn,
  count(*) FILTER (WHERE label = 1 AND s1 > 0.5) AS tp FROM sc)"""


def called(spark, d):
    return scored_labels(spark, d).withColumn("called", (F.col("s1") > 0.5).cast("int"))


@query("m8_confusion_matrix", f"{CM} SELECT tn, fp, fn, tp FROM cm")
def m8(spark, d):
    return M.confusion_matrix(called(spark, d), "label", "called")


def _long_sql() -> str:
    return f"""{SC}, v AS (SELECT 'v1' AS version, label, s1 AS s FROM sc UNION ALL SELECT 'v2', label, s2 FROM sc),
  g AS (SELECT version, s, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM v GROUP BY 1, 2),
  w AS (SELECT *, sum(pos) OVER (PARTITION BY version ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY version ORDER BY s DESC) AS cn,
    sum(pos) OVER (PARTITION BY version) AS tp, sum(neg) OVER (PARTITION BY version) AS tn FROM g),
  auc AS (SELECT version, sum(neg * (cp - pos / 2)) / (max(tp) * max(tn)) AS roc_auc, sum(pos * cp / (cp + cn)) / max(tp) AS pr_auc
    FROM w GROUP BY 1),
  c AS (SELECT version, count(*) FILTER (WHERE label = 0 AND s <= 0.5)::DOUBLE AS tn, count(*) FILTER (WHERE label = 0 AND s > 0.5)::DOUBLE AS fp,
    count(*) FILTER (WHERE label = 1 AND s <= 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE label = 1 AND s > 0.5)::DOUBLE AS tp FROM v GROUP BY 1),
  m AS (SELECT version, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
    2 * tp / (2 * tp + fp + fn) AS f1, tp + tn + fp + fn AS samples FROM c)"""


LONG = _long_sql()


def versions_long(spark, d):
    both = scored_labels(spark, d)
    return both.select(
        "o_orderkey", "label", F.expr("stack(2, 'v1', s1, 'v2', s2) AS (version, score)")
    )


@query(
    "m9_roc_pr_auc", f"{LONG} SELECT version, {r('roc_auc', 'roc_auc')}, {r('pr_auc', 'pr_auc')} FROM auc"
)
def m9(spark, d):
    return tidy(M.area_metrics(versions_long(spark, d), "label", "score", ["version"]))


@query(
    "m9_roc_auc_by_ranks",
    f"""{SC}, k AS (SELECT label, rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0::DOUBLE AS rk FROM sc)
    SELECT {r('(sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE label = 1)::DOUBLE * count(*) FILTER (WHERE label = 0))', 'roc_auc')} FROM k""",
)
def m9_ranks(spark, d):
    """Same area with small slices, so that the sliced path is what runs."""
    return tidy(M.area_metrics(scored_labels(spark, d), "label", "s1", rows_per_slice=1000).select("roc_auc"))


SCORE_BORDERS = [i / 25 for i in range(1, 25)]


@query(
    "m9_areas_binned",
    f"""{LONG}, b AS (SELECT version, len(list_filter({SCORE_BORDERS}, lambda x: s >= x)) AS b, sum(label)::DOUBLE AS pos,
      sum(1 - label)::DOUBLE AS neg FROM v WHERE label IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY version) AS tp,
      sum(neg) OVER (PARTITION BY version) AS tn FROM b WINDOW w AS (PARTITION BY version ORDER BY b DESC)),
    e AS (SELECT *, cp / (cp + cn) AS used, coalesce(cp / nullif(cp + cn - neg, 0), 1) AS most, coalesce((cp - pos) / nullif(cp - pos + cn, 0), 0) AS least
      FROM k)
    SELECT version, {r('sum(neg * (cp - pos / 2)) / max(tp * tn)', 'roc_auc')}, {r('sum(pos * neg / 2) / max(tp * tn)', 'roc_auc_error')},
    {r('sum(pos * used) / max(tp)', 'pr_auc')}, {r('sum(pos * greatest(most - used, used - least)) / max(tp)', 'pr_auc_error')} FROM e GROUP BY version""",
)
def m9_binned(spark, d):
    """Areas over counted bins of scores, with bounds of their errors."""
    return tidy(M.binned_areas(versions_long(spark, d), "label", "score", ["version"], borders=SCORE_BORDERS))


@query(
    "m10_classification_metrics",
    f"""{LONG} SELECT version, {r('accuracy', 'accuracy')}, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')},
    CAST(samples AS BIGINT) AS samples FROM m""",
)
def m10(spark, d):
    scored = versions_long(spark, d).withColumn("called", (F.col("score") > 0.5).cast("int"))
    return tidy(M.classification_metrics(M.confusion_matrix(scored, "label", "called", ["version"]), ["version"]))


@query(
    "m11_classification_report",
    f"""{CM}, k AS (SELECT '0' AS class, tn::DOUBLE AS hit, (tn + fn)::DOUBLE AS called, (tn + fp)::DOUBLE AS support FROM cm
      UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM cm),
    p AS (SELECT class, hit / called AS precision, hit / support AS recall, 2 * hit / (called + support) AS f1, support FROM k)
    SELECT class, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM p
    UNION ALL SELECT 'macro avg', {r('avg(precision)', 'precision')}, {r('avg(recall)', 'recall')}, {r('avg(f1)', 'f1')}, CAST(sum(support) AS BIGINT) FROM p
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM p""",
)
def m11(spark, d):
    return tidy(M.classification_report(called(spark, d), "label", "called"))


@query(
    "a22_score_agreement",
    f"""{SC} SELECT {r('avg(abs(s1 - s2))', 'mae')}, {r('max(abs(s1 - s2))', 'max_abs_diff')}, {r('avg((s1 - s2) * (s1 - s2))', 'mse')},
    CAST(avg(abs(s1 - s2)) < 0.0001 AS INTEGER) AS agrees FROM sc""",
)
def a22(spark, d):
    return tidy(M.score_agreement(scored_labels(spark, d), "s1", "s2"))


@query(
    "j1_metric_comparison",
    f"""{LONG}, l AS (SELECT version, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, precision, recall, f1]) AS value FROM m)
    SELECT a.metric, {r('a.value', 'reference')}, {r('b.value', 'current')} FROM l a JOIN l b ON a.metric = b.metric
    WHERE a.version = 'v1' AND b.version = 'v2' AND a.metric <> 'precision'""",
)
def j1(spark, d):
    ref, cur = version_metrics(spark, d)
    return tidy(J.metric_comparison(ref, cur.filter("metric IN ('accuracy', 'recall', 'f1')")))


def version_metrics(spark, d):
    """Metric rows of both versions, from one evaluation."""
    wide = M.evaluation(versions_long(spark, d), "label", "score", ["version"])
    long = M.metrics_long(pin_small(wide), ["version"])
    return tuple(long.filter(F.col("version") == v).select("metric", "value") for v in ("v1", "v2"))


@query(
    "j2_versus_baseline",
    f"""{BATCH_RUNS}, s AS (SELECT model, max(throughput_rps) AS t, min(avg_latency_ms) AS l FROM runs GROUP BY 1),
    b AS (SELECT * FROM s WHERE model = 'click')
    SELECT s.model, {r('s.t', 'best_throughput_rps')}, {r('s.l', 'best_latency_ms')}, {r('s.t / greatest(b.t, 1)', 'throughput_vs_baseline')},
    {r('b.l / greatest(s.l, 1)', 'latency_vs_baseline')} FROM s, b""",
)
def j2(spark, d):
    from scorelens.operators.ranking import best_batch_size

    best = best_batch_size(batch_runs(spark, d))
    return tidy(J.versus_baseline(best, "model", "click", "best_throughput_rps", "best_latency_ms"))


@query(
    "j5_champion_challenger_join",
    f"""{LONG} SELECT m.version, {r('accuracy', 'accuracy')}, {r('f1', 'f1')}, {r('roc_auc', 'roc_auc')} FROM m JOIN auc ON m.version = auc.version""",
)
def j5(spark, d):
    both = scored_labels(spark, d)
    pairs = J.version_pairs(
        both.select("o_orderkey", F.col("s1").alias("score")),
        both.select("o_orderkey", F.col("s2").alias("score")),
        table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 250000).cast("int").alias("label")),
        "o_orderkey",
        "score",
        "label",
    )
    long = pairs.select(
        "label", F.expr("stack(2, 'v1', champion_score, 'v2', challenger_score) AS (version, score)")
    )
    out = M.evaluation(long, "label", "score", ["version"])
    return tidy(out.select("version", "accuracy", "f1", "roc_auc"))


@query(
    "m16_champion_challenger",
    f"""{LONG}, x AS (SELECT (SELECT accuracy FROM m WHERE version = 'v2') - (SELECT accuracy FROM m WHERE version = 'v1') AS a,
      (SELECT roc_auc FROM auc WHERE version = 'v2') - (SELECT roc_auc FROM auc WHERE version = 'v1') AS u,
      (SELECT f1 FROM m WHERE version = 'v2') - (SELECT f1 FROM m WHERE version = 'v1') AS f)
    SELECT CAST(3 AS BIGINT) AS compared_metrics, {r('a', 'accuracy_diff')}, {r('u', 'roc_auc_diff')}, {r('f', 'f1_diff')},
    CAST(greatest(a, u, f) > 0.01 AS INTEGER) AS is_better, CAST(greatest(a, u, f) >= 0.01 AS INTEGER) AS deploy FROM x""",
)
def m16(spark, d):
    return tidy(M.champion_challenger(*version_metrics(spark, d)))


@query(
    "m15_row_explanation",
    """WITH i AS (SELECT *, row_number() OVER () AS rid FROM lineitem),
    f AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
      unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM i)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, abs(v) AS importance,
      CAST(row_number() OVER (PARTITION BY rid ORDER BY abs(v) DESC, feature) AS INTEGER) AS position
    FROM f QUALIFY row_number() OVER (PARTITION BY rid ORDER BY abs(v) DESC, feature) <= 2""",
)
def m15(spark, d):
    items = table(spark, d, "lineitem")
    return absolute_contributions(
        items,
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        2,
        keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )


@query(
    "m18_active_version",
    f"""WITH e AS (SELECT user_id % 20 AS model, 'v' || CAST(event_id % 7 AS VARCHAR) AS version, ts, event_id,
      CASE WHEN event_type = 'click' THEN 'activate' WHEN event_type = 'view' THEN 'delete' ELSE 'create' END AS action FROM events),
    act AS (SELECT model, arg_max(version, ts) AS active FROM e WHERE action = 'activate' GROUP BY 1),
    vers AS (SELECT model, version, max(ts) FILTER (WHERE action = 'create') AS created_at,
      arg_max(action, ts) FILTER (WHERE action IN ('create', 'delete')) AS last_action FROM e GROUP BY 1, 2)
    SELECT vers.model, version, {t('created_at', 'created_at')}, CAST(coalesce(version = active, false) AS INTEGER) AS is_active,
    CAST(coalesce(version <> active, true) AS INTEGER) AS may_delete FROM vers LEFT JOIN act ON vers.model = act.model
    WHERE created_at IS NOT NULL AND (last_action = 'create' OR coalesce(version = active, false))""",
)
def m18(spark, d):
    kind = F.when(F.col("event_type") == "click", "activate").when(F.col("event_type") == "view", "delete")
    events = table(spark, d, "events").select(
        (F.col("user_id") % 20).alias("model"),
        F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")).alias("version"),
        F.col("ts").alias("at"),
        kind.otherwise("create").alias("action"),
    )
    return tidy(active_versions(events))
