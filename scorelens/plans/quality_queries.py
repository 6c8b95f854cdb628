"""Data validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import quality as Q
from scorelens.plans.catalog import query
from scorelens.plans.tidy import r, tidy
from scorelens.sources.views import SPARSE_SQL, sparse_orders, table

SO = f"WITH {SPARSE_SQL}"
SO_COLS = ["o_orderkey", "cust_mod", "totalprice", "priority", "o_orderstatus", "target", "fixed"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
RANGES = {"totalprice": (10_000, 400_000), "cust_mod": (0, 6), "o_orderkey": (0, 10**15)}


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query(
    "a8_null_profile",
    f"{SO} "
    + _union(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
            f"{r(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 'missing_percent')} FROM so"
            for c in SO_COLS
        ]
    ),
)
def a8(spark, d):
    return tidy(Q.null_profile(sparse_orders(spark, d)))


@query(
    "a8_null_totals",
    f"{SO}, p AS ("
    + _union(
        [
            f"SELECT count(*) - count({c}) AS m, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS pct FROM so"
            for c in SO_COLS
        ]
    )
    + f""") SELECT CAST(sum(m) AS BIGINT) AS total_missing, {r('max(pct)', 'max_missing_percent')},
    CAST(sum(CASE WHEN pct > 0 THEN 1 ELSE 0 END) AS BIGINT) AS columns_with_missing FROM p""",
)
def a8_totals(spark, d):
    return tidy(Q.null_totals(Q.null_profile(sparse_orders(spark, d))))


def _range_sql(c: str, lo: float, hi: float) -> str:
    bad = f"sum(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END)"
    return f"""SELECT '{c}' AS "column", {lo}::DOUBLE AS min_allowed, {hi}::DOUBLE AS max_allowed,
    {r(f'min({c})::DOUBLE', 'actual_min')}, {r(f'max({c})::DOUBLE', 'actual_max')},
    CAST({bad} AS BIGINT) AS violations_count, {r(f'{bad} * 100.0::DOUBLE / count(*)', 'violation_percent')},
    CASE WHEN {bad} * 100.0 / count(*) > 5 THEN 'error' ELSE 'warning' END AS severity
    FROM so HAVING {bad} > 0"""


@query("a9_range_violations", f"{SO} " + _union([_range_sql(c, *v) for c, v in RANGES.items()]))
def a9(spark, d):
    return tidy(Q.range_violations(sparse_orders(spark, d), RANGES))


@query(
    "a9_range_examples",
    f"""{SO}, h AS (SELECT 'totalprice' AS "column", totalprice::DOUBLE AS value, o_orderkey FROM so
      WHERE totalprice < 10000 OR totalprice > 400000
      UNION ALL SELECT 'cust_mod', cust_mod::DOUBLE, o_orderkey FROM so WHERE cust_mod < 0 OR cust_mod > 4)
    SELECT "column", value, o_orderkey,
    CAST(row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey, value) AS INTEGER) AS example
    FROM h QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey, value) <= 5""",
)
def a9_examples(spark, d):
    return Q.range_examples(
        sparse_orders(spark, d), {"totalprice": (10_000, 400_000), "cust_mod": (0, 4)}, ["o_orderkey"]
    )


IN_P = ", ".join(f"'{p}'" for p in PRIORITIES)


@query(
    "a10_category_violations",
    f"""{SO}, i AS (SELECT 'priority' AS "column", priority AS value FROM so WHERE priority NOT IN ({IN_P})
      UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM so WHERE o_orderstatus NOT IN ('F', 'O'))
    SELECT "column", count(DISTINCT value) AS invalid_values, count(*) AS invalid_count,
    {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM so)', 'invalid_percent')},
    CASE WHEN count(*) * 100.0 / (SELECT count(*) FROM so) > 1 THEN 'error' ELSE 'warning' END AS severity
    FROM i GROUP BY "column" """,
)
def a10(spark, d):
    allowed = {"priority": PRIORITIES, "o_orderstatus": ["F", "O"]}
    return tidy(Q.category_violations(sparse_orders(spark, d), allowed))


@query(
    "a11_target_checks",
    f"""{SO}, c AS (SELECT target, count(*) AS n FROM so GROUP BY 1)
    SELECT CAST(coalesce(sum(n) FILTER (WHERE target IS NULL OR target NOT IN (0, 1)), 0) AS BIGINT) AS invalid_target,
    CAST(coalesce(sum(n) FILTER (WHERE target IS NULL), 0) AS BIGINT) AS missing_target,
    count(target) AS classes, {r('''CASE WHEN count(target) = 2 THEN (max(n) FILTER (WHERE target IS NOT NULL)
      - min(n) FILTER (WHERE target IS NOT NULL)) * 100.0::DOUBLE / sum(n) FILTER (WHERE target IS NOT NULL) END''', 'class_imbalance')},
    CAST((max(n) FILTER (WHERE target IS NOT NULL) - min(n) FILTER (WHERE target IS NOT NULL)) * 100.0
      / sum(n) FILTER (WHERE target IS NOT NULL) > 40 AS INTEGER) AS imbalanced FROM c""",
)
def a11(spark, d):
    return tidy(Q.target_checks(sparse_orders(spark, d), "target"))


@query(
    "a12_duplicate_rows",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag, count(*) AS n FROM lineitem
      GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
    {r('(sum(n) - count(*)) * 100.0::DOUBLE / sum(n)', 'duplicate_percent')} FROM s""",
)
def a12(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, 'N')").alias("flag")
    )
    return tidy(Q.duplicate_rows(items))


@query(
    "a13_constant_columns",
    f"{SO} "
    + _union(
        [f"SELECT '{c}' AS \"column\" FROM so HAVING count(DISTINCT {c}) <= 1" for c in SO_COLS]
    ),
)
def a13(spark, d):
    return Q.constant_columns(sparse_orders(spark, d))


OUT_COLS = ["quantity", "extendedprice", "value"]


def _iqr_sql(src: str, c: str) -> str:
    return f"""SELECT * FROM (WITH f AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}),
      l AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)
    SELECT '{c}' AS "column", CAST(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS BIGINT) AS count,
    {r(f'sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*)', 'percent')},
    {r('max(lo)', 'lower_bound')}, {r('max(hi)', 'upper_bound')},
    CAST(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) * 100.0 / count(*) > 5 AS INTEGER) AS warn
    FROM {src}, l HAVING sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) > 0)"""


@query(
    "a14_iqr_outliers",
    "WITH src AS (SELECT abs(value) AS v, value * value AS v2, user_id::DOUBLE AS u FROM events) "
    + _union([_iqr_sql("src", c) for c in ("v", "v2", "u")]),
)
def a14(spark, d):
    e = table(spark, d, "events").select(
        F.abs("value").alias("v"),
        (F.col("value") * F.col("value")).alias("v2"),
        F.col("user_id").cast("double").alias("u"),
    )
    return tidy(Q.iqr_outliers(e, ["v", "v2", "u"]))


@query(
    "a15_structure_checks",
    f"{SO} SELECT CAST(count(*) >= 100 AS INTEGER) AS min_samples, 1 AS has_target_column, 1 AS has_features FROM so",
)
def a15(spark, d):
    return tidy(Q.structure_checks(sparse_orders(spark, d), "target", 100))


@query(
    "a16_validation_summary",
    f"""{SO}, m AS ("""
    + _union([f"SELECT (count(*) - count({c})) * 100.0 / count(*) AS pct FROM so" for c in SO_COLS])
    + f"""), one AS (SELECT (SELECT count(*) FROM so) AS n, (SELECT max(pct) FROM m) AS worst,
      (SELECT count(*) FROM m WHERE pct > 0 AND pct <= 5) AS miss_warn, (SELECT count(*) FROM m WHERE pct > 5) AS miss_err,
      (SELECT count(*) - count(target) FROM so) AS no_target,
      (SELECT count(*) FROM (SELECT 1 FROM so GROUP BY ALL HAVING count(*) > 1)) AS dup),
    f AS (SELECT *, CAST(n >= 100 AS INT) + 2 + CAST(worst <= 5 AS INT) + 1 + CAST(no_target = 0 AS INT) AS ok,
      miss_err + 2 * CAST(no_target > 0 AS INT)
        + (SELECT CAST(count(*) FILTER (WHERE totalprice < 10000 OR totalprice > 400000) * 100.0 / count(*) > 5 AS INT) FROM so)
        + (SELECT CAST(count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) * 100.0 / count(*) > 1 AS INT) FROM so) AS err FROM one)
    SELECT CAST(6 AS BIGINT) AS total_checks, CAST(ok AS BIGINT) AS passed_checks, {r('ok * 100.0::DOUBLE / 6', 'validation_score')},
    CAST(err AS BIGINT) AS error_count, CAST(miss_warn + CAST(n < 100 AS INT) + 1
      + (SELECT CAST(count(*) FILTER (WHERE totalprice < 10000 OR totalprice > 400000) * 100.0 / count(*) BETWEEN 1e-9 AND 5 AS INT) FROM so)
      AS BIGINT) AS warning_count,
    CAST(err = 0 AS INT) AS is_valid, CASE WHEN err = 0 THEN 'PASS' ELSE 'FAIL' END AS overall_status FROM f""",
)
def a16(spark, d):
    checks = Q.validate(
        sparse_orders(spark, d),
        "target",
        numeric=["totalprice"],
        ranges={"totalprice": (10_000, 400_000)},
        allowed={"o_orderstatus": ["F", "O"]},
    )
    return tidy(Q.validation_summary(checks))


@query(
    "d24_training_gate",
    f"""{SO}, c AS (SELECT target, count(*) AS n FROM so WHERE target IS NOT NULL GROUP BY 1), m AS ("""
    + _union([f"SELECT (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS pct FROM so" for c in SO_COLS])
    + f""") SELECT (SELECT count(*) FROM so) AS rows, {r('(SELECT min(n)::DOUBLE / max(n) FROM c)', 'class_ratio')},
    {r('(SELECT max(pct) FROM m)', 'max_missing_percent')}, CAST((SELECT count(*) FROM so) >= 1000 AS INTEGER) AS enough_rows,
    CAST((SELECT min(n)::DOUBLE / max(n) FROM c) >= 0.3 AS INTEGER) AS balanced,
    CAST((SELECT max(pct) FROM m) <= 5 AS INTEGER) AS complete,
    CAST((SELECT count(*) FROM so) >= 1000 AS INTEGER) AS may_train""",
)
def d24(spark, d):
    return tidy(Q.training_gate(sparse_orders(spark, d), "target", min_samples=1000))
