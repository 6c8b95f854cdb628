"""Projections, feature preparation, splits and set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelens.functions import columns as C
from scorelens.operators import features as E
from scorelens.operators import lookups as J
from scorelens.operators import rows as P
from scorelens.operators import sets as U
from scorelens.operators import split as X
from scorelens.operators.predlog import flatten_features
from scorelens.operators.quality import per_column
from scorelens.plans.catalog import query
from scorelens.plans.tidy import r, t, tidy
from scorelens.roles import Roles
from scorelens.session import cut_lineage
from scorelens.sources.readers import dataset_metadata
from scorelens.sources.views import (
    APPLICATIONS_SQL,
    LOG_SQL,
    SPARSE_SQL,
    applications,
    prediction_log,
    sparse_orders,
    table,
)

SO = f"WITH {SPARSE_SQL}"
LOG = f"WITH {LOG_SQL}"

# ---- projections -------------------------------------------------------------------------------


@query(
    "p1_recode",
    "SELECT doc_id, CASE quality WHEN 0 THEN 'poor' END AS quality, CASE toxic WHEN 0 THEN 1 WHEN 1 THEN 0 END AS clean FROM labels",
)
def p1(spark, d):
    return table(spark, d, "labels").select(
        "doc_id",
        C.recode("quality", {0: "poor"}).alias("quality"),
        C.recode("toxic", {0: 1, 1: 0}).alias("clean"),
    )


@query("p2_rename_drop", "SELECT c_custkey AS customer_id, c_nationkey, c_mktsegment AS segment FROM customer")
def p2(spark, d):
    c = table(spark, d, "customer")
    renamed = c.withColumnsRenamed({"c_custkey": "customer_id", "c_mktsegment": "segment"})
    return renamed.drop("c_acctbal", "c_name")


@query("p3_select_existing", "SELECT p_size, p_retailprice, p_brand FROM part")
def p3(spark, d):
    roles = Roles(numeric=("p_size", "p_retailprice", "p_weight"), categorical=("p_brand", "p_colour"))
    out, _missing = P.select_existing(table(spark, d, "part"), roles)
    return out


@query(
    "p4_ratio_features",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0) AS debt_to_income_ratio,
    l_extendedprice / nullif(l_quantity, 0) AS monthly_payment FROM lineitem""",
)
def p4(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_extendedprice").alias("credit_amount"),
        F.col("l_discount").alias("income"),
        F.col("l_quantity").alias("loan_duration"),
    )
    return P.ratio_features(items).drop("credit_amount", "income", "loan_duration")


@query(
    "p5_bin_right",
    """SELECT p_partkey, CASE WHEN p_size > 5 AND p_size <= 15 THEN 'small' WHEN p_size > 15 AND p_size <= 30 THEN 'medium'
    WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS band FROM part""",
)
def p5(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", C.bin_right("p_size", [5, 15, 30, 50], ["small", "medium", "large"]).alias("band")
    )


SQL_FEATURES = {
    "net": "l_extendedprice * (1 - l_discount)",
    "size_class": "CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'small' WHEN l_quantity BETWEEN 11 AND 30 THEN 'middle' ELSE 'bulk' END",
}


@query(
    "p6_sql_features",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {SQL_FEATURES['net']} AS net, {SQL_FEATURES['size_class']} AS size_class
    FROM lineitem""",
)
def p6(spark, d):
    out = P.sql_features(table(spark, d, "lineitem"), SQL_FEATURES)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "net", "size_class")


@query(
    "p7_purpose_indicators",
    """SELECT event_id, CAST(event_type = 'click' AS DOUBLE) AS event_type_click, CAST(event_type = 'view' AS DOUBLE) AS event_type_view,
    CAST(event_type = 'error' AS DOUBLE) AS event_type_error FROM events""",
)
def p7(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return P.purpose_indicators(e, "event_type", ["click", "view", "error"]).drop("event_type")


@query(
    "p8_order_features",
    f"""{SO} SELECT o_orderkey, coalesce(totalprice, -1) AS totalprice, -1.0::DOUBLE AS absent,
    coalesce(CAST(cust_mod AS DOUBLE), -1) AS cust_mod FROM so""",
)
def p8(spark, d):
    return P.order_features(
        sparse_orders(spark, d), ["totalprice", "absent", "cust_mod"], default=-1.0, keep=["o_orderkey"]
    )


@query(
    "p9_range_flags",
    f"""{SO}, f AS (SELECT o_orderkey, totalprice < 20000 OR totalprice > 400000 AS a, cust_mod < 2 OR cust_mod > 5 AS b FROM so)
    SELECT o_orderkey, CAST(coalesce(a, false) AS INT) + CAST(coalesce(b, false) AS INT) AS n_errors,
    concat_ws('; ', CASE WHEN a THEN 'totalprice out of range [20000, 400000]' END, CASE WHEN b THEN 'cust_mod out of range [2, 5]' END) AS errors FROM f""",
)
def p9(spark, d):
    flags = P.range_flags({"totalprice": (20000, 400000), "cust_mod": (2, 5)})
    return _errors(sparse_orders(spark, d), flags)


def _errors(df, flags):
    out = P.with_errors(df, flags)
    return out.select(
        "o_orderkey", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors")
    )


@query(
    "p10_allowed_value_flags",
    f"""{SO}, f AS (SELECT o_orderkey, priority NOT IN ('1-URGENT', '2-HIGH') AS a, NOT regexp_matches(o_orderstatus, '^[FO]$') AS b FROM so)
    SELECT o_orderkey, CAST(coalesce(a, false) AS INT) + CAST(coalesce(b, false) AS INT) AS n_errors,
    concat_ws('; ', CASE WHEN a THEN 'priority has a value outside its list' END, CASE WHEN b THEN 'o_orderstatus does not match ^[FO]$' END) AS errors FROM f""",
)
def p10(spark, d):
    flags = P.allowed_flags({"priority": ["1-URGENT", "2-HIGH"]}) + P.pattern_flags({"o_orderstatus": "^[FO]$"})
    return _errors(sparse_orders(spark, d), flags)


@query(
    "p11_required_flags",
    f"""{SO} SELECT o_orderkey, CAST(priority IS NULL AS INT) + CAST(totalprice IS NULL AS INT) AS n_errors,
    concat_ws('; ', CASE WHEN priority IS NULL THEN 'priority is missing' END, CASE WHEN totalprice IS NULL THEN 'totalprice is missing' END) AS errors FROM so""",
)
def p11(spark, d):
    return _errors(sparse_orders(spark, d), P.required_flags(["priority", "totalprice"]))


@query(
    "p12_type_flags",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN substring(o_orderpriority, 1, 1)
      WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS raw FROM orders)
    SELECT o_orderkey, CAST(raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL AS INTEGER) AS n_errors,
    CASE WHEN raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL THEN 'raw must be a number' ELSE '' END AS errors FROM x""",
)
def p12(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.substring("o_orderpriority", 1, 1)).when(k % 7 != 0, F.col("o_orderpriority"))
    return _errors(table(spark, d, "orders").withColumn("raw", raw), P.type_flags(["raw"]))


@query(
    "p13_split_valid_invalid",
    f"""{SO}, f AS (SELECT *, totalprice IS NULL OR priority IS NULL AS bad FROM so)
    SELECT 'valid' AS part, count(*) AS rows, {r('sum(totalprice)', 'total', 2)} FROM f WHERE NOT bad
    UNION ALL SELECT 'invalid', count(*), {r('sum(totalprice)', 'total', 2)} FROM f WHERE bad
    UNION ALL SELECT 'zero_filled', count(*), {r('sum(CASE WHEN bad THEN 0.0 ELSE totalprice END)', 'total', 2)} FROM f""",
)
def p13(spark, d):
    checked = P.with_errors(sparse_orders(spark, d), P.required_flags(["totalprice", "priority"]))
    valid, invalid = P.split_valid_invalid(checked)
    filled = P.zero_fill_invalid(checked, ["totalprice"])

    def line(name, df):
        return df.agg(
            F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.sum("totalprice").alias("total")
        )

    return tidy(line("valid", valid).union(line("invalid", invalid)).union(line("zero_filled", filled)), 2)


# ---- scalar functions --------------------------------------------------------------------------


@query(
    "f1_json_extract",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS probability,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS class FROM events""",
)
def f1(spark, d):
    from scorelens.operators.predlog import extract_result

    result = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").cast("double").alias("probability"),
            (F.get_json_object("props", "$.k").cast("int") % 2).alias("class"),
        )
    )
    log = table(spark, d, "events").select("event_id", result.alias("prediction_result"))
    return extract_result(log).select("event_id", "probability", "class")


@query(
    "f2_json_flatten",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 0.5
    ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS prediction, count(*) AS n FROM events GROUP BY 1, 2""",
)
def f2(spark, d):
    props = F.get_json_object("props", "$.k").cast("double")
    result = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(props.alias("probability")))).otherwise("{}")
    log = table(spark, d, "events").select("props", result.alias("prediction_result"))
    flat = flatten_features(log, "props", "k BIGINT")
    return flat.groupBy("k", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f3_date_trunc",
    f"""SELECT event_id, {t("date_trunc('hour', ts)", 'hour')}, {t("date_trunc('day', ts)", 'day')}, {t("date_trunc('week', ts)", 'week')} FROM events""",
)
def f3(spark, d):
    return tidy(
        table(spark, d, "events").select(
            "event_id", *[F.date_trunc(u, "ts").alias(u) for u in ("hour", "day", "week")]
        )
    )


@query("f4_extract_hour", "SELECT event_id, CAST(extract(hour FROM ts) AS INTEGER) AS hour FROM events")
def f4(spark, d):
    return table(spark, d, "events").select("event_id", F.hour("ts").alias("hour"))


@query(
    "f5_elapsed_days",
    """SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2001-12-31') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days,
    CAST(epoch(TIMESTAMP '2001-12-31') - epoch(o_orderdate) >= 86400 AS INTEGER) AS due FROM orders""",
)
def f5(spark, d):
    days = C.days_since("o_orderdate", F.lit(datetime(2001, 12, 31)))
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), (days >= 1).cast("int").alias("due"))


@query(
    "f6_timestamp_text",
    """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""",
)
def f6(spark, d):
    return table(spark, d, "events").select(
        "event_id", C.stamp("ts", compact=True).alias("compact"), C.stamp("ts").alias("iso")
    )


@query("f7_prefix_key", "SELECT page_id, substring(html, 1, 100) AS query_key FROM pages")
def f7(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring("html", 1, 100).alias("query_key"))


@query(
    "f8_hash_bucket",
    "SELECT DISTINCT source, CAST(CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 1000 AS INTEGER) AS bucket FROM documents",
)
def f8(spark, d):
    """Stable bucket in 0..999 per category."""
    docs = table(spark, d, "documents").select("source").distinct()
    return docs.select("source", C.hash_bucket("source").alias("bucket"))


@query(
    "f9_score_text",
    f"{LOG} SELECT request_id, printf('%.2f', probability) AS score, 'Score: ' || printf('%.2f', probability) AS message FROM log",
)
def f9(spark, d):
    text = C.score_text("probability", 2)
    return prediction_log(spark, d).select(
        "request_id", text.alias("score"), F.concat(F.lit("Score: "), text).alias("message")
    )


@query(
    "f10_rounding",
    """SELECT o_orderkey, CAST(floor(o_totalprice * 0.8) AS BIGINT) AS floored, abs(o_custkey - 500) AS distance,
    greatest(o_custkey, 500) AS at_least FROM orders""",
)
def f10(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.floor(F.col("o_totalprice") * 0.8).alias("floored"),
        F.abs(F.col("o_custkey") - 500).alias("distance"),
        F.greatest(F.col("o_custkey"), F.lit(500).cast("long")).alias("at_least"),
    )


@query("f11_row_ids", "SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS row_id, count(*) AS n FROM lineitem GROUP BY 1")
def f11(spark, d):
    ids = table(spark, d, "lineitem").select(C.row_ids("l_orderkey", "l_linenumber").alias("row_id"))
    return ids.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))


@query("f12_default_fill", f"{SO} SELECT o_orderkey, coalesce(totalprice, 0.5) AS totalprice FROM so")
def f12(spark, d):
    return sparse_orders(spark, d).select("o_orderkey", C.fill_default("totalprice", 0.5).alias("totalprice"))


@query("f13_regex_match", "SELECT p_partkey, CAST(regexp_matches(p_brand, '^Brand#[0-9]$') AS INTEGER) AS one_digit FROM part")
def f13(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").rlike("^Brand#[0-9]$").cast("int").alias("one_digit")
    )


@query(
    "f14_risk_level",
    f"{LOG} SELECT request_id, CASE WHEN probability < 0.3 THEN 'low' WHEN probability < 0.6 THEN 'medium' ELSE 'high' END AS risk FROM log",
)
def f14(spark, d):
    return prediction_log(spark, d).select("request_id", C.risk_level("probability").alias("risk"))


@query("f15_guarded_ratio", "SELECT c_custkey, c_acctbal / greatest(c_nationkey, 1) AS per_nation FROM customer")
def f15(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", C.guarded_ratio("c_acctbal", "c_nationkey").alias("per_nation"))


# ---- fit and transform -------------------------------------------------------------------------

NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "e1_standardise",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(r(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)", c) for c in NUM)
    + " FROM lineitem",
)
def e1(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *NUM)
    return tidy(E.standardise(items, NUM))


@query(
    "e2_inverse_standardise",
    "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(r(c, c, 4) for c in NUM) + " FROM lineitem",
)
def e2(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *NUM)
    fit = E.FittedPrep(E.fit_numeric(items, NUM, medians=False))
    return tidy(E.inverse_standardise(E.standardise(items, NUM, fit), fit, NUM), 4)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "e3_one_hot",
    "SELECT c_custkey, "
    + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS c_mktsegment_{s}" for s in SEGMENTS[1:])
    + " FROM customer",
)
def e3(spark, d):
    return E.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query(
    "e3_one_hot_wide",
    "SELECT c_custkey, "
    + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS c_mktsegment_{s}" for s in SEGMENTS[1:])
    + " FROM customer",
)
def e3_wide(spark, d):
    """The sparse form, forced by a limit below the number of levels, opened up into columns."""
    out = E.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], max_levels=3)
    opened = vector_to_array("c_mktsegment_onehot")
    return out.select("c_custkey", *[opened[i].alias(f"c_mktsegment_{s}") for i, s in enumerate(SEGMENTS[1:])])


@query(
    "e4_label_encode",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders",
)
def e4(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.label_encode(orders, "o_orderpriority", output="code").drop("o_orderpriority")


@query(
    "e4_label_encode_wide",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code FROM customer",
)
def e4_wide(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    codes = E.level_codes(customers, "c_name", max_rows=100)
    return E.label_encode(customers, "c_name", codes, output="code").drop("c_name")


@query(
    "e5_impute",
    f"""{SO} SELECT o_orderkey, {r('coalesce(totalprice, (SELECT quantile_cont(totalprice, 0.5) FROM so))', 'totalprice')},
    coalesce(priority, (SELECT priority FROM so WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM so""",
)
def e5(spark, d):
    so = sparse_orders(spark, d).select("o_orderkey", "totalprice", "priority")
    return tidy(E.impute(so, Roles(numeric=("totalprice",), categorical=("priority",))))


@query(
    "e6_zscore_outliers",
    f"""SELECT event_id, CAST(abs((abs(value) - (SELECT avg(abs(value)) FROM events)) / (SELECT stddev_pop(abs(value)) FROM events)) > 3 AS INTEGER) AS ms_outlier
    FROM events""",
)
def e6(spark, d):
    e = table(spark, d, "events").select("event_id", F.abs("value").alias("ms"))
    return E.zscore_outliers(e, ["ms"]).drop("ms")


@query(
    "e6_zscore_clip",
    f"""WITH s AS (SELECT avg(abs(value)) AS m, stddev_pop(abs(value)) AS sd FROM events)
    SELECT event_id, {r('least(abs(value), m + 3 * sd)', 'ms', 4)} FROM events, s""",
)
def e6_clip(spark, d):
    e = table(spark, d, "events").select("event_id", F.abs("value").alias("ms"))
    return tidy(E.zscore_outliers(e, ["ms"], mode="clip"), 4)


def _quota_sql(src: str, key: str, y: str, test: float, val: float | None) -> str:
    """Class quotas by largest remainder, then rank by the portable key."""
    step = f"""k AS (SELECT {key} AS id, {y} AS y, ({key} * 2654435761) % 4294967296 AS rk FROM {src}),
    c AS (SELECT y, count(*) AS n FROM k GROUP BY y),
    q AS (SELECT y, n, ceil(sum(n) OVER () * {test}) * n / sum(n) OVER () AS x, ceil(sum(n) OVER () * {test}) AS tot FROM c),
    a AS (SELECT y, n, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, CAST(y AS VARCHAR)) <= tot - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS t FROM q),
    """
    if val is None:
        return step + "z AS (SELECT y, t, t AS v FROM a)"
    return (
        step
        + f"""q2 AS (SELECT y, t, n - t AS m, ceil(sum(n - t) OVER () * {val}) * (n - t) / sum(n - t) OVER () AS x, ceil(sum(n - t) OVER () * {val}) AS tot FROM a),
    z AS (SELECT y, t, t + floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, CAST(y AS VARCHAR)) <= tot - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS v FROM q2)"""
    )


def _rank():
    return (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)


@query(
    "e8_stratified_split",
    f"""WITH {_quota_sql('orders', 'o_orderkey', 'o_orderstatus', 0.2, None)}
    SELECT id AS o_orderkey, k.y AS o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY k.y ORDER BY rk, id) <= t THEN 'test' ELSE 'train' END AS split
    FROM k JOIN z ON k.y = z.y""",
)
def e8(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return X.stratified_split(orders, "o_orderstatus", "o_orderkey", rank=_rank(), rank_bits=32)


@query(
    "e9_three_way_split",
    f"""WITH {_quota_sql('orders', 'o_orderkey', 'o_orderstatus', 0.2, 0.25)},
    x AS (SELECT id, k.y, t, v, row_number() OVER (PARTITION BY k.y ORDER BY rk, id) AS rn FROM k JOIN z ON k.y = z.y)
    SELECT id AS o_orderkey, y AS o_orderstatus, CASE WHEN rn <= t THEN 'test' WHEN rn <= v THEN 'validation' ELSE 'train' END AS split FROM x""",
)
def e9(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return X.train_val_test(orders, "o_orderstatus", "o_orderkey", 0.2, 0.25, rank=_rank(), rank_bits=32)


@query(
    "s11_dataset_metadata",
    f"""WITH {_quota_sql('orders', 'o_orderkey', "CAST(o_orderstatus = 'F' AS INTEGER)", 0.2, None)},
    x AS (SELECT k.y, CASE WHEN row_number() OVER (PARTITION BY k.y ORDER BY rk, id) <= t THEN 'test' ELSE 'train' END AS split
      FROM k JOIN z ON k.y = z.y)
    SELECT split, count(*) AS samples, 2 AS features, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative, {r('avg(y)', 'ratio')} FROM x GROUP BY split""",
)
def s11(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("target")
    )
    parts = X.stratified_split(orders, "target", "o_orderkey", rank=_rank(), rank_bits=32)
    return tidy(dataset_metadata(parts, "target"))


APP_ROLES = Roles(
    numeric=("quantity", "extendedprice", "totalprice", "acctbal"),
    categorical=("linestatus", "orderpriority", "mktsegment"),
)


def _feature_sums() -> str:
    num = [
        f"SELECT '{c}' AS feature, count(*) AS rows, round(sum(abs(({c} - m) / s)), 2) AS total FROM apps, "
        f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM apps) GROUP BY ALL"
        for c in APP_ROLES.numeric
    ]
    cat = [
        f"SELECT '{c}_' || {c} AS feature, (SELECT count(*) FROM apps) AS rows, count(*)::DOUBLE AS total FROM apps "
        f"WHERE {c} <> (SELECT min({c}) FROM apps) GROUP BY {c}"
        for c in APP_ROLES.categorical
    ]
    return " UNION ALL ".join(num + cat)


@query("e7_prepared_applications", f"WITH {APPLICATIONS_SQL} {_feature_sums()}")
def e7(spark, d):
    """Fit and transform the joined application table; the sum of absolute values per feature name."""
    # The fit reads the joined table several times, so the join is done once and written.
    apps = cut_lineage(applications(spark, d).select(*APP_ROLES.features))
    fit = E.fit_prep(apps, APP_ROLES)
    names = fit.feature_names()
    prepared = fit.transform(apps)
    sums = per_column(
        prepared, names, {"total": lambda c: F.sum(F.abs(F.col(c)))}, [("rows", F.count(F.lit(1)))]
    )
    return sums.select(F.col("column").alias("feature"), "rows", F.round("total", 2).alias("total"))


@query("e7_prepared_wide", f"WITH {APPLICATIONS_SQL} {_feature_sums()}")
def e7_wide(spark, d):
    """As above with every text column beyond the limit: sums over the elements of the assembled vectors."""
    apps = cut_lineage(applications(spark, d).select(*APP_ROLES.features))
    fit = E.fit_prep(apps, APP_ROLES, max_levels=1)
    vectors = fit.vectors(apps)
    n = vectors.count()
    elements = vectors.select(F.posexplode(vector_to_array("features")).alias("position", "value"))
    sums = elements.groupBy("position").agg(F.round(F.sum(F.abs("value")), 2).alias("total"))
    return sums.join(fit.named_positions(spark), "position").select("feature", F.lit(n).alias("rows"), "total")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _requests_sql() -> str:
    """Median, mode and scale of the fit, the checks, and zeros for rows that fail one."""

    def scaled(c: str) -> str:
        fit = f"(SELECT quantile_cont({c}, 0.5) FROM so)", f"(SELECT avg({c}) FROM so)", f"(SELECT stddev_pop({c}) FROM so)"
        return f"CASE WHEN errors = '' THEN (coalesce({c}, {fit[0]}) - {fit[1]}) / {fit[2]} ELSE 0 END"

    mode = "(SELECT priority FROM so WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)"
    levels = ", ".join(
        f"CASE WHEN errors = '' AND coalesce(priority, {mode}) = '{p}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"priority_{p}\""
        for p in PRIORITIES[1:]
    )
    bucket = "CAST('0x' || substr(md5(o_orderstatus), 1, 8) AS BIGINT) % 1000"
    return f"""{SO}, f AS (SELECT *, concat_ws('; ', CASE WHEN priority IS NULL THEN 'priority is missing' END,
        CASE WHEN totalprice < 20000 OR totalprice > 400000 THEN 'totalprice out of range [20000, 400000]' END) AS errors FROM so)
    SELECT o_orderkey, errors, {r(scaled('totalprice'), 'totalprice')}, {r(scaled('cust_mod'), 'cust_mod')}, {levels},
    CASE WHEN errors = '' THEN {bucket} ELSE 0 END::DOUBLE AS o_orderstatus_bucket FROM f"""


def _requests(spark, d, max_levels: int):
    so = sparse_orders(spark, d)
    fit = E.fit_prep(so, Roles(numeric=("totalprice", "cust_mod"), categorical=("priority",)), max_levels)
    out = E.transform_requests(
        so,
        fit,
        "o_orderkey",
        ranges={"totalprice": (20000, 400000)},
        required=["priority"],
        unfitted=["o_orderstatus"],
    )
    return out.withColumn("errors", F.concat_ws("; ", "errors"))


@query("e12_transform_requests", _requests_sql())
def e12(spark, d):
    """Fit on orders, transform a batch with broken rows and a column that the fit does not know."""
    return tidy(_requests(spark, d, 10_000))


@query("e12_transform_requests_wide", _requests_sql())
def e12_wide(spark, d):
    """The same with the text column beyond the limit of levels."""
    out = _requests(spark, d, 2)
    opened = vector_to_array("priority_onehot")
    levels = [opened[i].alias(f"priority_{p}") for i, p in enumerate(PRIORITIES[1:])]
    return tidy(out.select("o_orderkey", "errors", "totalprice", "cust_mod", *levels, "o_orderstatus_bucket"))


@query(
    "e8_split_many_classes",
    f"""WITH {_quota_sql('orders', 'o_orderkey', "CAST(o_custkey % 97 AS VARCHAR)", 0.2, 0.25)},
    x AS (SELECT id, k.y, t, v, row_number() OVER (PARTITION BY k.y ORDER BY rk, id) AS rn FROM k JOIN z ON k.y = z.y)
    SELECT id AS o_orderkey, y AS class, CASE WHEN rn <= t THEN 'test' WHEN rn <= v THEN 'validation' ELSE 'train' END AS split FROM x""",
)
def e8_many(spark, d):
    """More classes than are shared out on the driver."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).cast("string").alias("class"))
    return X.train_val_test(orders, "class", "o_orderkey", 0.2, 0.25, rank=_rank(), rank_bits=32, few_classes=10)


@query(
    "u1_append_new_data",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
    UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def u1(spark, d):
    o = table(spark, d, "orders")
    cut = C.moment(o, "o_orderdate", datetime(1998, 1, 1))
    old = o.filter(F.col("o_orderdate") < cut).select("o_orderkey", "o_totalprice", "o_orderpriority")
    new = o.filter(F.col("o_orderdate") >= cut).select("o_totalprice", "o_orderkey")
    return U.append_new(old, new)


@query(
    "u2_set_difference",
    "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
)
def u2(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey"))
    return U.only_in_current(c, o, "custkey")


@query("u3_distinct_values", f"{SO} SELECT DISTINCT priority FROM so WHERE priority IS NOT NULL")
def u3(spark, d):
    return U.distinct_values(sparse_orders(spark, d), "priority")


@query(
    "j4_unseen_values",
    """SELECT l_partkey AS value, count(*) AS count FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01' AND l_partkey NOT IN
    (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') GROUP BY 1""",
)
def j4(spark, d):
    items = table(spark, d, "lineitem")
    ref = items.filter(F.col("l_shipdate") < C.moment(items, "l_shipdate", datetime(1996, 1, 1)))
    cur = items.filter(F.col("l_shipdate") >= C.moment(items, "l_shipdate", datetime(1998, 7, 1)))
    return J.unseen_values(ref, cur, "l_partkey")
