"""Round trips: tables written to the shared folder by one operator and read back by another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scorelens.operators import features as E
from scorelens.operators.lookups import extra_columns
from scorelens.plans.catalog import query
from scorelens.plans.tidy import r, t, tidy
from scorelens.session import scratch_path
from scorelens.sources import readers as S
from scorelens.sources import writers as O
from scorelens.sources.views import LOG_SQL, prediction_log, table

ORDERS = "o_orderkey BIGINT, o_orderstatus STRING, o_shippriority INT"


def _orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("long"), "o_orderstatus", (F.col("o_orderkey") % 3).cast("int").alias("o_shippriority")
    )


ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 3 AS INTEGER) AS o_shippriority FROM orders"


@query("s1_read_applications", ORDERS_SQL)
def s1(spark, d):
    path = scratch_path(spark, "applications")
    _orders(spark, d).write.option("header", True).csv(path)
    return S.read_applications(spark, path, ORDERS)


@query("s2_read_delimited", ORDERS_SQL)
def s2(spark, d):
    path = scratch_path(spark, "delimited")
    _orders(spark, d).write.option("sep", " ").csv(path)
    return S.read_delimited(spark, path, ORDERS)


@query(
    "s6_append_predictions",
    f"""WITH {LOG_SQL} SELECT request_id, {t('created_at', 'created_at')}, {r('probability', 'probability')},
      strftime(created_at, '%Y-%m-%d') AS day FROM log""",
)
def s6(spark, d):
    log = prediction_log(spark, d).select("request_id", "created_at", "probability")
    path = scratch_path(spark, "predictions")
    O.append_predictions(log.filter("request_id % 2 = 0"), path)
    stored = O.append_predictions(log.filter("request_id % 2 = 1"), path)
    return tidy(stored.withColumn("day", F.col("date").cast("string")).drop("date"))


@query(
    "s8_write_splits",
    """SELECT o_orderkey, o_orderstatus,
      CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'validation' ELSE 'test' END AS split
    FROM orders""",
)
def s8(spark, d):
    place = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.col("o_shippriority") + 1)
    parts = _orders(spark, d).withColumn("split", place).drop("o_shippriority")
    return O.write_splits(parts, scratch_path(spark, "splits"))


@query(
    "s9_write_report",
    f"SELECT o_orderstatus, count(*) AS n, {r('avg(o_totalprice)', 'mean')} FROM orders GROUP BY o_orderstatus",
)
def s9(spark, d):
    report = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")
    )
    return tidy(O.write_report(report, scratch_path(spark, "report")))


@query(
    "s10_append_alerts",
    f"WITH {LOG_SQL} SELECT request_id, model_version FROM log WHERE class = 1",
)
def s10(spark, d):
    hits = prediction_log(spark, d).filter("class = 1").select("request_id", "model_version")
    path = scratch_path(spark, "alerts")
    O.append_alerts(hits.filter("request_id % 2 = 0"), path)
    return O.append_alerts(hits.filter("request_id % 2 = 1"), path)


@query("s12_snapshot_restore", ORDERS_SQL)
def s12(spark, d):
    """A table is copied, emptied and restored."""
    name = f"orders_{uuid.uuid4().hex}"
    _orders(spark, d).write.saveAsTable(name)
    O.snapshot_table(spark, name)
    spark.createDataFrame([], ORDERS).write.mode("overwrite").saveAsTable(name)
    return O.restore_table(spark, name)


@query(
    "s14_load_metrics",
    f"""SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'mean', {r('avg(o_totalprice)', 'value')} FROM orders""",
)
def s14(spark, d):
    one = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"), F.avg("o_totalprice").alias("mean"))
    path = scratch_path(spark, "metrics")
    one.select(F.to_json(F.struct("rows", "mean"))).coalesce(1).write.text(path)
    return tidy(S.load_metrics(spark, path))


@query(
    "e10_saved_preparation",
    f"""SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()', 'o_totalprice')}
    FROM orders""",
)
def e10(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    path = scratch_path(spark, "prep")
    E.FittedPrep(E.fit_numeric(orders, ["o_totalprice"])).save(spark, path)
    return tidy(E.FittedPrep.load(spark, path).transform(orders, keep=["o_orderkey"]))


@query(
    "e11_step_chain",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice / 1000 AS price FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, {r('(price - avg(price) OVER ()) / stddev_pop(price) OVER ()', 'price')} FROM x""",
)
def e11(spark, d):
    steps = [
        ("settled", lambda df: df.filter("o_orderstatus <> 'P'")),
        ("price", lambda df: df.withColumn("price", F.col("o_totalprice") / 1000)),
    ]
    orders = table(spark, d, "orders")
    fit = E.FittedPrep(E.fit_numeric(E.run_steps(orders, steps), ["price"]))
    return tidy(E.run_steps(orders, steps, fit, keep=["o_orderkey"]))


def _columns_sql(name: str) -> str:
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items())
    return f"SELECT column_name, CASE column_type {cases} ELSE column_type END AS data_type FROM (DESCRIBE {name})"


@query(
    "s13_describe_table",
    f"SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name, data_type, 1 AS is_nullable FROM ({_columns_sql('orders')})",
)
def s13(spark, d):
    return tidy(S.describe_table(table(spark, d, "orders")))


@query(
    "j3_schema_compatibility",
    """SELECT column_name, 'current' AS only_in FROM (DESCRIBE labels) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE documents))
    UNION ALL SELECT column_name, 'reference' FROM (DESCRIBE documents) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE labels))""",
)
def j3(spark, d):
    """Columns that the labels have and the documents lack, and the other way round."""
    current, reference = extra_columns(table(spark, d, "documents"), table(spark, d, "labels"))
    rows = [(c, "current") for c in sorted(current)] + [(c, "reference") for c in sorted(reference)]
    return spark.createDataFrame(rows, "column_name STRING, only_in STRING")
