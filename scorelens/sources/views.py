"""The library's tables as views of the given test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for the event table, whose last day is 2024-01-30.
AS_OF = datetime(2024, 1, 31)

#: Line items shipped before this day are the reference side, the others the current side.
CUT = datetime(1998, 7, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    """Works on a batch and on a stream of ``events``."""
    props = F.from_json("props", "k DOUBLE")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"),
        F.abs("value").alias("processing_time_ms"),
        (props["k"] / 100).alias("probability"),
        (F.col("event_type") == "error").cast("int").alias("class"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"),
    )


LOG_SQL = """log AS (
  SELECT event_id AS request_id, ts AS created_at, user_id AS client, event_type AS endpoint,
         abs(value) AS processing_time_ms,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS probability,
         CAST(event_type = 'error' AS INTEGER) AS class,
         'v' || CAST(user_id % 3 AS VARCHAR) AS model_version
  FROM events)"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order and customer. The target says whether the item was returned."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .select(
            "l_orderkey",
            "l_partkey",
            "l_linenumber",
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("extendedprice"),
            F.col("l_discount").alias("discount"),
            F.col("o_totalprice").alias("totalprice"),
            F.col("c_acctbal").alias("acctbal"),
            F.col("l_linestatus").alias("linestatus"),
            F.col("o_orderpriority").alias("orderpriority"),
            F.col("c_mktsegment").alias("mktsegment"),
            F.col("l_shipdate").alias("shipdate"),
            (F.col("l_returnflag") == "R").cast("int").alias("target"),
        )
    )


APPLICATIONS_SQL = """apps AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS extendedprice,
         l_discount AS discount, o_totalprice AS totalprice, c_acctbal AS acctbal,
         l_linestatus AS linestatus, o_orderpriority AS orderpriority, c_mktsegment AS mktsegment,
         l_shipdate AS shipdate, CAST(l_returnflag = 'R' AS INTEGER) AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with NULLs put in by rule, for the operators that look for them."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.expr("nullif(o_custkey % 7, 0)").alias("cust_mod"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("totalprice"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("priority"),
        "o_orderstatus",
        F.when(
            F.col("o_orderkey") % 17 != 0, (F.col("o_orderstatus") == "F").cast("int")
        ).alias("target"),
        F.lit(1).alias("fixed"),
    )


SPARSE_SQL = """so AS (
  SELECT o_orderkey, nullif(o_custkey % 7, 0) AS cust_mod,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS totalprice,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS priority,
         o_orderstatus,
         CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderstatus = 'F' AS INTEGER) END AS target,
         1 AS fixed
  FROM orders)"""


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and current line items, cut at a ship date; the cut reaches the scan."""
    cols = [
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        (F.col("l_extendedprice") / 120000).alias("prediction"),
    ]
    items = table(spark, sf_dir, "lineitem")
    cut = F.lit(CUT).cast(items.schema["l_shipdate"].dataType)
    return (
        items.filter(F.col("l_shipdate") < cut).select(*cols),
        items.filter(F.col("l_shipdate") >= cut).select(*cols),
    )


SIDES_SQL = """sides AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 0 ELSE 1 END AS side,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount,
         l_returnflag AS returnflag, l_linestatus AS linestatus,
         CAST(l_returnflag = 'R' AS INTEGER) AS target, l_extendedprice / 120000 AS prediction
  FROM lineitem)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label and the scores of two versions, all derived from order columns."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        (F.col("o_totalprice") > 250000).cast("int").alias("label"),
        ((F.floor(F.col("o_totalprice") / 1000) + F.col("o_orderkey") * 37 % 400) % 1000 / 1000).alias("s1"),
        ((F.floor(F.col("o_totalprice") / 500) + F.col("o_orderkey") * 91 % 300) % 1000 / 1000).alias("s2"),
    )


SCORED_SQL = """sc AS (
  SELECT o_orderkey, CAST(o_totalprice > 250000 AS INTEGER) AS label,
         (CAST(floor(o_totalprice / 1000) AS BIGINT) + o_orderkey * 37 % 400) % 1000 / 1000.0::DOUBLE AS s1,
         (CAST(floor(o_totalprice / 500) AS BIGINT) + o_orderkey * 91 % 300) % 1000 / 1000.0::DOUBLE AS s2
  FROM orders)"""
