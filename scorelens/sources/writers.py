"""Writers. Each returns the table it wrote, read back from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_predictions(scored: DataFrame, path: str, ts: str = "created_at") -> DataFrame:
    """Append to the log, partitioned by day so that time filters prune folders.

    The rebalance hint gathers a day's rows into few large files, and adaptive execution splits a day
    that is too large for one writer.
    """
    spark = scored.sparkSession
    dated = scored.withColumn("date", F.to_date(ts)).hint("rebalance", "date")
    dated.write.mode("append").partitionBy("date").parquet(path)
    return spark.read.parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> DataFrame:
    alerts.write.mode("append").parquet(path)
    return alerts.sparkSession.read.schema(alerts.schema).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> DataFrame:
    """One folder per split (train, validation, test) in a single pass over the data."""
    writer = df.write.mode("overwrite").partitionBy(split).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    reader = df.sparkSession.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    ordered = [f for f in df.schema if f.name != split] + [df.schema[split]]
    return reader.schema(type(df.schema)(ordered)).load(path)


def write_report(report: DataFrame, path: str) -> DataFrame:
    report.write.mode("overwrite").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)


def snapshot_table(spark: SparkSession, name: str, suffix: str = "backup") -> DataFrame:
    copy = f"{name}_{suffix}"
    spark.table(name).write.mode("overwrite").saveAsTable(copy)
    return spark.table(copy)


def restore_table(spark: SparkSession, name: str, suffix: str = "backup") -> DataFrame:
    spark.table(f"{name}_{suffix}").write.mode("overwrite").saveAsTable(name)
    return spark.table(name)
