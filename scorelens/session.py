"""Session, scratch folders and the one rule for what may reach the driver."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Upper bound on rows that a fitted statistic may bring to the driver.
SMALL_ROWS = 10_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scorelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="scorelens-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local session may go without that setting; its temporary folder goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_scratch().name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so that a lost executor cannot recompute its past.

    The table is read back from files, which every executor can reach.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> pa.Table | None:
    """The rows of a table known to be small, or None when it holds more than ``max_rows``."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Turn a fitted statistic into a local relation when its size is proven, else leave it alone.

    Joins against the pinned form broadcast; joins against the other form shuffle on their keys.
    """
    table = collect_small(df, max_rows)
    if table is None:
        return df
    return df.sparkSession.createDataFrame(table, schema=df.schema)
