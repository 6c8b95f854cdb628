"""Start streams over what is available now, with their state and output in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


#: Event time of the row that closes a bounded stream, later than all rows and all that waits for them.
END = datetime(9000, 1, 1)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state outside the heap; the caller's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class BoundedStream:
    """A stream that ends: ``rows`` has the source's rows and, once ``close`` was called, one more at ``END``.

    The watermark waits behind the newest row, so the last windows and slots of a bounded source would stay open. The
    closing row comes from a folder of its own, which is filled when the source has been read; a query started again
    from its checkpoint then meets nothing but that row. It is null in all other columns, and as its own window never
    closes it is in no result of a windowed or time-ordered operator.
    """

    def __init__(self, source: DataFrame, ts: str = "created_at"):
        self.spark, self.ts = source.sparkSession, ts
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in source.schema])
        self.path = scratch_path(self.spark, "closing")
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.rows = source.unionByName(self.spark.readStream.schema(self.schema).parquet(self.path))

    def close(self) -> None:
        at = self.schema.fieldNames().index(self.ts)
        row = tuple(END if i == at else None for i in range(len(self.schema)))
        self.spark.createDataFrame([row], self.schema).write.mode("append").parquet(self.path)


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, schema: str | T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def folder_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant, so a zone-less column is read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> None:
    """Append-mode file sink, which commits each batch exactly once."""
    with state_in_rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    query.awaitTermination()


def run_append(stream: DataFrame, name: str, bounded: BoundedStream | None = None) -> DataFrame:
    """All rows that the stream appends; with ``bounded``, those of the last windows as well."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    append_to(stream, f"{base}/out", f"{base}/checkpoint")
    if bounded is not None:
        bounded.close()
        append_to(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def each_batch(
    stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], DataFrame], mode: str = "append"
) -> None:
    """``write`` turns a batch into rows, which replace the folder of that batch id.

    A batch that is repeated after a failure overwrites its own folder, so nothing is written twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with state_in_rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(handle)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def run_each_batch(
    stream: DataFrame,
    name: str,
    write: Callable[[DataFrame, int], DataFrame],
    schema: T.StructType,
    mode: str = "append",
    bounded: BoundedStream | None = None,
) -> DataFrame:
    """Rows of all batches with a ``batch`` column; with ``bounded``, those of the last windows as well."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    each_batch(stream, f"{base}/out", f"{base}/checkpoint", write, mode)
    if bounded is not None:
        bounded.close()
        each_batch(stream, f"{base}/out", f"{base}/checkpoint", write, mode)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(f"{base}/out")


def run_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Update-mode results folded to the last value of each key."""
    changes = run_each_batch(stream, name, lambda b, i: b, stream.schema, mode="update")
    rest = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*")
