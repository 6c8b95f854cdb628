"""What several text operators share: reading, the held-out rule, per-worker objects and Arrow rows."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and \t to \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns and their names never matter. Null text is empty text."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    )


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves remainder 0 by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def per_worker(key: Any, make: Callable[[], Any], alone: bool = False) -> Any:
    """One object per Python worker process, kept between its tasks: a tokenizer or a cache.

    Functions of this package travel by value, so a module's globals are new in every task. ``alone`` drops what other
    operators have left in the worker before the object is made: Spark hands one job's workers to the next, and each
    would come to hold the caches of all of them.
    """
    store = sys.modules.setdefault("_scorelens_worker", types.ModuleType("_scorelens_worker")).__dict__
    kept = store.setdefault("kept", {})
    if key not in kept:
        if alone and kept:
            kept.clear()
            pa.default_memory_pool().release_unused()
        kept[key] = make()
    return kept[key]


class WordCache:
    """Results by word, filled on demand and emptied when it holds ``limit`` of them; never changes a result."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.data = limit, {}

    def room(self) -> dict:
        if len(self.data) > self.limit:
            self.data.clear()
        return self.data


def rows(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` rows, so that a slice of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def gathered(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches anew, about ``most`` bytes at once: many short texts, or few long ones."""
    held, size = [], 0
    for b in rows(batches, 256):
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@contextmanager
def small_batches(spark: SparkSession, most: int = 1024) -> Iterator[None]:
    """Jobs started inside hand Python at most so many rows at once; the caller's setting is put back.

    A batch of 10,000 rows of texts, or of pairs of them, stands in the buffers of the executor and of Python at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)
