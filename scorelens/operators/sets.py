"""Set operations on datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows followed by new ones; a column that one side lacks is NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def only_in_current(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    return current.select(column).subtract(reference.select(column))


def distinct_values(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    out = df.select(column).distinct()
    return out.na.drop(subset=[column]) if dropna else out
