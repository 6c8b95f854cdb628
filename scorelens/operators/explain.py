"""Why a row got its score, and which features a model leans on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _largest(parts: Sequence[tuple[str, Column]], k: int) -> Column:
    """The ``k`` largest (feature, importance) pairs of a row, as an array; features break ties."""
    pairs = F.array(*[F.struct((-v).alias("neg"), F.lit(n).alias("feature")) for n, v in parts])
    return F.slice(F.array_sort(pairs), 1, k)


def _exploded(df: DataFrame, top: Column, keep: Sequence[str], signed: Mapping[str, Column] | None) -> DataFrame:
    rows = df.select(*keep, *([c.alias(f"_v_{n}") for n, c in signed.items()] if signed else []), F.posexplode(top).alias("_i", "_p"))
    value = -F.col("_p.neg")
    cols = [F.col("_p.feature").alias("feature"), value.alias("importance"), (F.col("_i") + 1).alias("position")]
    if signed:
        own = F.coalesce(*[F.when(F.col("_p.feature") == n, F.col(f"_v_{n}")) for n in signed])
        cols.append(own.alias("contribution"))
    return rows.select(*keep, *cols)


def absolute_contributions(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str] = ()) -> DataFrame:
    """The plain form: a feature weighs as much as its absolute value."""
    parts = [(f, F.abs(F.col(f).cast("double"))) for f in features]
    return _exploded(df, _largest(parts, k), keep, None)


def linear_contributions(
    df: DataFrame,
    coefficients: Mapping[str, float],
    means: Mapping[str, float],
    k: int,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Coefficient times distance from the mean, for a linear model."""
    signed = {f: (F.col(f).cast("double") - F.lit(means[f])) * F.lit(c) for f, c in coefficients.items()}
    parts = [(f, F.abs(e)) for f, e in signed.items()]
    return _exploded(df, _largest(parts, k), keep, signed)
