"""Exact cumulative sums over an ordered column without sending a whole group to one task.

The caller aggregates to one row per (keys, order value) first. Each key's range of values is cut into
slices; a window runs inside a slice, and the totals of the slices before it (a table of at most
``slices`` rows per key) are added. Where a slice column is absent the key is known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.session import cut_lineage

#: Rows that one task may order by itself.
ROWS_PER_SLICE = 1_000_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on grouping keys, with NULL equal to NULL as in a grouping; the right copies are dropped.

    A key that cannot be NULL on one side is compared plainly, which keeps an existing partitioning by
    that key usable.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )

    def same(k: str) -> Column:
        a, b = left[k], renamed[f"_r_{k}"]
        both_nullable = left.schema[k].nullable and right.schema[k].nullable
        return a.eqNullSafe(b) if both_nullable else a == b

    cond = reduce(lambda a, b: a & b, [same(k) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_bounds(df: DataFrame, value: str, rows_per_slice: int = ROWS_PER_SLICE) -> list[float]:
    """Inner slice borders of a numeric column; empty when its rows fit into one slice.

    A count, and where it asks for slices one quantile sketch that grows with their number; no shuffle of rows.
    """
    v = F.col(value).cast("double")
    values = df.filter(~F.isnan(v))
    wanted = -(-values.agg(F.count(v).alias("n")).first()["n"] // rows_per_slice)
    if wanted <= 1:
        return []
    marks = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
    row = values.agg(F.percentile_approx(v, marks, max(2000, 10 * wanted)).alias("m")).first()
    return sorted(set(row["m"]))


def with_slice(df: DataFrame, value: str, bounds: Sequence[float], name: str = "_slice") -> DataFrame:
    """Slice number by binary search over the borders; it never falls as the value rises."""
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(
        splits=splits, inputCol=value, outputCol=name, handleInvalid="keep"
    ).transform(df)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Sequence[str],
    slice_col: str | None = None,
    slice_desc: bool = False,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``tot_<s>`` (per key) for each column of ``sums``."""
    frame = (Window.unboundedPreceding, Window.currentRow)
    if slice_col is None:
        w = Window.partitionBy(*keys)
        ordered = w.orderBy(*order).rowsBetween(*frame)
        return df.select(
            "*",
            *[F.sum(s).over(ordered).alias(f"cum_{s}") for s in sums],
            *[F.sum(s).over(w).alias(f"tot_{s}") for s in sums],
        )

    # The sliced table is read twice. Written once to the shared folder, the scan and the shuffle that
    # made it run once, and a lost executor does not bring them back.
    df = cut_lineage(df)
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(*frame)
    local = df.select("*", *[F.sum(s).over(inside).alias(f"_cum_{s}") for s in sums])

    per_slice = df.groupBy(*keys, slice_col).agg(*[F.sum(s).alias(f"_sl_{s}") for s in sums])
    by_key = Window.partitionBy(*keys)
    first = F.col(slice_col).desc() if slice_desc else F.col(slice_col).asc()
    before = by_key.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    # A slice number is never NULL; saying so lets the join use the partitioning of the window.
    never_null = F.coalesce(F.col(slice_col), F.lit(0).cast(df.schema[slice_col].dataType))
    offsets = per_slice.select(
        *keys,
        never_null.alias(slice_col),
        *[F.coalesce(F.sum(f"_sl_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sl_{s}").over(by_key).alias(f"tot_{s}") for s in sums],
    )
    joined = join_keys(local, offsets, [*keys, slice_col])
    out = joined.select(
        *df.columns,
        *[(F.col(f"_cum_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"tot_{s}") for s in sums],
    )
    return out


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Rows with their place, from 0, in ``order`` over the whole table; no task orders more than its range.

    Rows are dealt by ranges of the order and sorted there; the sizes of the earlier ranges, a row per partition, are
    added. Rows that the order does not tell apart are numbered in any way.
    """
    at = F.monotonically_increasing_id()  # the partition, and behind 33 bits the place in it
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row per partition
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["count"]
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part BIGINT, _before BIGINT"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(before, "_part")
    return joined.select(*df.columns, (F.col("_before") + inside).alias(name))
