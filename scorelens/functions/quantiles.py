"""Exact grouped quantiles (linear interpolation) that do not hold a group's values in one task.

Pass 1 counts each group and brackets every wanted rank with a quantile sketch whose rank error is
bounded. Pass 2 keeps only rows inside a bracket, one per distinct value, and finds the ranks there.
Groups of up to ``exact_below`` rows are left to the built-in exact aggregate, whose memory they bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.running import join_keys, running_totals
from scorelens.session import collect_small

EXACT_BELOW = 100_000
ACCURACY = 10_000
_SUB_SLICES = 64


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    approximate: bool = False,
    exact_below: int = EXACT_BELOW,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group of ``keys`` with a column per entry of ``probs``. NULL and NaN are skipped."""
    keys = list(keys)
    names, ps = list(probs), [float(p) for p in probs.values()]
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    wanted = F.array(*[F.lit(p) for p in ps])

    def spread(q: DataFrame) -> DataFrame:
        return q.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])

    if approximate:
        return spread(base.groupBy(*keys).agg(F.percentile_approx("_v", wanted, accuracy).alias("_q")))

    slack = 2.0 / accuracy
    ends = [e for p in ps for e in (max(0.0, p - slack), min(1.0, p + slack))]
    brackets = base.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_m"),
    )
    table = collect_small(brackets)
    if table is not None:
        largest = pc.max(table["_n"]).as_py() if table.num_rows else 0
    else:
        sizes = base.groupBy(*keys).agg(F.count("_v").alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0]
    if largest <= exact_below:
        return spread(base.groupBy(*keys).agg(F.percentile("_v", wanted).alias("_q")))
    if table is None:
        return _split(base, brackets, keys, names, ps, exact_below, True, True)
    small = pc.min(table["_n"]).as_py() <= exact_below
    pinned = df.sparkSession.createDataFrame(table, schema=brackets.schema)
    return _split(base, pinned, keys, names, ps, exact_below, small, True)


def _split(base, brackets, keys, names, ps, exact_below, small: bool, large: bool) -> DataFrame:
    """Small groups by the built-in aggregate, large ones by refinement."""
    parts = []
    if large:
        wide = brackets.filter(F.col("_n") > exact_below).select(
            *keys,
            "_n",
            *[F.get("_m", F.lit(2 * i)).alias(f"_lo{i}") for i in range(len(ps))],
            *[F.get("_m", F.lit(2 * i + 1)).alias(f"_hi{i}") for i in range(len(ps))],
        )
        parts.append(_refine(base, wide, keys, names, ps))
    if small:
        few = brackets.filter(F.col("_n") <= exact_below).select(*keys)
        wanted = F.array(*[F.lit(p) for p in ps])
        q = join_keys(base, few, keys).groupBy(*keys).agg(F.percentile("_v", wanted).alias("_q"))
        parts.append(q.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _refine(base, brackets, keys, names, ps) -> DataFrame:
    """Ranks from one more scan: a value outside every bracket only adds to the counts below brackets.

    The scan aggregates to the distinct values inside the brackets (a few of every ``accuracy`` rows)
    before anything is shuffled; all later steps work on that remainder.
    """
    n = len(ps)
    cols = ["_n", *[f"_lo{i}" for i in range(n)], *[f"_hi{i}" for i in range(n)]]
    if keys:
        rows = join_keys(base, brackets, keys)
    else:
        one = brackets.select(F.struct(*cols).alias("b")).scalar()
        rows = base.select("_v", one.alias("_b")).select("_v", "_b.*")
    v = F.col("_v")
    inside = [(v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")) for i in range(n)]
    any_inside = inside[0]
    for e in inside[1:]:
        any_inside = any_inside | e
    kept = (
        rows.groupBy(*keys, *cols, F.when(any_inside, v).alias("_v"))
        .agg(
            F.count(F.lit(1)).alias("c"),
            *[F.sum((v < F.col(f"_lo{i}")).cast("long")).alias(f"_b{i}") for i in range(n)],
        )
    )

    def side(i: int):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        sub = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * _SUB_SLICES)).otherwise(0)
        below = F.struct(
            F.lit(i).alias("p"), F.lit(None).cast("double").alias("v"), F.lit(-1).alias("s"), F.col(f"_b{i}").alias("c")
        )
        here = F.struct(F.lit(i).alias("p"), v.alias("v"), sub.cast("int").alias("s"), F.col("c"))
        return [below, F.when(v.isNotNull() & inside[i], here)]

    entries = F.explode(F.array_compact(F.array(*[e for i in range(n) for e in side(i)])))
    counted = (
        kept.select(*keys, "_n", entries.alias("x"))
        .groupBy(*keys, "_n", F.col("x.p").alias("_p"), F.col("x.s").alias("_s"), F.col("x.v").alias("_v"))
        .agg(F.sum("x.c").alias("c"))
    )
    ranked = running_totals(counted, [*keys, "_n", "_p"], ["_v"], ["c"], slice_col="_s")
    prob = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_p") + 1)
    placed = ranked.filter(v.isNotNull()).withColumn("_pos", prob * (F.col("_n") - 1))
    low, high = F.floor("_pos"), F.ceil("_pos")
    at = placed.groupBy(*keys, "_p").agg(
        F.min(F.when(F.col("cum_c") > low, v)).alias("a"),
        F.min(F.when(F.col("cum_c") > high, v)).alias("b"),
        F.max(F.col("_pos") - low).alias("f"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    return at.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == i, value)).alias(name) for i, name in enumerate(names)]
    )
