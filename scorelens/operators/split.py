"""Stratified splits with exact class counts and no shuffle of the rows.

Every row has a rank key (a hash of its id). Per class, the rows with the smallest keys form the
first split, the next ones the second, and so on. To find where a split ends, keys are counted in
65,536 slices; only the slice that contains the end is ordered. The rows themselves then compare
their key with the end of their class.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.running import join_keys, numbered
from scorelens.session import SMALL_ROWS, collect_small, cut_lineage, pin_small

_SLICE_BITS = 16


def share_out(counts: Mapping, total: int) -> dict:
    """Split ``total`` over classes in proportion to ``counts``: floors, then largest remainders."""
    size = sum(counts.values())
    exact = {k: total * n / size for k, n in counts.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    left = total - sum(out.values())
    for k in sorted(counts, key=lambda k: (-(exact[k] - out[k]), str(k)))[:left]:
        out[k] += 1
    return out


def quotas(counts: Mapping, fractions: Sequence[tuple[str, float]]) -> dict[str, dict]:
    """Rows per class for each named split; each fraction applies to what the earlier ones left."""
    left, out = dict(counts), {}
    for name, fraction in fractions:
        wanted = share_out(left, math.ceil(round(sum(left.values()) * fraction, 9)))
        out[name] = wanted
        left = {k: left[k] - wanted[k] for k in left}
    return out


def _class_goals(counts: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(_y, step, goal): the rule of ``quotas`` over a class table (_y, n) of any size."""
    left, goals = counts.select("_y", F.col("n").alias("left"), F.lit(0).cast("long").alias("goal")), []
    for step, fraction in enumerate(fractions):
        total = left.agg(F.coalesce(F.sum("left"), F.lit(0)).alias("s")).first()["s"]
        wanted = math.ceil(round(total * fraction, 9))
        exact = F.lit(wanted) * F.col("left") / F.lit(float(max(1, total)))
        shared = left.withColumn("q", F.floor(exact)).withColumn("rest", exact - F.col("q"))
        spare = wanted - shared.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("s")).first()["s"]
        # The classes with the largest remainders get one more; ties go by the class as text.
        shared = numbered(shared, [F.desc("rest"), F.col("_y").cast("string")])
        shared = shared.withColumn("q", F.col("q") + (F.col("rank") < spare).cast("long"))
        left = cut_lineage(
            shared.select("_y", (F.col("left") - F.col("q")).alias("left"), (F.col("goal") + F.col("q")).alias("goal"))
        )
        goals.append(left.select("_y", F.lit(step).alias("step"), "goal"))
    return reduce(DataFrame.unionAll, goals)


def stratified_split(
    df: DataFrame,
    target: str,
    key: str,
    fractions: Sequence[tuple[str, float]] = (("test", 0.2),),
    rest: str = "train",
    seed: int = 42,
    rank: Column | None = None,
    rank_bits: int = 64,
    name: str = "split",
    few_classes: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``split``. ``key`` identifies a row; ``rank`` may replace the hash by an own order.

    Quotas of up to ``few_classes`` classes are shared out on the driver, those of more by the same rule as tables.
    """
    rank = F.xxhash64(F.col(key), F.lit(seed)) if rank is None else rank
    ranked = df.withColumn("_rank", rank)
    narrow = ranked.select(
        F.col(target).alias("_y"),
        F.shiftright("_rank", rank_bits - _SLICE_BITS).alias("_slice"),
        "_rank",
        F.col(key).alias("_id"),
    )
    per_slice = cut_lineage(narrow.groupBy("_y", "_slice").agg(F.count(F.lit(1)).alias("n")))
    by_class = per_slice.groupBy("_y").agg(F.sum("n").alias("n"))
    table = collect_small(by_class, few_classes)
    if table is None:
        goals = _class_goals(cut_lineage(by_class), [f for _, f in fractions])
    else:
        counts = {r["_y"]: r["n"] for r in table.to_pylist()}
        ends: list[tuple] = []
        upto = {k: 0 for k in counts}
        for step, wanted in enumerate(quotas(counts, fractions).values()):
            for k in counts:
                upto[k] += wanted[k]
                ends.append((k, step, upto[k]))
        kind = df.schema[target].dataType.simpleString()
        goals = F.broadcast(df.sparkSession.createDataFrame(ends, f"_y {kind}, step INT, goal BIGINT"))

    w = Window.partitionBy("_y").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = per_slice.withColumn("upto", F.sum("n").over(w))
    hit = (
        join_keys(reached, goals, ["_y"])
        .filter((F.col("upto") - F.col("n") < F.col("goal")) & (F.col("goal") <= F.col("upto")))
        .select("_y", "_slice", "step", (F.col("goal") - F.col("upto") + F.col("n")).alias("nth"))
    )
    edge_rows = join_keys(narrow, pin_small(hit), ["_y", "_slice"])
    order = Window.partitionBy("_y", "step").orderBy("_rank", "_id")
    cuts = (
        edge_rows.withColumn("rn", F.row_number().over(order))
        .filter("rn = nth")
        .groupBy("_y")
        .agg(
            *[
                F.max(F.when(F.col("step") == i, F.struct("_rank", "_id"))).alias(f"_cut{i}")
                for i in range(len(fractions))
            ]
        )
    )
    place = F.struct(F.col("_rank"), F.col(key).alias("_id"))
    choice = F.lit(rest)
    for i, (label, _) in reversed(list(enumerate(fractions))):
        choice = F.when(place <= F.col(f"_cut{i}"), F.lit(label)).otherwise(choice)
    keyed = ranked.withColumn("_y", F.col(target))
    return join_keys(keyed, pin_small(cuts), ["_y"], "left").select(*df.columns, choice.alias(name))


def train_val_test(
    df: DataFrame, target: str, key: str, test: float = 0.2, val: float = 0.2, **kw
) -> DataFrame:
    """Test rows first, then validation rows out of the remainder."""
    return stratified_split(df, target, key, (("test", test), ("validation", val)), **kw)
