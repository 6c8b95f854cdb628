"""Latest rows, top-k, best configurations, trailing counts and empirical distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.binned import sketched_borders, with_bins
from scorelens.functions.columns import col, micros
from scorelens.functions.running import join_keys, running_totals, value_bounds, with_slice
from scorelens.session import collect_small


def latest_per(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key.

    The newest time per key is a plain hash aggregate over two columns. If those keys are few, they
    reduce the table to the rows of that time by a broadcast join; whole rows are compared only then.
    """
    newest_time = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    table = collect_small(newest_time)
    if table is not None:
        marks = df.sparkSession.createDataFrame(table, schema=newest_time.schema)
        df = join_keys(df, marks, keys).filter(F.col(ts) == F.col("_newest")).drop("_newest")
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(ts), *[F.col(t) for t in tie]))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def recent(df: DataFrame, ts: str, n: int, tie: Sequence[str | Column] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), *tie).limit(n)


def top_k(
    df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. The rank limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_under_sla(
    runs: DataFrame, keys: Sequence[str] = (), min_success: float = 0.95, max_p95: float = 500.0
) -> DataFrame:
    """The run with most throughput among those inside the limits, and how far load may safely go."""
    ok = (F.col("success_rate") > min_success) & (F.col("latency_p95_ms") < max_p95)
    rps = F.col("throughput_rps")
    users = F.col("concurrent_users")
    best = F.max_by(users, F.when(ok, F.struct(rps, -users)))
    return runs.groupBy(*keys).agg(
        best.alias("best_concurrent_users"),
        F.max(F.when(ok, rps)).alias("best_throughput_rps"),
        F.max(F.when(F.col("success_rate") > min_success, rps)).alias("max_safe_load"),
        F.coalesce(F.floor(best * 0.8), F.lit(50)).cast("long").alias("recommended_concurrent_users"),
        F.sum(F.when(F.col("latency_p95_ms") > max_p95, 1).otherwise(0)).alias("sla_violations"),
    )


def best_batch_size(runs: DataFrame, model: str = "model") -> DataFrame:
    """Per model: the batch size with most throughput (smallest one on a tie) and the least latency."""
    rps = F.col("throughput_rps")
    return runs.groupBy(model).agg(
        F.max(rps).alias("best_throughput_rps"),
        F.min("avg_latency_ms").alias("best_latency_ms"),
        F.max_by("batch_size", F.struct(rps, -F.col("batch_size"))).alias("optimal_batch_size"),
    )


def trailing_counts(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int | Sequence[int], names: Sequence[str] | None = None
) -> DataFrame:
    """Earlier requests of the same key inside the last ``seconds``, the row itself not counted.

    The window is partitioned by key and by a time slot as wide as the longest span. A row enters a span once and leaves
    it a span later, so a count is a running total per key and slot, which starts with what the slot before has left. A
    key that holds a third of all rows is thus spread over all slots.
    """
    spans = [seconds] if isinstance(seconds, int) else list(seconds)
    names = names or [f"prior_{s}s" for s in spans]
    width = max(spans) * 1_000_000
    at = df.withColumn("_us", micros(ts)).withColumn("_first", F.floor(F.col("_us") / width))
    # Span 0 is the row itself, the others are its way out of a span.
    visits = at.select("*", F.posexplode(F.array(*[F.lit(s * 1_000_000) for s in [0, *spans]])).alias("_span", "_later"))
    changes = visits.withColumn("_us", F.col("_us") + F.col("_later")).withColumn("_slot", F.floor(F.col("_us") / width))
    inside = Window.partitionBy(*keys, "_slot")
    until = inside.orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("_span") == 0

    def inside_span(i: int) -> Column:
        leaves = F.col("_span") == i
        # Rows without a time never leave; both of their copies count.
        change = F.when(own, 1).when(leaves & F.col("_us").isNotNull(), -1)
        carried = F.when(leaves & (F.col("_us").isNull() | (F.col("_slot") != F.col("_first"))), 1)
        return F.sum(change).over(until) + F.coalesce(F.sum(carried).over(inside), F.lit(0)) - 1

    counted = changes.select(*df.columns, "_span", *[inside_span(i).alias(n) for i, n in enumerate(names, 1)])
    return counted.filter(own).drop("_span")


# Requests per second at which the load level changes, and the factor of each level.
LOAD_LEVELS = ((10.0, "low", 1.5), (50.0, "normal", 1.0), (100.0, "high", 0.5))
CRITICAL_LOAD = ("critical", 0.2)


def load_bands(rps: Column, levels=LOAD_LEVELS, top=CRITICAL_LOAD) -> tuple[Column, Column]:
    """Load level and limit factor for a request rate."""
    level, factor = F.lit(top[0]), F.lit(top[1])
    for limit, name, f in reversed(levels):
        level = F.when(rps < limit, F.lit(name)).otherwise(level)
        factor = F.when(rps < limit, F.lit(f)).otherwise(factor)
    return level, factor


def load_levels(
    df: DataFrame, ts: str, base_limit: int = 60, seconds: int = 30, levels=LOAD_LEVELS
) -> DataFrame:
    """Global request rate over the trailing window and the limit it leads to, per request instant.

    Requests of one instant are counted first. An instant enters the window once and leaves it a window's width later, so
    the rate is a running total per time slot, which starts with what the slot before it has left; no frame is summed anew.
    """
    width = seconds * 1_000_000
    instants = df.groupBy(micros(ts).alias("us")).agg(F.count(F.lit(1)).alias("n"))
    slot = F.floor(F.col("us") / width)
    visits = instants.select("us", "n", F.posexplode(F.array(slot, slot + 1)).alias("_left", "_slot"))
    changes = visits.select(
        (F.col("us") + F.col("_left") * width).alias("us"),
        "n",
        "_left",
        "_slot",
        # Requests without a time never leave; both of their copies count.
        F.when(F.col("_left") == 0, F.col("n")).when(F.col("us").isNotNull(), -F.col("n")).alias("_change"),
    )
    inside = Window.partitionBy("_slot")
    until = inside.orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.sum(F.when(F.col("_left") == 1, F.col("n"))).over(inside), F.lit(0))
    rate = changes.withColumn("rps", (before + F.sum("_change").over(until)) / seconds).filter("_left = 0")
    level, factor = load_bands(F.col("rps"), levels)
    return rate.select(
        "us",
        F.col("n").alias("requests"),
        "rps",
        level.alias("load_level"),
        factor.alias("load_factor"),
        F.floor(F.lit(base_limit) * factor).cast("long").alias("adjusted_limit"),
    )


def empirical_cdf(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rows_per_slice: int | None = None,
    approximate: int | None = None,
    borders: Sequence[float] | None = None,
) -> DataFrame:
    """Share of rows at or below each distinct value, per key.

    With ``approximate``, a number of bins, or with given ``borders``: only the largest value of each bin, for which the
    share is exact; between two of them it is wrong by the share of one bin at most.
    """
    src = df.select(*keys, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    if approximate or borders is not None:
        borders = sketched_borders(src, ["value"], approximate)["value"] if borders is None else borders
        binned = with_bins(src, {"value": borders})
        counts = binned.groupBy(*keys, "value_bin").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
        ranked = running_totals(counts, keys, ["value"], ["n"])
    else:
        args = {} if rows_per_slice is None else {"rows_per_slice": rows_per_slice}
        bounds = value_bounds(src, "value", **args)
        counts = src.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
        sliced = with_slice(counts, "value", bounds) if bounds else counts
        ranked = running_totals(sliced, keys, ["value"], ["n"], slice_col="_slice" if bounds else None)
    return ranked.select(*keys, "value", "n", (F.col("cum_n") / F.col("tot_n")).alias("cdf"))


def examples(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 5) -> DataFrame:
    return top_k(df, keys, [col(o) for o in order], k, rank="example")
