"""Drift between a reference table and a current table.

All columns are measured in one plan: both sides are stacked with a side flag, unpivoted, and counted
per (column, value) with both counts beside each other. Statistics then work on those counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.binned import sketched_borders, with_bins
from scorelens.functions.quantiles import grouped_quantiles
from scorelens.functions.running import ROWS_PER_SLICE, join_keys, running_totals, value_bounds, with_slice
from scorelens.functions.tails import chi2_tail, kolmogorov_tail, normal_two_sided
from scorelens.operators.predlog import flag
from scorelens.operators.quality import per_column, unpivot_numeric

# Limits of the monitoring configuration.
KS_LIMIT = 0.1
#: Bins of the approximate distance: it lacks about a thousandth at most where no value is frequent.
KS_BINS = 1_000
PSI_LIMIT = 0.2
DATA_DRIFT_LIMIT = 0.3
CONCEPT_DRIFT_LIMIT = 0.2
DECAY_PERCENT = 10.0
ABSOLUTE_DECAY = 0.05
PSI_BINS = 10
PSI_FLOOR = 1e-4

SIDES = {"reference": 0, "current": 1}


def two_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables with a ``side`` flag: 0 for reference, 1 for current."""
    return reference.select(*columns, F.lit(0).alias("side")).unionByName(
        current.select(*columns, F.lit(1).alias("side"))
    )


def _both_counts(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.sum(flag(F.col("side") == 0)).alias("n_ref"), F.sum(flag(F.col("side") == 1)).alias("n_cur")
    )


def text_counts(sides: DataFrame, columns: Sequence[str]) -> DataFrame:
    text = sides.select("side", *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot(["side"], list(columns), "column", "value").filter("value IS NOT NULL")
    return _both_counts(long, ["column", "value"])


def ks_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    approximate: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per numeric column.

    ``approximate`` is a number of bins: ``binned_ks`` then stands in, which has a column ``error``.
    """
    if approximate:
        return binned_ks(reference, current, columns, approximate)
    sides = two_sides(reference, current, columns)
    long = unpivot_numeric(sides, columns, ["side"])
    bounds = value_bounds(long, "value", rows_per_slice)
    counts = _both_counts(long, ["column", "value"])
    sliced = with_slice(counts, "value", bounds) if bounds else counts
    ranked = running_totals(
        sliced, ["column"], ["value"], ["n_ref", "n_cur"], slice_col="_slice" if bounds else None
    )
    gap = F.abs(F.col("cum_n_ref") / F.col("tot_n_ref") - F.col("cum_n_cur") / F.col("tot_n_cur"))
    both = ranked.filter("tot_n_ref > 0 AND tot_n_cur > 0")
    out = both.groupBy("column").agg(
        F.max(gap).alias("statistic"), F.max("tot_n_ref").alias("n_ref"), F.max("tot_n_cur").alias("n_cur")
    )
    return out.select(
        "column",
        "statistic",
        kolmogorov_tail(F.col("statistic"), F.col("n_ref"), F.col("n_cur")).alias("p_value"),
        "n_ref",
        "n_cur",
    )


def psi_of_counts(counts: DataFrame, keys: Sequence[str] = ("column",), floor: float = PSI_FLOOR) -> DataFrame:
    """Population stability index of counts per (keys, bin). An empty bin counts as the floor share.

    A column may have very many values, so its totals are not taken over a window. They are one row per
    measured column (and time window), a number set by the caller, and are broadcast to the counts.
    """
    totals = counts.groupBy(*keys).agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    shares = join_keys(counts, F.broadcast(totals), list(keys)).select(
        *keys,
        F.greatest(F.coalesce(F.try_divide("n_ref", "_r"), F.lit(0.0)), F.lit(floor)).alias("p"),
        F.greatest(F.coalesce(F.try_divide("n_cur", "_c"), F.lit(0.0)), F.lit(floor)).alias("q"),
    )
    return shares.groupBy(*keys).agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))


def fit_edges(reference: DataFrame, columns: Sequence[str], bins: int = PSI_BINS, **kw) -> dict[str, list[float]]:
    """Inner quantile edges of the reference per numeric column: a profile of fixed size."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    rows = grouped_quantiles(unpivot_numeric(reference, columns), ["column"], "value", probs, **kw).collect()
    return {r["column"]: sorted({r[p] for p in probs}) for r in rows}


def bin_number(c: str, edges: Sequence[float]) -> Column:
    """How many edges lie below the value; NULL stays NULL."""
    v = F.col(c).cast("double")
    total = F.lit(0)
    for e in edges:
        total = total + (v > F.lit(e)).cast("int")
    return F.when(v.isNotNull() & ~F.isnan(v), total)


def binned_counts(sides: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    wide = sides.select("side", *[bin_number(c, e).alias(c) for c, e in edges.items()])
    long = wide.unpivot(["side"], list(edges), "column", "bin").filter("bin IS NOT NULL")
    return _both_counts(long, ["column", "bin"])


def psi_drift(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    bins: int = PSI_BINS,
    edges: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """PSI per column: over reference quantile bins for numbers, over values for categories."""
    parts = []
    if numeric:
        edges = edges or fit_edges(reference, numeric, bins)
        parts.append(psi_of_counts(binned_counts(two_sides(reference, current, numeric), edges)))
    if categorical:
        parts.append(psi_of_counts(text_counts(two_sides(reference, current, categorical), categorical)))
    if not parts:
        return reference.sparkSession.createDataFrame([], "`column` STRING, psi DOUBLE")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chi2_of_counts(counts: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """Chi-square of the 2 x k table of (side, value) with its degrees of freedom and p-value.

    With row totals R, C and N = R + C the statistic is sum of n_r^2/(R*n/N) + n_c^2/(C*n/N) - N per
    value, so one grouped sum is enough.
    """
    n = F.col("n_ref") + F.col("n_cur")
    sums = counts.groupBy(*keys).agg(
        F.sum("n_ref").alias("r"),
        F.sum("n_cur").alias("c"),
        F.sum(F.col("n_ref").cast("double") * F.col("n_ref") / n).alias("sr"),
        F.sum(F.col("n_cur").cast("double") * F.col("n_cur") / n).alias("sc"),
        F.count(F.lit(1)).alias("values"),
    )
    total = F.col("r") + F.col("c")
    stat = total * (F.col("sr") / F.col("r") + F.col("sc") / F.col("c") - 1)
    out = sums.filter("r > 0 AND c > 0").select(
        *keys,
        F.greatest(stat, F.lit(0.0)).alias("statistic"),
        (F.col("values") - 1).alias("degrees"),
        F.col("r").alias("n_ref"),
        F.col("c").alias("n_cur"),
    )
    return out.select(*keys, "statistic", "degrees", chi2_tail("statistic", "degrees").alias("p_value"), "n_ref", "n_cur")


def chi2_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    return chi2_of_counts(text_counts(two_sides(reference, current, columns), columns))


def binned_ks(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    bins: int = KS_BINS,
    borders: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """KS distance at the ends of bins, for columns with very many distinct values.

    ``statistic`` is no more than the exact distance, and ``error``, the largest share of a side in one bin, bounds what
    it may lack. At most ``bins`` rows per column leave a task. ``borders`` may be given; else a sketch of both sides.
    """
    sides = two_sides(reference, current, columns)
    borders = borders or sketched_borders(sides, columns, bins)
    numbers = with_bins(sides, {c: borders[c] for c in columns}).select("side", *[F.col(f"{c}_bin").alias(c) for c in columns])
    long = numbers.unpivot(["side"], list(columns), "column", "bin").filter("bin IS NOT NULL")
    counts = _both_counts(long, ["column", "bin"])
    ranked = running_totals(counts, ["column"], ["bin"], ["n_ref", "n_cur"]).filter("tot_n_ref > 0 AND tot_n_cur > 0")
    gap = F.abs(F.col("cum_n_ref") / F.col("tot_n_ref") - F.col("cum_n_cur") / F.col("tot_n_cur"))
    share = F.greatest(F.col("n_ref") / F.col("tot_n_ref"), F.col("n_cur") / F.col("tot_n_cur"))
    out = ranked.groupBy("column").agg(
        F.max(gap).alias("statistic"),
        F.max(share).alias("error"),
        F.max("tot_n_ref").alias("n_ref"),
        F.max("tot_n_cur").alias("n_cur"),
    )
    tail = kolmogorov_tail(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    return out.select("column", "statistic", "error", tail.alias("p_value"), "n_ref", "n_cur")


def proportion_drift(reference: DataFrame, current: DataFrame, target: str) -> DataFrame:
    """Two-proportion z of a 0/1 column, pooled."""
    sides = two_sides(reference, current, [target]).filter(F.col(target).isNotNull())
    y = F.col(target).cast("double")

    def on(side: int, e: Column) -> Column:
        return F.when(F.col("side") == side, e)

    s = sides.agg(
        F.count(on(0, y)).alias("n_ref"),
        F.count(on(1, y)).alias("n_cur"),
        F.avg(on(0, y)).alias("p_ref"),
        F.avg(on(1, y)).alias("p_cur"),
        F.avg(y).alias("p"),
    )
    spread = F.sqrt(F.col("p") * (1 - F.col("p")) * (1.0 / F.col("n_ref") + 1.0 / F.col("n_cur")))
    z = F.try_divide(F.col("p_cur") - F.col("p_ref"), spread)
    return s.select("n_ref", "n_cur", "p_ref", "p_cur", z.alias("z")).select(
        "*", normal_two_sided("z").alias("p_value")
    )


def column_drift_report(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    ks_limit: float = KS_LIMIT,
    psi_limit: float = PSI_LIMIT,
    confidence: float | None = None,
    approximate: int | None = None,
) -> DataFrame:
    """Test, statistic, p-value, score and verdict per column; numbers over ``approximate`` bins if given.

    The score of a number is its KS distance, that of a category its PSI; a column has drifted when the
    score exceeds its limit. With ``confidence`` the verdict is ``p_value < 1 - confidence`` instead.
    """
    parts = []
    if numeric:
        ks = ks_drift(reference, current, numeric, approximate=approximate)
        parts.append(
            ks.select(
                "column",
                F.lit("numeric").alias("kind"),
                F.lit("ks").alias("test_name"),
                "statistic",
                "p_value",
                F.col("statistic").alias("drift_score"),
                F.lit(float(ks_limit)).alias("limit"),
            )
        )
    if categorical:
        counts = text_counts(two_sides(reference, current, categorical), categorical)
        joined = join_keys(chi2_of_counts(counts), psi_of_counts(counts), ["column"])
        parts.append(
            joined.select(
                "column",
                F.lit("categorical").alias("kind"),
                F.lit("chi2").alias("test_name"),
                "statistic",
                "p_value",
                F.col("psi").alias("drift_score"),
                F.lit(float(psi_limit)).alias("limit"),
            )
        )
    if not parts:
        return reference.sparkSession.createDataFrame(
            [],
            "`column` STRING, kind STRING, test_name STRING, statistic DOUBLE, p_value DOUBLE, drift_score DOUBLE, "
            "drift_detected BOOLEAN",
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    hit = F.col("drift_score") > F.col("limit")
    if confidence is not None:
        hit = F.col("p_value") < 1 - confidence
    return out.select(*[c for c in out.columns if c != "limit"], hit.alias("drift_detected"))


def dataset_drift(report: DataFrame, limit: float = DATA_DRIFT_LIMIT) -> DataFrame:
    """Share of drifted columns and the verdict over the whole table."""
    hit = flag(F.col("drift_detected"))
    share = F.sum(hit) / F.count(F.lit(1))
    names = F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column"))))
    return report.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.sum(hit).alias("drifted_columns_count"),
        F.sum(F.when(F.col("kind") == "numeric", hit).otherwise(0)).alias("drifted_numeric"),
        F.sum(F.when(F.col("kind") == "categorical", hit).otherwise(0)).alias("drifted_categorical"),
        share.alias("data_drift_score"),
        names.alias("drifted_columns"),
        (share > limit).alias("data_drift_detected"),
    )


def target_drift(
    reference: DataFrame, current: DataFrame, target: str, limit: float = CONCEPT_DRIFT_LIMIT
) -> DataFrame:
    """PSI of the classes as the score, with mean and sample deviation of both sides."""
    counts = (
        two_sides(reference, current, [target])
        .filter(F.col(target).isNotNull())
        .groupBy(F.col(target).cast("double").alias("y"))
        .agg(F.sum(flag(F.col("side") == 0)).alias("n_ref"), F.sum(flag(F.col("side") == 1)).alias("n_cur"))
    )

    def moments(n: str) -> tuple[Column, Column]:
        w, y = F.col(n).cast("double"), F.col("y")
        total, s1, s2 = F.sum(w), F.sum(w * y), F.sum(w * y * y)
        variance = F.try_divide(s2 - s1 * s1 / F.nullif(total, F.lit(0.0)), total - 1)
        return F.try_divide(s1, total), F.sqrt(F.greatest(variance, F.lit(0.0)))

    (mr, sr), (mc, sc) = moments("n_ref"), moments("n_cur")
    total_ref = counts.agg(F.struct(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c")).alias("t")).scalar()
    p = F.greatest(F.try_divide(F.col("n_ref"), total_ref["r"]), F.lit(PSI_FLOOR))
    q = F.greatest(F.try_divide(F.col("n_cur"), total_ref["c"]), F.lit(PSI_FLOOR))
    out = counts.withColumns({"_p": p, "_q": q}).agg(
        F.sum((F.col("_p") - F.col("_q")) * F.log(F.col("_p") / F.col("_q"))).alias("target_drift_score"),
        mr.alias("reference_mean"),
        sr.alias("reference_std"),
        mc.alias("current_mean"),
        sc.alias("current_std"),
    )
    return out.select("*", (F.col("target_drift_score") > limit).alias("target_drift_detected"))


def prediction_drift(
    reference: DataFrame, current: DataFrame, column: str = "prediction", approximate: int | None = None
) -> DataFrame:
    """KS distance of the score column, over ``approximate`` bins if given; zero where a side lacks it.

    The concept drift score takes this table, so it has the same error.
    """
    if column not in reference.columns or column not in current.columns:
        return reference.sparkSession.createDataFrame([(0.0,)], "prediction_drift_score DOUBLE")
    ks = ks_drift(reference, current, [column], approximate=approximate)
    return ks.agg(F.coalesce(F.max("statistic"), F.lit(0.0)).alias("prediction_drift_score"))


def concept_drift(target: DataFrame, prediction: DataFrame, limit: float = CONCEPT_DRIFT_LIMIT) -> DataFrame:
    """The larger of target and prediction drift, from the two one-row tables."""
    other = prediction.select("prediction_drift_score").scalar()
    out = target.withColumn("prediction_drift_score", F.coalesce(other, F.lit(0.0)))
    score = F.greatest("target_drift_score", "prediction_drift_score")
    return out.withColumn("concept_drift_score", score).withColumn("concept_drift_detected", score > limit)


def performance_decay(pairs: DataFrame, limit_percent: float = DECAY_PERCENT) -> DataFrame:
    """Decay in percent of the reference per metric; zero where the reference is not positive."""
    ref, cur = F.col("reference"), F.col("current")
    decay = F.when(ref > 0, (ref - cur) / ref * 100).otherwise(0.0)
    return pairs.select(
        "metric",
        "reference",
        "current",
        decay.alias("decay_percent"),
        (F.abs(decay) > limit_percent).alias("significant_decay"),
    )


def absolute_decay(
    pairs: DataFrame, limit: float = ABSOLUTE_DECAY, metrics: Sequence[str] = ("accuracy", "roc_auc", "f1")
) -> DataFrame:
    """Whether any of the compared metrics fell by more than the limit."""
    fall = F.col("reference") - F.col("current")
    return pairs.filter(F.col("metric").isin(*metrics)).agg(
        F.max(fall).alias("largest_fall"), F.coalesce(F.max(fall > limit), F.lit(False)).alias("decayed")
    )


def missing_share(df: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Share of missing cells over all columns and its largest value in one column."""
    columns = list(columns)
    rows = per_column(
        df, columns, {"m": lambda c: F.sum(flag(F.col(c).isNull()))}, [("n", F.count(F.lit(1)))]
    )
    share = F.sum("m") / F.sum("n")
    return rows.agg(
        F.sum("m").alias("missing_cells"),
        share.alias("missing_share"),
        F.max(F.col("m") / F.col("n")).alias("worst_column_share"),
        (share < limit).alias("within_limit"),
    )


def column_summary(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, distinct, mean, deviation, extremes and quartiles per side and column.

    Values are counted once per (side, column, value); the moments follow from those counts.
    """
    columns = list(columns)
    sides = two_sides(reference, current, columns)
    wide = sides.select("side", *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(["side"], columns, "column", "value")
    keys = ["side", "column"]
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("unique"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    moments = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    quartiles = grouped_quantiles(long, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    out = join_keys(join_keys(stats, moments, keys), quartiles, keys, "left")
    side = F.when(F.col("side") == 0, "reference").otherwise("current")
    return out.withColumn("side", side)


def column_correlations(df: DataFrame, column: str, others: Sequence[str]) -> DataFrame:
    """Pearson correlation of one column with others, in one pass."""
    out = per_column(df, list(others), {"correlation": lambda c: F.corr(F.col(column), F.col(c))})
    return out


def value_range_share(
    reference: DataFrame, current: DataFrame, column: str, left: float, right: float
) -> DataFrame:
    inside = F.avg(F.col(column).between(left, right).cast("double"))
    sides = two_sides(reference, current, [column])
    side = F.when(F.col("side") == 0, "reference").otherwise("current")
    return sides.groupBy(side.alias("side")).agg(inside.alias("share_in_range"))


def column_quantile(reference: DataFrame, current: DataFrame, column: str, quantile: float = 0.5) -> DataFrame:
    out = grouped_quantiles(two_sides(reference, current, [column]), ["side"], column, {"value": quantile})
    return out.withColumn("side", F.when(F.col("side") == 0, "reference").otherwise("current"))


_METRIC_ROWS = "metric STRING, `column` STRING, side STRING, value DOUBLE"


def custom_metrics(reference: DataFrame, current: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """Configured metrics as ``(metric, column, side, value)`` rows. Unknown types are left out.

    Metrics of one kind share their pass.
    """
    drift = [m["column_name"] for m in config if m["type"] == "column_drift"]
    summaries = [m["column_name"] for m in config if m["type"] == "column_summary"]
    parts: list[DataFrame] = []

    def rows(df: DataFrame, metric: Column, column: Column, side: Column, value: str) -> None:
        parts.append(
            df.select(
                metric.alias("metric"),
                column.alias("column"),
                side.alias("side"),
                F.col(value).cast("double").alias("value"),
            )
        )

    if drift:
        rows(ks_drift(reference, current, drift), F.lit("column_drift"), F.col("column"), F.lit("both"), "statistic")
    if summaries:
        names = ["count", "missing", "unique", "min", "max", "mean", "std", "p25", "p50", "p75"]
        summary = column_summary(reference, current, summaries).select(
            "side", "column", *[F.col(n).cast("double").alias(n) for n in names]
        )
        flat = summary.unpivot(["side", "column"], names, "stat", "value")
        rows(flat, F.concat(F.lit("column_summary."), F.col("stat")), F.col("column"), F.col("side"), "value")
    for m in config:
        name = m.get("column_name")
        if m["type"] == "column_correlations":
            others = m["others"]
            out = column_correlations(current, name, others)
            metric = F.concat(F.lit("column_correlations."), F.col("column"))
            rows(out, metric, F.lit(name), F.lit("current"), "correlation")
        elif m["type"] == "column_value_range":
            out = value_range_share(reference, current, name, m["left"], m["right"])
            rows(out, F.lit("column_value_range"), F.lit(name), F.col("side"), "share_in_range")
        elif m["type"] == "column_quantile":
            out = column_quantile(reference, current, name, m.get("quantile", 0.5))
            rows(out, F.lit("column_quantile"), F.lit(name), F.col("side"), "value")
    if not parts:
        return reference.sparkSession.createDataFrame([], _METRIC_ROWS)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def check_row(name: str, value: Column, op: str, limit: float) -> Column:
    """One test as a struct; limits are strict."""
    v = value.cast("double")
    passed = v < limit if op == "<" else v > limit
    return F.struct(
        F.lit(name).alias("name"),
        v.alias("value"),
        F.lit(op).alias("op"),
        F.lit(float(limit)).alias("limit"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def drift_tests(
    report: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    max_share: float = 0.3,
    max_count: int | None = 5,
    max_missing: float = 0.1,
    important: Sequence[str] = (),
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Pass/fail rows over the drift report and the current table.

    ``max_count=None`` allows as many drifted columns as the share of all columns, rounded down.
    """
    hit = flag(F.col("drift_detected"))
    n = F.count(F.lit(1))
    from_report = [check_row("share_of_drifted_columns", F.sum(hit) / n, "<", max_share)]
    if max_count is not None:
        from_report.append(check_row("number_of_drifted_columns", F.sum(hit), "<", max_count))
    else:
        allowed = F.floor(n * F.lit(max_share)).cast("double")
        v = F.sum(hit).cast("double")
        from_report.append(
            F.struct(
                F.lit("number_of_drifted_columns").alias("name"),
                v.alias("value"),
                F.lit("<").alias("op"),
                allowed.alias("limit"),
                (v < allowed).alias("passed"),
            )
        )
    for c in important:
        drifted = F.max(F.when(F.col("column") == c, hit))
        from_report.append(check_row(f"drift:{c}", drifted, "<", 1))
    missing = [F.sum(flag(F.col(c).isNull())) for c in numeric]
    cells = F.count(F.lit(1)) * len(numeric)
    total = F.lit(0)
    for m in missing:
        total = total + m
    from_data = [check_row("share_of_missing_values", F.try_divide(total, cells), "<", max_missing)]
    for c, (lo, hi) in (bounds or {}).items():
        if lo is not None:
            from_data.append(check_row(f"min:{c}", F.min(c), ">", lo))
        if hi is not None:
            from_data.append(check_row(f"max:{c}", F.max(c), "<", hi))
    a = report.agg(F.array(*from_report).alias("t")).select(F.inline("t"))
    b = current.agg(F.array(*from_data).alias("t")).select(F.inline("t"))
    return a.unionByName(b)


def test_verdict(tests: DataFrame) -> DataFrame:
    failed = F.when(~F.col("passed"), F.col("name"))
    return tests.agg(
        F.count(F.lit(1)).alias("tests"),
        F.count(failed).alias("failed"),
        F.array_sort(F.collect_list(failed)).alias("failed_tests"),
        F.min("passed").alias("all_passed"),
    )


def last_rows(
    df: DataFrame, keys: Sequence[str], ts: str, n: int = 1000, min_samples: int = 100, tie: Sequence[str] = ()
) -> DataFrame:
    """The newest ``n`` rows per key, for keys that have at least ``min_samples`` rows.

    The rank limit prunes rows before the shuffle, so a hot key does not meet in one task whole.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *tie)
    kept = df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return kept.withColumn("_n", size).filter(F.col("_n") >= min_samples).drop("_rn", "_n")
