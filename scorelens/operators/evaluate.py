"""Quality of scores against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.binned import sketched_borders, with_bins
from scorelens.functions.running import ROWS_PER_SLICE, join_keys, running_totals, value_bounds, with_slice
from scorelens.operators.lookups import metric_comparison
from scorelens.operators.predlog import flag

#: Bins of scores of the approximate areas.
SCORE_BINS = 1_000


def _safe(num: Column, den: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*keys).agg(
        F.sum(flag(~y & ~p)).alias("tn"),
        F.sum(flag(~y & p)).alias("fp"),
        F.sum(flag(y & ~p)).alias("fn"),
        F.sum(flag(y & p)).alias("tp"),
    )


def classification_metrics(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion.select(
        *keys,
        _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + tn + fp + fn).alias("samples"),
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then the macro and the weighted average.

    Label and prediction are counted together once; the rest works on classes x classes counts.
    """
    pairs = (
        df.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    roles = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("y").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("called"),
                    F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("called"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    sums = roles.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    hit, called, support = F.col("hit"), F.col("called"), F.col("support")
    per_class = sums.select(
        "class",
        _safe(hit, called).alias("precision"),
        _safe(hit, support).alias("recall"),
        _safe(2 * hit, called + support).alias("f1"),
        "support",
    )
    names = ("precision", "recall", "f1")
    macro = per_class.agg(
        F.lit("macro avg").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")
    )
    weighted = per_class.agg(
        F.lit("weighted avg").alias("class"),
        *[_safe(F.sum(F.col(n) * support), F.sum(support)).alias(n) for n in names],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(macro).unionByName(weighted)


def score_curve(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Per key and distinct score: positives and negatives there, cumulative from the top, in total."""
    keys = list(keys)
    src = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("score"), (F.col(label) == 1).alias("_pos")
    )
    bounds = value_bounds(src, "score", rows_per_slice)
    counts = src.groupBy(*keys, "score").agg(
        F.sum(flag(F.col("_pos"))).alias("pos"), F.sum(flag(~F.col("_pos"))).alias("neg")
    )
    sliced = with_slice(counts, "score", bounds) if bounds else counts
    return running_totals(
        sliced,
        keys,
        [F.col("score").desc()],
        ["pos", "neg"],
        slice_col="_slice" if bounds else None,
        slice_desc=True,
    )


def area_metrics(
    df: DataFrame,
    label: str,
    score: str,
    keys: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    approximate: int | None = None,
) -> DataFrame:
    """Exact ROC-AUC (ties count half) and PR-AUC as step-wise average precision.

    ``approximate`` is a number of bins: ``binned_areas`` then stands in, which has columns with bounds of the error.
    """
    if approximate:
        return binned_areas(df, label, score, keys, approximate)
    curve = score_curve(df, label, score, keys, rows_per_slice)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos = F.col("cum_pos").cast("double")
    roc = neg * (cum_pos - pos / 2)
    step = pos * cum_pos / (F.col("cum_pos") + F.col("cum_neg"))
    total_pos, total_neg = F.max("tot_pos").cast("double"), F.max("tot_neg").cast("double")
    return curve.groupBy(*keys).agg(
        F.try_divide(F.sum(roc), total_pos * total_neg).alias("roc_auc"),
        F.try_divide(F.sum(step), total_pos).alias("pr_auc"),
    )


def binned_areas(
    df: DataFrame,
    label: str,
    score: str,
    keys: Sequence[str] = (),
    bins: int = SCORE_BINS,
    borders: Sequence[float] | None = None,
) -> DataFrame:
    """ROC-AUC and PR-AUC over scores in bins, each with a bound of its error.

    Positives and negatives that share a bin count as ties. Of the ROC area that is wrong by half of their pairs at
    most; of the PR area by what the precision can change inside the bin, whatever their order there.
    """
    keys = list(keys)
    src = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("score"), (F.col(label) == 1).alias("_pos")
    )
    borders = sketched_borders(src, ["score"], bins)["score"] if borders is None else borders
    counts = (
        with_bins(src, {"score": borders})
        .groupBy(*keys, F.coalesce("score_bin", F.lit(len(borders) + 1)).alias("bin"))
        .agg(F.sum(flag(F.col("_pos"))).alias("pos"), F.sum(flag(~F.col("_pos"))).alias("neg"))
    )
    ranked = running_totals(counts, keys, [F.col("bin").desc()], ["pos", "neg"])
    pos, neg, cum_pos, cum_neg = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    used = cum_pos / (cum_pos + cum_neg)
    most = F.coalesce(F.try_divide(cum_pos, cum_pos + cum_neg - neg), F.lit(1.0))
    least = F.coalesce(F.try_divide(cum_pos - pos, cum_pos - pos + cum_neg), F.lit(0.0))
    total_pos, pairs = F.max("tot_pos").cast("double"), F.max("tot_pos").cast("double") * F.max("tot_neg")
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(neg * (cum_pos - pos / 2)), pairs).alias("roc_auc"),
        F.try_divide(F.sum(pos * neg / 2), pairs).alias("roc_auc_error"),
        F.try_divide(F.sum(pos * used), total_pos).alias("pr_auc"),
        F.try_divide(F.sum(pos * F.greatest(most - used, used - least)), total_pos).alias("pr_auc_error"),
    )


def evaluation(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), threshold: float = 0.5, **kw
) -> DataFrame:
    """Threshold metrics and areas per key, in wide form."""
    keys = list(keys)
    called = df.withColumn("_called", (F.col(score) > threshold).cast("int"))
    point = classification_metrics(confusion_matrix(called, label, "_called", keys), keys)
    areas = area_metrics(df, label, score, keys, **kw)
    if keys:
        return join_keys(point, areas, keys)
    area = areas.select(F.struct("roc_auc", "pr_auc").alias("a")).scalar()
    return point.select("*", area["roc_auc"].alias("roc_auc"), area["pr_auc"].alias("pr_auc"))


def metrics_long(wide: DataFrame, keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    names = names or [c for c in wide.columns if c not in keys and c != "samples"]
    return wide.unpivot(list(keys), list(names), "metric", "value")


def score_agreement(
    df: DataFrame, a: str, b: str, keys: Sequence[str] = (), tolerance: float = 1e-4
) -> DataFrame:
    """Distance of two score columns; they agree when the mean distance is under the tolerance."""
    diff = F.col(a) - F.col(b)
    mae = F.avg(F.abs(diff))
    return df.groupBy(*keys).agg(
        mae.alias("mae"),
        F.max(F.abs(diff)).alias("max_abs_diff"),
        F.avg(diff * diff).alias("mse"),
        (mae < tolerance).alias("agrees"),
    )


# Fixed value: metrics on which a challenger is compared.
COMPARED = ("accuracy", "roc_auc", "f1")


def champion_challenger(
    champion: DataFrame, challenger: DataFrame, threshold: float = 0.01, compared: Sequence[str] = COMPARED
) -> DataFrame:
    """Difference per metric and the verdict. Both inputs are ``(metric, value)`` rows.

    The challenger is better when any metric gains more than the threshold, or when there is nothing
    to compare it with. Deployment stops when it is not better and every gain is under the threshold.
    """
    pairs = metric_comparison(champion, challenger).filter(F.col("metric").isin(*compared))
    diff = F.col("current") - F.col("reference")
    wide = pairs.agg(
        F.count(F.lit(1)).alias("compared_metrics"),
        *[F.max(F.when(F.col("metric") == m, diff)).alias(f"{m}_diff") for m in compared],
        F.max(diff).alias("best_gain"),
    )
    better = F.coalesce(F.col("best_gain") > threshold, F.lit(True))
    stop = ~better & (F.col("best_gain") < threshold)
    return wide.select("*", better.alias("is_better"), (~stop).alias("deploy")).drop("best_gain")
