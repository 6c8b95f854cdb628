"""Validation of an application table. Checks share one pass over the data where they can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelens.functions.quantiles import grouped_quantiles
from scorelens.functions.running import join_keys
from scorelens.operators.predlog import flag
from scorelens.operators.ranking import top_k
from scorelens.session import pin_small

# Ranges and category lists of the application table, limits of the checks.
NUMERIC_RANGES = {
    "age": (18, 100),
    "income": (0, 1_000_000),
    "credit_amount": (0, 100_000),
    "loan_duration": (1, 120),
}
OUT_OF_RANGE_ERROR = 5.0
BAD_CATEGORY_ERROR = 1.0
OUTLIER_WARNING = 5.0
IMBALANCE_WARNING = 40.0


def _is_blank(df: DataFrame, c: str) -> Column:
    """NULL, and NaN where the type has one."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def per_column(df: DataFrame, columns: Sequence[str], parts: Mapping[str, object], extra=()) -> DataFrame:
    """One pass over ``df``, then one row per column.

    ``parts`` maps an output name to a function from column name to aggregate; ``extra`` holds
    (name, aggregate) pairs that are the same for every column.
    """
    aggs = [fn(c).alias(f"{i}_{p}") for i, c in enumerate(columns) for p, fn in parts.items()]
    wide = df.agg(*aggs, *[a.alias(f"x_{n}") for n, a in extra])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{i}_{p}").alias(p) for p in parts],
            *[F.col(f"x_{n}").alias(n) for n, _ in extra],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent per column."""
    columns = list(columns or df.columns)
    out = per_column(
        df,
        columns,
        {"missing_count": lambda c: F.sum(flag(_is_blank(df, c)))},
        [("rows", F.count(F.lit(1)))],
    )
    return out.select(
        "column", "missing_count", (F.col("missing_count") * 100.0 / F.col("rows")).alias("missing_percent")
    )


def null_totals(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.sum("missing_count").alias("total_missing"),
        F.max("missing_percent").alias("max_missing_percent"),
        F.sum(flag(F.col("missing_percent") > 0)).alias("columns_with_missing"),
    )


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per column with a violation: actual limits, count, percent, and whether it is an error."""
    have = [c for c in ranges if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)]

    def outside(c: str) -> Column:
        lo, hi = ranges[c]
        return (F.col(c) < lo) | (F.col(c) > hi)

    out = per_column(
        df,
        have,
        {
            "min_allowed": lambda c: F.max(F.lit(float(ranges[c][0]))),
            "max_allowed": lambda c: F.max(F.lit(float(ranges[c][1]))),
            "actual_min": lambda c: F.min(c).cast("double"),
            "actual_max": lambda c: F.max(c).cast("double"),
            "violations_count": lambda c: F.sum(flag(outside(c))),
        },
        [("rows", F.count(F.lit(1)))],
    )
    percent = F.col("violations_count") * 100.0 / F.col("rows")
    return out.filter("violations_count > 0").select(
        "column",
        "min_allowed",
        "max_allowed",
        "actual_min",
        "actual_max",
        "violations_count",
        percent.alias("violation_percent"),
        F.when(percent > OUT_OF_RANGE_ERROR, "error").otherwise("warning").alias("severity"),
    )


def range_examples(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]], order: Sequence[str], k: int = 5
) -> DataFrame:
    """The first ``k`` values outside the range per column, in the stated order."""
    have = [c for c in ranges if c in df.columns]
    hits = [
        F.when(
            (F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1]),
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")),
        )
        for c in have
    ]
    rows = df.select(*order, F.explode(F.array_compact(F.array(*hits))).alias("_h"))
    flat = rows.select(F.col("_h.column").alias("column"), F.col("_h.value").alias("value"), *order)
    return top_k(flat, ["column"], [*order, "value"], k, rank="example")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` over several text columns, NULL values included."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], list(columns), "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def category_violations(
    df: DataFrame, allowed: Mapping[str, Sequence[str]], nulls_invalid: bool = False
) -> DataFrame:
    """Values outside the list per column. A NULL is invalid only with ``nulls_invalid``.

    One pass: rows outside the list are counted without a shuffle of the table; only the distinct
    invalid values are grouped.
    """
    have = [c for c in allowed if c in df.columns]

    def bad(c: str) -> Column:
        outside = ~F.col(c).isin(*allowed[c])
        return F.coalesce(outside, F.lit(nulls_invalid))

    hits = [
        F.when(bad(c), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
        for c in have
    ]
    invalid = (
        df.select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
        .groupBy(F.col("h.column").alias("column"), F.col("h.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The number of rows comes from the files' metadata where no filter stands before it.
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = invalid.groupBy("column").agg(
        F.count(F.lit(1)).alias("invalid_values"), F.sum("n").alias("invalid_count")
    )
    percent = F.col("invalid_count") * 100.0 / total
    return per.select("column", "invalid_values", "invalid_count", percent.alias("invalid_percent")).select(
        "*", F.when(F.col("invalid_percent") > BAD_CATEGORY_ERROR, "error").otherwise("warning").alias("severity")
    )


def target_checks(df: DataFrame, target: str, allowed: Sequence = (0, 1)) -> DataFrame:
    """Invalid and missing targets, class counts, and the gap of the two class percentages.

    A missing target is invalid as well. The gap is defined for two classes only.
    """
    y = F.col(target)
    counts = df.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("y").isNotNull()
    n = F.when(seen, F.col("n"))
    gap = F.when(F.count(n) == 2, (F.max(n) - F.min(n)) * 100.0 / F.sum(n))
    return counts.agg(
        F.coalesce(F.sum(F.when(~seen | ~F.col("y").isin(*allowed), F.col("n"))), F.lit(0)).alias(
            "invalid_target"
        ),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("missing_target"),
        F.count(n).alias("classes"),
        gap.alias("class_imbalance"),
    ).select(
        "*", F.coalesce(F.col("class_imbalance") > IMBALANCE_WARNING, F.lit(False)).alias("imbalanced")
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each set of identical rows; NULLs are equal to each other."""
    columns = list(columns or df.columns)
    sets = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    extra = rows - F.count(F.lit(1))
    return sets.agg(
        rows.alias("rows"), extra.alias("duplicates"), F.try_divide(extra * 100.0, rows).alias("duplicate_percent")
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct value, NULLs left out: the smallest equals the largest."""
    columns = list(columns or df.columns)
    out = per_column(
        df, columns, {"constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True))}
    )
    return out.filter("constant").select("column")


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., column, value)`` with NULL and NaN left out."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(list(keep), list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5, **quantile_args) -> DataFrame:
    """Values beyond ``k`` quartile distances per numeric column.

    Quartiles come from one grouped quantile over all columns; the fences (one row per column) then
    serve a second pass that only counts.
    """
    columns = list(columns)
    long = unpivot_numeric(df, columns)
    quartiles = grouped_quantiles(long, ["column"], "value", {"q1": 0.25, "q3": 0.75}, **quantile_args)
    spread = F.col("q3") - F.col("q1")
    fences = quartiles.select(
        "column", (F.col("q1") - k * spread).alias("lower_bound"), (F.col("q3") + k * spread).alias("upper_bound")
    )
    limits = fences.agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct("lower_bound", "upper_bound")))
        ).alias("m")
    ).scalar()

    def outside(c: str) -> Column:
        lim = F.element_at(limits, F.lit(c))
        v = F.col(c).cast("double")
        return ~F.isnan(v) & ((v < lim["lower_bound"]) | (v > lim["upper_bound"]))

    counts = per_column(
        df, columns, {"count": lambda c: F.sum(flag(outside(c)))}, [("rows", F.count(F.lit(1)))]
    )
    percent = F.col("count") * 100.0 / F.col("rows")
    return (
        join_keys(counts, fences, ["column"])
        .filter("count > 0")
        .select(
            "column",
            "count",
            percent.alias("percent"),
            "lower_bound",
            "upper_bound",
            (percent > OUTLIER_WARNING).alias("warn"),
        )
    )


def structure_checks(df: DataFrame, target: str, min_samples: int = 100) -> DataFrame:
    return df.agg(
        (F.count(F.lit(1)) >= min_samples).alias("min_samples"),
        F.max(F.lit(target in df.columns)).alias("has_target_column"),
        F.max(F.lit(len(df.columns) > 1)).alias("has_features"),
    )


def _rows(df: DataFrame, check: Column, severity: Column, passed: Column | None = None) -> DataFrame:
    """Check rows. ``passed`` is NULL for findings that raise a message but are not scored."""
    ok = F.lit(None).cast("boolean") if passed is None else passed
    return df.select(check.alias("check"), ok.alias("passed"), severity.alias("severity"))


def column_facts(
    df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Row count, missing values, constancy and range violations of every column, in one pass."""
    ranges = ranges or {}

    def outside(c: str) -> Column:
        if c not in ranges or not isinstance(df.schema[c].dataType, T.NumericType):
            return F.lit(False)
        return (F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1])

    return per_column(
        df,
        df.columns,
        {
            "missing": lambda c: F.sum(flag(_is_blank(df, c))),
            "constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True)),
            "outside": lambda c: F.sum(flag(outside(c))),
        },
        [("rows", F.count(F.lit(1)))],
    )


def validate(
    df: DataFrame,
    target: str,
    numeric: Sequence[str] = (),
    ranges: Mapping[str, tuple[float, float]] | None = None,
    allowed: Mapping[str, Sequence[str]] | None = None,
    min_samples: int = 100,
    max_missing_percent: float = 5.0,
) -> DataFrame:
    """All checks as rows ``(check, passed, severity)``; severity is NULL, ``warning`` or ``error``.

    Structure, missing values, ranges and constant columns come from one pass, pinned as one row per
    column; target, categories, duplicates and outliers each read only what they need.
    """
    none = F.lit(None).cast("string")
    facts = pin_small(column_facts(df, ranges))
    share = F.col("missing") * 100.0 / F.col("rows")
    has_target = target in df.columns
    many = F.max("rows") >= min_samples
    complete = F.coalesce(F.max(share) <= max_missing_percent, F.lit(True))

    def scored(name: str, passed: Column, severity: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), severity.alias("severity"))

    basic = facts.agg(
        F.array(
            scored("min_samples", many, F.when(~many, "warning")),
            # A missing target is an error here and a warning of the target section.
            scored("has_target_column", F.lit(has_target), none if has_target else F.lit("error")),
            scored("has_features", F.lit(len(df.columns) > 1), none),
            scored("missing_values", complete, none),
        ).alias("c")
    ).select(F.inline("c"))
    outside = F.col("outside") * 100.0 / F.col("rows")
    constant = facts.filter("constant").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    parts = [
        basic,
        _rows(
            facts.filter("missing > 0"),
            F.concat(F.lit("missing:"), F.col("column")),
            F.when(share > max_missing_percent, "error").otherwise("warning"),
        ),
        _rows(
            facts.filter("outside > 0"),
            F.concat(F.lit("range:"), F.col("column")),
            F.when(outside > OUT_OF_RANGE_ERROR, "error").otherwise("warning"),
        ),
        _rows(constant, F.lit("constant_columns"), F.lit("warning")),
    ]
    if has_target:
        tc = pin_small(target_checks(df, target))
        whole = F.col("missing_target") == 0
        parts += [
            _rows(tc, F.lit("target_present"), none, F.lit(True)),
            _rows(tc, F.lit("target_complete"), F.when(~whole, "error"), whole),
            _rows(tc.filter("invalid_target > 0"), F.lit("target_values"), F.lit("error")),
            _rows(tc.filter("imbalanced"), F.lit("target_balance"), F.lit("warning")),
        ]
    else:
        parts.append(_rows(facts.limit(1), F.lit("target_absent"), F.lit("warning")))
    if allowed:
        bad = category_violations(df, allowed)
        parts.append(_rows(bad, F.concat(F.lit("category:"), F.col("column")), F.col("severity")))
    parts.append(_rows(duplicate_rows(df).filter("duplicates > 0"), F.lit("duplicates"), F.lit("warning")))
    if numeric:
        far = iqr_outliers(df, numeric).filter("warn")
        parts.append(_rows(far, F.concat(F.lit("outliers:"), F.col("column")), F.lit("warning")))
    return reduce(DataFrame.unionByName, parts)


def validation_summary(checks: DataFrame) -> DataFrame:
    """Score over the scored checks, and the verdict: valid when nothing is an error."""
    total, passed = F.count("passed"), F.sum(flag(F.col("passed")))
    errors = F.sum(flag(F.col("severity") == "error"))
    return checks.agg(
        total.alias("total_checks"),
        passed.alias("passed_checks"),
        F.coalesce(F.try_divide(passed * 100.0, total), F.lit(0.0)).alias("validation_score"),
        errors.alias("error_count"),
        F.sum(flag(F.col("severity") == "warning")).alias("warning_count"),
        (errors == 0).alias("is_valid"),
        F.when(errors == 0, "PASS").otherwise("FAIL").alias("overall_status"),
    )


def training_gate(
    df: DataFrame,
    target: str,
    min_samples: int = 1000,
    balance_threshold: float = 0.3,
    max_missing_percent: float = 5.0,
) -> DataFrame:
    """Whether a table may be trained on. Only the row count blocks; the others are warnings.

    Class counts and NULL counts come from one grouped pass over the target.
    """
    cols = list(df.columns)
    per_class = df.groupBy(F.col(target).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(flag(_is_blank(df, c))).alias(f"_m{i}") for i, c in enumerate(cols)],
    )
    n = F.when(F.col("_y").isNotNull(), F.col("_n"))
    rows = F.sum("_n")
    worst = F.greatest(*[F.sum(f"_m{i}") for i in range(len(cols))]) if len(cols) > 1 else F.sum("_m0")
    out = per_class.agg(
        rows.alias("rows"),
        (F.min(n) / F.max(n)).alias("class_ratio"),
        (worst * 100.0 / rows).alias("max_missing_percent"),
    )
    return out.select(
        "rows",
        "class_ratio",
        "max_missing_percent",
        (F.col("rows") >= min_samples).alias("enough_rows"),
        (F.col("class_ratio") >= balance_threshold).alias("balanced"),
        (F.col("max_missing_percent") <= max_missing_percent).alias("complete"),
        (F.col("rows") >= min_samples).alias("may_train"),
    )
