"""Row-wise features and request checks. Nothing here shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.functions.columns import bin_right, fill_default, ratio, since
from scorelens.roles import Roles

# Age bands, their labels, and the loan purposes that get an indicator.
AGE_EDGES = (18, 25, 35, 50, 65, 100)
AGE_LABELS = ("18-25", "26-35", "36-50", "51-65", "66+")
PURPOSES = ("car", "home", "education", "business")

# Ranges a single scoring request must respect.
REQUEST_RANGES = {
    "age": (18, 100),
    "income": (0, 1_000_000),
    "credit_score": (300, 850),
    "loan_amount": (1_000, 100_000),
    "employment_years": (0, 50),
    "debt_to_income": (0, 1),
}


def select_existing(df: DataFrame, roles: Roles) -> tuple[DataFrame, tuple[str, ...]]:
    have = roles.existing(df)
    return df.select(*have.features, *([have.target] if have.target else [])), have.missing


def ratio_features(
    df: DataFrame, amount: str = "credit_amount", income: str = "income", months: str = "loan_duration"
) -> DataFrame:
    """Debt-to-income and monthly payment, each where both of its inputs exist."""
    have = set(df.columns)
    if {amount, income} <= have:
        df = df.withColumn("debt_to_income_ratio", ratio(amount, income))
    if {amount, months} <= have:
        df = df.withColumn("monthly_payment", ratio(amount, months))
    return df


def age_groups(df: DataFrame, age: str = "age") -> DataFrame:
    if age not in df.columns:
        return df
    return df.withColumn("age_group", bin_right(age, AGE_EDGES, AGE_LABELS))


def sql_features(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in exprs.items()})


def purpose_indicators(df: DataFrame, column: str, values: Sequence[str] = PURPOSES) -> DataFrame:
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values}
    )


def order_features(
    df: DataFrame, names: Sequence[str], default: float = 0.0, keep: Sequence[str] = ()
) -> DataFrame:
    """Numeric features in a fixed order; a missing column or value takes the default."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            (fill_default(n, default) if n in have else F.lit(float(default))).alias(n)
            for n in names
        ],
    )


def range_flags(ranges: Mapping[str, tuple[float, float]]) -> list[Column]:
    out = []
    for c, (lo, hi) in ranges.items():
        v = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        out.append(F.when((v < lo) | (v > hi), F.lit(f"{c} out of range [{lo}, {hi}]")))
    return out


def allowed_flags(allowed: Mapping[str, Sequence]) -> list[Column]:
    return [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(f"{c} has a value outside its list"))
        for c, values in allowed.items()
    ]


def pattern_flags(patterns: Mapping[str, str]) -> list[Column]:
    return [F.when(~F.col(c).rlike(p), F.lit(f"{c} does not match {p}")) for c, p in patterns.items()]


def required_flags(columns: Sequence[str]) -> list[Column]:
    return [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in columns]


def type_flags(columns: Sequence[str]) -> list[Column]:
    return [
        F.when(
            F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull(),
            F.lit(f"{c} must be a number"),
        )
        for c in columns
    ]


def with_errors(df: DataFrame, flags: Sequence[Column], name: str = "errors") -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.withColumn(name, F.array_compact(F.array(*flags)) if flags else empty)


def split_valid_invalid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size(errors) == 0).drop(errors), df.filter(F.size(errors) > 0)


def zero_fill_invalid(df: DataFrame, columns: Sequence[str], errors: str = "errors") -> DataFrame:
    """Batch form: an invalid row stays, with zeros for its features."""
    bad = F.size(errors) > 0
    return df.withColumns({c: F.when(bad, F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in columns})


def window_filter(df: DataFrame, ts: str, as_of: datetime, half_open: bool = True, **span: float) -> DataFrame:
    return since(df, ts, as_of, half_open, **span)


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; one whose value is None is left out."""
    for c, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def slow_operations(df: DataFrame, ms: str, limit_ms: float = 1000.0) -> DataFrame:
    return df.filter(F.col(ms) > limit_ms)


# Fixed value: words that mark a log line as an error.
ERROR_PATTERN = "(?i)error|exception|fail"


def error_lines(
    df: DataFrame, text: str, order: Sequence[str | Column], k: int = 5, pattern: str = ERROR_PATTERN
) -> DataFrame:
    return df.filter(F.col(text).rlike(pattern)).orderBy(*order).limit(k)
