"""Last step of a registered query: rounded doubles, timestamps as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns a negative zero into a plain one.
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of the rounding."""
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def t(expr: str, name: str) -> str:
    """SQL twin of the timestamp text."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"
