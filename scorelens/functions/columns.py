"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(c: str | Column, mapping: Mapping) -> Column:
    """Value map; a value without an entry becomes NULL."""
    expr = F.lit(None)
    for old, new in mapping.items():
        expr = F.when(col(c) == F.lit(old), F.lit(new)).otherwise(expr)
    return expr


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL, not an error, for a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def guarded_ratio(num: str | Column, den: str | Column) -> Column:
    return col(num).cast("double") / F.greatest(col(den).cast("double"), F.lit(1.0))


def bin_right(
    c: str | Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False
) -> Column:
    """Right-closed bands. The lowest edge is outside the first band unless ``include_lowest``."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    expr = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        above = col(c) >= edges[i] if include_lowest and i == 0 else col(c) > edges[i]
        expr = F.when(above & (col(c) <= edges[i + 1]), F.lit(labels[i])).otherwise(expr)
    return expr


def threshold_class(p: str | Column, t: float = 0.5, inclusive: bool = False) -> Column:
    return ((col(p) >= t) if inclusive else (col(p) > t)).cast("int")


def risk_level(
    p: str | Column,
    cuts: Sequence[float] = (0.3, 0.6),
    labels: Sequence[str] = ("low", "medium", "high"),
) -> Column:
    """Band of a default probability. The cut-offs are ours and are arguments."""
    expr = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        expr = F.when(col(p) < cut, F.lit(label)).otherwise(expr)
    return F.when(col(p).isNotNull(), expr)


def hash_bucket(c: str | Column, buckets: int = 1000) -> Column:
    """Stable bucket for a category that the fit has not seen: the first 32 bits of its MD5, so other tools agree."""
    head = F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("long")
    return (head % F.lit(buckets)).cast("int")


def fill_default(c: str | Column, default: float) -> Column:
    """NULL and NaN both become the default."""
    return F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(default)))


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def score_text(score: str | Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", col(score).cast("double"))


def stamp(ts: str | Column, compact: bool = False) -> Column:
    return F.date_format(col(ts), "yyyyMMdd_HHmmss" if compact else "yyyy-MM-dd'T'HH:mm:ss")


def row_ids(batch: str | Column, index: str | Column) -> Column:
    return F.concat_ws("_", col(batch).cast("string"), col(index).cast("string"))


def derived_id(*parts: str | Column) -> Column:
    """A repeatable id; use ``F.uuid()`` when a retry may give a new one."""
    return F.lower(F.hex(F.xxhash64(*[col(p) for p in parts])))


def days_since(earlier: str | Column, later: str | Column) -> Column:
    return F.timestamp_diff("DAY", col(earlier).cast("timestamp"), col(later).cast("timestamp"))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def moment(df: DataFrame, ts: str, when: datetime) -> Column:
    """``when`` as a literal of the column's own type, so that the comparison reaches the scan."""
    return F.lit(when).cast(df.schema[ts].dataType)


def since(df: DataFrame, ts: str, as_of: datetime, half_open: bool = True, **span: float) -> DataFrame:
    """Rows of the last ``span`` (``hours=24``, ``days=7``) before ``as_of``."""
    out = df.filter(F.col(ts) >= moment(df, ts, as_of - timedelta(**span)))
    return out.filter(F.col(ts) < moment(df, ts, as_of)) if half_open else out
