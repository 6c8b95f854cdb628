"""Counts of values in bins made before any shuffle, for measures over columns with very many distinct values.

Borders come from a mergeable quantile sketch, one aggregate for all columns, so bins hold about equal numbers of rows;
a value that comes very often begins a bin. A bin is closed below and open above. Each task sends at most a row per
bin, whatever the number of distinct values, and what is computed at the end of a bin is exact there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank error of a border, in bins.
SKETCH_ROWS_PER_BIN = 10


def sketched_borders(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Inner borders of ``bins`` bins per numeric column; NULL and NaN are left out."""
    marks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(
        *[
            F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), marks, SKETCH_ROWS_PER_BIN * bins).alias(c)
            for c in columns
        ]
    ).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def with_bins(df: DataFrame, borders: Mapping[str, Sequence[float]], suffix: str = "_bin") -> DataFrame:
    """Add the number of the bin of each column, from 0, by binary search; NULL and NaN get NULL."""
    infinite = float("inf")
    out = df.withColumns({f"_{c}_number": F.col(c).cast("double") for c in borders})
    cut = [c for c in borders if borders[c]]
    if cut:
        out = Bucketizer(
            splitsArray=[[-infinite, *sorted(borders[c]), infinite] for c in cut],
            inputCols=[f"_{c}_number" for c in cut],
            outputCols=[f"{c}{suffix}" for c in cut],
            handleInvalid="keep",
        ).transform(out)
    out = out.withColumns({f"{c}{suffix}": F.lit(0) for c in borders if not borders[c]})
    known = {}
    for c in borders:
        number = F.col(f"_{c}_number")
        known[f"{c}{suffix}"] = F.when(number.isNotNull() & ~F.isnan(number), F.col(f"{c}{suffix}").cast("int"))
    return out.withColumns(known).drop(*[f"_{c}_number" for c in borders])
