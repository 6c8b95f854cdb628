"""Fit on one table, transform any other. A fit is a few aggregates; a transform is a projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.columns import fill_default, hash_bucket
from scorelens.functions.quantiles import grouped_quantiles
from scorelens.functions.running import running_totals
from scorelens.operators import rows as P
from scorelens.operators.quality import category_counts, per_column, unpivot_numeric
from scorelens.roles import Roles
from scorelens.session import SMALL_ROWS, collect_small, cut_lineage

Step = tuple[str, Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class NumericFit:
    mean: float
    std: float
    median: float

    @property
    def scale(self) -> float:
        """A column without spread is left unscaled."""
        return self.std if self.std else 1.0


@dataclass(frozen=True)
class WideLevels:
    """Levels of a column that has too many for a list: a table (level, code), codes 0..n-1 in sorted order."""

    n: int
    codes: DataFrame


@dataclass(frozen=True)
class FittedPrep:
    """Statistics of a fit. Levels are sorted; the first one is the dropped level of an encoding.

    A column of few levels has a list of them in ``levels`` and an indicator column for each. One of more levels has
    its codes in a table, ``wide``, and the same indicators as one sparse vector, ``<column>_onehot``.
    """

    numeric: dict[str, NumericFit] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    wide: dict[str, WideLevels] = field(default_factory=dict)

    # -- expressions

    def filled(self, c: str) -> Column:
        if c in self.numeric:
            return fill_default(c, self.numeric[c].median)
        return F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))

    def scaled(self, c: str, impute: bool = True) -> Column:
        fit = self.numeric[c]
        value = self.filled(c) if impute else F.col(c).cast("double")
        return (value - F.lit(fit.mean)) / F.lit(fit.scale)

    def unscaled(self, c: str) -> Column:
        fit = self.numeric[c]
        return F.col(c) * F.lit(fit.scale) + F.lit(fit.mean)

    def indicators(self, c: str, drop_first: bool = True, impute: bool = True) -> dict[str, Column]:
        """One column per level. An unknown level gives zeros everywhere."""
        value = self.filled(c) if impute else F.col(c).cast("string")
        levels = self.levels[c][1:] if drop_first else self.levels[c]
        return {f"{c}_{v}": F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in levels}

    def with_vectors(
        self,
        df: DataFrame,
        columns: Sequence[str],
        drop_first: bool = True,
        impute: bool = True,
        valid: Column | None = None,
    ) -> DataFrame:
        """Add ``<column>_onehot`` for wide columns; an unknown level, or a row that is not ``valid``, gives zeros.

        Codes come by a join on the level, broadcast only where their table is small; the vector is Spark's encoder
        over them, which needs no more than the number of levels.
        """
        columns = [c for c in columns if c in self.wide]
        if not columns:
            return df
        have = df.columns
        sizes = {c: self.wide[c].n - (1 if drop_first else 0) for c in columns}
        for c in columns:
            value = self.filled(c) if impute else F.col(c).cast("string")
            if valid is not None:
                value = F.when(valid, value)
            codes = self.wide[c].codes.select(
                F.col("level").alias(f"_{c}_level"), F.col("code").alias(f"_{c}_code")
            )
            keyed = df.withColumn(f"_{c}_value", value)
            df = keyed.join(codes, F.col(f"_{c}_value") == F.col(f"_{c}_level"), "left")
            place = F.col(f"_{c}_code") - (1 if drop_first else 0)
            df = df.withColumn(f"_{c}_index", F.when(place >= 0, place).otherwise(sizes[c]).cast("double"))
        encoder = _encoder(df.sparkSession, sizes)
        return encoder.transform(df).select(*have, *[f"{c}_onehot" for c in columns])

    # -- tables

    @property
    def categorical(self) -> list[str]:
        return list(dict.fromkeys([*self.modes, *self.levels, *self.wide]))

    def feature_names(self, drop_first: bool = True) -> list[str]:
        """Columns of ``transform``; a wide column counts as one, a vector."""
        names = [*self.numeric]
        for c in self.categorical:
            if c in self.wide:
                names.append(f"{c}_onehot")
            else:
                names += [f"{c}_{v}" for v in self._kept(c, drop_first)]
        return names

    def _kept(self, c: str, drop_first: bool) -> list[str]:
        return self.levels.get(c, [])[1:] if drop_first else self.levels.get(c, [])

    def named_positions(self, spark: SparkSession, drop_first: bool = True) -> DataFrame:
        """(position, feature): the name of every element of ``vectors``, the levels of wide columns too."""
        at, listed, tables = 0, [], []
        for c in self.categorical:
            if c in self.wide:
                tables.append((c, len(self.numeric) + at))
                at += self.wide[c].n - (1 if drop_first else 0)
            else:
                for v in self._kept(c, drop_first):
                    listed.append((len(self.numeric) + at, f"{c}_{v}"))
                    at += 1
        listed = [*enumerate(self.numeric), *listed]
        out = spark.createDataFrame(listed, "position INT, feature STRING")
        first = 1 if drop_first else 0
        for c, start in tables:
            codes = self.wide[c].codes.filter(F.col("code") >= first)
            out = out.unionByName(
                codes.select(
                    (F.col("code") + (start - first)).cast("int").alias("position"),
                    F.concat(F.lit(f"{c}_"), "level").alias("feature"),
                )
            )
        return out

    def transform(
        self, df: DataFrame, keep: Sequence[str] = (), drop_first: bool = True, valid: Column | None = None
    ) -> DataFrame:
        """Impute, encode and scale: ``keep`` columns followed by ``feature_names``. Rows not ``valid`` get zeros."""

        def checked(e: Column) -> Column:
            return e if valid is None else F.when(valid, e).otherwise(F.lit(0.0))

        df = self.with_vectors(df, list(self.wide), drop_first, valid=valid)
        cols = [checked(self.scaled(c)).alias(c) for c in self.numeric]
        for c in self.categorical:
            if c in self.wide:
                cols.append(F.col(f"{c}_onehot"))
            elif c in self.levels:
                cols += [checked(e).alias(n) for n, e in self.indicators(c, drop_first).items()]
        return df.select(*keep, *cols)

    def vectors(self, df: DataFrame, keep: Sequence[str] = (), drop_first: bool = True) -> DataFrame:
        names = self.feature_names(drop_first)
        assembled = VectorAssembler(inputCols=names, outputCol="features").transform(
            self.transform(df, keep, drop_first)
        )
        return assembled.select(*keep, "features")

    # -- storage

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for i, (c, n) in enumerate(self.numeric.items()):
            rows += [("mean", c, i, None, n.mean), ("std", c, i, None, n.std), ("median", c, i, None, n.median)]
        for c, levels in self.levels.items():
            rows += [("level", c, i, v, None) for i, v in enumerate(levels)]
        rows += [("wide", c, i, None, float(x.n)) for i, (c, x) in enumerate(self.wide.items())]
        rows += [("mode", c, i, v, None) for i, (c, v) in enumerate(self.modes.items())]
        return spark.createDataFrame(
            rows, "kind STRING, column STRING, position INT, text STRING, value DOUBLE"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Statistics under ``path``, the codes of wide columns under ``path.levels``, a folder each."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)
        for i, x in enumerate(self.wide.values()):
            x.codes.write.mode("overwrite").parquet(f"{path}.levels/{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPrep":
        stored = spark.read.parquet(path).orderBy("kind", "position", "column").toArrow().to_pylist()
        parts: dict[str, dict[str, float]] = {}
        levels: dict[str, list[str]] = {}
        modes: dict[str, str] = {}
        for row in stored:
            if row["kind"] == "level":
                levels.setdefault(row["column"], []).append(row["text"])
            elif row["kind"] == "mode":
                modes[row["column"]] = row["text"]
            elif row["kind"] != "wide":
                parts.setdefault(row["column"], {})[row["kind"]] = row["value"]
        order = [r["column"] for r in stored if r["kind"] == "mean"]
        tables = {
            r["column"]: WideLevels(
                int(r["value"]), spark.read.schema("level STRING, code INT").parquet(f"{path}.levels/{r['position']}")
            )
            for r in stored
            if r["kind"] == "wide"
        }
        return FittedPrep({c: NumericFit(**parts[c]) for c in order}, levels, modes, tables)


def _encoder(spark: SparkSession, sizes: Mapping[str, int]) -> OneHotEncoderModel:
    """Spark's encoder for ``_<column>_index``, 0 to size - 1; the index ``size`` gives zeros.

    The encoder takes the number of categories from the largest index of what it is fitted to: one row.
    """
    columns = [f"_{c}_index" for c in sizes]
    largest = spark.createDataFrame([tuple(float(n - 1) for n in sizes.values())], ", ".join(f"`{c}` DOUBLE" for c in columns))
    encoder = OneHotEncoder(inputCols=columns, outputCols=[f"{c}_onehot" for c in sizes], handleInvalid="keep")
    return encoder.fit(largest)


def fit_numeric(
    df: DataFrame, columns: Sequence[str], medians: bool = True, **quantile_args
) -> dict[str, NumericFit]:
    """Mean and population deviation in one pass; medians by grouped quantiles where they are needed.

    Without medians the mean stands in for them.
    """
    columns = list(columns)
    if not columns:
        return {}
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    stats = per_column(
        df,
        columns,
        {"mean": lambda c: F.avg(clean[c]), "std": lambda c: F.stddev_pop(clean[c])},
    ).collect()
    if not medians:
        return {r["column"]: NumericFit(r["mean"] or 0.0, r["std"] or 0.0, r["mean"] or 0.0) for r in stats}
    middle = {
        r["column"]: r["median"]
        for r in grouped_quantiles(
            unpivot_numeric(df, columns), ["column"], "value", {"median": 0.5}, **quantile_args
        ).collect()
    }
    return {
        r["column"]: NumericFit(r["mean"] or 0.0, r["std"] or 0.0, middle.get(r["column"]) or 0.0) for r in stats
    }


def fit_levels(
    df: DataFrame, columns: Sequence[str], max_levels: int = SMALL_ROWS
) -> tuple[dict[str, list[str]], dict[str, str], dict[str, WideLevels]]:
    """Sorted levels and most frequent level per column (the smallest one on a tie), and the codes of wide columns.

    A mode is one row per column whatever the number of levels. Columns with more than ``max_levels`` levels have no
    list of them but a table of codes, written once.
    """
    columns = list(columns)
    if not columns:
        return {}, {}, {}
    counts = cut_lineage(category_counts(df, columns).filter("value IS NOT NULL"))
    per_column = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), "value")).alias("mode"), F.count(F.lit(1)).alias("n")
    )
    found = {r["column"]: r for r in per_column.collect()}  # a row per column
    narrow = [c for c in columns if c not in found or found[c]["n"] <= max_levels]
    levels: dict[str, list[str]] = {c: [] for c in narrow}
    if narrow:  # one job for the lists of all columns, each within the limit
        listed = counts.filter(F.col("column").isin(*narrow)).select("column", "value").toArrow()
        for c, value in zip(listed["column"].to_pylist(), listed["value"].to_pylist()):
            levels[c].append(value)
    wide = {
        c: WideLevels(found[c]["n"], cut_lineage(_codes_of(counts, c))) for c in columns if c not in levels
    }
    return {c: sorted(x) for c, x in levels.items()}, {c: found[c]["mode"] for c in columns if c in found}, wide


def _codes_of(counts: DataFrame, column: str) -> DataFrame:
    return level_codes(counts.filter(F.col("column") == column), "value").select("level", F.col("code").cast("int"))


def fit_prep(df: DataFrame, roles: Roles, max_levels: int = SMALL_ROWS) -> FittedPrep:
    have = roles.existing(df)
    levels, modes, wide = fit_levels(df, have.categorical, max_levels)
    return FittedPrep(fit_numeric(df, have.numeric), levels, modes, wide)


def standardise(df: DataFrame, columns: Sequence[str], fit: FittedPrep | None = None) -> DataFrame:
    fit = fit or FittedPrep(fit_numeric(df, columns, medians=False))
    return df.withColumns({c: fit.scaled(c, impute=False) for c in columns})


def inverse_standardise(df: DataFrame, fit: FittedPrep, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: fit.unscaled(c) for c in columns})


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = True,
    fit: FittedPrep | None = None,
    max_levels: int = SMALL_ROWS,
) -> DataFrame:
    """An indicator column per level, in place of the column; unknown levels and NULL give zeros.

    A column with more than ``max_levels`` levels gets the same indicators as one sparse vector, ``<column>_onehot``;
    ``named_positions`` of the fit has the level of each element.
    """
    if fit is None:
        levels, _, wide = fit_levels(df, columns, max_levels)
        fit = FittedPrep(levels=levels, wide=wide)
    rest = [c for c in df.columns if c not in columns]
    df = fit.with_vectors(df, columns, drop_first, impute=False)
    extra = []
    for c in columns:
        if c in fit.wide:
            extra.append(F.col(f"{c}_onehot"))
        else:
            extra += [e.alias(n) for n, e in fit.indicators(c, drop_first, impute=False).items()]
    return df.select(*rest, *extra)


def wide_encoder(columns: Sequence[str]) -> Pipeline:
    """Sparse indicators for columns with many levels; unknown levels give zeros."""
    idx = [f"{c}_index" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(columns), outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep"
            ),
            OneHotEncoder(inputCols=idx, outputCols=[f"{c}_vec" for c in columns], dropLast=True),
        ]
    )


def level_codes(df: DataFrame, column: str, max_rows: int = SMALL_ROWS, splitters: int = 255) -> DataFrame:
    """``(level, code)`` with codes 0..n-1 in sorted order.

    Few levels are numbered in one sort. Otherwise the levels are cut into slices at borders drawn
    from the levels themselves, numbered per slice, and shifted by the size of the earlier slices.
    """
    levels = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    table = collect_small(levels, max_rows)
    spark = df.sparkSession
    if table is not None:
        ordered = sorted(table["level"].to_pylist())
        kind = levels.schema["level"].dataType.simpleString()
        return spark.createDataFrame([(v, i) for i, v in enumerate(ordered)], f"level {kind}, code INT")
    borders = [r["level"] for r in levels.orderBy(F.xxhash64("level")).limit(splitters).collect()]
    marks = F.array(*[F.lit(b) for b in sorted(borders)])
    sliced = levels.select(
        "level", F.lit(1).alias("n"), F.size(F.filter(marks, lambda b: b <= F.col("level"))).alias("_slice")
    )
    ranked = running_totals(sliced, [], ["level"], ["n"], slice_col="_slice")
    return ranked.select("level", (F.col("cum_n") - 1).cast("int").alias("code"))


def label_encode(
    df: DataFrame, column: str, codes: DataFrame | None = None, output: str | None = None
) -> DataFrame:
    """Level number in place of the level. A level the fit has not seen raises."""
    output = output or f"{column}_code"
    codes = codes if codes is not None else level_codes(df, column)
    joined = df.join(codes, F.col(column) == codes["level"], "left").drop("level")
    unseen = F.col(column).isNotNull() & F.col("code").isNull()
    message = F.concat(F.lit(f"unseen level in {column}: "), F.col(column).cast("string"))
    value = F.when(unseen, F.raise_error(message).cast("int")).otherwise(F.col("code"))
    return joined.withColumn(output, value).drop(*(["code"] if output != "code" else []))


def impute(df: DataFrame, roles: Roles, fit: FittedPrep | None = None) -> DataFrame:
    """Median for numbers, most frequent level for categories."""
    fit = fit or fit_prep(df, roles)
    return df.withColumns({c: fit.filled(c) for c in [*fit.numeric, *fit.modes]})


def zscore_outliers(
    df: DataFrame,
    columns: Sequence[str],
    threshold: float = 3.0,
    mode: str = "flag",
    fit: FittedPrep | None = None,
) -> DataFrame:
    """``flag`` adds ``<c>_outlier``; ``clip`` pulls values to the limit; ``drop`` removes the rows."""
    fit = fit or FittedPrep(fit_numeric(df, columns, medians=False))
    far = {c: F.coalesce(F.abs(fit.scaled(c, impute=False)) > threshold, F.lit(False)) for c in columns}
    if mode == "flag":
        return df.withColumns({f"{c}_outlier": e.cast("int") for c, e in far.items()})
    if mode == "drop":
        for e in far.values():
            df = df.filter(~e)
        return df
    if mode == "clip":
        out = {}
        for c in columns:
            n = fit.numeric[c]
            lo, hi = n.mean - threshold * n.scale, n.mean + threshold * n.scale
            v = F.col(c).cast("double")
            out[c] = F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v)
        return df.withColumns(out)
    raise ValueError(f"unknown mode {mode}")


def run_steps(df: DataFrame, steps: Sequence[Step], fit: FittedPrep | None = None, **kw) -> DataFrame:
    """Named steps in order, then the fitted preparation."""
    for _, step in steps:
        df = df.transform(step)
    return fit.transform(df, **kw) if fit is not None else df


def transform_requests(
    requests: DataFrame,
    fit: FittedPrep,
    key: str,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    allowed: Mapping[str, Sequence] | None = None,
    required: Sequence[str] = (),
    unfitted: Sequence[str] = (),
) -> DataFrame:
    """Check, order, encode, impute and scale a batch. An invalid row keeps its place with zeros.

    A text column that the fit does not know, one of ``unfitted``, becomes its bucket of 0 to 999, ``<column>_bucket``;
    a NULL counts as the text ``missing``.
    """
    numeric = list(fit.numeric)
    flags = [
        *P.required_flags(required),
        *P.type_flags(numeric),
        *P.range_flags(ranges or {}),
        *P.allowed_flags(allowed or {}),
    ]
    checked = P.with_errors(requests, flags)
    numbers = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric}
    valid = F.size("errors") == 0
    buckets = {
        f"{c}_bucket": F.when(valid, hash_bucket(F.coalesce(F.col(c).cast("string"), F.lit("missing")))).otherwise(0)
        for c in unfitted
    }
    ready = checked.withColumns(numbers | {n: b.cast("double") for n, b in buckets.items()})
    known = fit.transform(ready, keep=[key, "errors", *buckets], valid=valid)
    return known.select(key, "errors", *fit.feature_names(), *buckets)
