"""Fit, search, score and inspect classifiers with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from scorelens.operators.sets import append_new
from scorelens.operators.split import stratified_split
from scorelens.session import cut_lineage

# Default parameters of the forest and hidden layers of the network.
FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 42}
HIDDEN_LAYERS = (128, 64, 32)


def _network(n_features: int, hidden: Sequence[int] = HIDDEN_LAYERS, **params: Any):
    """Sigmoid hidden layers with a soft-max output, fitted by L-BFGS; no dropout or normalisation."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], seed=42, **params)


ESTIMATORS: dict[str, Callable[..., Any]] = {
    "random_forest": lambda n, **p: RandomForestClassifier(**{**FOREST, **p}),
    "logistic_regression": lambda n, **p: LogisticRegression(**p),
    "xgboost": lambda n, **p: GBTClassifier(**{"seed": 42, **p}),
    "neural_network": _network,
}


def width(df: DataFrame, features: str = "features") -> int:
    """Number of features: from the column's metadata, else from one row."""
    attrs = df.schema[features].metadata.get("ml_attr", {})
    if "num_attrs" in attrs:
        return int(attrs["num_attrs"])
    return len(df.select(features).first()[0])


def estimator(kind: str, n_features: int, label: str = "label", features: str = "features", **params: Any):
    """Estimator by name; an unknown name means the forest."""
    made = ESTIMATORS.get(kind, ESTIMATORS["random_forest"])(n_features, **params)
    return made.setLabelCol(label).setFeaturesCol(features)


def train(
    df: DataFrame, kind: str = "random_forest", label: str = "label", features: str = "features", **params: Any
) -> Model:
    return estimator(kind, width(df, features), label, features, **params).fit(df)


def score(df: DataFrame, model: Model, keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Probability of the positive class and the class it leads to. Works on a stream as well."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    out = model.transform(df).select(*keep, p.alias("score"))
    return out.withColumn("predicted", (F.col("score") > threshold).cast("int"))


def score_batches(
    df: DataFrame,
    model: bytes,
    load: Callable[[bytes], Callable],
    features: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """Score with any Python model. It is loaded once per task and called once per Arrow batch.

    ``load`` turns the bytes into a function from a float matrix to probabilities.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    features, keep = list(features), list(keep)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("score", T.DoubleType())])

    def run(batches):
        predict = load(held.value)
        for batch in batches:
            out = batch[keep].copy()
            out["score"] = predict(batch[features].to_numpy(dtype="float64"))
            yield out

    return df.select(*keep, *[f for f in features if f not in keep]).mapInPandas(run, schema)


def with_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))


def _search(
    df: DataFrame, key: str, kind: str, grid: Sequence[Mapping[str, Any]], folds: int, parallelism: int, **params: Any
) -> DataFrame:
    """Mean AUC per parameter set over the folds, best first; draws of one score keep their order.

    A set may hold whatever the estimator's builder takes, the layers of a network too. The fold table is written once;
    ``parallelism`` fits run at a time, each a distributed job over it.
    """
    n = width(df)
    stored = cut_lineage(with_folds(df, key, folds))
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")

    def one(task: tuple[int, int]) -> float:
        i, fold = task
        model = estimator(kind, n, **{**params, **grid[i]}).fit(stored.filter(F.col("fold") != fold))
        return evaluator.evaluate(model.transform(stored.filter(F.col("fold") == fold)))

    tasks = [(i, fold) for i in range(len(grid)) for fold in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), tasks))
    aucs = [found[i * folds : (i + 1) * folds] for i in range(len(grid))]
    means = [sum(x) / folds for x in aucs]
    rows = [
        (place, str(dict(grid[i])), means[i], (sum((a - means[i]) ** 2 for a in aucs[i]) / folds) ** 0.5)
        for place, i in enumerate(sorted(range(len(grid)), key=lambda i: -means[i]), 1)
    ]
    return df.sparkSession.createDataFrame(rows, "place INT, params STRING, mean_auc DOUBLE, std_auc DOUBLE")


def cross_validate(df: DataFrame, key: str, kind: str, folds: int = 5, parallelism: int = 4, **params: Any) -> DataFrame:
    return _search(df, key, kind, [{}], folds, parallelism, **params)


def random_search(
    df: DataFrame,
    key: str,
    kind: str,
    space: Mapping[str, Sequence],
    draws: int = 20,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """Random draws from the space, each cross-validated."""
    rng = random.Random(seed)
    grid = [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(draws)]
    return _search(df, key, kind, grid, folds, parallelism)


def feature_importance(df: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    """Tree importances, absolute coefficients, or mean absolute first-layer weights."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        n, hidden = model.getLayers()[0], model.getLayers()[1]
        values = abs(model.weights.toArray()[: n * hidden]).reshape(hidden, n, order="F").mean(axis=0)
    ranked = sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))
    rows = [(i, n, v) for i, (n, v) in enumerate(ranked, 1)]
    return df.sparkSession.createDataFrame(rows, "place INT, feature STRING, importance DOUBLE")


def prepare_retraining(
    old: DataFrame, new: DataFrame | None, target: str, key: str, validation: float = 0.2, **kw: Any
) -> DataFrame:
    """Old and new rows together, split by class into train and validation."""
    data = append_new(old, new) if new is not None else old
    if target not in data.columns:
        raise ValueError(f"target {target} is missing")
    return stratified_split(data, target, key, (("validation", validation),), **kw)
