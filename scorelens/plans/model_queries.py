"""Model fits and scoring. Fits have no SQL form; the tests check their results."""

from __future__ import annotations

import pickle
from datetime import datetime

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scorelens.functions.columns import moment
from scorelens.operators import evaluate as E
from scorelens.operators import models as M
from scorelens.operators.explain import linear_contributions
from scorelens.operators.features import fit_numeric
from scorelens.operators.split import stratified_split
from scorelens.plans.catalog import query
from scorelens.plans.tidy import tidy
from scorelens.roles import Roles
from scorelens.sources.views import CUT, prediction_log, table


def vectors(spark, d):
    """Embeddings with a two-class label."""
    return table(spark, d, "embeddings").select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        (F.col("label") >= 5).cast("double").alias("label"),
    )


def _fit_and_score(spark, d, kind, **params):
    """Fitted on four fifths of each class; the other fifth is scored."""
    df = stratified_split(vectors(spark, d), "label", "vec_id")
    model = M.train(df.filter("split = 'train'").drop("split"), kind, **params)
    return tidy(M.score(df.filter("split = 'test'"), model, ["vec_id", "label"]), 8)


@query("m1_random_forest")
def m1(spark, d):
    return _fit_and_score(spark, d, "random_forest")


@query("m2_logistic_regression")
def m2(spark, d):
    return _fit_and_score(spark, d, "logistic_regression")


@query("m3_boosted_trees")
def m3(spark, d):
    return _fit_and_score(spark, d, "xgboost")


@query("m4_neural_network")
def m4(spark, d):
    return _fit_and_score(spark, d, "neural_network")


@query("m5_train_by_name")
def m5(spark, d):
    """An unknown name falls back to the forest."""
    return _fit_and_score(spark, d, "no_such_model")


def item_features(spark, d):
    """Line items as a wide numeric table; the label is whether the item was returned."""
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


ITEM_FEATURES = ["quantity", "extendedprice", "discount", "tax"]


def fit_items(spark, d):
    from scorelens.operators.features import FittedPrep

    items = item_features(spark, d)
    prep = FittedPrep(fit_numeric(items, ITEM_FEATURES, medians=False))
    return items, prep, M.train(prep.vectors(items, keep=["label"]), "logistic_regression")


@query("m6_score")
def m6(spark, d):
    items, prep, model = fit_items(spark, d)
    rows = prep.vectors(items, keep=["l_orderkey", "l_linenumber", "label"])
    return tidy(M.score(rows, model, ["l_orderkey", "l_linenumber", "label"]), 6)


def load_linear(data: bytes):
    """A plain numpy model: weights and bias through a logistic curve."""
    import numpy as np

    weights = pickle.loads(data)
    w, b = np.asarray(weights["w"]), weights["b"]
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + b)))


PLAIN_MODEL = {"w": [0.02, 0.00003, -1.0, 0.5], "b": -2.0}


@query(
    "m7_score_user_model",
    """SELECT l_orderkey, l_linenumber, round(1.0 / (1.0 + exp(-(l_quantity * 0.02 + l_extendedprice * 0.00003 - l_discount + l_tax * 0.5 - 2.0))), 6) AS score
    FROM lineitem""",
)
def m7(spark, d):
    items = item_features(spark, d)
    out = M.score_batches(
        items, pickle.dumps(PLAIN_MODEL), load_linear, ITEM_FEATURES, ["l_orderkey", "l_linenumber"]
    )
    return tidy(out)


@query("m12_cross_validation")
def m12(spark, d):
    return tidy(M.cross_validate(vectors(spark, d), "vec_id", "logistic_regression", folds=5, regParam=0.1))


@query("m13_random_search")
def m13(spark, d):
    space = {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}
    return tidy(M.random_search(vectors(spark, d), "vec_id", "logistic_regression", space))


@query("m13_network_search")
def m13_network(spark, d):
    """Layers, rounds and step of the network, drawn from lists."""
    space = {"hidden": [(16,), (32,), (32, 16), (16, 8, 8)], "maxIter": [10, 25, 50], "solver": ["l-bfgs", "gd"], "stepSize": [0.03, 0.1]}
    return tidy(M.random_search(vectors(spark, d), "vec_id", "neural_network", space))


@query("m14_feature_importance")
def m14(spark, d):
    df = vectors(spark, d)
    model = M.train(df, "random_forest")
    return tidy(M.feature_importance(df, model, [f"e{i}" for i in range(M.width(df))]))


@query("m15_linear_explanation")
def m15_linear(spark, d):
    """The three strongest contributions per item under the fitted linear model."""
    items, prep, model = fit_items(spark, d)
    # The model works on scaled features, so a coefficient is divided by the feature's spread.
    coefficients = {f: float(c) / prep.numeric[f].scale for f, c in zip(ITEM_FEATURES, model.coefficients)}
    means = {f: prep.numeric[f].mean for f in ITEM_FEATURES}
    return tidy(linear_contributions(items, coefficients, means, 3, keep=["l_orderkey", "l_linenumber"]))


@query(
    "m17_prepare_retraining",
    """WITH k AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS target, CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN o_orderpriority END AS priority,
      (o_orderkey * 2654435761) % 4294967296 AS rk FROM orders),
    c AS (SELECT target, count(*) AS n FROM k GROUP BY 1), q AS (SELECT target, ceil(sum(n) OVER () * 0.2) * n / sum(n) OVER () AS x, ceil(sum(n) OVER () * 0.2) AS tot FROM c),
    z AS (SELECT target, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, CAST(target AS VARCHAR)) <= tot - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS t FROM q)
    SELECT id, k.target, priority, CASE WHEN row_number() OVER (PARTITION BY k.target ORDER BY rk, id) <= t THEN 'validation' ELSE 'train' END AS split FROM k JOIN z ON k.target = z.target""",
)
def m17(spark, d):
    o = table(spark, d, "orders")
    cut = moment(o, "o_orderdate", CUT)
    base = [F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("target")]
    old = o.filter(F.col("o_orderdate") < cut).select(*base, F.col("o_orderpriority").alias("priority"))
    new = o.filter(F.col("o_orderdate") >= cut).select(*base)
    rank = (F.col("id") * F.lit(2654435761)) % F.lit(4294967296)
    return M.prepare_retraining(old, new, "target", "id", 0.2, rank=rank, rank_bits=32)


MONITORED = Roles(
    numeric=("processing_time_ms", "probability"), categorical=("endpoint", "model_version"), target="class"
)


def monitored_sides(spark, d):
    """The log before the last ten days as reference, the last ten days as current."""
    log = prediction_log(spark, d).withColumn("prediction", F.col("probability"))
    cut = moment(log, "created_at", datetime(2024, 1, 21))
    return log.filter(F.col("created_at") < cut), log.filter(F.col("created_at") >= cut)


@query(
    "d28_monitor_inputs",
    """WITH x AS (SELECT ts, event_type = 'error' AS bad, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p FROM events WHERE ts >= TIMESTAMP '2024-01-21')
    SELECT count(*) AS samples, round(avg(CASE WHEN (p > 0.5) = bad THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM x""",
)
def d28_inputs(spark, d):
    """The evaluation inside the monitor, beside its SQL form."""
    _, cur = monitored_sides(spark, d)
    return tidy(E.evaluation(cur, "class", "prediction").select("samples", "accuracy"))
