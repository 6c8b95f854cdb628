"""Features, splits, checks and readers on small hand-made tables."""

import hashlib
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scorelens.functions import columns as C
from scorelens.functions.running import numbered
from scorelens.operators import features as E
from scorelens.operators import lookups as J
from scorelens.operators import quality as Q
from scorelens.operators import rows as P
from scorelens.operators import split as X
from scorelens.roles import GERMAN_CREDIT, Roles
from scorelens.session import scratch_path
from scorelens.sources import readers as S
from scorelens.sources import writers as O

ROLES = Roles(("age", "income", "credit_amount"), ("credit_history", "purpose"))
SCHEMA = "age INT, income INT, credit_amount INT, credit_history STRING, purpose STRING"


@pytest.fixture(scope="module")
def train(spark):
    rows = [
        (25, 30000, 5000, "A30", "A40"),
        (35, 40000, 10000, "A31", "A41"),
        (45, 50000, 15000, "A30", "A40"),
        (55, 60000, 20000, "A32", "A42"),
        (65, 70000, 25000, "A31", "A41"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_fit_then_transform(spark, train):
    fit = E.fit_prep(train, ROLES)
    assert fit.levels == {"credit_history": ["A30", "A31", "A32"], "purpose": ["A40", "A41", "A42"]}
    assert fit.modes["credit_history"] == "A30"
    new = spark.createDataFrame([(30, 35000, 7500, "A30", "A40"), (50, 55000, 17500, "A31", "A42")], SCHEMA)
    out = [r.asDict() for r in fit.transform(new).collect()]
    assert list(out[0]) == fit.feature_names() and len(out[0]) == 3 + 2 + 2
    assert out[0]["age"] == pytest.approx((30 - 45) / 200**0.5)
    assert out[1]["purpose_A42"] == 1.0 and out[0]["purpose_A42"] == 0.0


def test_missing_values_are_imputed_and_unknown_level_is_zero(spark, train):
    fit = E.fit_prep(train, ROLES)
    row = fit.transform(spark.createDataFrame([(None, None, 7500, "A99", None)], SCHEMA)).first().asDict()
    assert all(v is not None for v in row.values())
    assert row["age"] == 0.0  # the median equals the mean here
    assert row["credit_history_A31"] == row["credit_history_A32"] == 0.0


def test_zero_spread_is_not_scaled(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x DOUBLE")
    assert [r.x for r in E.standardise(df, ["x"]).collect()] == [0.0, 0.0]


def test_fitted_prep_round_trip(spark, train):
    fit = E.fit_prep(train, ROLES)
    path = scratch_path(spark, "prep")
    fit.save(spark, path)
    assert E.FittedPrep.load(spark, path) == fit


def test_label_encode_rejects_unseen(spark, train):
    codes = E.level_codes(train, "purpose")
    assert {r.level: r.code for r in codes.collect()} == {"A40": 0, "A41": 1, "A42": 2}
    other = spark.createDataFrame([("A49",)], "purpose STRING")
    with pytest.raises(Exception, match="unseen level"):
        E.label_encode(other, "purpose", codes).collect()


def test_wide_encoder_gives_zeros_for_unknown(spark, train):
    model = E.wide_encoder(["purpose"]).fit(train)
    vec = model.transform(spark.createDataFrame([("A42",), ("A99",)], "purpose STRING")).collect()
    assert vec[0].purpose_vec.toArray().tolist() == [0, 0, 1] and vec[1].purpose_vec.toArray().sum() == 0


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(a,) for a in (18, 19, 25, 26, 100, 101)], "age INT")
    assert [r.age_group for r in P.age_groups(df).collect()] == [None, "18-25", "18-25", "26-35", "66+", None]
    low = df.select(C.bin_right("age", P.AGE_EDGES, P.AGE_LABELS, include_lowest=True).alias("g")).first().g
    assert low == "18-25"


def test_ratios_survive_zero(spark):
    df = spark.createDataFrame([(100, 0, 10)], "credit_amount INT, income INT, loan_duration INT")
    row = P.ratio_features(df).first()
    assert row.debt_to_income_ratio is None and row.monthly_payment == 10.0


def test_sql_features(spark, train):
    out = P.sql_features(
        train, {"share": "credit_amount / income", "grp": "case when age between 20 and 40 then 'young' else 'old' end"}
    )
    assert [r.grp for r in out.collect()] == ["young", "young", "old", "old", "old"]


def test_text_in_a_numeric_column_is_reported(spark):
    df = spark.createDataFrame([("31", 1), ("abc", 2), (None, 3)], "age STRING, id INT")
    out = P.with_errors(df, P.type_flags(["age"]) + P.required_flags(["age"]) + P.range_flags({"age": (18, 30)}))
    assert [r.errors for r in out.orderBy("id").collect()] == [
        ["age out of range [18, 30]"],
        ["age must be a number"],
        ["age is missing"],
    ]
    valid, invalid = P.split_valid_invalid(out)
    assert (valid.count(), invalid.count()) == (0, 3)


def test_invalid_requests_become_zeros(spark, train):
    fit = E.fit_prep(train, ROLES)
    df = spark.createDataFrame(
        [(1, "30", 1, 2, "A30", "A40"), (2, "x", 1, 2, "A30", "A40")],
        "id INT, age STRING, income INT, credit_amount INT, credit_history STRING, purpose STRING",
    )
    out = {r.id: r for r in E.transform_requests(df, fit, "id").collect()}
    assert out[1].age == pytest.approx((30 - 45) / 200**0.5) and out[1].errors == []
    assert out[2].age == 0.0 and len(out[2].errors) == 1


def test_outlier_modes(spark):
    df = spark.createDataFrame([(float(x),) for x in [1] * 20 + [100]], "x DOUBLE")
    assert E.zscore_outliers(df, ["x"]).agg(F.sum("x_outlier")).first()[0] == 1
    assert E.zscore_outliers(df, ["x"], mode="drop").count() == 20
    assert E.zscore_outliers(df, ["x"], mode="clip").agg(F.max("x")).first()[0] < 100


def test_split_sizes_match_quota(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 < 3).cast("int"))
    out = X.stratified_split(df, "y", "id")
    got = {(r.split, r.y): r["count"] for r in out.groupBy("split", "y").count().collect()}
    assert got == {("train", 0): 560, ("train", 1): 240, ("test", 0): 140, ("test", 1): 60}
    again = X.stratified_split(df.repartition(7), "y", "id")
    assert out.exceptAll(again).count() == 0


def test_three_way_split_adds_up(spark):
    df = spark.range(103).withColumn("y", F.col("id") % 3)
    counts = {r.split: r["count"] for r in X.train_val_test(df, "y", "id").groupBy("split").count().collect()}
    assert counts == {"test": 21, "validation": 17, "train": 65}


def test_quota_by_largest_remainder():
    assert X.share_out({"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x"), (2, "x")], "a INT, b STRING")
    assert Q.duplicate_rows(df).first().duplicates == 1


def test_target_nulls_are_invalid_and_missing(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,), (7,)], "y INT")
    row = Q.target_checks(df, "y").first()
    assert (row.invalid_target, row.missing_target, row.classes, row.class_imbalance) == (2, 1, 3, None)


def test_category_nulls_are_optional(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c STRING")
    assert Q.category_violations(df, {"c": ["a"]}).first().invalid_count == 1
    assert Q.category_violations(df, {"c": ["a"]}, nulls_invalid=True).first().invalid_count == 2


def test_validation_of_a_clean_table_and_of_one_without_target(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("default"), (F.col("id") % 50 + 20).alias("age"))
    good = Q.validation_summary(Q.validate(df, "default", numeric=["age"], ranges=Q.NUMERIC_RANGES)).first()
    assert (good.total_checks, good.passed_checks, good.is_valid, good.overall_status) == (6, 6, True, "PASS")
    bad = Q.validation_summary(Q.validate(df.drop("default"), "default")).first()
    assert (bad.total_checks, bad.passed_checks, bad.error_count, bad.warning_count) == (4, 3, 1, 1)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x DOUBLE")
    assert Q.null_profile(df).first().missing_count == 2
    assert S.blank_nan(df).filter("x IS NULL").count() == 2


def test_readers_and_writers(spark):
    base = scratch_path(spark, "io")
    apps = spark.range(50).selectExpr(
        "id", "cast(id % 5 = 0 AS INT) AS default", "cast(id * 7 AS INT) AS credit_amount", "concat('A', id % 3) AS purpose"
    )
    parts = X.stratified_split(apps, "default", "id")
    written = O.write_splits(parts, f"{base}/splits")
    assert written.count() == 50 and set(written.columns) == set(parts.columns)
    meta = {r.split: r for r in S.dataset_metadata(written, "default").collect()}
    assert meta["test"].samples == 10 and meta["train"].positive + meta["train"].negative == 40
    apps.coalesce(1).write.option("header", True).csv(f"{base}/apps.csv")
    assert S.read_any(spark, f"{base}/apps.csv", apps.schema).count() == 50
    with pytest.raises(ValueError):
        S.read_any(spark, f"{base}/apps.xml")


def test_csv_that_breaks_the_schema_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("age,name\nabc,x\n")
    with pytest.raises(Exception):
        S.read_applications(spark, str(tmp_path / "bad.csv"), "age INT, name STRING").collect()


def test_space_separated_without_header(spark, tmp_path):
    (tmp_path / "raw.data").write_text("A11 6 1\nA12 48 2\n")
    df = S.read_delimited(spark, str(tmp_path / "raw.data"), "checking_status STRING, duration INT, class INT")
    out = df.select(C.recode("class", {1: 0, 2: 1}).alias("default"), "duration")
    assert [tuple(r) for r in out.collect()] == [(0, 6), (1, 48)]


def test_application_schema_has_all_roles():
    names = set(S.application_schema().names)
    assert set(GERMAN_CREDIT.features) <= names and len(names) == 21


def test_log_append_prunes_by_day(spark):
    rows = [(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 2, 5))]
    df = spark.createDataFrame(rows, "request_id INT, created_at TIMESTAMP")
    path = scratch_path(spark, "log")
    O.append_predictions(df, path)
    back = O.append_predictions(df, path)
    assert back.count() == 4 and "date" in back.columns


def test_reports_metrics_and_table_description(spark):
    path = scratch_path(spark, "report")
    report = spark.createDataFrame([(1, [0.5])], "n INT, scores ARRAY<DOUBLE>")
    assert O.write_report(report, path).first().scores == [0.5]
    assert S.load_metrics(spark, path + "-none").count() == len(S.DEFAULT_METRICS)
    described = S.describe_table(report).collect()
    assert [(r.column_name, r.data_type) for r in described] == [("n", "int"), ("scores", "array<double>")]


def test_saved_metrics(spark, tmp_path):
    (tmp_path / "metrics.json").write_text('{"accuracy": 0.9, "note": "x", "f1": 0.8}')
    got = {r.metric: r.value for r in S.load_metrics(spark, str(tmp_path / "metrics.json")).collect()}
    assert got == {"accuracy": 0.9, "f1": 0.8}


def test_snapshot_and_restore(spark, tmp_path):
    name = f"snap_{uuid.uuid4().hex}"
    try:
        spark.range(5).write.option("path", str(tmp_path / "t")).saveAsTable(name)
        assert O.snapshot_table(spark, name).count() == 5
        spark.range(9).write.mode("overwrite").option("path", str(tmp_path / "t2")).saveAsTable(name)
        assert O.restore_table(spark, name).count() == 5
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_backup")


def test_schema_comparison(spark):
    a = spark.createDataFrame([(1, 2)], "x INT, y INT")
    b = spark.createDataFrame([(1, 2)], "x INT, z INT")
    assert J.extra_columns(a, b) == ({"z"}, {"y"})


def test_steps_run_in_order(spark):
    df = spark.createDataFrame([(1,)], "x INT")
    steps = [("add", lambda d: d.withColumn("x", F.col("x") + 1)), ("twice", lambda d: d.withColumn("x", F.col("x") * 2))]
    assert E.run_steps(df, steps).first().x == 4


def test_splits_of_many_classes_follow_the_same_rule(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 37 % 11 AS STRING) AS y")
    fractions = (("test", 0.2), ("validation", 0.25))
    few = X.stratified_split(df, "y", "id", fractions)
    many = X.stratified_split(df, "y", "id", fractions, few_classes=3)
    assert few.exceptAll(many).count() == 0 and many.count() == 3000


@pytest.fixture(scope="module")
def wide_rows(spark):
    rows = [(i, f"v{i * 7 % 40}" if i % 9 else None, "a" if i % 3 else "b", float(i)) for i in range(400)]
    return spark.createDataFrame(rows, "id INT, wide STRING, narrow STRING, x DOUBLE")


def named_values(spark, fit, df, drop_first=True):
    vectors = fit.vectors(df, keep=["id"], drop_first=drop_first)
    names = {r.position: r.feature for r in fit.named_positions(spark, drop_first).collect()}
    return {r.id: {names[i]: v for i, v in enumerate(r.features.toArray())} for r in vectors.collect()}


@pytest.mark.parametrize("drop_first", [True, False])
def test_wide_columns_have_the_same_indicators_as_narrow_ones(spark, wide_rows, drop_first):
    """On both sides of the limit, for levels, nulls and unknown levels."""
    roles = Roles(("x",), ("wide", "narrow"))
    listed, coded, mixed = (E.fit_prep(wide_rows, roles, n) for n in (100, 1, 10))
    assert (set(listed.wide), set(coded.wide), set(mixed.wide)) == (set(), {"wide", "narrow"}, {"wide"})
    assert coded.modes == listed.modes and coded.feature_names() == ["x", "wide_onehot", "narrow_onehot"]
    asked = wide_rows.union(spark.createDataFrame([(900, "new", "c", None), (901, None, None, 1.0)], wide_rows.schema))
    want = named_values(spark, listed, asked, drop_first)
    assert len(want[0]) == 1 + 40 + 2 - 2 * drop_first
    assert named_values(spark, coded, asked, drop_first) == want == named_values(spark, mixed, asked, drop_first)
    assert sum(want[900].values()) == want[900]["x"]


def test_sparse_one_hot_leaves_nulls_and_unknown_levels_at_zero(spark, wide_rows):
    fit = E.FittedPrep(wide=E.fit_levels(wide_rows, ["wide"], 5)[2])
    df = spark.createDataFrame([(1, "v3"), (2, None), (3, "other"), (4, "v0")], "id INT, wide STRING")
    out = {r.id: r.wide_onehot for r in E.one_hot(df, ["wide"], fit=fit).collect()}
    assert {i: v.numNonzeros() for i, v in out.items()} == {1: 1, 2: 0, 3: 0, 4: 0} and out[1].size == 39
    assert E.one_hot(wide_rows, ["wide"], max_levels=5).columns == ["id", "narrow", "x", "wide_onehot"]


def test_wide_fit_round_trip(spark, wide_rows):
    fit = E.fit_prep(wide_rows, Roles(("x",), ("narrow", "wide")), 10)
    path = scratch_path(spark, "prep")
    fit.save(spark, path)
    again = E.FittedPrep.load(spark, path)
    assert (again.numeric, again.levels, again.modes) == (fit.numeric, fit.levels, fit.modes)
    assert named_values(spark, again, wide_rows) == named_values(spark, fit, wide_rows)


def test_unfitted_columns_become_buckets_and_invalid_rows_zeros(spark, wide_rows):
    fit = E.fit_prep(wide_rows, Roles(("x",), ("wide",)), 10)
    df = spark.createDataFrame(
        [(1, "v3", "3", "p"), (2, "v3", "oops", "p"), (3, "v4", None, None)], "id INT, wide STRING, x STRING, extra STRING"
    )
    out = {r.id: r for r in E.transform_requests(df, fit, "id", unfitted=["extra"]).collect()}
    bucket = lambda v: int(hashlib.md5(v.encode()).hexdigest()[:8], 16) % 1000
    assert (out[1].extra_bucket, out[2].extra_bucket, out[3].extra_bucket) == (bucket("p"), 0.0, bucket("missing"))
    assert out[1].wide_onehot.numNonzeros() == 1 and out[2].wide_onehot.numNonzeros() == 0 == out[2].x


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(5000).select("id", F.expr("pmod(hash(id), 50)").alias("a"))
    for n in (df, df.repartition(1), df.limit(0)):
        got = [(r.a, r.id, r["rank"]) for r in numbered(n, [F.desc("a"), "id"]).collect()]
        want = sorted(((r.a, r.id) for r in n.collect()), key=lambda x: (-x[0], x[1]))
        assert sorted(got, key=lambda x: x[2]) == [(*x, i) for i, x in enumerate(want)]


def test_many_classes_of_one_size_share_spare_rows_by_name(spark):
    """All remainders tie, so the order of the names decides; both sides of the limit agree."""
    df = spark.range(700).selectExpr("id", "concat('c', id % 100) AS y")
    few = X.stratified_split(df, "y", "id", (("test", 0.25),))
    many = X.stratified_split(df, "y", "id", (("test", 0.25),), few_classes=7)
    assert few.exceptAll(many).count() == 0 and many.filter("split = 'test'").count() == 175


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch_path(Session(), "x")
