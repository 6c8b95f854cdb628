"""Model fits on separable data; streams against plain loops and against batch results."""

import pickle
from collections import defaultdict
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from scorelens.operators import drift as R
from scorelens.operators import evaluate as E
from scorelens.operators import models as M
from scorelens.session import scratch_path
from scorelens.sources.views import prediction_log
from scorelens.streaming import limiter as L
from scorelens.streaming import runner as S
from scorelens.streaming import windows as W


@pytest.fixture(scope="module")
def separable(spark):
    x = (F.col("id") % 40).cast("double")
    return spark.range(400).select(
        "id", array_to_vector(F.array(x, (F.col("id") % 7).cast("double"))).alias("features"), (x > 20).cast("double").alias("label")
    )


@pytest.mark.parametrize(
    "kind,params",
    [
        ("random_forest", {"numTrees": 10}),
        ("logistic_regression", {}),
        ("xgboost", {"maxIter": 5}),
        ("neural_network", {"hidden": (8,), "maxIter": 60}),
        ("unknown", {"numTrees": 5}),
    ],
)
def test_fits_rank_separable_rows(separable, kind, params):
    scored = M.score(separable, M.train(separable, kind, **params), ["id", "label"])
    row = scored.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] == 400
    assert E.area_metrics(scored, "label", "score").first().roc_auc > 0.95


def test_same_seed_same_scores(separable):
    a = M.score(separable, M.train(separable, numTrees=5), ["id"])
    b = M.score(separable, M.train(separable, numTrees=5), ["id"])
    assert a.exceptAll(b).count() == 0


def test_importance_finds_the_feature(separable):
    for kind, params in (("random_forest", {"numTrees": 5}), ("neural_network", {"hidden": (4,), "maxIter": 5})):
        rows = M.feature_importance(separable, M.train(separable, kind, **params), ["x", "noise"]).collect()
        assert len(rows) == 2
        if kind == "random_forest":
            assert rows[0].feature == "x"


def test_search_orders_by_score(separable):
    rows = M.random_search(separable, "id", "logistic_regression", {"regParam": [0.0, 10.0]}, draws=2, folds=2).collect()
    assert rows[0].mean_auc >= rows[1].mean_auc


def test_network_search_varies_layers_and_is_repeatable(separable):
    space = {"hidden": [(4,), (8,), (4, 3)], "maxIter": [5, 20]}
    first, again = (
        M.random_search(separable, "id", "neural_network", space, draws=5, folds=2, seed=3).collect() for _ in range(2)
    )
    assert first == again and len(first) == 5
    assert len({r.params for r in first}) > 2 and all("hidden" in r.params for r in first)
    assert [r.mean_auc for r in first] == sorted((r.mean_auc for r in first), reverse=True)
    boosted = M.random_search(separable, "id", "xgboost", {"maxIter": [2], "stepSize": [0.1, 0.3]}, draws=2, folds=2).collect()
    assert all(r.mean_auc > 0.9 for r in boosted)


def test_user_model(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.0, 0.0)], "id INT, a DOUBLE, b DOUBLE")

    def load(data):
        w = np.array(pickle.loads(data))
        return lambda x: x @ w

    out = M.score_batches(df, pickle.dumps([1.0, 10.0]), load, ["a", "b"], ["id"])
    assert {r.id: r.score for r in out.collect()} == {1: 32.0, 2: 0.0}


def test_missing_target_stops_retraining(spark):
    with pytest.raises(ValueError):
        M.prepare_retraining(spark.range(3), None, "y", "id")


def in_parts(spark, df, n, ts):
    """The rows as n files in time order, so that a stream meets them in several batches."""
    path = scratch_path(spark, "parts")
    rows = df.orderBy(ts).toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), n)):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(path)
    return S.folder_stream(spark, path, df.schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def requests(spark):
    start = datetime(2024, 1, 1)
    rng = np.random.default_rng(4)
    at = np.cumsum(rng.exponential(3.0, 400))
    rows = [
        (i, int(rng.integers(0, 3)), "e", start + timedelta(seconds=float(a)), bool(rng.random() < 0.4))
        for i, a in enumerate(at)
    ]
    return spark.createDataFrame(rows, "request_id BIGINT, client INT, endpoint STRING, created_at TIMESTAMP, failed BOOLEAN")


def micro(df):
    return {r.request_id: r for r in df.select("*", F.unix_micros("created_at").alias("us")).collect()}


def limiter_loop(rows, window, burst_window, limit_of):
    logs, out = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r.us, r.request_id)):
        limit, burst = limit_of(r)
        log = logs[(r.client, r.endpoint)] = [a for a in logs[(r.client, r.endpoint)] if r.us - a < window * 10**6]
        near = [a for a in log if r.us - a < burst_window * 10**6]
        ok = len(log) < limit and len(near) < burst
        if ok:
            log.append(r.us)
        out[r.request_id] = ok
    return out


def test_limiter_over_batches_equals_a_loop(spark, requests):
    stream = S.BoundedStream(in_parts(spark, requests, 3, "created_at"))
    got = S.run_append(L.rate_limiter(stream.rows, limit=6, burst=3), "limiter-test", stream).collect()
    want = limiter_loop(micro(requests).values(), 60, 10, lambda r: (6, 3))
    assert {r.request_id: r.allowed for r in got} == want and 0 < sum(want.values()) < 400


def test_adaptive_limiter_over_batches_equals_a_loop(spark, requests):
    levels = ((0.3, "low", 1.5), (0.4, "normal", 1.0), (0.5, "high", 0.5))
    stream = S.BoundedStream(in_parts(spark, requests, 3, "created_at"))
    got = S.run_append(L.adaptive_limiter(stream.rows, limit=4, burst=3, levels=levels), "adaptive-test", stream).collect()
    rows = micro(requests)
    times = sorted(r.us for r in rows.values())

    def limit_of(r):
        step = r.us // 10**6 * 10**6  # the rate ends where the request's second begins
        rps = sum(step - 30 * 10**6 <= t < step for t in times) / 30
        factor = next((f for top, _, f in levels if rps < top), 0.2)
        return int(4 * factor), int(3 * factor)

    want = limiter_loop(rows.values(), 30, 10, limit_of)
    assert {r.request_id: r.allowed for r in got} == want and 0 < sum(want.values()) < 400


def test_adaptive_limiter_keeps_clients_of_a_group_apart(spark, requests, monkeypatch):
    """The state's keys are groups, and not clients, whose number grows with the requests."""
    monkeypatch.setattr(L, "GROUPS", 2)
    many = requests.withColumn("client", F.col("request_id").cast("int") % 9)
    stream = S.BoundedStream(in_parts(spark, many, 2, "created_at"))
    levels = ((1000.0, "low", 1.5),)
    got = S.run_append(L.adaptive_limiter(stream.rows, limit=2, burst=1, levels=levels), "adaptive-groups", stream).collect()
    want = limiter_loop(micro(many).values(), 30, 10, lambda r: (3, 1))
    assert {r.request_id: r.allowed for r in got} == want and 0 < sum(want.values()) < 400
    assert {r.request_id: r.key for r in got} == {i: f"{i % 9}:e" for i in range(400)}


def test_adaptive_limiter_keeps_many_requests_in_one_row_of_the_join(spark, requests):
    """The state of the join by step grows with steps and batches of rows, not with requests."""
    same = requests.withColumn("created_at", F.lit(datetime(2024, 1, 1, 0, 0, 5)))
    stream = S.BoundedStream(in_parts(spark, same, 1, "created_at"))
    out = L.adaptive_limiter(stream.rows, limit=4, burst=3, levels=((1000.0, "low", 1.5),))
    base = scratch_path(spark, "adaptive-packed")
    with S.state_in_rocksdb(spark):
        writer = out.writeStream.option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if "Join" in o["operatorName"]]
    assert 0 < max(kept) < 50
    got = S.run_append(out, "adaptive-same", stream).collect()
    want = limiter_loop(micro(same).values(), 30, 10, lambda r: (6, 4))
    assert {r.request_id: r.allowed for r in got} == want and sum(want.values()) == 12


def test_breaker_over_batches_equals_a_loop(spark, requests):
    stream = S.BoundedStream(in_parts(spark, requests.withColumn("service", F.col("client").cast("string")), 3, "created_at"))
    got = S.run_append(L.circuit_breaker(stream.rows), "breaker-test", stream).collect()
    state, want = defaultdict(lambda: ["CLOSED", 0, 0]), {}
    for r in sorted(micro(requests).values(), key=lambda r: (r.us, r.request_id)):
        s = state[r.client]
        if s[0] == "OPEN" and r.us - s[2] > 60 * 10**6:
            s[0] = "HALF_OPEN"
        rejected = s[0] == "OPEN"
        if not rejected and r.failed:
            s[1], s[2] = s[1] + 1, r.us
            if s[1] >= 5:
                s[0] = "OPEN"
        elif not rejected and s[0] == "HALF_OPEN":
            s[0], s[1] = "CLOSED", 0
        want[r.request_id] = (rejected, s[0], s[1])
    assert {r.request_id: (r.rejected, r.state, r.failures) for r in got} == want
    assert {v[1] for v in want.values()} >= {"OPEN", "CLOSED"}


def test_running_counters_over_batches_equal_batch(spark, sf_dir):
    log = prediction_log(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = in_parts(spark, log, 3, "created_at")
    out = S.run_updates(W.running_endpoints(stream), "running-test", ["endpoint"])
    want = {r.endpoint: r["count"] for r in log.groupBy("endpoint").count().collect()}
    assert {r.endpoint: r.request_count for r in out.collect()} == want


def test_alerts_are_written_once_per_window(spark, sf_dir):
    log = prediction_log(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = in_parts(spark, log, 3, "created_at")
    alerts = S.run_append(W.alert_stream(stream, F.col("processing_time_ms") > 50, F.lit("SLOW")), "alerts-test")
    want = log.filter("processing_time_ms > 50").select(F.date_trunc("hour", "created_at").alias("h")).distinct().count()
    assert alerts.count() == want == alerts.distinct().count()


class FakeState:
    """Value and map state of one key, and its timers, as plain objects."""

    def __init__(self):
        self.values, self.maps, self.timers = {}, {}, set()

    def getValueState(self, name, schema):
        return FakeValue(self.values, name)

    def getMapState(self, name, key, value):
        return FakeMap(self.maps.setdefault(name, {}))

    def registerTimer(self, at):
        self.timers.add(at)


class FakeValue:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        return self.store.get(self.name)

    def update(self, value):
        self.store[self.name] = value

    def clear(self):
        self.store.pop(self.name, None)


class FakeMap:
    def __init__(self, store):
        self.store = store

    def updateValue(self, key, value):
        self.store[key] = value

    def getValue(self, key):
        return self.store[key]

    def removeKey(self, key):
        del self.store[key]


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def drive(machine, batches, watermarks):
    """Feed batches of frames and let timers expire behind each batch, as the engine does."""
    state = FakeState()
    machine.init(state)
    out = []
    for batch, watermark in zip(batches, watermarks):
        out += list(machine.handleInputRows(("k",), iter(batch), Clock(watermark)))
        while due := [t for t in state.timers if t <= watermark]:
            for t in sorted(due):
                state.timers.discard(t)
                out += list(machine.handleExpiredTimer(("k",), Clock(watermark), None))
    return out, state


def test_a_hot_key_is_decided_a_slot_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    us = np.sort(rng.integers(0, 300 * 10**6, 9_000))
    frame = pd.DataFrame({"us": us, "request_id": np.arange(len(us)), "max_requests": 40, "max_burst": 9})
    mixed = frame.sample(frac=1, random_state=1)  # rows of a batch come in any order
    batches = [[mixed[mixed.us < 150 * 10**6][:2_500], mixed[mixed.us < 150 * 10**6][2_500:]], [mixed[mixed.us >= 150 * 10**6]], []]
    calls = []
    one_slot = L.Limiter.decide
    monkeypatch.setattr(L.Limiter, "decide", lambda self, key, c: (calls.append(len(c[0])), one_slot(self, key, c))[1])
    out, state = drive(L.Limiter(60, 10, 10**6), batches, [120_000, 290_000, 10**9])
    got = pd.concat(out).set_index("request_id")["allowed"].to_dict()
    rows = [SimpleNamespace(us=int(t), request_id=i, client=0, endpoint="e") for i, t in enumerate(us)]
    assert got == limiter_loop(rows, 60, 10, lambda r: (40, 9))
    assert max(calls) == pd.Series(us // 10**6).value_counts().max() < 100 and sum(calls) == len(us)
    assert max(len(f) for f in out) < L.PART + 100
    # Nothing of the key is left once its window has passed.
    assert state.values == {} and state.maps["waiting"] == {}


def test_keys_of_a_group_share_their_messages(monkeypatch):
    """Each access to state is a message; they must not grow with the requests. Few rows wait in a value, many in the map."""
    messages = []
    for kind in (FakeValue, FakeMap):
        for name in [n for n in vars(kind) if not n.startswith("_")]:
            plain = getattr(kind, name)
            monkeypatch.setattr(kind, name, lambda self, *a, plain=plain: (messages.append(1), plain(self, *a))[1])
    rng = np.random.default_rng(3)
    us = rng.integers(0, 300 * 10**6, 6_000)
    keys = rng.integers(0, 50, len(us))
    frame = pd.DataFrame({"us": us, "request_id": np.arange(len(us)), "max_requests": 4, "max_burst": 2, "key": keys.astype(str)})
    early = frame[frame.us < 150 * 10**6]
    batches = [[early[:2_500], early[2_500:]], [frame[frame.us >= 150 * 10**6]], []]
    rows = [SimpleNamespace(us=int(t), request_id=i, client=k, endpoint="e") for i, (t, k) in enumerate(zip(us, keys))]
    want = limiter_loop(rows, 60, 10, lambda r: (4, 2))
    for few in (L.Limiters.few, 2_000):
        monkeypatch.setattr(L.Limiters, "few", few)
        messages.clear()
        out, state = drive(L.Limiters(60, 10, 10**6), batches, [120_000, 290_000, 10**9])
        got = pd.concat(out).set_index("request_id")
        assert got["allowed"].to_dict() == want and 0 < sum(want.values()) < len(us)
        assert (got["key"].astype(int) == keys[got.index]).all()
        assert len(messages) < (40 if few > len(us) else len(us) // 3)
        assert state.values == {} and state.maps["waiting"] == {}


def test_parts_of_a_slot_are_bounded_and_joined_in_order():
    n = 3 * L.PART + 7
    frame = pd.DataFrame({"us": np.arange(n)[::-1], "request_id": np.arange(n), "failed": False})
    state = FakeState()
    breaker = L.Breaker(5, 60 * 10**6, 10**6)
    breaker.init(state)
    list(breaker.handleInputRows(("k",), iter([frame]), Clock(0)))
    assert [len(v[0]) for v in state.maps["waiting"].values()] == [L.PART] * 3 + [7]
    out = pd.concat(breaker.handleExpiredTimer(("k",), Clock(1_000), None))
    assert out.us.tolist() == list(range(n)) and state.maps["waiting"] == {}


def test_late_and_unordered_batches_are_decided_by_event_time(spark, requests):
    """The files come in no order; a long delay keeps every row."""
    shuffled = requests.withColumn("order", F.xxhash64("request_id"))
    source = in_parts(spark, shuffled, 4, "order")
    stream = S.BoundedStream(source)
    got = S.run_append(L.rate_limiter(stream.rows, limit=6, burst=3, delay="2 hours"), "unordered", stream).collect()
    assert {r.request_id: r.allowed for r in got} == limiter_loop(micro(requests).values(), 60, 10, lambda r: (6, 3))


def test_adaptive_limiter_is_one_query(spark, requests):
    """Building it starts nothing; an hour without requests has rate 0."""
    late = requests.withColumn("created_at", F.expr("created_at + make_interval(0, 0, 0, 0, request_id DIV 200)"))
    stream = S.BoundedStream(in_parts(spark, late, 2, "created_at"))
    before = {q.id for q in spark.streams.active}
    out = L.adaptive_limiter(stream.rows, limit=4, burst=3, levels=((0.3, "low", 1.5),), delay="10 seconds")
    assert {q.id for q in spark.streams.active} == before
    got = {r.request_id: r for r in S.run_append(out, "adaptive-gap", stream).collect()}
    assert len(got) == 400 and got[200].applied_limit == 6 == got[0].applied_limit


def test_closing_a_bounded_stream_emits_every_window_once(spark, sf_dir):
    log = prediction_log(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    open_end = S.run_append(W.tumbling_statistics(in_parts(spark, log, 3, "created_at")), "open-end").count()
    stream = S.BoundedStream(in_parts(spark, log, 3, "created_at"))
    out = S.run_append(W.tumbling_statistics(stream.rows), "closed-end", stream)
    hours = log.groupBy(F.date_trunc("hour", "created_at").alias("h")).count()
    assert open_end < hours.count() == out.count()
    assert {(r.time_interval, r.request_count) for r in out.collect()} == {tuple(r) for r in hours.collect()}


def test_an_empty_bounded_stream_gives_nothing(spark, requests):
    path = scratch_path(spark, "none")
    requests.limit(0).write.parquet(path)
    stream = S.BoundedStream(S.folder_stream(spark, path, requests.schema))
    assert S.run_append(L.rate_limiter(stream.rows), "none", stream).collect() == []


def test_count_window_over_batches_equals_the_batch_form(spark, requests):
    log = requests.withColumn("v", F.when(F.col("request_id") % 7 > 0, F.col("request_id") * 0.5))
    source = in_parts(spark, log.withColumn("order", F.xxhash64("request_id")), 4, "order")
    stream = L.last_rows_stream(source, ["client", "endpoint"], "v", n=60, min_samples=130)
    last = S.run_updates(stream, "ring", ["client", "endpoint"]).collect()
    want = R.last_rows(log, ["client", "endpoint"], "created_at", 60, 1, tie=["request_id"]).toPandas()
    sizes = log.toPandas().groupby("client").size()
    assert len(last) == sum(min(60, x) >= 130 for x in sizes)  # the gate is on rows kept, as in the batch form
    stream = L.last_rows_stream(source, ["client", "endpoint"], "v", n=60, min_samples=50)
    for row in S.run_updates(stream, "ring", ["client", "endpoint"]).collect():
        mine = want[want.client == int(row.client)]
        assert set(row.request_ids) == set(mine.request_id) and row.n_rows == 60
        assert abs(row.mean_value - mine.v.mean()) < 1e-9


def test_the_ring_never_grows(spark):
    state = FakeState()
    ring = L.LastRows(100, 10, ["k"])
    ring.init(state)
    for at in range(0, 5_000, 500):
        frame = pd.DataFrame({"us": np.arange(at, at + 500) // 3, "request_id": np.arange(at, at + 500), "value": np.nan})
        out = list(ring.handleInputRows(("a",), iter([frame[:250], frame[250:]]), Clock(0)))
        assert all(len(x) == 100 for x in state.values["ring"]) and out[0]["n_rows"][0] == 100
        assert out[0]["mean_value"][0] is None
    # The third row of the last instant has no fellow; ties inside an instant go to the smaller id.
    assert state.values["ring"][1][:4] == [4998, 4999, 4995, 4996]


def test_daily_drift_of_text_equals_the_batch_form(spark, sf_dir):
    log = prediction_log(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    log = log.withColumn("endpoint", F.when(F.col("request_id") % 50 > 0, F.col("endpoint")))
    cut = F.lit(datetime(2024, 1, 21))
    reference = log.filter(F.col("created_at") < cut)
    levels = W.frequent_levels(reference, ["endpoint"])
    stream = S.BoundedStream(in_parts(spark, log, 3, "created_at"))
    counts = S.run_append(W.drift_counts(stream.rows, {}, levels), "text-drift", stream)
    psi = {r.window_start.date(): r.psi for r in W.window_psi(counts, W.reference_profile(reference, {}, levels)).collect()}
    for day in (datetime(2024, 1, 2), datetime(2024, 1, 30)):
        current = log.filter(F.to_date("created_at") == F.lit(day.date()))
        assert abs(psi[day.date()] - R.psi_drift(reference, current, categorical=["endpoint"]).first().psi) < 1e-9


def test_rare_and_new_levels_share_one_bin(spark):
    reference = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",), ("d",), (None,)], "v STRING")
    levels = W.frequent_levels(reference, ["v"], most=2)
    assert levels == {"v": ["a", "b"]}
    profile = {r.bin: r.n_ref for r in W.reference_profile(reference, {}, levels).collect()}
    assert profile == {"value:a": 5, "value:b": 4, W.OTHER: 2}
    assert W.frequent_levels(reference.limit(0), ["v"]) == {"v": []}


def test_the_callers_state_store_setting_is_kept(spark, requests):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    S.run_updates(L.last_rows_stream(in_parts(spark, requests, 1, "created_at"), ["client"], "client"), "conf", ["client"])
    assert spark.conf.get(key) == before != S.ROCKSDB
