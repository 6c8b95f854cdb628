"""Keyed state machines: sliding-window rate limiter, adaptive limiter, circuit breaker and count window.

The decision on a request depends on the earlier decisions for its key, so rows of a key are decided in time order.
Few rows wait together in one value. More wait in map state by time slot, in parts of bounded size, and are decided slot
by slot when the watermark has passed: rows may come in any order and in any number of batches within the delay, and a
call never holds more of a key than one slot, or those few. State of a decided key is bounded: at most ``limit`` accepted
times, or one breaker row. One timer is kept per key, at the end of its earliest slot.

Each access to state is a message between Python and the JVM, and each key a call. The limiters therefore keep a fixed
number of groups of keys as their state keys, so that the messages grow with groups and slots and not with requests.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scorelens.functions.columns import micros
from scorelens.operators.ranking import CRITICAL_LOAD, LOAD_LEVELS, load_bands
from scorelens.streaming.runner import END

SECOND = 1_000_000

LIMITER_OUTPUT = "key STRING, request_id BIGINT, us BIGINT, allowed BOOLEAN, applied_limit INT, remaining INT, reset_in INT"


def decide(
    times: np.ndarray, accepted: list[int], window: int, burst_window: int, limits: np.ndarray, bursts: np.ndarray
) -> tuple[list[tuple[bool, int, int, int]], list[int]]:
    """Accept or reject sorted request times (microseconds) given the accepted ones so far.

    A request is rejected when ``limit`` accepted ones lie in the window or ``burst`` in the short
    window. Rejected requests leave no trace.
    """
    out = []
    kept, near = deque(accepted), deque(accepted)
    for t, limit, burst in zip(times.tolist(), limits.tolist(), bursts.tolist()):
        while kept and t - kept[0] >= window:
            kept.popleft()
        while near and t - near[0] >= burst_window:
            near.popleft()
        if len(kept) >= limit:
            oldest = kept[0] if kept else t
            out.append((False, limit, 0, (window - (t - oldest)) // SECOND))
        elif len(near) >= burst:
            oldest = near[0] if near else t
            out.append((False, burst, 0, (burst_window - (t - oldest)) // SECOND))
        else:
            left = limit - len(kept) - 1
            kept.append(t)
            near.append(t)
            out.append((True, limit, left, (window - (t - kept[0])) // SECOND))
    return out, list(kept)


#: Rows of one value in map state, and about the rows of one output frame.
PART = 1024


#: Keys of the limiters' state; each holds many clients' requests.
GROUPS = 4096


class InOrder(StatefulProcessor):
    """Rows of a key by event time, a slot at a time. ``columns`` has names and types, time and request id first."""

    columns: dict[str, str] = {}

    #: Rows that may wait in one value; beyond that they go to map state.
    few = PART

    def __init__(self, slot: int):
        self.slot = slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} ARRAY<{kind}>" for name, kind in self.columns.items())
        self.waiting = handle.getMapState("waiting", "slot BIGINT, part INT", arrays)
        self.open = handle.getValueState("open", f"slots ARRAY<BIGINT>, parts ARRAY<INT>, due BIGINT, {arrays}")

    def start(self, key) -> None:
        """Load what earlier decisions of the key have left."""

    def decide(self, key, columns: list[np.ndarray]) -> dict:
        """Output columns for rows in time order."""
        raise NotImplementedError

    def stop(self, key) -> None:
        """Store what later decisions of the key need."""

    def rest(self, key, now: int) -> None:
        """No row of the key waits; ``now`` is the watermark in microseconds."""

    def _arrays(self, lists) -> list[np.ndarray]:
        return [np.array(x, dtype=object if kind == "STRING" else None) for x, kind in zip(lists, self.columns.values())]

    def _load(self) -> tuple[dict[int, int], int | None, list[np.ndarray] | None]:
        """Slots in map state with their parts, the time of the timer, and the rows that wait in the value."""
        stored = self.open.get()
        if not stored:
            return {}, None, None
        return dict(zip(stored[0], stored[1])), stored[2], self._arrays(stored[3:]) if stored[3] else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, due, few = self._load()
        held = [] if few is None else [few]
        for chunk in rows:
            held.append([chunk[name].to_numpy() for name in self.columns])
            if parts or sum(len(columns[0]) for columns in held) > self.few:
                self._file(_joined(held), parts)
                held = []
        self._keep(parts, _joined(held) if held else None, due)
        return iter(())

    def _file(self, columns: list[np.ndarray], parts: dict[int, int]) -> None:
        """Put rows into map state by slot."""
        slots = columns[0] // self.slot
        order = np.argsort(slots, kind="stable")
        values = [c[order] for c in columns]
        found, starts = np.unique(slots[order], return_index=True)
        for slot, begin, end in zip(found.tolist(), starts, [*starts[1:], len(slots)]):
            for at in range(begin, end, PART):
                part = parts.get(slot, 0)
                self.waiting.updateValue((slot, part), tuple(v[at : min(end, at + PART)].tolist() for v in values))
                parts[slot] = part + 1

    def _keep(self, parts: dict[int, int], few: list[np.ndarray] | None, due: int | None) -> None:
        """Store the open slots; a timer ends the earliest, unless ``due`` is one that comes before."""
        first = min(parts) if few is None else int(few[0].min() // self.slot)
        end = -((first + 1) * self.slot // -1000)
        if due is None or end < due:
            self.handle.registerTimer(end)
            due = end
        lists = [[] for _ in self.columns] if few is None else [c.tolist() for c in few]
        self.open.update((list(parts), list(parts.values()), due, *lists))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts, _, few = self._load()
        closed = sorted(s for s in parts if (s + 1) * self.slot <= now)
        ended = few is not None and (few[0] // self.slot + 1) * self.slot <= now
        decided = bool(closed) or bool(np.any(ended))
        if decided:
            self.start(key)
            out, held = [], 0
            for slot in closed:
                loaded = [self.waiting.getValue((slot, k)) for k in range(parts[slot])]
                for k in range(parts.pop(slot)):
                    self.waiting.removeKey((slot, k))
                out.append(self._decide_all(key, _joined([self._arrays(x) for x in loaded])))
                held += len(out[-1]["us"])
                if held >= PART:
                    yield _frame(out)
                    out, held = [], 0
            if np.any(ended):
                out.append(self._decide_all(key, [c[ended] for c in few]))
                few = None if ended.all() else [c[~ended] for c in few]
            if out:
                yield _frame(out)
            self.stop(key)
        if parts or few is not None:
            if decided:
                self._keep(parts, few, None)
        else:
            if decided:
                self.open.clear()
            self.rest(key, now)

    def _decide_all(self, key, columns: list[np.ndarray]) -> dict:
        order = np.lexsort((columns[1], columns[0]))
        return self.decide(key, [c[order] for c in columns])

    def close(self) -> None:
        pass


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    return pieces[0] if len(pieces) == 1 else [np.concatenate(columns) for columns in zip(*pieces)]


def _frame(slots: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate([s[name] for s in slots]) for name in slots[0]})


class Limiter(InOrder):
    """The limiter of one key. Its accepted times are dropped once the window has passed without a request."""

    columns = {"us": "BIGINT", "request_id": "BIGINT", "max_requests": "INT", "max_burst": "INT"}

    def __init__(self, window: int, burst_window: int, slot: int):
        super().__init__(slot)
        self.window, self.burst_window = window, burst_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getValueState("accepted", "times ARRAY<BIGINT>")

    def start(self, key) -> None:
        stored = self.accepted.get()
        self.seen = list(stored[0]) if stored else []

    def decide(self, key, columns: list[np.ndarray]) -> dict:
        us, ids, limits, bursts = columns
        decisions, self.seen = decide(us, self.seen, self.window * SECOND, self.burst_window * SECOND, limits, bursts)
        allowed, applied, left, reset = zip(*decisions)
        return {
            "key": np.full(len(us), key[0], dtype=object),
            "request_id": ids,
            "us": us,
            "allowed": np.array(allowed),
            "applied_limit": np.array(applied, dtype="int32"),
            "remaining": np.array(left, dtype="int32"),
            "reset_in": np.array(reset, dtype="int32"),
        }

    def stop(self, key) -> None:
        self.accepted.update((self.seen,))

    def rest(self, key, now: int) -> None:
        stored = self.accepted.get()
        if not stored or not stored[0] or now - stored[0][-1] >= self.window * SECOND:
            self.accepted.clear()
        else:
            self.handle.registerTimer((stored[0][-1] + self.window * SECOND) // 1000 + 1)


class Limiters(InOrder):
    """The limiters of all keys of a group. A key's accepted times are dropped with the window of the last one."""

    columns = {**Limiter.columns, "key": "STRING"}

    few = 16 * PART

    def __init__(self, window: int, burst_window: int, slot: int):
        super().__init__(slot)
        self.window, self.burst_window = window * SECOND, burst_window * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getValueState("accepted", "names ARRAY<STRING>, times ARRAY<ARRAY<BIGINT>>")

    def start(self, key) -> None:
        stored = self.accepted.get()
        self.seen = {name: list(times) for name, times in zip(*stored)} if stored else {}
        self.newest = None

    def decide(self, key, columns: list[np.ndarray]) -> dict:
        codes, names = pd.factorize(columns[4])
        order = np.argsort(codes, kind="stable")
        us, ids, limits, bursts, keys = (c[order] for c in columns)
        ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        decisions = []
        for name, begin, end in zip(names, [0, *ends], ends):
            own = slice(begin, end)
            made, times = decide(us[own], self.seen.get(name, []), self.window, self.burst_window, limits[own], bursts[own])
            decisions += made
            if times:
                self.seen[name] = times
            else:
                self.seen.pop(name, None)
        self.newest = int(us.max())
        allowed, applied, left, reset = zip(*decisions)
        return {
            "key": keys,
            "request_id": ids,
            "us": us,
            "allowed": np.array(allowed),
            "applied_limit": np.array(applied, dtype="int32"),
            "remaining": np.array(left, dtype="int32"),
            "reset_in": np.array(reset, dtype="int32"),
        }

    def stop(self, key) -> None:
        """No later request comes before the newest decided one."""
        live = {name: times for name, times in self.seen.items() if self.newest - times[-1] < self.window}
        self.accepted.update((list(live), list(live.values())))

    def rest(self, key, now: int) -> None:
        stored = self.accepted.get()
        newest = max((times[-1] for times in stored[1]), default=None) if stored else None
        if newest is None or now - newest >= self.window:
            self.accepted.clear()
        else:
            self.handle.registerTimer((newest + self.window) // 1000 + 1)


def _timed(requests: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked rows without the one that only closes a stream; a request without an id has the id -1.

    The filter names the time, so it stays behind the watermark, which must meet that row.
    """
    rows = requests.withWatermark(ts, delay).filter(F.col(ts) < F.lit(END))
    return rows.withColumn("request_id", F.coalesce(F.col("request_id").cast("long"), F.lit(-1)))


def _limited(keyed: DataFrame, window: int, burst_window: int, slot: int) -> DataFrame:
    grouped = keyed.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    return grouped.groupBy("group").transformWithStateInPandas(
        statefulProcessor=Limiters(window, burst_window, slot * SECOND),
        outputStructType=LIMITER_OUTPUT,
        outputMode="append",
        timeMode="EventTime",
    )


def rate_limiter(
    requests: DataFrame,
    ts: str = "created_at",
    limit: int = 60,
    burst: int = 10,
    window: int = 60,
    burst_window: int = 10,
    delay: str = "1 minute",
    slot: int = 1,
) -> DataFrame:
    """Decision per request of a stream with ``client``, ``endpoint``, ``request_id`` and a time.

    Requests are decided once the watermark has passed their slot of ``slot`` seconds.
    """
    keyed = _timed(requests, ts, delay).select(
        F.concat_ws(":", F.col("client").cast("string"), "endpoint").alias("key"),
        "request_id",
        micros(ts).alias("us"),
        F.lit(limit).cast("int").alias("max_requests"),
        F.lit(burst).cast("int").alias("max_burst"),
        ts,
    )
    return _limited(keyed, window, burst_window, slot)


def _packed(requests: DataFrame, ts: str, step: int) -> DataFrame:
    """(newest, keys, ids, times): requests with a time, those of a step and of one batch of rows in one row.

    A row's step is that of its ``newest`` time. The closing row has a step of its own.
    """
    rows = requests.select(
        F.concat_ws(":", F.col("client").cast("string"), "endpoint").alias("keys"),
        F.coalesce(F.col("request_id").cast("long"), F.lit(-1)).alias("ids"),
        micros(ts).alias("times"),
    ).filter("times IS NOT NULL")
    width = step * SECOND

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            us = batch.column(2).to_numpy()
            order = np.argsort(us // width, kind="stable")
            us = us[order]
            starts = np.flatnonzero(np.diff(us // width, prepend=us[0] // width - 1))
            ends = pa.array(np.append(starts, len(us)), pa.int32())
            newest = pa.array(np.maximum.reduceat(us, starts))
            lists = [pa.ListArray.from_arrays(ends, c) for c in batch.take(pa.array(order)).columns]
            yield pa.RecordBatch.from_arrays([newest, *lists], ["newest", *batch.schema.names])

    packs = rows.mapInArrow(pack, "newest BIGINT, keys ARRAY<STRING>, ids ARRAY<BIGINT>, times ARRAY<BIGINT>")
    return packs.withColumn("newest", F.timestamp_micros("newest"))


def adaptive_limiter(
    requests: DataFrame,
    ts: str = "created_at",
    limit: int = 60,
    burst: int = 10,
    burst_window: int = 10,
    seconds: int = 30,
    step: int = 1,
    levels=LOAD_LEVELS,
    delay: str = "1 minute",
) -> DataFrame:
    """Limits follow the global request rate of the trailing ``seconds``; the per-client window has that width.

    One query. The rate is a hopping count, summed by task before any shuffle, over the ``seconds`` that end where the
    request's step of ``step`` seconds begins, so the factor lags by less than a step. Requests wait for it in a
    stream join by step, many to a row of its state, and for their turn in the limiter; a step without any earlier
    request has rate 0.
    """
    hop, width = f"{step} seconds", f"{seconds} seconds"
    # As in _timed, the closing row must meet the watermark.
    packs = _packed(requests, ts, step).withWatermark("newest", delay).filter(F.col("newest") < F.lit(END))
    stepped = packs.select("keys", "ids", "times", F.window("newest", hop).alias("step"))
    waiting = stepped.select("keys", "ids", "times", F.window_time("step").alias("step_end"))
    # Counted one step later, so that a window ends with the step whose requests it limits.
    later = requests.select((F.col(ts) + F.expr(f"INTERVAL {hop}")).alias("later")).withWatermark("later", delay)
    rates = (
        later.groupBy(F.window("later", width, hop).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.window_time("w").alias("rate_end"), (F.col("n") / seconds).alias("rps"))
    )
    joined = waiting.join(rates, F.col("step_end") == F.col("rate_end"), "left")
    _, factor = load_bands(F.coalesce("rps", F.lit(0.0)), levels, CRITICAL_LOAD)
    each = joined.select(
        F.explode(F.arrays_zip("keys", "ids", "times")).alias("r"),
        F.floor(F.lit(limit) * factor).cast("int").alias("max_requests"),
        F.floor(F.lit(burst) * factor).cast("int").alias("max_burst"),
        "step_end",
    )
    keyed = each.select(
        F.col("r.keys").alias("key"),
        F.col("r.ids").alias("request_id"),
        F.col("r.times").alias("us"),
        "max_requests",
        "max_burst",
        "step_end",
    )
    return _limited(keyed, seconds, burst_window, step)


BREAKER_OUTPUT = "service STRING, request_id BIGINT, us BIGINT, rejected BOOLEAN, state STRING, failures INT"


def trip(
    times: np.ndarray, failed: np.ndarray, state: str, failures: int, last: int, threshold: int, reset: int
) -> tuple[list[tuple[bool, str, int]], str, int, int]:
    """Run sorted requests through the breaker.

    Open: requests are rejected until ``reset`` microseconds after the last failure, then one is tried.
    A success closes a half-open breaker and clears the count; a success while closed does not.
    """
    out = []
    for t, bad in zip(times.tolist(), failed.tolist()):
        if state == "OPEN":
            if t - last > reset:
                state = "HALF_OPEN"
            else:
                out.append((True, state, failures))
                continue
        if bad:
            failures += 1
            last = t
            if failures >= threshold:
                state = "OPEN"
        elif state == "HALF_OPEN":
            state, failures = "CLOSED", 0
        out.append((False, state, failures))
    return out, state, failures, last


class Breaker(InOrder):
    columns = {"us": "BIGINT", "request_id": "BIGINT", "failed": "BOOLEAN"}

    def __init__(self, threshold: int, reset: int, slot: int):
        super().__init__(slot)
        self.threshold, self.reset = threshold, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.memory = handle.getValueState("breaker", "state STRING, failures INT, last BIGINT")

    def start(self, key) -> None:
        self.now = self.memory.get() or ("CLOSED", 0, 0)

    def decide(self, key, columns: list[np.ndarray]) -> dict:
        us, ids, failed = columns
        decisions, *self.now = trip(us, failed, *self.now, self.threshold, self.reset)
        rejected, states, counts = zip(*decisions)
        return {
            "service": np.full(len(us), key[0], dtype=object),
            "request_id": ids,
            "us": us,
            "rejected": np.array(rejected),
            "state": np.array(states, dtype=object),
            "failures": np.array(counts, dtype="int32"),
        }

    def stop(self, key) -> None:
        self.memory.update(tuple(self.now))


def circuit_breaker(
    requests: DataFrame,
    ts: str = "created_at",
    threshold: int = 5,
    reset_seconds: int = 60,
    delay: str = "1 minute",
    slot: int = 1,
) -> DataFrame:
    """State of the breaker after each request of a stream with ``service``, ``request_id``, ``failed``.

    Requests are decided once the watermark has passed their slot of ``slot`` seconds; a null ``failed`` is no failure.
    """
    keyed = _timed(requests, ts, delay).select(
        "service", "request_id", micros(ts).alias("us"), F.coalesce("failed", F.lit(False)).alias("failed"), ts
    )
    return keyed.groupBy("service").transformWithStateInPandas(
        statefulProcessor=Breaker(threshold, reset_seconds * SECOND, slot * SECOND),
        outputStructType=BREAKER_OUTPUT,
        outputMode="append",
        timeMode="EventTime",
    )


class LastRows(StatefulProcessor):
    """The newest ``n`` requests of a key: a ring of three numbers a row, whatever the stream has brought."""

    def __init__(self, n: int, min_samples: int, names: list[str]):
        self.n, self.min_samples, self.names = n, min_samples, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "us ARRAY<BIGINT>, ids ARRAY<BIGINT>, value ARRAY<DOUBLE>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.ring.get() or ([], [], [])
        us, ids, value = (np.array(x, dtype=t) for x, t in zip(stored, ("i8", "i8", "f8")))
        for chunk in rows:
            us = np.concatenate([us, chunk["us"].to_numpy()])
            ids = np.concatenate([ids, chunk["request_id"].to_numpy()])
            value = np.concatenate([value, chunk["value"].to_numpy(dtype="f8")])
            newest = np.lexsort((ids, -us))[: self.n]
            us, ids, value = us[newest], ids[newest], value[newest]
        self.ring.update((us.tolist(), ids.tolist(), value.tolist()))
        if len(us) >= self.min_samples:
            known = value[~np.isnan(value)]
            yield pd.DataFrame(
                {name: [k] for name, k in zip(self.names, key)}
                | {"n_rows": [len(us)], "mean_value": [known.mean() if len(known) else None], "request_ids": [ids.tolist()]}
            )

    def close(self) -> None:
        pass


def last_rows_stream(
    log: DataFrame,
    keys: list[str],
    value: str,
    ts: str = "created_at",
    request_id: str = "request_id",
    n: int = 1000,
    min_samples: int = 100,
) -> DataFrame:
    """The newest ``n`` requests per key and the mean of their ``value``, after each batch that brings the key rows.

    Keys with fewer than ``min_samples`` requests so far give nothing. Ties in time go to the smaller id. Rows without
    a time or an id are left out; keys are text, a null one is the text ``null``. For update mode.
    """
    rows = log.filter(F.col(ts).isNotNull() & F.col(request_id).isNotNull()).select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("null")).alias(k) for k in keys],
        micros(ts).alias("us"),
        F.col(request_id).cast("long").alias("request_id"),
        F.col(value).cast("double").alias("value"),
    )
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=LastRows(n, min_samples, keys),
        outputStructType=", ".join(f"{k} STRING" for k in keys)
        + ", n_rows BIGINT, mean_value DOUBLE, request_ids ARRAY<BIGINT>",
        outputMode="update",
        timeMode="None",
    )
