"""Bytes covered by strings of 100 that start earlier elsewhere, by prefix doubling over sampled positions.

Ranks are 64-bit names: the name of 2k bytes is made from the names of the two halves, offset by k. Doubling over all
positions would move each of them several times, so the first rounds run on a sample that no repeat can escape: of the
32-byte names inside each window of 100 bytes the smallest is the window's anchor, and equal windows have equal
anchors at equal places.

1. Every anchor is a row: its 32-byte name, and the name of the stretch that its own windows cover (100 to 168 bytes).
   Of anchors that a document has twice, only the first is sent; the others are repeats and are found again where the
   text is cut. Spark sorts rows by this pair of ranks and by place. Anchors whose first rank is unique are done.
2. Where both ranks were seen at an earlier place, all windows of the anchor are repeats. Where only the first rank
   is shared, the earliest anchor of each pair stays open.
3. For the windows of open anchors, the pair of 64-byte names at offsets 0 and 36 ranks the whole 100 bytes. Equal
   windows have anchors of equal name, so Spark sorts open stretches by name and place, and a window whose rank was
   seen under that name is a repeat. Names with very many open stretches send a row per window instead, sorted by
   rank and place, so that no task holds more than the ranks of a bounded number of stretches.

The bytes of all repeated windows are removed, judged on the input.

Defined results: null and empty texts, and texts below 100 bytes, lose nothing; equal rows that repeat an id count as one
document; other rows that repeat an id are told apart by position only; texts with a null id lose only what
they repeat themselves; an empty table gives an empty table; other
columns are ignored. Texts of any length are handled whole; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scorelens.llm.common import per_worker, rows, texts
from scorelens.session import cut_lineage

#: Length of a repeat, of a sampled name, and of the names that rank whole windows.
REPEAT, GRAM, LONG = 100, 32, 64
_SPAN = REPEAT - GRAM + 1
#: Bytes that are worked on together, besides a text that is longer (a dozen arrays hold 8 bytes for each); rows of
#: texts that are; documents whose spans may be sent to all executors.
_TOGETHER, _ROWS, _SENT = 1 << 18, 512, 500_000
#: Open stretches of one name that a task compares in memory.
_HELD = 20_000
_A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for two names in this order."""
    x = a * np.uint64(_A) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(_B)
    x ^= x >> np.uint64(32)
    return x


def names(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 32 and of the 64 bytes from each position on; near the end they are of no use."""
    x = _pair(raw.astype(np.uint64) + np.uint64(1), np.full(1, 0x94D049BB133111EB, np.uint64))
    k, short = 1, x
    while k < LONG:
        if k == GRAM:
            short = x
        shifted = np.zeros_like(x)
        shifted[:-k or None] = x[k:]
        x, k = _pair(x, shifted), 2 * k
    return short, x


def groups(ids: list, values: list[str]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Some documents at a time: their ids, all their bytes, and where each begins (and the last one ends)."""
    held, raws, size = [], [], 0
    for i, t in zip(ids, values):
        raw = t.encode()
        if raws and size + len(raw) > _TOGETHER:
            yield held, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
            held, raws, size = [], [], 0
        held.append(i)
        raws.append(raw)
        size += len(raw)
    if raws:
        yield held, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])


def anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, rank of 32 bytes, rank of the stretch) of every anchor."""
    n = len(raw)
    if n < REPEAT:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    short, long = names(raw)
    # The smallest name in each window, and the leftmost of equals: a minimum over names that end in their place.
    x = (short & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    k = 1
    while 2 * k <= _SPAN:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = _SPAN - k
    if rest:
        x = np.minimum(x[:-rest], x[rest:])
    at = (x[: n - REPEAT + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    window = np.arange(len(at))
    owner = np.searchsorted(starts, window, "right") - 1
    inside = window + REPEAT <= starts[owner + 1]
    window, at, owner = window[inside], at[inside], owner[inside]
    if not len(window):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    first, last = window[new], window[np.concatenate([new[1:] - 1, [len(window) - 1]])]
    a, d = at[new], owner[new]
    size = last - first + REPEAT
    stretch = _pair(long[first], long[first + np.minimum(52, size - LONG)])
    stretch = _pair(stretch, long[first + size - LONG])
    stretch = _pair(stretch, ((a - first) << 8 | (a - last)).astype(np.uint64))
    return d, first - starts[d], last - starts[d], short[a], stretch


def _first_inside(d: np.ndarray, gram: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Whether an anchor is the first of its document with these ranks; anchors come in the order of their place."""
    order = np.lexsort((np.arange(len(d)), stretch, gram, d))
    same = np.zeros(len(d), bool)
    o = order
    same[o[1:]] = (d[o[1:]] == d[o[:-1]]) & (gram[o[1:]] == gram[o[:-1]]) & (stretch[o[1:]] == stretch[o[:-1]])
    return ~same


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(gram, stretch, doc_id, at): ``at`` is the first window's place, times 256, plus the number of further windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_worker("repeats", dict, alone=True)
        for b in rows(batches, _ROWS):
            for ids, raw, starts in groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d, first, last, gram, stretch = anchors(raw, starts)
                k = _first_inside(d, gram, stretch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[k].view(np.int64)), pa.array(stretch[k].view(np.int64)),
                     pa.array(np.array(ids, np.int64)[d[k]]), pa.array(first[k] << 8 | (last - first)[k])],
                    ["gram", "stretch", "doc_id", "at"],
                )

    return docs.mapInArrow(run, "gram long, stretch long, doc_id long, at long")


def _settle(sorted_rows: DataFrame) -> DataFrame:
    """(open, gram, doc_id, at) from anchors in the order of both ranks and place.

    A row whose ranks both equal those of the row before it is settled: that one starts earlier. The first row of a
    pair of ranks is open if its 32 bytes have another pair, and otherwise done. Nothing is held but one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pending = None  # ranks of the last row; the first row of its 32 bytes while that is not known to be open
        for b in batches:
            if not b.num_rows:
                continue
            g, h, d, at = (b.column(k).to_numpy() for k in range(4))
            new_g = np.concatenate([[last is None or last[0] != g[0]], g[1:] != g[:-1]])
            new = new_g | np.concatenate([[last is None or last[1] != h[0]], h[1:] != h[:-1]])
            group = np.cumsum(new_g)
            more = np.bincount(group[new & ~new_g], minlength=group[-1] + 1) > 0
            open_ = (new & ~new_g) | (new_g & more[group])
            told = ~new | open_
            out = [open_[told], g[told], d[told], at[told]]
            if more[0] and pending:
                out, pending = [np.append(x, y) for x, y in zip(out, (True, *pending))], None
            if group[-1] > 0:
                i = int(np.flatnonzero(new_g)[-1])
                pending = None if more[-1] else (g[i], d[i], at[i])
            last = g[-1], h[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["open", "gram", "doc_id", "at"])

    return sorted_rows.mapInArrow(run, "open boolean, gram long, doc_id long, at long")


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents with their lists, sent to all executors where they are counted to be few, else by a shuffle."""
    size = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("list")), F.lit(0)).alias("k")).first()
    small = size["n"] <= _SENT and size["k"] <= 10 * _SENT
    return docs.join(F.broadcast(lists) if small else lists, "doc_id", how)


def _open_lists(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(doc_id, text, list): documents with the open anchors in them, as (at, gram)."""
    lists = opened.groupBy("doc_id").agg(F.collect_list(F.struct("at", "gram")).alias("list"))
    return _with_lists(docs, cut_lineage(lists), "inner").select("doc_id", "text", "list")


def _stretch_rows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(gram, doc_id, at, bytes) of every open anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, _ROWS):
            grams, ids, ats, parts = [], [], [], []
            for i, text, found in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode()
                for x in found:
                    first = x["at"] >> 8
                    grams.append(x["gram"])
                    ids.append(i)
                    ats.append(x["at"])
                    parts.append(raw[first : first + (x["at"] & 255) + REPEAT])
            for at in range(0, len(ids), 20_000):
                part = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[part], pa.int64()), pa.array(ids[part], pa.int64()),
                     pa.array(ats[part], pa.int64()), pa.array(parts[part], pa.binary())],
                    ["gram", "doc_id", "at", "bytes"],
                )

    return _open_lists(docs, opened).mapInArrow(run, "gram long, doc_id long, at long, bytes binary")


def _seen_before(sorted_rows: DataFrame) -> DataFrame:
    """(doc_id, span) of windows whose rank an earlier stretch of the same name has; neighbours are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seen = None, set()
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(3).to_pylist()
            starts = np.cumsum([0, *map(len, parts)])
            _, long = names(np.frombuffer(b"".join(parts), np.uint8))
            rank = _pair(long[: len(long) - (REPEAT - LONG)], long[REPEAT - LONG :])
            ids, spans = [], []
            for k, (gram, doc, at) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if gram != name:
                    name, seen = gram, set()
                mine = rank[starts[k] : starts[k] + (at & 255) + 1].tolist()
                hit = [j for j, r in enumerate(mine) if r in seen]
                seen.update(mine)
                first = at >> 8
                begin = None
                for j, nxt in zip(hit, [*hit[1:], -1]):
                    begin = j if begin is None else begin
                    if nxt != j + 1:
                        ids.append(doc)
                        spans.append((first + begin) << 32 | first + j + REPEAT)
                        begin = None
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.int64())], ["doc_id", "span"])

    return sorted_rows.mapInArrow(run, "doc_id long, span long")


def _window_rows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(rank, doc_id, place) of every window of the open anchors; the rank is that of all 100 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, _ROWS):
            lists = b.column(2).to_pylist()
            k = 0
            for ids, raw, starts in groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ats = [np.array([x["at"] for x in found], np.int64) for found in lists[k : k + len(ids)]]
                k += len(ids)
                begin = np.concatenate([(x >> 8) + s for x, s in zip(ats, starts)])
                size = np.concatenate([x & 255 for x in ats]) + 1
                owner = np.repeat(np.repeat(np.arange(len(ids)), [len(x) for x in ats]), size)
                place = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                _, long = names(raw)
                rank = _pair(long[place], long[place + REPEAT - LONG])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank.view(np.int64)), pa.array(np.array(ids, np.int64)[owner]), pa.array(place - starts[owner])],
                    ["rank", "doc_id", "place"],
                )

    return _open_lists(docs, opened).mapInArrow(run, "rank long, doc_id long, place long")


def _later(sorted_rows: DataFrame) -> DataFrame:
    """(doc_id, place) of the rows whose rank the row before them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                r = b.column(0).to_numpy()
                again = pa.array(np.concatenate([[last == r[0]], r[1:] == r[:-1]]))
                last = r[-1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).filter(again), b.column(2).filter(again)], ["doc_id", "place"]
                )

    return sorted_rows.mapInArrow(run, "doc_id long, place long")


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = _HELD
) -> DataFrame:
    """(doc_id, list): starts and ends of stretches that an earlier anchor settles, as start * 2^32 + end.

    They may overlap. Anchors that a document repeats itself are left to ``_inside``.
    """
    docs = texts(df, id_col, text_col).filter(F.col("doc_id").isNotNull())
    ordered = _anchor_rows(docs).repartition("gram").sortWithinPartitions("gram", "stretch", "doc_id", "at")
    found = cut_lineage(_settle(ordered))
    opened = found.filter("open").select("gram", "doc_id", "at")
    many = cut_lineage(opened.groupBy("gram").count().filter(F.col("count") > held).select("gram"))
    first = F.shiftright("at", 8)
    whole = F.shiftleft(first, 32) + first + F.col("at").bitwiseAND(255) + REPEAT
    spans = found.filter("NOT open").select("doc_id", whole.alias("span"))
    rest = opened
    if not many.isEmpty():
        rest = opened.join(many, "gram", "left_anti")
        windows = _window_rows(docs, opened.join(many, "gram", "left_semi"))
        again = _later(windows.repartition("rank").sortWithinPartitions("rank", "doc_id", "place"))
        spans = spans.unionAll(again.select("doc_id", (F.shiftleft("place", 32) + F.col("place") + REPEAT).alias("span")))
    stretches = _stretch_rows(docs, rest).repartition("gram").sortWithinPartitions("gram", "doc_id", "at")
    spans = spans.unionAll(_seen_before(stretches))
    return spans.groupBy("doc_id").agg(F.collect_list("span").alias("list"))


def _inside(values: list[str]) -> list[list[int]]:
    """Per text, the spans of anchors that it has had before, as start * 2^32 + end."""
    out: list[list[int]] = []
    for ids, raw, starts in groups(list(range(len(values))), values):
        d, first, last, gram, stretch = anchors(raw, starts)
        again = ~_first_inside(d, gram, stretch)
        spans = (first << 32 | last + REPEAT)[again]
        ends = np.searchsorted(d[again], np.arange(len(ids) + 1))
        out += [spans[ends[k] : ends[k + 1]].tolist() for k in range(len(ids))]
    return out


def cut_texts(values: list[str], lists: list[list[int] | None]) -> Iterator[tuple[bytes, bytes, int]]:
    """Each text's bytes, what is left of them, and the number of stretches cut out."""
    for text, spans, own in zip(values, lists, _inside(values)):
        raw, at, parts = text.encode(), 0, []
        cut = merged([*(spans or []), *own])
        for start, end in cut.tolist():
            parts.append(raw[at:start])
            at = end
        yield raw, b"".join([*parts, raw[at:]]), len(cut)


def merged(spans: list[int] | None) -> np.ndarray:
    """Maximal stretches (start, end) that overlapping or touching spans cover."""
    x = np.sort(np.array(spans or [], np.int64))
    if not len(x):
        return x.reshape(0, 2)
    start, end = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.concatenate([new[1:], [True]])]], 1)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeated bytes cut out of its text; other columns stay. Broken characters are left out."""
    lists = cut_lineage(repeated_spans(df, id_col, text_col)).select(
        F.col("doc_id").alias("_repeats_id"), F.col("list").alias("_repeats_list")
    )
    size = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_repeats_list")), F.lit(0)).alias("k")).first()
    small = size["n"] <= _SENT and size["k"] <= 10 * _SENT
    on = df[id_col].cast("long") == F.col("_repeats_id")

    @F.arrow_udf(StringType())
    def cut(column: pa.Array, known: pa.Array, spans: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(column), _ROWS):
            values, named = (x.slice(at, _ROWS).to_pylist() for x in (column, known))
            done = cut_texts([t if t and k else "" for t, k in zip(values, named)], spans.slice(at, _ROWS).to_pylist())
            left = [
                rest.decode(errors="ignore") if t and k and n else t
                for t, k, (_, rest, n) in zip(values, named, done)
            ]
            parts.append(pa.array(left, pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    joined = df.join(F.broadcast(lists) if small else lists, on, "left")
    known = F.col(id_col).isNotNull()
    return joined.withColumn(text_col, cut(text_col, known, "_repeats_list")).select(*df.columns)


def remove_repeats(
    df: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every document.

    What is left of a text may begin or end inside a character; ``kept_text`` leaves such broken characters out.
    """
    docs = texts(df, id_col, text_col)
    lists = cut_lineage(repeated_spans(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, _ROWS):
            out: tuple[list, ...] = ([], [], [], [], [])
            for raw, left, n in cut_texts(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept = left.decode(errors="ignore") if with_text else ""
                row = len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), kept
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, kind) for c, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            )

    joined = _with_lists(docs, lists, "left").select("doc_id", "text", "list")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    done = joined.mapInArrow(run, schema)
    return done if with_text else done.drop("kept_text")
