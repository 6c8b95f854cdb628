"""Packing token pieces into sequences by patterns of lengths.

Documents are cut only where they are longer than a sequence. The histogram of piece lengths, at most ``size`` rows,
is all that planning sees: every pattern of one, two or three lengths that fills a sequence is a column of a
non-negative least-squares problem whose solution says how often to repeat it. Repeats are rounded along a running
total, so that their sum stays, and limited to what the histogram still has; what is left over is packed best fit, the
longest first, still by counts and not by pieces. The plan says, for every length, which ranks go to which sequences
and offsets; pieces find their rank by counting within salted groups of their length, so the work on pieces is one
aggregate, one window over bounded groups and one lookup.

Defined results: null and empty texts are one piece of just the end id; rows that repeat an id are packed each for
itself; ties between pieces of equal length are broken by id, piece number and checksum; an empty table gives an empty
table; other columns are ignored. A text of any length is handled whole.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.common import gathered, per_worker, texts
from scorelens.llm.words import WordEncoder
from scorelens.session import cut_lineage

#: Pieces in a salted group that is ranked together: this many, or as many as leave ``_MOST_GROUPS`` groups.
_GROUP, _MOST_GROUPS = 300, 50_000


def cut_pieces(
    df: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("words", path, False), lambda: WordEncoder(path, spaces=False), alone=True)
        end = end_id.to_bytes(4, "little")
        for b in gathered(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, got in zip(b.column(0).to_pylist(), encoder.encode_array(b.column(1)).to_pylist()):
                ids = got + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row = doc, k, at // 4, len(part) // 4, zlib.crc32(part), part
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, kind) for c, kind in zip(out, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in out[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return texts(df, id_col, text_col).mapInArrow(cut, schema)


def patterns(size: int) -> np.ndarray:
    """All non-rising triples of lengths that sum to ``size``; zeros where a pattern has fewer parts."""
    out = [np.array([[size, 0, 0]])]
    half = np.arange(1, size // 2 + 1)
    out.append(np.stack([size - half, half, 0 * half], 1))
    for c in range(1, size // 3 + 1):
        b = np.arange(c, (size - c) // 2 + 1)
        out.append(np.stack([size - c - b, b, np.full(len(b), c)], 1))
    return np.concatenate(out)


def repeat_counts(histogram: np.ndarray, shapes: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: how often each pattern should be used.

    Lengths weigh alike. The problem's matrix has three entries a column, so products with it are sums by length.
    """
    n = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    used = (target[shapes] > 0) | (shapes == 0)
    open_ = used.all(1)  # a pattern with a length that nothing has can't be filled
    parts = shapes[open_]
    x = np.zeros(len(parts))
    if not len(parts):
        return np.zeros(len(shapes))
    degree = np.bincount(parts.ravel(), minlength=n).astype(float)
    degree[0] = 0
    # Steps scaled by how many patterns compete for a length.
    step = 1.0 / np.maximum(1.0, degree[parts].sum(1))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        made = np.bincount(parts.ravel(), np.repeat(y, 3), minlength=n)
        gap = target - made
        gap[0] = 0
        new = np.maximum(0, y + step * gap[parts].sum(1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    out = np.zeros(len(shapes))
    out[open_] = x
    return out


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: (lengths of a sequence, how many such sequences)."""
    room: dict[int, Counter] = defaultdict(Counter)  # free ids -> contents -> sequences
    for length in range(size, 0, -1):
        n = int(left[length])
        # The fullest sequences that still have room; what a length makes of them is set aside until the next length
        # unless it can take another piece of the same length.
        while n:
            free = min((f for f in room if f >= length), default=None)
            if free is None:
                k = size // length
                whole, rest = divmod(n, k)
                if whole:
                    room[size - k * length][(length,) * k] += whole
                if rest:
                    room[size - rest * length][(length,) * rest] += 1
                break
            group = room[free]
            held, many = next(iter(group.items()))
            take = min(many, n)
            n -= take
            if take == many:
                del group[held]
            else:
                group[held] -= take
            if not group:
                del room[free]
            room[free - length][(*held, length)] += take
    return [(held, many) for group in room.values() for held, many in group.items()]


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up the histogram (item k: pieces of length k)."""
    left, out = histogram.astype(np.int64).copy(), []
    left[0] = 0
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    shapes = patterns(size)[1:]
    for _ in range(3):
        wanted = repeat_counts(left, shapes)
        total = np.floor(np.cumsum(wanted) + 0.5).astype(np.int64)
        count = np.diff(total, prepend=0)
        took = 0
        for k in np.argsort(-count, kind="stable")[: int((count > 0).sum())]:
            parts = [int(v) for v in shapes[k] if v]
            need = Counter(parts)
            n = min(int(count[k]), *(int(left[v]) // m for v, m in need.items()))
            if n > 0:
                for v, m in need.items():
                    left[v] -= n * m
                out.append((tuple(parts), n))
                took += n
        if took * 50 < left.sum():
            break
    return out + best_fit(left, size)


def placements(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: where the pieces of each length go."""
    out, ranks, sequence = [], Counter(), 0
    for parts, n in chosen:
        offset = 0
        for v in parts:
            out.append((v, ranks[v], sequence, offset))
            ranks[v] += n
            offset += v
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset. Needs doc_id, piece, length and ids_crc32; reads ``pieces`` three times."""
    spark = pieces.sparkSession
    histogram = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().toLocalIterator():  # at most one row per length
        histogram[r["length"]] = r["count"]
    where = placements(plan(histogram, size))
    group = max(_GROUP, int(histogram.sum()) // _MOST_GROUPS)
    salts = F.array(*[F.lit(max(1, -(-int(n) // group))) for n in histogram])
    salted = pieces.withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))).cast("int")
    )
    # Groups are as many as their size allows, so their counts fit the driver.
    base: dict[tuple[int, int], int] = {}
    total: Counter = Counter()
    counts = salted.groupBy("length", "_salt").count()
    for r in sorted(counts.toLocalIterator(), key=lambda r: (r["length"], r["_salt"])):
        base[r["length"], r["_salt"]] = total[r["length"]]
        total[r["length"]] += r["count"]
    shared = spark.sparkContext.broadcast((base, where))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, where = shared.value
        keys = where[:, 0] << 42 | where[:, 1]
        for b in batches:
            length, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_salt", "_rank"))
            rank = rank + np.array([base[x] for x in zip(length.tolist(), salt.tolist())], np.int64)
            k = np.searchsorted(keys, length << 42 | rank, "right") - 1
            keep = [i for i, c in enumerate(b.schema.names) if c not in ("_salt", "_rank")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(where[k, 2] + rank - where[k, 1]), pa.array(where[k, 3])],
                [*(b.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", (F.row_number().over(order) - 1).cast("long"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(
    df: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every piece of every document with its place; pieces are written to the shared folder once."""
    return pack(cut_lineage(cut_pieces(df, path, size, end_id, False, id_col, text_col)), size)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences. Needs ``ids``; a group has ``size`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda p: p["offset"]).alias("offsets"),
    )
