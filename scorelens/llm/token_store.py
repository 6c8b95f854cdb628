"""Token ids in compressed blocks: static range asymmetric numeral system over one shared frequency table.

A store is a folder of two tables. ``freq`` is the shared table: how many of 2^20 slots each id has. ``blocks`` has one
row per block: the documents in it, in ascending order, their lengths, the position of the block's first id in the
whole, and the payload. A payload is a header, the final coder states, checkpoints and 32-bit words, all
little-endian, with a checksum that reading verifies. Ids are dealt to interleaved lanes, one numpy operation per step
for all lanes. Blocks decode independently of each other, and inside a block from any checkpoint.

Documents are ordered by range partitions; no task sees more than its range, and a block is closed as soon as it
holds ``BLOCK`` ids. A document lies whole in one block. Frequencies are counted over all ids.

Defined results: null and empty texts have only the end id; rows that repeat an id stand next to each other, ordered by
text; an empty table gives an empty store and reads back as an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.llm.common import gathered, per_worker, rows, small_batches, texts
from scorelens.llm.words import WordEncoder, offsets
from scorelens.session import scratch_path

#: Slots of the frequency table as a power of two, lowest coder state, ids in a block, lanes, steps between checkpoints.
PRECISION, LOW, BLOCK, LANES, EVERY = 20, 1 << 31, 1 << 18, 1024, 128
_HEAD = "<4sIIII"  # mark, ids, lanes, checkpoints, words


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Slots per id, in proportion to the counts; every id that occurs has one at least, and they fill the table."""
    total, slots = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * (slots / total)).astype(np.int64), 0)
    spare = slots - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare >= 0:
        freq[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        take = min(-spare, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
        freq[i] -= take
        spare += take
    while spare < 0:
        i = int(np.argmax(freq))
        freq[i] -= 1
        spare += 1
    return freq


class Coder:
    """Encodes and decodes one block at a time with a given frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.common = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, ids: np.ndarray) -> bytes:
        """The block's bytes. Steps are coded from the last to the first, so that decoding goes forwards."""
        n = len(ids)
        lanes = int(min(LANES, max(1, n // 128)))
        steps = -(-n // lanes)
        grid = np.full(steps * lanes, self.common, np.uint32)
        grid[:n] = ids
        grid = grid.reshape(steps, lanes)
        f, c = self.freq[grid], self.start[grid]
        if not f.all():
            raise ValueError("an id has no slot in the frequency table")
        x = np.full(lanes, LOW, np.uint64)
        most = np.uint64((LOW >> PRECISION) << 32)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for k in range(steps - 1, -1, -1):
            fk = f[k]
            full = x >= most * fk
            out = x[full]
            if len(out):
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(out)
                x[full] = out >> np.uint64(32)
            q = x // fk
            x = (q << np.uint64(PRECISION)) + (x - q * fk) + c[k]
            if k and k % EVERY == 0:
                marks.append((written, x.copy()))
        body = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        head = struct.pack(_HEAD, b"rANS", n, lanes, len(marks), len(body))
        points = b"".join(struct.pack("<I", written - w) + s.astype("<u8").tobytes() for w, s in marks[::-1])
        rest = head + x.astype("<u8").tobytes() + points + body.tobytes()
        return rest + struct.pack("<I", zlib.crc32(rest))

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last``; all by default."""
        if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        mark, n, lanes, points, size = struct.unpack_from(_HEAD, payload)
        if mark != b"rANS":
            raise ValueError("not a block")
        at = struct.calcsize(_HEAD)
        x, pos = np.frombuffer(payload, "<u8", lanes, at).copy(), 0
        if first:
            place = at + 8 * lanes + (first - 1) * (4 + 8 * lanes)
            pos = struct.unpack_from("<I", payload, place)[0]
            x = np.frombuffer(payload, "<u8", lanes, place + 4).copy()
        words = np.frombuffer(payload, "<u4", size, len(payload) - 4 - 4 * size)
        steps = -(-n // lanes)
        end = steps if last is None else min(steps, last * EVERY)
        out = np.empty((end - first * EVERY, lanes), np.uint32)
        low_bits, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
        for k in range(len(out)):
            slot = x & low_bits
            s = self.symbol[slot]
            out[k] = s
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = x[low] << np.uint64(32) | words[pos : pos + len(low)]
                pos += len(low)
        return out.reshape(-1)[: max(0, min(n, end * lanes) - first * EVERY * lanes)]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The ids of some rows (doc_id, text) at a time, with the end id."""
    encoder = per_worker(("words", path), lambda: WordEncoder(path, limit=600_000), alone=True)
    end = struct.pack("<I", end_id)
    for b in gathered(batches, 8 << 20):
        yield b.column(0), encoder.encode_array(b.column(1), end)


def encode_ids(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids with the end id as little-endian unsigned 32-bit bytes, in the order of the rows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, got in _encoded(batches, path, end_id):
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.diff(offsets(got)) // 4), got.cast(pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return texts(df, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def write_store(
    df: DataFrame, to: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode all texts in ascending id order into a new store at ``to``."""
    spark = df.sparkSession
    ordered = texts(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    plain = scratch_path(spark, "ids")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Encode, narrow the ids, and say where each document starts in its partition, all in one worker a task: of two,
        # each would come to keep the words.
        at = 0
        for doc_ids, got in _encoded(batches, path, end_id):
            ends = offsets(got) // 4
            n, starts = np.diff(ends), at + ends[:-1]
            at += int(ends[-1])
            ids = np.frombuffer(got.buffers()[2], "<u4", ends[-1])
            if ids.max() < 65536:
                cuts, raw = (2 * ends).astype(np.int32), ids.astype("<u2")
                short = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
            else:
                found = [ids[a:b] for a, b in zip(ends, ends[1:])]
                short = pa.array([(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(n), short, pa.array(starts)], ["doc_id", "n_tokens", "ids", "at"]
            )

    encoded = ordered.mapInArrow(number, "doc_id long, n_tokens long, ids binary, at long")
    with small_batches(spark):
        encoded.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(plain)
    plain_ids = spark.read.schema("doc_id long, n_tokens long, ids binary, at long, part int").parquet(plain)

    # One row per partition: the sums reach the driver, the documents don't.
    base, bases = 0, {}
    for r in plain_ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():
        bases[r["part"]], base = base, base + r["n"]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            both: tuple[list[bytes], list[bytes]] = ([], [])
            for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[len(x) != 2 * n].append(x)
            for some, kind in zip(both, ("<u2", "<u4")):
                seen = np.bincount(np.frombuffer(b"".join(some), kind))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    # As many rows as the vocabulary has ids at most.
    counted = plain_ids.select("ids", "n_tokens").mapInArrow(histogram, "id long, n long")
    found = counted.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(max(found["id"].to_pylist(), default=-1)) + 1, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    freq = frequencies(counts)
    spark.createDataFrame(
        pa.table({"id": pa.array(np.flatnonzero(freq), pa.int64()), "freq": pa.array(freq[freq > 0], pa.int64())}),
        "id long, freq long",
    ).coalesce(1).write.parquet(f"{to}/freq")

    shared = spark.sparkContext.broadcast((freq, bases))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, bases = shared.value
        coder = Coder(freq)
        docs, parts, size, start, due = [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([start], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                    pa.array([coder.encode(np.concatenate(parts))], pa.binary()),
                ],
                ["start", "doc_ids", "lengths", "payload"],
            )

        for b in batches:
            for doc, n, ids, at, part in zip(*(b.column(k).to_pylist() for k in range(5))):
                here = bases[part] + at
                if docs and (size >= BLOCK or here != due):
                    yield close()
                    docs, parts, size = [], [], 0
                if not docs:
                    start = here
                docs.append(doc)
                parts.append(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"))
                size, due = size + n, here + n
        if docs:
            yield close()

    plain_ids.mapInArrow(blocks, "start long, doc_ids array<long>, lengths array<long>, payload binary").write.option(
        "compression", "none"
    ).parquet(f"{to}/blocks")


def read_store(spark: SparkSession, store: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files of a store."""
    found = spark.read.schema("id long, freq long").parquet(f"{store}/freq").toArrow()  # a row per used id
    freq = np.zeros(int(max(found["id"].to_pylist(), default=-1)) + 1, np.int64)
    freq[found["id"].to_numpy()] = found["freq"].to_numpy()
    shared = spark.sparkContext.broadcast(freq)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in rows(batches, 1):
            start, lengths = b.column(0)[0].as_py(), np.array(b.column(2)[0].as_py(), np.int64)
            ids = coder.decode(b.column(3)[0].as_py()).astype("<u4")
            ends = np.cumsum(lengths)
            each = np.split(ids, ends[:-1])
            out = [
                b.column(1)[0].values,
                pa.array(start + ends - lengths, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array([x.tolist() for x in each], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    table = spark.read.schema("start long, doc_ids array<long>, lengths array<long>, payload binary")
    return table.parquet(f"{store}/blocks").mapInArrow(decode, schema)
