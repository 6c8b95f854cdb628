"""Document fingerprints: an invertible Bloom lookup sketch of a text's paragraphs.

A paragraph is a line, and a long line is cut on after words chosen by their own hash, so that short texts have
several and an edit moves no other border. Each paragraph's 64-bit digest (with the number of its earlier
occurrences) is added to one cell in each of three parts of the sketch. Two sketches subtract cell by cell; what both
texts have cancels, and peeling cells that hold one digest recovers the digests in which they differ. A sketch too
small for the difference fails to peel, and both are built anew at twice the size until they do. The first size follows
from an estimate of the difference: sums of random signs, which subtract as the cells do. Many pairs are built,
subtracted and peeled at once, in flat arrays. Likeness is shared over all paragraphs of both texts.

The fingerprint is the sketch of the smallest size in hexadecimal, with the number of paragraphs and a checksum of
the text. Documents are ordered by range partitions; the one document that a range needs from the next range is
copied to it, so each text moves once.

Defined results: null and empty texts have no paragraph, are alike to each other (1) and to nothing else (0); rows that
repeat an id stand in the order of their texts; a null id stands below all others; a single document is its own next;
an empty table gives an empty table; other columns are ignored. Texts of any length are handled whole, at about 60 bytes
of memory for each of their bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import per_worker, texts

#: Cells of the smallest sketch, its parts, one word in so many ends a paragraph, and signs that estimate a difference.
CELLS, PARTS, CUT, SIGNS = 24, 3, 8, 24
#: Odd numbers that hashes are made with, and the bytes that separate words: space and \t to \r.
_ODD, _GOLDEN = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CHECK, _SIGN = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5C5C5C5C5C5C5C5C)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests:
    """Paragraph digests of texts, from their bytes: no word is looked at alone."""

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            self.byte = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
        self.power = np.ones(1, np.uint64)

    def of(self, text: str) -> np.ndarray:
        return self.of_all([text])[0]

    def of_all(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The digests of all texts side by side, those of a paragraph's repeats apart, and the text of each digest."""
        raw = [t.encode() for t in many]
        b = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        blank = _BLANK[b]
        inner = np.flatnonzero(~blank)
        if not len(inner):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(inner, prepend=-2) > 1)  # of each word, among the bytes that are not blank
        starts = inner[first]
        length = np.diff(first, append=len(inner))
        if length.max() > len(self.power):
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length.max(), _ODD)]), dtype=np.uint64)
        place = np.arange(len(inner)) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            h = _mix(np.add.reduceat(self.byte[b[inner]] * self.power[place], first) + length.astype(np.uint64))
        text = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), starts, side="right")
        # A paragraph starts after a line end and after a word that ends one; each text ends in a line end here.
        line = np.searchsorted(np.flatnonzero(b == 10), starts)
        begins = np.concatenate([[True], (line[1:] != line[:-1]) | (h[:-1] % np.uint64(CUT) == 0)])
        first = np.flatnonzero(begins)
        place = np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h)))
        with np.errstate(over="ignore"):
            digest = _mix(np.add.reduceat(_mix(h + place.astype(np.uint64) * _GOLDEN), first))
            text = text[first]
            order = np.lexsort((digest, text))
            digest, text = digest[order], text[order]
            # The n-th occurrence of a paragraph is an item of its own.
            new = (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])
            start = np.flatnonzero(np.concatenate([[True], new]))
            again = np.arange(len(digest)) - np.repeat(start, np.diff(start, append=len(digest)))
            return _mix(digest + again.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), text


class Sketch:
    """Cells of (count, sum of digests, sum of checks) of one set, or of many side by side, each of its size.

    Sums are taken modulo 2^64, so they cancel as the counts do.
    """

    def __init__(self, items: np.ndarray, size: int | np.ndarray = CELLS, owner: np.ndarray | None = None):
        self.sizes = np.atleast_1d(np.asarray(size, np.int64))
        self.start = np.cumsum(self.sizes) - self.sizes
        cells = int(self.sizes.sum())
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.count = np.zeros(cells, np.int64)
        self.digests, self.checks = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        self._add(items, np.zeros(len(items), np.int64) if owner is None else owner, np.ones(len(items), np.int64))

    def _add(self, items: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Put each item into its owner's cells; the cells that were touched."""
        part, start = self.sizes[owner] // PARTS, self.start[owner]
        touched = np.zeros(len(self.count), bool)
        with np.errstate(over="ignore"):
            times = sign.astype(np.uint64)
            digests, checks = items * times, _mix(items ^ _CHECK) * times
            for k in range(PARTS):
                at = (_mix(items + np.uint64(k + 1)) % part.astype(np.uint64)).astype(np.int64) + start + k * part
                np.add.at(self.count, at, sign)
                np.add.at(self.digests, at, digests)
                np.add.at(self.checks, at, checks)
                touched[at] = True
        return np.flatnonzero(touched)

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(np.zeros(0, np.uint64), self.sizes)
        out.count = self.count - other.count
        out.digests, out.checks = self.digests - other.digests, self.checks - other.checks
        return out

    def peel_all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests, their sketches and signs as far as peeling comes, and which sketches got stuck."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        look = np.flatnonzero(self.count)
        for _ in range(2 * int(self.sizes.max(initial=0)) + 1):
            pure = look[np.abs(self.count[look]) == 1]
            sign = self.count[pure]
            with np.errstate(over="ignore"):
                items = self.digests[pure] * sign.astype(np.uint64)
                alone = self.checks[pure] * sign.astype(np.uint64) == _mix(items ^ _CHECK)
            if not alone.any():
                break
            # An item may lie alone in several cells of its sketch; it is taken out once.
            items, owner, sign = items[alone], self.owner[pure[alone]], sign[alone]
            order = np.lexsort((items, owner))
            items, owner, sign = items[order], owner[order], sign[order]
            once = np.concatenate([[True], (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])])
            found.append((items[once], owner[once], sign[once]))
            look = self._add(items[once], owner[once], -sign[once])
        left = (self.count != 0) | (self.digests != 0) | (self.checks != 0)
        stuck = np.bincount(self.owner[left], minlength=len(self.sizes)) > 0
        return *(np.concatenate(x) for x in zip(*found)), stuck

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests that only the first and only the second set has, or None where peeling gets stuck."""
        items, _, sign, stuck = self.peel_all()
        return None if stuck.any() else (items[sign > 0], items[sign < 0])

    def texts(self) -> list[str]:
        cells = np.empty(len(self.count), [("count", ">u2"), ("digests", ">u8"), ("checks", ">u4")])
        cells["count"], cells["digests"] = self.count & 0xFFFF, self.digests
        cells["checks"] = self.checks & np.uint64(0xFFFFFFFF)
        raw, width = cells.tobytes().hex(), 2 * cells.itemsize
        return [raw[s * width : (s + n) * width] for s, n in zip(self.start.tolist(), self.sizes.tolist())]


def _sums(items: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(SIGNS, n): per set, over its digests, the sum of a random sign from each bit; the sums of sets subtract."""
    out = np.zeros((SIGNS, n), np.int64)
    if len(items):
        bits = _mix(items ^ _SIGN).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        many = np.diff(first, append=len(items))
        for k in range(SIGNS):
            out[k, owner[first]] = 2 * np.add.reduceat((bits >> k) & 1, first) - many
    return out


def differences(
    items: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, size: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests in which the sets ``left[k]`` and ``right[k]`` differ, with k and the side (1 left, -1 right).

    ``items`` are the digests of ``n`` sets by ascending ``owner``. The mean square of the difference of two sets' signed
    sums estimates how many digests they differ in, and so the first size of a pair's sketches, unless ``size`` states
    it. Pairs whose peeling gets stuck are built again at twice the size until none is left, so the answer is whole.
    """
    length = np.bincount(owner, minlength=n)
    begin = np.cumsum(length) - length
    if size is None:
        sums = _sums(items, owner, n)
        apart = ((sums[:, left] - sums[:, right]) ** 2).mean(axis=0)
        sizes = PARTS * np.ceil((1.8 * apart + 9) / PARTS).astype(np.int64)
    else:
        sizes = np.full(len(left), size, np.int64)
    open_ = np.arange(len(left))
    found = []

    def side(which: np.ndarray) -> Sketch:
        many = length[which]
        at = np.repeat(begin[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return Sketch(items[at], sizes[open_], np.repeat(np.arange(len(which)), many))

    while len(open_):
        got, pair, sign, stuck = side(left[open_]).minus(side(right[open_])).peel_all()
        done = ~stuck[pair]
        found.append((got[done], open_[pair[done]], sign[done]))
        open_ = open_[stuck]
        sizes[open_] *= 2
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((empty.astype(np.uint64), empty, empty), *found))


def difference(a: np.ndarray, b: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digests that only one side has."""
    owner = np.repeat([0, 1], [len(a), len(b)])
    items, _, sign = differences(np.concatenate([a, b]), owner, np.array([0]), np.array([1]), 2, size)
    return items[sign > 0], items[sign < 0]


def likeness(items: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Per pair of sets, paragraphs that both have over paragraphs that either has; 1 for two empty sets."""
    apart = np.bincount(differences(items, owner, left, right, n)[1], minlength=len(left))
    length = np.bincount(owner, minlength=n)
    both = length[left] + length[right]
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def fingerprint(text: str, items: np.ndarray) -> str:
    return _prints([text], items, np.zeros(len(items), np.int64))[0]


def _prints(many: list[str], items: np.ndarray, owner: np.ndarray) -> list[str]:
    length = np.bincount(owner, minlength=len(many)).tolist()
    cells = Sketch(items, np.full(len(many), CELLS), owner).texts()
    return [f"{n:x}:{zlib.crc32(t.encode()):08x}:{c}" for t, n, c in zip(many, length, cells)]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512, chars: int = 1 << 21) -> Iterator[list[tuple]]:
    """Rows in lists of bounded number and length; a longer text is in a list of its own or ends one."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            for row in zip(*(c.to_pylist() for c in part.columns)):
                held.append(row)
                size += len(row[-1])
                if len(held) >= rows or size >= chars:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _with_next(df: DataFrame) -> DataFrame:
    """(range_, spare, doc_id, text): each range with, behind its rows, the first row of what follows it."""
    spark = df.sparkSession
    lowest = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(lowest))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(key.alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < key)) if cuts else F.lit(0)
    found = df.select(key.alias("k"), of.alias("r")).groupBy("r").agg(F.max("k").alias("k")).collect()  # a row per range
    highest = {r["r"]: r["k"] for r in found}
    order = sorted(highest)
    # The highest row of a range follows the lowest row of the range above; the highest of all follows the lowest.
    above = {highest[r]: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    copy = F.lit(None).cast("int")
    if above:
        target = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
        copy = F.try_element_at(target, key).cast("int")
    places = F.array_compact(
        F.array(
            F.struct(of.cast("int").alias("range_"), F.lit(0).alias("spare")),
            F.when(copy.isNotNull(), F.struct(copy.alias("range_"), F.lit(1).alias("spare"))),
        )
    )
    placed = df.select(F.explode(places).alias("p"), "doc_id", "text").select("p.range_", "p.spare", "doc_id", "text")
    return placed.repartition("range_").sortWithinPartitions(
        "range_", "spare", F.coalesce("doc_id", F.lit(lowest)).desc(), "text"
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_items, fingerprint) of every text, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = per_worker("paragraphs", Digests)
        for part in _slices(batches):
            many = [t for _, t in part]
            items, owner = digests.of_all(many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part], pa.int64()),
                    pa.array(np.bincount(owner, minlength=len(many)), pa.int64()),
                    pa.array(_prints(many, items, owner), pa.string()),
                ],
                ["doc_id", "n_items", "fingerprint"],
            )

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_items long, fingerprint string")


def edited_and_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next document's are.

    The edited form has its last third replaced by as many first characters of the next document, by falling id.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = per_worker("paragraphs", Digests)
        held = None  # the row whose next one comes with the next slice
        for part in _slices(batches):
            # Of rows that repeat the copied id only the first is the next document.
            ahead = ([held] if held else []) + part
            chosen = [r for k, r in enumerate(ahead) if not (k and r[1] and ahead[k - 1][1] and r[0] == ahead[k - 1][0])]
            held = chosen[-1]
            pairs = [k for k in range(len(chosen) - 1) if chosen[k][0] == chosen[k + 1][0] and not chosen[k][1]]
            if not pairs:
                continue
            own = [r[3] for r in chosen]
            edited = []
            for k in pairs:
                keep = len(own[k]) - len(own[k]) // 3
                edited.append(own[k][:keep] + own[k + 1][: len(own[k]) - keep])
            items, owner = digests.of_all(own + edited)
            prints = _prints(own + edited, items, owner)
            here = np.array(pairs)
            changed = len(own) + np.arange(len(pairs))
            like = likeness(items, owner, np.tile(here, 2), np.concatenate([changed, here + 1]), len(own) + len(edited))
            columns = (
                [chosen[k][2] for k in pairs],
                [len(own[k]) for k in pairs],
                [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                [prints[k] for k in pairs],
                prints[len(own) :],
                like[: len(pairs)],
                like[len(pairs) :],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return _with_next(texts(df, id_col, text_col)).mapInArrow(run, schema)
