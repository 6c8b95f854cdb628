"""Near-duplicate documents by HyperMinHash registers, with every link confirmed on the full shingle sets.

1. A text's set of hashed word shingles becomes 128 registers: four hash functions with 32 buckets each, and per bucket
   the smallest hash as its count of leading zeros and ten bits after them. Texts with equal sets are one from here on.
2. Four registers are a band, and texts that agree in a band share a bucket. Texts of few shingles have many empty
   registers; they share buckets by prefix instead: the smallest quarter of the hashes of two similar sets must meet.
3. A shingle that is in the prefix of more than 100 texts is common: a line or passage that unlike texts share. Prefixes
   of the texts concerned are taken anew in an order that puts common shingles last; the order is the same for all.
4. In a bucket every text is compared with one hub. Pairs whose collision-corrected estimate is within five standard
   errors of the threshold are verified on the full sets, and links are merged into components.
5. A bucket stays open while its other texts lie in different components. Its hubs are done with; the next round
   takes four times as many, those of the smallest components first. A bucket that still holds more than 16 texts
   outside its largest component after one hub is a line or passage that unlike texts share. Its texts are dealt anew by
   an exact prefix of all their shingles for each pair of sizes, the rarest among these texts first, so that what they
   share comes last and only texts that meet elsewhere, or share enough, are compared. Rounds go on until no bucket is open, so nothing is capped.

A band misses a pair at similarity 0.75 with probability 0.68, all 32 bands with 5 in a million, and less above it.

Defined results: null and empty texts and texts without a word have no shingle and are linked with nothing; a null id
gets no component; rows that repeat an id or a text are linked; ties go to the smallest id; an empty table gives an
empty table; other columns are ignored. Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import per_worker, rows, small_batches, texts
from scorelens.llm.components import components
from scorelens.session import cut_lineage

#: Hash functions, buckets of each, bits kept behind the leading zeros, registers in a band, sizes that use prefixes.
HASHES, BUCKETS, MANTISSA, BAND, FEW = 4, 32, 10, 4, 128
REGISTERS = HASHES * BUCKETS
#: A shingle of more prefixes is common. Buckets with more texts outside their largest component are dealt anew.
_COMMON, _LARGE = 100, 16
#: Ratio of the sizes at which classes of sizes begin.
_CLASS = 1.06
#: Ids that may be sent to all executors to pick texts for verification; more are joined by a shuffle.
_SENT = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed shingles; the hashes of words are kept per worker."""

    def __init__(self, width: int = 5, limit: int = 150_000):
        self.width, self.limit, self.known = width, limit, {}

    def of(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes in rising order. ``bytes`` methods know just A-Z and the six ASCII blanks."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        return np.unique(out)


def registers(items: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash in each bucket; 0 for an empty one."""
    out = np.zeros((HASHES, BUCKETS), np.uint16)
    if not len(items):
        return out.ravel()
    for k in range(HASHES):
        x = _mix(items + np.uint64(k * 0x632BE59BD9B4E019 % 2**64))
        least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, (x % np.uint64(BUCKETS)).astype(np.int64), x >> np.uint64(5))  # 59 bits
        held = least != np.iinfo(np.uint64).max
        v = np.maximum(least[held], 1 << MANTISSA)
        top = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1  # place of the leading one, 0 to 58
        top -= (np.uint64(1) << top.astype(np.uint64)) > v  # rounding up to the next power
        rest = (v >> (top - MANTISSA).astype(np.uint64)).astype(np.int64) & ((1 << MANTISSA) - 1)
        out[k, held] = ((59 - top) << MANTISSA | rest).astype(np.uint16)
    return out.ravel()


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[float, float]:
    """Jaccard similarity from two sets' registers, less the expected chance collisions, and its standard error at 0.75.

    The chance that two unrelated registers agree is 0.1699 * 4r / (1 + r)^2 / 2^bits for sets in ratio r.
    """
    used = int(((a > 0) | (b > 0)).sum())
    if not used:
        return 0.0, 1.0
    same = int(((a == b) & (a > 0)).sum())
    r = na / max(1, nb)
    chance = 0.169919487 * 4 * r / (1 + r) ** 2 / (1 << MANTISSA)
    return (same / used - chance) / (1 - chance), (0.75 * 0.25 / used) ** 0.5


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit key per band, and whether the band has any register in use."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    with np.errstate(over="ignore"):
        return _mix(packed + np.arange(1, len(packed) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)), packed > 0


def uses_prefix(n: int, percent: int) -> bool:
    """Sets of up to FEW shingles, and those that one of them can be similar to."""
    return 0 < n and n * percent <= FEW * 100


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def shingle_keys(items: np.ndarray) -> np.ndarray:
    """Keys of single shingles in rising order, which is the order of prefixes."""
    return np.sort(_mix(items ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)).view(np.uint64)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, regs, bands, prefix): 128 bits that name the set, its registers and its buckets."""
    none = np.zeros(0, np.uint64)

    def lists(values: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *values]).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = per_worker("shingles", Shingles, alone=True)
        for b in rows(batches):
            n, hi, lo, regs, bands, prefix = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                items = shingles.of(t)
                r = registers(items)
                n.append(len(items))
                with np.errstate(over="ignore"):
                    hi.append(_mix(items ^ np.uint64(0x1B873593CC9E2D51)).sum(dtype=np.uint64).astype(np.int64))
                    lo.append(_mix(items + np.uint64(0x38B34AE5A1E38B93)).sum(dtype=np.uint64).astype(np.int64))
                regs.append(r.tobytes())
                bands.append(band_keys(r)[0] if len(items) > FEW else none)
                few = uses_prefix(len(items), percent)
                prefix.append(shingle_keys(items)[: prefix_size(len(items), percent)] if few else none)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.array(regs, pa.binary()), lists(bands), lists(prefix)],
                ["doc_id", "n_shingles", "hi", "lo", "regs", "bands", "prefix"],
            )

    return texts(df, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_shingles long, hi long, lo long, regs binary, bands array<long>, prefix array<long>",
    )


def _labelled(df: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    """With the component of a column's text; texts that are in no link are their own."""
    if labels is None:
        return df.withColumn(name, F.col(column))
    known = labels.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(known, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers don't rule the similarity out."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            ra, rb = (np.array(batch.column(k).to_pylist(), object) for k in (4, 5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for k in range(batch.num_rows):
                j, error = estimate(np.frombuffer(ra[k], np.uint16), np.frombuffer(rb[k], np.uint16), na[k], nb[k])
                sizes = 100 * min(na[k], nb[k]) >= percent * max(na[k], nb[k])
                keep.append(bool(sizes and j >= percent / 100 - 5 * error))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))],
                ["a", "b"],
            )

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    return both.mapInArrow(run, "a long, b long")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of some ids (doc_id), by a broadcast where these are counted to be few."""
    return docs.join(F.broadcast(ids) if ids.count() <= _SENT else ids, "doc_id")


def _shingles_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, id, n): a row for each shingle of the texts with some ids (doc_id); n is the size of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = per_worker("shingles", Shingles, alone=True)
        for b in rows(batches, 256):
            found = [shingle_keys(shingles.of(t)) for t in b.column(1).to_pylist()]
            size = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(np.repeat(size, size))],
                ["key", "id", "n"],
            )

    return _texts_of(ids, docs).select("doc_id", "text").mapInArrow(run, "key long, id long, n long")


def _ordered(marked: DataFrame, order: str) -> DataFrame:
    """(id, n, all): the shingles of each set in the order of a column; a task holds one text's at a time."""
    return marked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(order, "key"))).alias("all"))


def _dealt(ids: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(key, id, side, n, rest) for texts with some ids: prefixes of all shingles, the rarest among these texts first.

    Sets of sizes a and b must share percent / (100 + percent) of a + b, and so one of the shingles that come before the
    last so many of either, in any order that is the same for all. Sizes fall in classes, and a text enters the buckets
    of each pair of classes that its size allows with the prefix for that pair, so no pair is lost, and texts whose
    common part is just too small never meet. Side 1 has the smaller class of a pair, side 2 the larger one, 0 both.
    A shingle that no other text has counts in the prefix and needs no bucket. ``rest`` counts a text's shingles from the
    bucket's one on. Two texts whose first common shingle this is share no more than the smaller of their rests.
    """
    ids = cut_lineage(ids)
    counts = _shingles_of(ids, docs).groupBy("key").count().filter("count > 1")
    shared = cut_lineage(counts.select("key", F.floor(F.log2("count")).alias("level")))
    marked = _shingles_of(ids, docs).join(shared, "key", "left").fillna(0, ["level"])
    longest = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    found = _ordered(marked, "level").select("id", "n", F.posexplode(F.slice("all", F.lit(1), longest)).alias("place", "k"))
    found = found.filter("k.level > 0").withColumn("own", F.floor(F.log("n") / math.log(_CLASS)).cast("int"))
    reach = math.ceil(math.log(100 / percent) / math.log(_CLASS))
    found = found.withColumn("other", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    least = F.greatest(F.floor(F.pow(F.lit(_CLASS), "other")), F.ceil(F.col("n") * percent / 100))
    found = found.filter(F.col("place") <= F.col("n") - F.ceil((F.col("n") + least) * percent / (100 + percent)))
    return found.select(
        F.xxhash64("k.key", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        "id",
        F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0).alias("side"),
        "n",
        (F.col("n") - F.col("place")).alias("rest"),
    )


def _buckets(sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(key, id): bands, and prefixes in an order of shingles that puts common ones last."""
    bands = sets.select(F.explode("bands").alias("key"), "id")
    short = sets.select(F.explode("prefix").alias("key"), "id")
    common = short.groupBy("key").count().filter(F.col("count") > _COMMON).select("key")

    def having(some: DataFrame) -> DataFrame:
        return cut_lineage(short.join(some, "key", "left_semi").select(F.col("id").alias("doc_id")).distinct())

    concerned = having(common)
    if concerned.isEmpty():
        return bands.unionAll(short)
    often = cut_lineage(
        _shingles_of(concerned, docs).groupBy("key").count().filter(F.col("count") > _COMMON).select("key")
    )
    concerned = having(often)
    marked = _shingles_of(concerned, docs).join(often.withColumn("often", F.lit(True)), "key", "left")
    size = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    anew = _ordered(marked.fillna(False, ["often"]), "often")
    anew = anew.select(F.explode(F.slice("all", F.lit(1), size)).alias("k"), "id").select("k.key", "id")
    same = short.join(concerned.select(F.col("doc_id").alias("id")), "id", "left_anti").select("key", "id")
    return bands.unionAll(same).unionAll(anew)


def verify(pairs: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets. ``docs``: (doc_id, text)."""
    needed = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    side = lambda x: needed.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = per_worker("shingles", Shingles, alone=True)
        last: tuple[int | None, int, np.ndarray] = (None, 0, np.zeros(0, np.uint64))
        for batch in rows(batches, 256):
            keep = []
            for b, ta, tb in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if last[:2] != (b, hash(tb)):  # neighbours often share the smaller text
                    last = (b, hash(tb), shingles.of(tb))
                sa, sb = shingles.of(ta), last[2]
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; see the module's text."""
    with small_batches(df.sparkSession):
        return _near_duplicates(texts(df, id_col, text_col), percent)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    signed = cut_lineage(signatures(docs, percent=percent))
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = cut_lineage(
        named.groupBy("hi", "lo").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("regs").alias("regs"),
            F.first("bands").alias("bands"),
            F.first("prefix").alias("prefix"),
        )
    )
    labels: DataFrame | None = None

    def link(pairs: DataFrame) -> None:
        """Verify those pairs that lie in different components, and merge."""
        nonlocal labels
        apart = _labelled(_labelled(pairs, labels, "a", "ca"), labels, "b", "cb").filter("ca <> cb")
        likely = cut_lineage(_likely(apart.select("a", "b"), sets, percent))
        if likely.isEmpty():
            return
        links = cut_lineage(verify(likely, docs, percent))
        if links.isEmpty():
            return
        between = _labelled(_labelled(links, labels, "a", "ca"), labels, "b", "cb")
        roots = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        if labels is not None:
            moved = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            old = labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            roots = old.unionAll(roots).groupBy("node").agg(F.min("root").alias("root"))
        labels = cut_lineage(roots)

    def round_(buckets: DataFrame) -> DataFrame:
        """Compare the texts of each bucket with its hubs; the other texts of the buckets that stay open.

        ``outside`` counts a bucket's texts that are not in its largest component.
        """
        sized = _labelled(buckets, labels, "id", "c")
        if labels is not None:  # the smallest components first: the fewest texts have to be compared with all others
            weight = labels.groupBy("root").agg(F.count("*").alias("w")).withColumnRenamed("root", "c")
            sized = sized.join(weight, "c", "left").fillna(1, ["w"])
        else:
            sized = sized.withColumn("w", F.lit(1))
        # One hub for each remainder, so that hubs are grouped minima and no bucket is sorted.
        able = F.when(F.col("side") < 2, F.struct("w", "id"))
        picked = sized.groupBy("key", "many", F.pmod(F.xxhash64("id"), F.col("many")).alias("part")).agg(
            F.min_by(F.struct("id", "c", "n", "rest"), able).alias("hub"), F.count("*").alias("m")
        )
        chosen = picked.groupBy("key").agg(F.collect_list("hub").alias("hubs"), F.sum("m").alias("m"))
        chosen = chosen.filter((F.col("m") > 1) & (F.size("hubs") > 0)).select("key", "hubs")
        members = cut_lineage(sized.select("key", "many", *who, "c").join(chosen, "key"))
        # Only hubs of another component are left to compare with, and of those only ones that can share enough.
        most = lambda h: (100 + percent) * F.least("rest", h["rest"]) >= percent * (F.col("n") + h["n"])
        apart = F.filter("hubs", lambda h: (h["c"] != F.col("c")) & most(h))
        compared = members.filter("side <> 1").select("id", F.explode(F.transform(apart, lambda h: h["id"])).alias("hub"))
        link(compared.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct())
        others = members.filter(~F.exists("hubs", lambda h: h["id"] == F.col("id"))).select("key", "many", *who)
        left = _labelled(others, labels, "id", "c")
        sides = (F.count_if(F.col("side") < 2).alias("able"), F.count_if(F.col("side") != 1).alias("asked"))
        state = left.groupBy("key", "c").agg(F.count("*").alias("m"), *sides).groupBy("key").agg(
            F.count("*").alias("parts"),
            (F.sum("m") - F.max("m")).alias("outside"),
            F.sum("able").alias("able"),
            F.sum("asked").alias("asked"),
        )
        state = state.filter("parts > 1 AND able > 0 AND asked > 0").select("key", "outside")
        return cut_lineage(left.join(state, "key").select("key", "many", *who, "outside"))

    once, more, none = F.lit(1).alias("many"), (F.col("many") * 4).alias("many"), F.lit(0).cast("long")
    who = ("id", "side", "n", "rest")
    first = cut_lineage(_buckets(sets, docs, percent))
    opened = round_(first.select("key", once, "id", F.lit(0).alias("side"), none.alias("n"), none.alias("rest")))
    mixed = opened.filter(F.col("outside") > _LARGE).select(F.col("id").alias("doc_id")).distinct()
    buckets = opened.filter(F.col("outside") <= _LARGE).select("key", more, *who)
    if not mixed.isEmpty():
        dealt = cut_lineage(_dealt(mixed, docs, percent))
        buckets = buckets.unionAll(dealt.select("key", once, *who))
    while not buckets.isEmpty():
        buckets = round_(buckets).select("key", more, *who)

    rooted = _labelled(sets.select("hi", "lo", "id"), labels, "id", "c").select("hi", "lo", "c")
    found = named.select("doc_id", "n_shingles", "hi", "lo").join(rooted, ["hi", "lo"])
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL")
    out = found.select("doc_id", "n_shingles", F.col("c").alias("component_id")).unionAll(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
