"""Ranked lexical search over impact vectors in buckets by length.

A document is the vector of its impacts: for each term, the term's weight times its saturated frequency, an integer.
An item is the 0/1 vector of its terms, so a score is an inner product. Documents are ordered by the length (norm) of
their vectors and cut into buckets. With k terms in an item:

* Cauchy-Schwarz: no score in a bucket exceeds sqrt(k) times its largest norm; buckets below the item's threshold, the
  score of its 50th best document so far, are skipped whole.
* Coordinates: inside a bucket the item's ``FOCUS`` heaviest terms are summed exactly, and the rest of a vector,
  sqrt(norm^2 - sum of squares of those), bounds what the other k - ``FOCUS`` terms can add.
* What survives is rescored from all terms in 64-bit integers, so bounds in floating point, rounded up, lose nothing.

Spark makes the vectors in one pass over the texts, keeping only terms that some item has, and their counts in a
second over the vectors. A histogram of norms gives the head: the longest vectors, searched first, in parallel, for
thresholds. The rest is then searched with those; each task keeps the 50 best of each item and what ties must keep,
and a ranking by salted groups, then by item, merges them. Items are searched in blocks of ``ITEMS``, so vocabulary and
thresholds sent to workers are bounded by a block's own text.

Defined results: null and empty texts have no terms and are in no result and in no count; items without terms, or whose
terms are nowhere, have no rows; rows of one ``item_id`` are one item with all their terms; repeated documents are ranked
each for itself; ties come by ``doc_id``, null last; empty tables give an empty table; other columns are ignored.
Texts and documents of any number and length are searched whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.llm.common import rows, texts
from scorelens.session import cut_lineage

#: Characters of terms: ASCII letters and digits, and all that is not ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Rows returned for an item; items of one block; documents of a bucket, and of those that a task sorts at once.
TOP, ITEMS, BUCKET, SORTED = 50, 1_000, 256, 8_192
#: Terms of an item that are summed before the rest is bounded.
FOCUS = 6
#: The head holds at least so many documents, or all.
HEAD = 4_096
_LOWER = {c: c + 32 for c in range(65, 91)}
_SALTS = 64

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
HITS = "item int, doc_id long, score long"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, number of terms, the vocabulary's terms in the text, how often) of each text that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pattern, lower = TERM, _LOWER

    def make(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        find = re.compile(pattern).findall
        for batch in rows(batches):
            ids, ns, found, tfs, ends = [], [], [], [], [0]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find(text.translate(lower))
                if not words:
                    continue
                counts = Counter(map(known.get, words))
                counts.pop(None, None)
                ids.append(i)
                ns.append(len(words))
                found.extend(counts)
                tfs.extend(counts.values())
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]
            )

    return texts(docs).mapInArrow(make, VECTORS)


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of ``size`` terms; a task sends one number per term."""

    def count(batches):
        total = np.zeros(size, "i8")
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["term", "df"])

    counted = vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    table = counted.toArrow()  # at most ``size`` rows
    out = np.zeros(size, "i8")
    out[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return out


class _Impacts:
    """Impacts of documents, from their counts and those of the corpus."""

    def __init__(self, weights: np.ndarray, n_docs: int, n_terms: int):
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term, impact and row of each entry, and the norm of each row."""
        n = batch.column("n").to_numpy()
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy().astype("i8")
        row = np.repeat(np.arange(len(n)), terms.value_lengths().to_numpy())
        term = terms.flatten().to_numpy()
        impact = self.weights[term] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[row]))
        square = np.bincount(row, impact.astype("f8") ** 2, minlength=len(n)) if len(row) else np.zeros(len(n))
        return term, impact, row, np.sqrt(square) * (1 + 1e-9)


class _Best:
    """The best documents of an item so far, all above a threshold."""

    def __init__(self, least: int, top: int):
        self.least, self.top = least, top
        self.scores, self.ids = np.empty(0, "i8"), np.empty(0, "i8")

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > self.top:
            order = np.lexsort((ids, -scores))[: self.top]
            scores, ids = scores[order], ids[order]
            self.least = max(self.least, int(scores[-1]))
        self.scores, self.ids = scores, ids


#: Stands for a null id in an array of numbers; ranked last among ties, as null is.
_NULL = 2**63 - 1


def _search_slice(batch: pa.RecordBatch, impacts: _Impacts, items: list[np.ndarray], best: list[_Best]) -> None:
    """Search one slice of documents, longest vectors first. ``items``: terms of each, heaviest first."""
    term, impact, row, norms = impacts.of(batch)
    if not len(term):
        return
    ids = batch.column("doc_id").fill_null(_NULL).to_numpy()
    order = np.argsort(-norms, kind="stable")
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    entry = np.argsort(place[row], kind="stable")
    term, impact, at = term[entry], impact[entry], place[row][entry]
    roots = np.sqrt([len(t) for t in items])
    rests = np.sqrt([max(0, len(t) - FOCUS) for t in items])
    dense = np.zeros((len(impacts.weights), BUCKET), "i8")
    for begin in range(0, len(order), BUCKET):
        docs = order[begin : begin + BUCKET]
        size = norms[docs]
        least = np.array([b.least for b in best])
        open_items = np.flatnonzero(roots * size[0] >= least)
        if not len(open_items):
            break
        low, high = np.searchsorted(at, [begin, begin + BUCKET])
        cells = term[low:high], at[low:high] - begin
        dense[cells] = impact[low:high]
        square = size * size
        for k in open_items:
            terms, found = items[k], best[k]
            head = dense[terms[:FOCUS], : len(docs)]
            score = head.sum(axis=0)
            rest = np.sqrt(np.maximum(square - (head.astype("f8") ** 2).sum(axis=0) * (1 - 1e-9), 0))
            open_docs = np.flatnonzero(score + rests[k] * rest >= found.least)
            if not len(open_docs):
                continue
            score = score[open_docs]
            if len(terms) > FOCUS:
                score = score + dense[terms[FOCUS:][:, None], open_docs].sum(axis=0)
            hit = (score >= found.least) & (score > 0)
            if hit.any():
                found.add(score[hit], ids[docs[open_docs[hit]]])
        dense[cells] = 0


def _search(vectors: DataFrame, impacts: _Impacts, items: list[np.ndarray], least: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): of every task, the ``top`` best documents of each item with at least its threshold."""
    sent = vectors.sparkSession.sparkContext.broadcast((impacts.weights, impacts.n_docs, impacts.n_terms, items, least))

    def search(batches: Iterator[pa.RecordBatch]):
        weights, n_docs, n_terms, wanted, thresholds = sent.value
        counts = _Impacts(weights, n_docs, n_terms)
        best = [_Best(int(x), top) for x in thresholds]
        for batch in rows(batches, SORTED):
            _search_slice(batch, counts, wanted, best)
        sizes = [len(b.scores) for b in best]
        ids = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best), dtype="i4"), sizes)),
                pa.array(ids, mask=ids == _NULL),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            ["item", "doc_id", "score"],
        )

    return vectors.mapInArrow(search, HITS)


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, with their rank; groups are salted, so that none holds all hits of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    for keys in (["item", "salt"], ["item"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
            F.col("rank") <= top
        )
    return salted.drop("salt")


def _head_norm(vectors: DataFrame, impacts: _Impacts) -> float:
    """A norm that at least ``HEAD`` documents reach, from counts in steps of an eighth of a power of two."""
    weights, n_docs, n_terms = impacts.weights, impacts.n_docs, impacts.n_terms

    def count(batches):
        total: Counter[int] = Counter()
        counts = _Impacts(weights, n_docs, n_terms)
        for batch in rows(batches, SORTED):
            norms = counts.of(batch)[-1]
            total.update(np.floor(np.log2(norms[norms > 0]) * 8).astype(int).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["step", "n"]
        )

    steps = vectors.mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n")).collect()  # hundreds at most
    reached, at = 0, 0.0
    for step, n in sorted(steps, reverse=True):
        at, reached = 2 ** (step / 8) * (1 - 1e-6), reached + n
        if reached >= HEAD:
            break
    return at


def _with_norms(vectors: DataFrame, impacts: _Impacts, least: float, above: bool) -> DataFrame:
    """The vectors whose norm reaches ``least``, or those whose norm does not."""
    weights, n_docs, n_terms = impacts.weights, impacts.n_docs, impacts.n_terms

    def keep(batches):
        counts = _Impacts(weights, n_docs, n_terms)
        for batch in rows(batches, SORTED):
            yield batch.filter(pa.array((counts.of(batch)[-1] >= least) == above))

    return vectors.mapInArrow(keep, VECTORS)


def _search_block(docs: DataFrame, names: list, wanted: list[set[str]], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*wanted)))}
    vectors = cut_lineage(_vectors(docs, vocabulary))
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_counts(vectors, len(vocabulary))
    weights = np.array([weight(n_docs, int(x)) for x in df], "i8")
    impacts = _Impacts(weights, n_docs, max(n_terms, 1))
    items = []
    for terms in wanted:
        own = np.array(sorted(vocabulary[t] for t in terms), "i8")
        own = own[(df[own] > 0) & (weights[own] > 0)]
        items.append(own[np.argsort(-weights[own], kind="stable")])
    at = _head_norm(vectors, impacts)
    head = cut_lineage(_search(_with_norms(vectors, impacts, at, True), impacts, items, np.ones(len(items), "i8"), top))
    least = np.ones(len(items), "i8")
    for item, score in _ranked(head, top).filter(F.col("rank") == top).select("item", "score").collect():  # one an item
        least[item] = score
    rest = _search(_with_norms(vectors, impacts, at, False), impacts, items, least, top)
    found = _ranked(head.union(rest), top)
    names_of = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")  # a block's rows
    return found.join(F.broadcast(names_of), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` highest-scoring documents of each item."""
    queries = items.select(
        items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text")
    )
    n = queries.select("item_id").distinct().count()
    blocks = max(1, math.ceil(n / ITEMS))
    keyed = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    out = None
    for k in range(blocks):
        wanted: dict[int | None, set[str]] = {}
        for item, text in keyed.filter(F.col("block") == k).select("item_id", "text").toLocalIterator():
            wanted.setdefault(item, set()).update(terms_of(text))
        names = [x for x, terms in wanted.items() if terms]
        if not names:
            continue
        found = _search_block(docs, names, [wanted[x] for x in names], top)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
