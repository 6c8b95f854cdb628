"""Byte-level BPE by replaying the ranked merges over a whole set of words at once.

All words of the set stand in one linked list of tokens. An inverted index has the places of every token pair under
the pair's rank; the least rank is taken, merged at all its places, left to right, and only the pairs with the new
token's neighbours enter the index. If a merge makes a pair of a lower rank, that one goes first and the places left
over wait, so that each word goes through the same merges as if it were encoded alone. Every merge costs a constant
number of steps; a word of a million letters needs no more than as many short ones.

Spark counts the words of the corpus, pre-aggregated by task. Words frequent enough that ``FREQUENT`` of them hold all
others out (by a histogram of counts, no sort) are replayed once for the corpus and sent to all workers, a table
bounded by that number and by ``LONG`` bytes a word. The rest are replayed by the task that meets them, all new words
of a slice of texts together.

Ids are those of the library for every match of the pattern. Defined results: null and empty texts have no ids; special
strings are ordinary text; ties, repeated rows and ids are encoded each for itself; an empty table gives an empty
table; other columns are ignored. A text of any length is handled whole, in memory linear in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import per_worker, rows, texts
from scorelens.llm.words import pieces

#: Words sent to all workers at most, and the bytes of one at most.
FREQUENT, LONG = 100_000, 64
#: Entries of a generation of words that a worker keeps.
KEPT = 400_000
#: The separator between words, and a rank behind all others.
_NONE, _FAR = -1, 2**31 - 1
#: Places from which on they are merged all at once.
_MANY = 24
#: Signs that are a token of their own behind a letter.
_SIGNS = ".,!?;:"
_BLANKS = re.compile(r" \s")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank; a line has a token in base 64 and its rank."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            found[int(rank)] = base64.b64decode(token)
    return [found[k] for k in range(len(found))]


class Merges:
    """Ranks of all pairs of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        rank = {t: k for k, t in enumerate(self.tokens)}
        self.rank = rank
        self.flat = np.frombuffer(b"".join(self.tokens), "u1")
        self.sizes = np.array([len(t) for t in self.tokens], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        # pairs[left].get(right): the rank of the pair
        none: dict[int, int] = {}
        self.pairs = [none] * len(self.tokens)
        for k, t in enumerate(self.tokens):
            for cut in range(1, len(t)):
                left, right = rank.get(t[:cut]), rank.get(t[cut:])
                if left is not None and right is not None:
                    if self.pairs[left] is none:
                        self.pairs[left] = {}
                    self.pairs[left][right] = k
        keys = [(left << 32 | right, k) for left, row in enumerate(self.pairs) for right, k in row.items()]
        self.keys, self.values = np.array(sorted(keys), "i8").T.copy()
        # Ranks of pairs of single bytes, the separator among them; ``_FAR`` where there is none.
        self.bytes = np.append(np.array([rank[bytes([b])] for b in range(256)], "i4"), _NONE)
        self.first = np.full((257, 257), _FAR, "i4")
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.pairs[self.bytes[a]].get(int(self.bytes[b]), _FAR)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_FAR`` where it has none; a separator pairs with nothing."""
        at = np.searchsorted(self.keys, left.astype("i8") << 32 | right)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == (left.astype("i8") << 32 | right), self.values[at], _FAR)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        # Every word and a separator behind it, as byte values with 256 for the separator.
        raw = np.frombuffer(b"\0".join([*words, b""]), "u1").astype("i4")
        ends = np.cumsum([len(w) + 1 for w in words], dtype="i8") - 1
        raw[ends] = 256
        wanted = np.append(self.first[raw[:-1], raw[1:]], np.int32(_FAR))
        order = np.argsort(wanted, kind="stable")[: np.count_nonzero(wanted != _FAR)]
        state = _Words(self, raw, wanted)
        state.enter(wanted[order], order)
        while state.queue:
            rank = heappop(state.queue)
            places = state.index.pop(rank, None)
            if places is None:
                continue
            if len(places) < _MANY or not state.merge_all(rank, np.sort(np.array(places))):
                state.merge_each(rank, sorted(places))
        left = state.alive & (state.token >= 0)
        ids = state.token[left].astype("<u4").tobytes()
        bounds = [0, *(4 * np.cumsum(left)[ends]).tolist()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


class _Words:
    """Words under replay: a linked list of tokens, the rank of each token's pair with the next, and the index."""

    def __init__(self, merges: Merges, raw: np.ndarray, wanted: np.ndarray):
        n = len(raw)
        self.merges = merges
        self.token, self.wanted = merges.bytes[raw], wanted
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.alive = np.ones(n, bool)
        # The same memory, quicker to reach one by one.
        self.views = [memoryview(x) for x in (self.token, self.wanted, self.after, self.before, self.alive)]
        self.index: dict[int, list[int]] = {}
        self.queue: list[int] = []

    def enter(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Enter places under their ranks, which rise."""
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        places = places.tolist()
        bounds = [*starts.tolist(), len(places)]
        for rank, a, b in zip(ranks[starts].tolist(), bounds, bounds[1:]):
            if rank in self.index:
                self.index[rank].extend(places[a:b])
            else:
                self.index[rank] = places[a:b]
                heappush(self.queue, rank)

    def merge_all(self, rank: int, places: np.ndarray) -> bool:
        """Merge at all places at once, unless that makes a pair of a lower rank; then nothing is done."""
        token, after, before = self.token, self.after, self.before
        places = places[self.wanted[places] == rank]
        if len(places) > 1:
            joined = after[places[:-1]] == places[1:]
            if joined.any():  # of places that overlap, every other one from the left
                here = np.arange(len(places))
                first = np.maximum.accumulate(np.where(np.append(False, joined), 0, here))
                places = places[(here - first) % 2 == 0]
        if not len(places):
            return True
        gone = after[places]
        nexts = after[gone]
        alike = np.full(len(places), rank)
        lefts = before[places]
        # The left neighbour may be the second half of a place that is merged here as well.
        left_merged = np.append(False, nexts[:-1] == places[1:])
        left_token = np.where(left_merged, rank, token[lefts])
        left_rank = self.merges.ranks(left_token, alike)
        if min(left_rank.min(), self.merges.ranks(alike, token[nexts]).min()) < rank:
            return False
        token[places] = rank
        after[places] = nexts
        before[nexts] = places
        self.alive[gone] = False
        self.wanted[gone] = _FAR
        right_rank = self.merges.ranks(alike, token[nexts])
        self.wanted[places] = right_rank
        lefts, left_rank = lefts[~left_merged], left_rank[~left_merged]
        inside = lefts >= 0
        lefts, left_rank = lefts[inside], left_rank[inside]
        self.wanted[lefts] = np.where(token[lefts] >= 0, left_rank, _FAR)
        ranks, at = np.append(left_rank, right_rank), np.append(lefts, places)
        found = ranks != _FAR
        ranks, at = ranks[found], at[found]
        order = np.argsort(ranks, kind="stable")
        self.enter(ranks[order], at[order])
        return True

    def merge_each(self, rank: int, places: list[int]) -> None:
        """Merge one by one from the left. A new pair of a lower rank goes first; the places left over wait."""
        token, wanted, after, before, alive = self.views
        index, queue, pairs = self.index, self.queue, self.merges.pairs
        for k, p in enumerate(places):
            if wanted[p] != rank:
                continue
            gone = after[p]
            token[p] = rank
            wanted[gone] = _FAR
            alive[gone] = False
            q = after[gone]
            after[p] = q
            before[q] = p
            # The pair with the right neighbour, then the one with the left.
            least = wanted[p] = pairs[rank].get(token[q], _FAR)
            if least != _FAR:
                if least in index:
                    index[least].append(p)
                else:
                    index[least] = [p]
                    heappush(queue, least)
            q = before[p]
            if q >= 0 and token[q] >= 0:
                new = wanted[q] = pairs[token[q]].get(rank, _FAR)
                if new != _FAR:
                    if new in index:
                        index[new].append(q)
                    else:
                        index[new] = [q]
                        heappush(queue, new)
                    least = min(least, new)
            if least < rank:
                index[rank] = places[k + 1 :]
                heappush(queue, rank)
                break


def runs_of_blanks(batch: list[str]) -> list[bool]:
    """Whether a text has a space beside other white space or at an end, so that it is not cut at every space.

    White space other than spaces is not printable, so most texts need no search for it.
    """
    return [
        text[:1] == " " or text[-1:] == " " or "  " in text or bool(not text.isprintable() and _BLANKS.search(text))
        for text in batch
    ]


class _Codes(dict):
    """Numbers of strings, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> bytes:
    """The stretches of ``flat`` with some codes, one behind the other; so many at a time that the places stay few."""
    out = []
    for at in range(0, len(codes), 1 << 18):
        some = codes[at : at + (1 << 18)]
        n = sizes[some]
        ends = np.cumsum(n)
        if len(ends):
            out.append(flat[np.repeat(starts[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


class Kept:
    """Ids by string in two generations: strings in use move to the young one, the rest is forgotten with the old."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def renew(self) -> None:
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young

    def lacking(self, wanted: set[str]) -> set[str]:
        """The wanted strings that neither generation has; the others are in the young one now."""
        young, old = self.young, self.old
        missing = wanted.difference(young)
        known = missing.intersection(old)
        young.update((x, old[x]) for x in known)
        return missing - known


class Replayer:
    """Ids of texts as little-endian unsigned 32-bit bytes; distinct new words of a set of texts are replayed together.

    ``spaced`` has what follows a space, which is part of the entry, ``bare`` all else.
    """

    def __init__(self, path: str, pattern: str, frequent: dict[str, bytes] | None = None):
        import regex

        self.merges = per_worker(("merges", path), lambda: Merges(path))
        self.find = regex.compile(pattern).findall
        self.spaced, self.bare = Kept(), Kept()
        for word, ids in (frequent or {}).items():
            self._put(word, ids)

    def _put(self, word: str, ids: bytes) -> None:
        if word[0] == " ":
            self.spaced.young[word[1:]] = ids
        else:
            self.bare.young[word] = ids

    def _get(self, word: str) -> bytes | None:
        return self.spaced.young.get(word[1:]) if word[0] == " " else self.bare.young.get(word)

    def split(self, chunk: str) -> list[str]:
        """Matches of the pattern. Plain letters, with or without one sign behind, need no search."""
        if chunk.isascii() or max(chunk) < "\u0250":
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[-1:] in _SIGNS and word[:-1].isalpha():
                return [chunk[:-1], word[-1]]
        return self.find(chunk)

    def _learn(self, spaced: set[str], bare: set[str]) -> None:
        """Entries for what follows a space and for what does not, all new words replayed at once."""
        self.spaced.renew()
        self.bare.renew()
        lacking = self.spaced.lacking(spaced)
        # Letters behind a space are one match, and so need no split.
        plain = {c for c in lacking if c.isascii() and c.isalpha()}
        chunks = [" " + c for c in lacking - plain]
        chunks += self.bare.lacking(bare)
        split = {c: self.split(c) for c in chunks}
        words = set().union(*split.values())
        after_space = list(plain | self.spaced.lacking({w[1:] for w in words if w[0] == " "}))
        others = list(self.bare.lacking({w for w in words if w[0] != " "}))
        ids = self.merges.replay([(" " + w).encode() for w in after_space] + [w.encode() for w in others])
        self.spaced.young.update(zip(after_space, ids))
        self.bare.young.update(zip(others, ids[len(after_space) :]))
        for chunk, parts in split.items():
            if len(parts) > 1:
                self._put(chunk, b"".join(map(self._get, parts)))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Texts are cut before single spaces, where no match of the pattern crosses. What follows one gets a number, by
        which its ids are put together when all are learnt.
        """
        codes, bare, heads, tails = _Codes(), set(), [], []
        code = codes.__getitem__
        for text, runs in zip(batch, runs_of_blanks(batch)):
            parts = pieces(text) if runs else text.split(" ")
            first = parts.pop(0)
            if first[:1] == " ":
                code(first[1:])
            elif first:
                bare.add(first)
            heads.append(first)
            tails.append(np.fromiter(map(code, parts), "i4", len(parts)))
        self._learn(set(codes), bare)
        found = list(map(self.spaced.young.__getitem__, codes))
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), "i8", len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        return [
            (self._get(first) if first else b"") + _gather(flat, starts, sizes, tail) for first, tail in zip(heads, tails)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.merges.flat, self.merges.starts, self.merges.sizes, ids)


def _slices(batches: Iterator[pa.RecordBatch], chars: int = 16_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some rows at a time, at most about ``chars`` characters unless one text has more."""
    for batch in batches:
        ids, held, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            held.append(t)
            size += len(t)
            if size > chars:
                yield ids, held
                ids, held, size = [], [], 0
        if ids:
            yield ids, held


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n): the pattern's matches over all texts, with their number of occurrences."""

    def count(batches):
        import regex

        find = regex.compile(pattern).findall
        spaced: Counter[str] = Counter()
        bare: Counter[str] = Counter()

        def flush():
            words: Counter[str] = Counter()
            for before, chunks in ((" ", spaced), ("", bare)):
                for chunk, n in chunks.items():
                    if chunk.isascii() and chunk.isalpha():
                        words[before + chunk] += n
                    else:
                        for word in find(before + chunk):
                            words[word] += n
                chunks.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
            )

        for _, held in _slices(batches):
            for text, runs in zip(held, runs_of_blanks(held)):
                parts = pieces(text) if runs else text.split(" ")
                bare[parts.pop(0)] += 1
                spaced.update(parts)
            if len(spaced) + len(bare) > KEPT:
                yield flush()
        yield flush()

    return texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str, pattern: str, most: int = FREQUENT) -> dict[str, bytes]:
    """Ids of the most frequent words, at most ``most``, each replayed once for the corpus.

    The least count is read off a histogram of counts in steps of an eighth of a power of two.
    """
    from scorelens.session import cut_lineage

    counted = cut_lineage(
        word_counts(docs, pattern).filter((F.octet_length("word") <= LONG) & (F.col("n") > 1)).withColumn(
            "step", F.floor(F.log2("n") * 8).cast("int")
        )
    )
    least, total = None, 0
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):  # at most 8 x 63 steps
        total += n
        if total > most:
            break
        least = step
    if least is None:
        return {}

    def replay(batches):
        merges = per_worker(("merges", path), lambda: Merges(path))
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = merges.replay([w.encode() for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    found = counted.filter(F.col("step") >= least).select("word").mapInArrow(replay, "word string, ids binary").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def encode(docs: DataFrame, path: str, pattern: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, ids), or with ``digest_only`` (doc_id, n_tokens, ids_sha256, decoded_sha256) of ids and decoded bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, pattern))
    run = uuid.uuid4().hex

    def replayer() -> Replayer:
        """One per worker process, that of the latest call."""
        kept = per_worker("replayer", dict)
        if kept.get("run") != run:
            kept.update(run=run, made=Replayer(path, pattern, sent.value))
        return kept["made"]

    def ids_of(batches):
        encoder = replayer()
        for doc_ids, held in _slices(batches):
            ids = [np.frombuffer(x, "<u4").astype("i4") for x in encoder.encode(held)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    def digests(batches):
        encoder = replayer()
        decimal = [str(k) for k in range(len(encoder.merges.tokens))].__getitem__
        for doc_ids, held in _slices(batches):
            out = []
            for raw in encoder.encode(held):
                ids = np.frombuffer(raw, "<u4")
                text = " ".join(map(decimal, ids.tolist()))
                out.append((len(ids), _sha(text.encode()), _sha(encoder.decode(ids))))
            n, a, b = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    if digest_only:
        return texts(docs).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return texts(docs).mapInArrow(ids_of, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids are none."""

    def join(batches: Iterable[pa.RecordBatch]):
        tokens = per_worker(("tokens", path), lambda: read_ranks(path))
        for batch in rows(batches):
            found = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, bytes binary")


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
