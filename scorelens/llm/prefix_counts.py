"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

``PrefixCounter.piece`` finds, for every prefix of a word, its exact number of tokens: the last token of a prefix is
the one that is compatible with the last token of the prefix before it, and the count is one more than there. Two
tokens are compatible when encoding their concatenation gives just these two. Counts of words add up, so the count of
any prefix of a text, and the longest prefix within a budget, follow without encoding anything again.

Special strings inside a text count as one token, as the library does by default. Defined results: null and empty
texts have no tokens; ties, repeated rows and repeated ids are counted each for itself; an empty table gives an empty
table; other columns are ignored. A text of any length is handled whole, and so is a word of any length: words above
``SHARED`` bytes keep one number per prefix, by position, and are kept in no cache.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import WordCache, per_worker, rows, texts
from scorelens.llm.words import pieces

#: Bytes, or characters of a text's word, up to which results are shared by string.
SHARED = 128


def _byte_alphabet() -> list[str]:
    """Printable Latin bytes stand for themselves; the others follow from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split_words = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = spec["model"]["vocab"]
        self.longest: dict[str, int] = {}  # last byte -> length of the longest token that ends with it
        for t in self.vocab:
            self.longest[t[-1]] = max(len(t), self.longest.get(t[-1], 0))
        self.merged: dict[tuple[int, int], int] = {}  # pair of tokens -> rank of its merge
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> rank of the merge that makes it, left, right
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = self.vocab[a], self.vocab[b]
            self.merged[left, right] = rank
            self.halves.setdefault(self.vocab[a + b], (rank, left, right))
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.counts = WordCache(600_000)
        self.first = WordCache(100_000)
        #: What the vocabulary writes for each byte.
        self.alphabet = _byte_alphabet()
        self.prefix_tables = WordCache(800_000)
        self.table = self.prefix_tables.data

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between the two tokens alone.

        Undo the merges from the latest on. If the two tokens that meet at the border could merge earlier than
        the merge just undone, that one would have come first.
        """
        limit = len(self.merged)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            ra, rb = self.halves.get(a, (-1,))[0], self.halves.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][2]
            else:  # merges of equal rank run from left to right, so the border's merge comes first
                limit, b = rb + 1, self.halves[b][1]

    def reachable(self, t: int) -> bool:
        """Whether BPE turns the token's own text into the token."""
        if t not in self.whole:
            half = self.halves.get(t)
            self.whole[t] = half is None or (
                self.reachable(half[1])
                and self.reachable(half[2])
                and self._joins(half[1], half[2], half[0])
            )
        return self.whole[t]

    def _joins(self, a: int, b: int, rank: int) -> bool:
        """As ``compatible`` but for the merge ``rank`` itself, which must be the first to cross the border."""
        limit = rank + 1
        first = True
        while True:
            crossing = self.merged.get((a, b), limit)
            if not first and crossing < limit:
                return False
            first = False
            ra, rb = self.halves.get(a, (-1,))[0], self.halves.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][2]
            else:
                limit, b = rb + 1, self.halves[b][1]

    def _follows(self, before: int, t: int) -> bool:
        """Whether a token can come behind a prefix, given by its last token and count (0 for the empty prefix)."""
        if not before:
            return self.reachable(t)
        key = before >> 32 << 20 | t
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            ok = self.fits[key] = self.compatible(before >> 32, t) and self.reachable(t)
        return ok

    def state(self, word: str) -> int:
        """The last token and the number of tokens of one word, which has one character per byte.

        Each prefix is worked out once: words that begin alike share their table.
        """
        if len(word) > SHARED:
            return self._states(word)[-1]
        vocab, table = self.vocab, self.table
        if len(table) > self.prefix_tables.limit:
            table.clear()
        table[""] = 0
        n = known = len(word)
        while word[:known] not in table:
            known -= 1
        for end in range(known + 1, n + 1):
            for start in range(max(0, end - self.longest.get(word[end - 1], 0)), end):
                t = vocab.get(word[start:end])
                if t is None:
                    continue
                before = table[word[:start]]
                if self._follows(before, t):
                    table[word[:end]] = t << 32 | (before & 0xFFFFFFFF) + 1
                    break
            else:
                raise ValueError(f"the vocabulary lacks a byte of {word!r}")
        return table[word]

    def _states(self, word: str) -> array:
        """``state`` of every prefix of a long word, by position: memory is linear in the word."""
        vocab, states = self.vocab, array("q", [0])
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest.get(word[end - 1], 0)), end):
                t = vocab.get(word[start:end])
                if t is not None and self._follows(states[start], t):
                    states.append(t << 32 | (states[start] & 0xFFFFFFFF) + 1)
                    break
            else:
                raise ValueError(f"the vocabulary lacks a byte of {word[end - 1]!r}")
        return states

    def piece(self, word: str) -> list[int]:
        """Tokens of every prefix of one word."""
        if len(word) > SHARED:
            return [s & 0xFFFFFFFF for s in self._states(word)]
        self.state(word)
        return [self.table[word[:k]] & 0xFFFFFFFF for k in range(len(word) + 1)]

    def word(self, piece: str) -> int:
        """Tokens of one word of the text with the space before it.

        Words of Latin letters, and a full stop or comma behind them, need no pattern to be split.
        """
        end, tail = len(piece), 0
        if piece[-1:] in (".", ","):
            end, tail = end - 1, 1
        letters = piece[:end]
        if letters.isalpha() and max(letters) < "\u0250":
            if not letters.isascii():
                letters = "".join(map(self.alphabet.__getitem__, letters.encode()))
            return (self.state(self.alphabet[32] + letters) & 0xFFFFFFFF) + tail
        return self.span(" " + piece)

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        if not any(s in text for s in self.special):
            return [(text, False)]
        found = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        return [(x, k % 2 == 1) for k, x in enumerate(found) if x]

    def span(self, text: str) -> int:
        """Tokens of a stretch of text that starts and ends at safe borders."""
        total = 0
        for part, special in self._parts(text):
            total += 1 if special else sum(self.state(w) & 0xFFFFFFFF for w, _ in self.split_words(part))
        return total

    def prefixes(self, text: str) -> list[int]:
        """Tokens of every prefix of such a stretch, by characters; item k is for ``text[:k]``.

        Most prefixes end inside a word and only need that word's counts. A prefix that ends in a run of white space
        or in a contraction is split into other words than the whole, so there the prefix itself is counted.
        """
        out, base, at_text = [0], 0, 0
        for part, special in self._parts(text):
            at_text += len(part)
            if special:
                before = text[: at_text - len(part)]
                out += [self.span(before + part[:k]) for k in range(1, len(part))] + [base + 1]
                base += 1
                continue
            at = 0  # where the words begin that a prefix may split otherwise
            start = base
            for word, (a, b) in self.split_words(part):
                counts, piece, n = self.piece(word), part[a:b], 0
                plain = not piece[0].isspace() or (piece[0] == " " and not piece.isspace())
                alone = (piece.isspace() and at == a) or (piece[0] == "'" and len(piece) > 3)
                odd = piece.isspace() or piece[0] == "'" or (a and part[a - 1].isspace() and not plain)
                odd = odd and not alone
                for k, char in enumerate(piece, 1):
                    n += len(char.encode())
                    out.append(start + self.span(part[at : a + k]) if odd or (k == 1 and piece[0] == " ") else base + counts[n])
                base += counts[-1]
                if not piece.isspace():
                    at, start = b, base
        return out

    def count(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and the characters of its longest prefix of at most ``limit`` tokens."""
        parts = pieces(text)
        head, rest = parts[0], parts[1:]
        data, first, self.table = self.counts.room(), self.first.room(), self.prefix_tables.room()
        n_head = first.get(head)
        if n_head is None:
            n_head = self.span(head)
            if len(head) <= SHARED:
                first[head] = n_head
        try:
            total = n_head + sum(map(data.get, rest))
        except TypeError:  # a word without an entry
            new = {p: self.word(p) for p in set(rest) if p not in data}
            data.update((p, n) for p, n in new.items() if len(p) <= SHARED)
            data = ChainMap(new, data) if any(len(p) > SHARED for p in new) else data
            total = n_head + sum(map(data.__getitem__, rest))
        if total <= limit:
            return total, len(text)
        done = at = 0
        for k, p in enumerate(parts):
            n = data[p] if k else n_head
            if done + n > limit:
                inside = self.prefixes(" " + p if k else p)
                return total, at + max(i for i, c in enumerate(inside) if done + c <= limit)
            done, at = done + n, at + len(p) + (k > 0)
        raise AssertionError


def token_counts(
    df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, kept_chars): exact counts, and where a budget of ``limit`` cuts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("prefix counts", path), lambda: PrefixCounter(path))
        for b in rows(batches):
            got = [counter.count(t, limit) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "kept_chars"],
            )

    docs = texts(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, kept_chars long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars"
    )
