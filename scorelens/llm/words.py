"""Tokenizing by words: a text is cut where no token can cross, and each distinct piece is encoded once per worker.

A piece is a word with the space before it. A cut at a space is safe for a byte-level tokenizer when what follows is
no white space: the pattern that splits words then starts anew at that space. Texts with longer runs of white space
are cut only at single spaces between other characters. Arrow splits texts, names their words and looks them up.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUNS = re.compile(r" \s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Signs at the end of a word.
_SIGNS = r"[!-&(-/:-@\[-`{-~]+$"
#: A line end between a visible sign and a letter, the only one of its word.
_LINED = r"^[^\n]*[!-~]\n[A-Za-z][^\n]*$"
#: Words that the library is given as one text.
JOINED = 200
#: Bytes of the longest words that are kept.
LONGEST = 100


def pieces(text: str) -> list[str]:
    """The text at its safe spaces; ``" ".join(pieces(text))`` is the text."""
    if text[:1] == " " or text[-1:] == " " or _RUNS.search(text):
        return _SINGLE.split(text)
    return text.split(" ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = dict(zip(shown, map(chr, shown))) | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def offsets(values: pa.Array) -> np.ndarray:
    """The ends of large binary values in their buffer, from where the first one begins."""
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)


def _binary(ends: np.ndarray, data: np.ndarray | pa.Buffer) -> pa.Array:
    begin = pa.py_buffer(np.ascontiguousarray(ends, np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, begin, pa.py_buffer(data)])


def _by_parts(tok, some: list[str], size: int) -> Iterator:
    """The library's results, which are large, for so many texts at once."""
    for at in range(0, len(some), size):
        yield from tok.encode_batch_fast(some[at : at + size], add_special_tokens=False)


class WordEncoder:
    """Token ids as ``tokenizers`` gives them, without added special tokens, as little-endian unsigned 32-bit bytes.

    ``spaces`` says whether the tokenizer keeps white space (byte-level) or drops it (word ends).
    """

    def __init__(self, path: str, spaces: bool = True, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.spaces = spaces
        # The words known so far, their ids, and the call that used them last.
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.used, self.calls, self.limit = np.zeros(0, np.int64), 0, limit
        self.tails = {c: self._ids(self.tok.encode(c, add_special_tokens=False)) for c in ".,"}
        # Letters that the normaliser turns into something else, to which a sign behind may be joined.
        normal = self.tok.normalizer.normalize_str if self.tok.normalizer else str
        self.odd = {c for c in map(chr, range(0x250)) if c.isalpha() and not normal(c).isalpha()}
        # Words of other letters are one word for any rule that splits a text, so the model alone gives their ids.
        self.model = tokenizers.Tokenizer(self.tok.model)
        self.model.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        shown = byte_letters()
        self.spelled = {
            ord(c): "".join(shown[b] for b in normal(c).encode())
            for c in map(chr, range(0x250))
            if c.isalpha() and c not in self.odd
        }
        # Tokens that begin a word (they have its space) or that end one.
        vocabulary = self.tok.get_vocab()
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.border[k] = token.startswith("\u0120") if spaces else token.endswith("</w>")

    @staticmethod
    def _ids(found) -> bytes:
        return array("I", found.ids).tobytes()

    def _lettered(self, word: str) -> bool:
        """Whether the word is only letters that the model's own spelling is known for."""
        return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and self.odd.isdisjoint(word)))

    def _encode_lettered(self, words: pa.Array) -> pa.Array:
        """Ids of words of letters. They go to the model many to a text, which is cut at the words' borders again."""
        ends = np.minimum(np.arange(0, len(words) + JOINED, JOINED), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), " ").to_pylist()
        joined = [text.translate(self.spelled) for text in joined]
        if self.spaces:
            joined = ["\u0120" + text.replace(" ", " \u0120") for text in joined]
        parts, sizes = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for k, got in enumerate(_by_parts(self.model, joined, 50)):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.border[ids])
            bounds = np.append(cuts, len(ids)) if self.spaces else np.concatenate([[0], cuts + 1])
            if len(cuts) != ends[k + 1] - ends[k] or bounds[0] or bounds[-1] != len(ids):
                found = self._encode_words(words.slice(ends[k], ends[k + 1] - ends[k]).to_pylist())
                ids = np.frombuffer(b"".join(found), "<u4")
                bounds = np.cumsum([0, *(len(x) // 4 for x in found)])
            parts.append(ids)
            sizes.append(np.diff(bounds))
        return _binary(np.cumsum(np.concatenate(sizes)) * 4, np.concatenate(parts))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of any words, by the library with all its rules."""
        shown = [" " + p for p in words] if self.spaces else words
        return list(map(self._ids, _by_parts(self.tok, shown, 5_000)))

    def _fill(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct words. Signs behind letters, other than an apostrophe, are what they are alone.

        No token crosses a line end between two signs that are not white space, so what follows it is one more word.
        """
        lined = pc.match_substring_regex(parts, _LINED)
        lines = np.flatnonzero(lined.to_numpy(zero_copy_only=False))
        halves = pc.split_pattern(parts.take(pa.array(lines)), "\n", max_splits=1).flatten()
        later = halves.take(pa.array(np.arange(1, len(halves), 2))).dictionary_encode()
        parts = pc.replace_with_mask(parts, lined, halves.take(pa.array(np.arange(0, len(halves), 2))))
        signed = pc.match_substring_regex(parts, _SIGNS).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(signed)
        behind = pc.extract_regex(parts.take(pa.array(ends)), f"(?P<s>{_SIGNS})").field("s").dictionary_encode()
        stems = pc.replace_substring_regex(parts, _SIGNS, "")
        lettered = pc.ascii_is_alpha(stems).to_numpy(zero_copy_only=False).copy()
        others = np.flatnonzero(~lettered)
        lettered[others] = list(map(self._lettered, stems.take(pa.array(others)).to_pylist()))
        plain, rest = np.flatnonzero(lettered), np.flatnonzero(~lettered)
        named = stems.take(pa.array(plain)).dictionary_encode()
        alone = self._encode_words(parts.take(pa.array(rest)).to_pylist())
        signs = list(map(self._tail, behind.dictionary.to_pylist()))
        below = list(map(self._ids, _by_parts(self.tok, ["\n" + x for x in later.dictionary.to_pylist()], 5_000)))
        known = pa.concat_arrays(
            [self._encode_lettered(named.dictionary), pa.array([*alone, *below, *signs, b""], pa.large_binary())]
        )
        # Three entries make a word: what is before the signs, the signs or nothing, the next line or nothing.
        n = len(known) - 1
        order = np.full((len(parts), 3), n)
        order[lines, 2] = n - len(signs) - len(below) + later.indices.to_numpy()
        order[ends, 1] = n - len(signs) + behind.indices.to_numpy()
        order[plain, 0] = named.indices.to_numpy()
        order[rest, 0], order[rest, 1] = len(named.dictionary) + np.arange(len(rest)), n
        joined = known.take(pa.array(order.ravel()))
        return _binary(offsets(joined)[::3], joined.buffers()[2])

    def _tail(self, signs: str) -> bytes:
        """The ids of signs that stand behind letters."""
        if len(self.tails) > 10_000:
            self.tails.clear()
        if signs not in self.tails:
            self.tails[signs] = self._ids(self.tok.encode(signs, add_special_tokens=False))
        return self.tails[signs]

    def _split(self, batch: pa.Array) -> pa.Array:
        """The pieces of each text, as lists of strings."""
        split = pc.split_pattern(batch, " ")
        if not self.spaces:
            return split
        odd = [k for k, text in enumerate(batch.to_pylist()) if text[:1] == " " or text[-1:] == " " or _RUNS.search(text)]
        if not odd:
            return split
        places = np.arange(len(batch))
        places[odd] = len(batch) + np.arange(len(odd))
        others = pa.array(list(map(pieces, batch.take(pa.array(odd)).to_pylist())), split.type)
        return pa.concat_arrays([split, others]).take(pa.array(places))

    def _forget(self) -> None:
        """Keep the half of the words that were used last."""
        keep = pa.array(np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2]))
        self.words, self.ids, self.used = self.words.take(keep), self.ids.take(keep), self.used[keep.to_numpy()]

    def encode_array(self, batch: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, with ``end`` behind them; new words of all texts go to the library together.

        Arrow splits the texts, names their distinct words, finds those that are known and puts ids together; Python
        does not see a word of ASCII letters. Known words are indexed anew at each call, so give it many texts at once.
        """
        if not len(batch):
            return pa.array([], pa.large_binary())
        if len(self.words) > self.limit:
            self._forget()
        count, split = len(batch), self._split(batch.cast(pa.string()))
        ends, flat = np.asarray(split.offsets, np.int64), split.flatten()
        ends = ends - ends[0] + np.arange(count + 1)  # the end is one more word of every text
        body = np.ones(len(flat) + count, bool)
        body[ends[1:] - 1] = False
        heads: list[bytes] = []
        if self.spaces:  # a text's first piece has no space before it
            firsts = ends[:-1] - np.arange(count)
            first = flat.take(pa.array(firsts)).to_pylist()
            heads = list(map(self._ids, self.tok.encode_batch_fast(first, add_special_tokens=False)))
            body[ends[:-1]] = False
            others = np.ones(len(flat), bool)
            others[firsts] = False
            flat = flat.filter(pa.array(others))
        named = flat.dictionary_encode()
        old = len(self.words)
        at = pc.index_in(named.dictionary, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        self.calls += 1
        self.used[at[at >= 0]] = self.calls
        new = named.dictionary.take(pa.array(missing))
        new_ids = self._fill(new) if len(new) else self.ids.slice(0, 0)
        at[missing] = old + np.arange(len(missing))
        known = pa.concat_arrays([self.ids, new_ids, pa.array([*heads, end], pa.large_binary())])
        order = np.empty(len(body), np.int64)
        order[body] = at[named.indices.to_numpy()]
        order[ends[1:] - 1] = len(known) - 1
        if heads:
            order[ends[:-1]] = old + len(new) + np.arange(count)
        joined = known.take(pa.array(order))
        # Words at a line's end hardly come again.
        short = pc.and_not(pc.less_equal(pc.binary_length(new), LONGEST), pc.match_substring(new, "\n"))
        self.words = pa.concat_arrays([self.words, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, new_ids.filter(short)])
        self.used = np.concatenate([self.used, np.full(len(self.words) - old, self.calls)])
        return _binary(offsets(joined)[ends], joined.buffers()[2])

    def encode_all(self, batch: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(batch, pa.string())).to_pylist()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]
