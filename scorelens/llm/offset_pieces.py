"""SentencePiece encoding that keeps, for every piece, the bytes of the original text that it stands for.

Normalisation walks the model's compiled character map: at each place the longest prefix found in its double-array
trie is replaced, and every byte of the replacement remembers the source bytes. White space handling follows the
model's settings. Pieces are cut along the normalised bytes, and each piece is projected to its source span; spans
never overlap and rise. With an identity map a text is cut at single spaces, across which no piece of the vocabulary
reaches, and each distinct word is encoded once per worker.

Ids are those of the library. Defined results: null and empty texts have no pieces; a piece that stands only for the
space put in front of the text has an empty span; ties, repeated rows and ids are encoded each for itself; an empty
table gives an empty table; other columns are ignored. A text of any length is handled whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scorelens.llm.common import WordCache, per_worker, rows, texts

#: The mark that stands for a space in pieces.
MARK = "▁"


def message_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized protocol message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield field, raw[at : at + size]
        at += size


class CharacterMap:
    """The normaliser's compiled map: a double-array trie of source strings and the replacements they point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that ``raw`` has at a place."""
        units, found = self.units, None
        if not units:
            return None
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = jump(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units) or units[node] & 0x800000FF != raw[k]:
                break
            leaf = units[node] >> 8 & 1
            node ^= jump(units[node])
            if leaf:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\x00", found[1])
        return found[0], self.replacements[found[1] : end]


class Normalizer:
    def __init__(self, spec: bytes):
        fields = dict(message_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy, self.trim = bool(fields.get(3, 1)), bool(fields.get(4, 1))
        self.mark = MARK.encode() if fields.get(5, 1) else b" "

    def normalize(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes, and the start and end of the source bytes of each."""
        raw, at, steps = text.encode(), 0, []
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit is None:
                lead = raw[at]
                hit = (n := 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4), raw[at : at + n]
            steps.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.trim:
            while steps and steps[0][0] in (b"", b" "):
                steps.pop(0)
        out, starts, ends = bytearray(), [], []

        def put(b: bytes, start: int, end: int) -> None:
            # A replacement of as many bytes as its source is aligned byte by byte, otherwise as a whole.
            same = len(b) == end - start
            for k in range(len(b)):
                starts.append(start + k if same else start)
                ends.append(start + k + 1 if same else end)
            out.extend(b)

        def space(start: int, end: int) -> None:
            for _ in self.mark:
                starts.append(start)
                ends.append(end)
            out.extend(self.mark)

        if self.dummy and steps:
            space(steps[0][1], steps[0][1])
        spaced = self.trim
        for new, start, end in steps:
            if self.trim and spaced:
                new = new.lstrip(b" ")
            if not new:
                continue
            if b" " in new:
                for k, part in enumerate(new.split(b" ")):
                    if k:
                        space(start, end)
                    put(part, start, end)
            else:
                put(new, start, end)
            spaced = new.endswith(b" ")
        if self.trim:
            while out.endswith(self.mark) and out:
                del out[-len(self.mark) :], starts[-len(self.mark) :], ends[-len(self.mark) :]
        return bytes(out), np.array(starts, np.int64), np.array(ends, np.int64)


class OffsetEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = b""
        for field, value in message_fields(self.sp.serialized_model_proto()):
            spec = value if field == 3 else spec
        self.normalizer = Normalizer(spec)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_of = np.array(
            [1 if self.sp.is_byte(i) else len(names[i].encode()) - 2 * names[i].count(MARK) for i in range(len(names))]
        )
        self.decimal = [b"%d" % i for i in range(len(names))]
        n = self.normalizer
        self.by_word = (
            not n.map.units
            and n.dummy
            and not n.trim
            and n.mark != b" "
            and self.sp.is_byte(self.sp.piece_to_id("<0x00>"))
            and not any(MARK in x.lstrip(MARK) for x in names)
        )
        self.cache = WordCache(400_000)

    def _aligned(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """By the library, every piece projected through the normaliser's alignment."""
        normal, starts, ends = self.normalizer.normalize(text)
        if not normal:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, cuts, at = self.sp.encode(text), [], 0
        for i, piece in zip(ids, self.sp.encode(text, out_type=str), strict=True):
            at += 1 if self.sp.is_byte(i) else len(piece.encode())
            cuts.append(at)
        if at != len(normal):
            raise ValueError("pieces do not spell the normalised text")
        last = np.array(cuts, np.int64)
        first = np.concatenate([[0], last[:-1]]).astype(np.int64)
        return ids, starts[first], np.maximum.accumulate(ends[last - 1])

    def words(self, batch: list[str]) -> list[bytes | None]:
        """Per text the ids, joined from those of its words with the space before them. None: not by words."""
        out: list[bytes | None] = [None] * len(batch)
        if not self.by_word:
            return out
        able = [
            k
            for k, text in enumerate(batch)
            if text and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text
        ]
        data = self.cache.room()
        split = [batch[k].split(" ") for k in able]
        parts = [p for some in split for p in some]
        found = list(map(data.get, parts))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            new = list({parts[k] for k in missing})
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                data.update(zip(some, [array("I", ids).tobytes() for ids in self.sp.encode(some, num_threads=1)]))
            for k in missing:
                found[k] = data[parts[k]]
        ends = np.cumsum([0, *map(len, split)]).tolist()
        for k, a, b in zip(able, ends, ends[1:]):
            out[k] = b"".join(found[a:b])
        return out

    def encode_all(self, batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, and start and end of the source bytes of each piece."""
        for text, got in zip(batch, self.words(batch)):
            if got is None:
                ids, starts, ends = self._aligned(text)
                yield np.array(ids, np.uint32), starts, ends
                continue
            found = np.frombuffer(got, "<u4")
            # The first word's space is the one that the model puts in front, which has no bytes of its own.
            ends = np.cumsum(self.bytes_of[found]) - 1
            yield found, np.concatenate([[0], ends[:-1]]), ends

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Ids, and start and end of the source bytes of each piece; the ids in decimal, joined by spaces."""
        ids, starts, ends = next(self.encode_all([text]))
        return ids, starts, ends, b" ".join(map(self.decimal.__getitem__, ids.tolist()))


def encode_offsets(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): piece ids and the half-open byte span of each in the original text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("offset pieces", path), lambda: OffsetEncoder(path))
        for b in rows(batches, 256):
            got = list(encoder.encode_all(b.column(1).to_pylist()))
            lists = [
                pa.array([x[k].tolist() for x in got], pa.list_(kind))
                for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "ids", "starts", "ends"])

    return texts(df, id_col, text_col).mapInArrow(
        encode, "doc_id long, ids array<int>, starts array<long>, ends array<long>"
    )


def decode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the library's text for each list of ids; null and empty lists give empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("offset pieces", path), lambda: OffsetEncoder(path))
        for b in rows(batches, 256):
            found = [encoder.sp.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(
        decode, "doc_id long, text string"
    )


def offset_digests(
    df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Digests of what ``encode_offsets`` and ``decode_pieces`` give, without carrying the lists between them.

    ``spans_sha256`` is over the little-endian 64-bit starts, then the ends.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("offset pieces", path), lambda: OffsetEncoder(path))
        last = b"%d" % end_id
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in rows(batches, 256):
            n, of_ids, of_text, of_spans = [], [], [], []
            for ids, starts, ends in encoder.encode_all(b.column(1).to_pylist()):
                listed = ids.tolist()
                n.append(len(listed) + 1)
                of_ids.append(sha(b" ".join([*map(encoder.decimal.__getitem__, listed), last])))
                of_text.append(sha(encoder.sp.decode([*listed, end_id]).encode()))
                of_spans.append(sha(starts.tobytes() + ends.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text), pa.array(of_spans)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return texts(df, id_col, text_col).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    )
