"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the weights of its words, each the sum of the weights of the word
and of its letter groups. A document is toxic unless all its sentences are clean, so its probability is the noisy-or
of theirs and of one background per document, whose probability is that of a sentence without weight. A sentence adds
what it has above the background, so one without a weighted word adds nothing, and scoring ignores sentences below
``NEUTRAL``: a text of such sentences alone has the background's score at any length. The weights are fitted to document labels through that combination, by gradient steps over all sampled
documents at once. The fitted sentence scores then say where in a document the offence is.

Defined results: null and empty texts and texts without a word score 0; texts of any length are scored whole; ties and
repeated rows are scored each for itself; without labels of both classes the score is the share of toxic rows in the
sample (0 without any); empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scorelens.llm.common import held_out, per_worker, rows, texts
from scorelens.llm.labelled import labelled_sample

#: Hashed features, and what ends a sentence besides a line end, which becomes a word of its own.
FEATURES, _LINE = 1 << 18, "\x00"
#: Sentences of a lower probability say nothing about their document.
NEUTRAL = 0.1
_ENDS = (".", "!", "?", ";", "…", "。")


def words(text: str) -> list[str]:
    return text.lower().replace("\n", f" {_LINE} ").split()


def features(word: str) -> list[int]:
    """Hashes of a word without the signs around it, and of its beginnings of four and six letters."""
    core = re.sub(r"^\W+|\W+$", "", word)
    if not core:
        return []
    found = {f"<{core}>", *(f"<{core[:n]}" for n in (4, 6) if len(core) >= n)}
    return [zlib.crc32(x.encode()) % FEATURES for x in sorted(found)]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def plain(self) -> tuple[np.ndarray, float, float | None]:
        """What is broadcast: workers need not have this package."""
        return self.weights, self.bias, self.constant

    def key(self) -> int:
        return zlib.crc32(self.weights.tobytes()) ^ hash((self.bias, self.constant))


def _log_clean(p: np.ndarray | None, bias: float):
    """What sentences add to the log of a document's clean probability; None for what it has without any sentence."""
    ground = -np.log1p(np.exp(np.clip(bias, -40, 40)))
    return ground if p is None else np.minimum(0.0, np.log1p(-np.minimum(p, 1 - 1e-12)) - ground)


class _Scorer:
    """Word weights by word, and sentence probabilities of one text."""

    def __init__(self, model: ToxicityModel, limit: int = 250_000):
        self.model, self.limit = model, limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.weight, self.ends = np.zeros(1024), np.zeros(1024, np.int64)

    def _add(self, word: str) -> None:
        n = len(self.index)
        if n == len(self.weight):
            self.weight, self.ends = np.resize(self.weight, 2 * n), np.resize(self.ends, 2 * n)
        got = features(word)
        self.weight[n] = self.model.weights[got].sum() if got else 0.0
        self.ends[n] = word == _LINE or word.endswith(_ENDS)
        self.index[word] = n

    def sentences(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each sentence that has a word, and the sentence of each token."""
        if len(self.index) > self.limit:
            self._reset()
        for w in set(tokens).difference(self.index):
            self._add(w)
        ids = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        of = np.cumsum(self.ends[ids])
        of = np.concatenate([[0], of[:-1]])
        # A sentence has a word or it hasn't; repeating it adds nothing.
        once = np.unique(of << 32 | ids)
        z = np.bincount(once >> 32, self.weight[once & 0xFFFFFFFF], of[-1] + 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), of

    def score(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant if text.strip() else 0.0
        tokens = words(text)
        if tokens.count(_LINE) == len(tokens):
            return 0.0
        p, _ = self.sentences(tokens)
        return float(-np.expm1(_log_clean(p[p >= NEUTRAL], self.model.bias).sum() + _log_clean(None, self.model.bias)))

    def offending(self, text: str, threshold: float) -> list[tuple[int, int, float]]:
        """Character spans of the sentences at or above a probability."""
        if self.model.constant is not None:
            return []
        spans, tokens = [], []
        for m in re.finditer(r"\n|\S+", text):
            tokens.append(_LINE if m[0] == "\n" else m[0].lower())
            spans.append(m.span())
        if not tokens:
            return []
        p, of = self.sentences(tokens)
        out = []
        for s in np.flatnonzero(p >= threshold):
            inside = [spans[k] for k in np.flatnonzero(of == s) if tokens[k] != _LINE]
            if inside:
                out.append((inside[0][0], inside[-1][1], float(p[s])))
        return out


def fit(
    texts_: list[str],
    y: list[int],
    weight: list[float],
    rounds: int = 150,
    l2: float = 5e-6,
    l1: float = 1e-4,
    seen: int | None = None,
) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood. Work per round follows the words of the sample.

    Features of fewer than ``seen`` documents (by default 2 to 6, with the toxic documents of the sample) keep weight
    0: a rare word explains its one document too easily.
    ``l1`` holds words without a clear lean at 0, which would add up in long texts.
    Weights are not negative: a clean word beside an offence does not excuse it.
    """
    share = float(np.average(y, weights=weight)) if y else 0.0
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(FEATURES, np.float32), 0.0, share)
    seen = seen or min(6, max(2, sum(y) // 100))
    index: dict[str, int] = {}
    feature, size = array("i"), array("i")  # of all words, one after another
    token, sentence, document = [], [], []
    n_sentences = 0
    for d, text in enumerate(texts_):
        tokens = words(text)
        if not tokens:
            continue
        for t in dict.fromkeys(tokens):
            if t not in index:
                index[t] = len(index)
                feature.extend(got := features(t))
                size.append(len(got))
        ids = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        ends = np.fromiter((t == _LINE or t.endswith(_ENDS) for t in tokens), np.int64, len(tokens))
        of = np.concatenate([[0], np.cumsum(ends)[:-1]])
        once = np.unique(of << 32 | ids)
        token.append((once & 0xFFFFFFFF).astype(np.int32))
        sentence.append(((once >> 32) + n_sentences).astype(np.int32))
        document.append(np.full(of[-1] + 1, d, np.int32))
        n_sentences += int(of[-1]) + 1
    if not token:
        return ToxicityModel(np.zeros(FEATURES, np.float32), 0.0, share)
    feature, size = np.array(feature, np.int64), np.array(size, np.int64)
    n_words, begin = len(index), np.cumsum(size) - size
    del index
    held = np.zeros(FEATURES, np.int64)
    for found in map(np.unique, token):  # a document at a time: all of them at once are many times the sample
        n = size[found]
        held[np.unique(feature[np.repeat(begin[found] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    owner = np.repeat(np.arange(n_words), size)
    common = held >= seen
    feature, owner = feature[common[feature]], owner[common[feature]]
    token, sentence, document = map(np.concatenate, (token, sentence, document))
    y_, weight_ = np.array(y, float), np.array(weight)
    told = np.bincount(document, minlength=len(y_)) > 0
    w, bias = np.zeros(FEATURES), -6.0
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for k in range(1, rounds + 1):
        of_word = np.bincount(owner, w[feature], n_words)
        z = np.bincount(sentence, of_word[token], n_sentences) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1 / (1 + np.exp(-bias))
        clean = np.exp(np.bincount(document, _log_clean(p, bias), len(y_)) + _log_clean(None, bias) * told)
        toxic = np.maximum(1 - clean, 1e-9)
        pull = np.where(y_ == 1, -clean / toxic, 1.0) * weight_ / len(y_)
        g = pull[document] * p
        by_word = np.bincount(token, g[sentence], n_words)
        gw = np.bincount(feature, by_word[owner], FEATURES) + l2 * w + l1
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        gb = (pull * told).sum() * p0 + (pull[document] * (p - p0)).sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a, b = 1 - 0.9**k, 1 - 0.999**k
        w = np.maximum(0, w - 0.15 * (m / a) / (np.sqrt(v / b) + 1e-8))
        bias -= 0.05 * (mb / a) / ((vb / b) ** 0.5 + 1e-8)
    return ToxicityModel(w.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class, none of them held out."""
    return fit(*labelled_sample(docs, labels, label, per_class))


def scorer(df: DataFrame, model: ToxicityModel):
    """A column function that scores whole texts; for use in ``select`` and ``filter``."""
    shared = df.sparkSession.sparkContext.broadcast(model.plain())

    @F.arrow_udf(DoubleType())
    def run(column: pa.Array) -> pa.Array:
        model = ToxicityModel(*shared.value)
        s = per_worker(("toxicity", model.key()), lambda: _Scorer(model), alone=True)
        return pa.array([s.score(t or "") for t in column.to_pylist()], pa.float64())

    return run


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences): n_sentences are those at 0.5 or above."""
    shared = df.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        scorer = per_worker(("toxicity", model.key()), lambda: _Scorer(model), alone=True)
        for b in rows(batches):
            all_texts = b.column(1).to_pylist()
            got = [scorer.score(t) for t in all_texts]
            n = [len(scorer.offending(t, 0.5)) if s >= 0.5 else 0 for t, s in zip(all_texts, got)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(got, pa.float64()), pa.array(n, pa.int32())], ["doc_id", "score", "n_sentences"]
            )

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_sentences int").select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
    )


def offending_sentences(
    df: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, end, score, sentence): a row per sentence at or above the threshold, by characters."""
    shared = df.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        scorer = per_worker(("toxicity", model.key()), lambda: _Scorer(model), alone=True)
        for b in rows(batches):
            out = [
                (doc, start, end, p, text[start:end])
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for start, end, p in scorer.offending(text, threshold)
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "score", "sentence"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")
