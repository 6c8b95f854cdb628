"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over the embedded bytes of
a chunk and the strongest answer of each filter is kept; a small hidden layer reads these maxima, the chunks' hidden
units are combined by mean and by maximum, and a logistic output turns them into one probability. Gradients flow back
through the maxima, so training touches one window per filter and chunk.

Defined results: null and empty texts are scored as one empty chunk; texts of any length are scored whole, a block of
chunks at a time; ties and repeated rows are scored each for itself; without labels of both classes the score is the
share of good rows in the sample (0.5 without any); empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scorelens.llm.common import held_out, rows, texts
from scorelens.llm.labelled import labelled_sample

#: Bytes of a chunk, of its step, and of a filter; the filters' step; sizes of byte vector, filter bank, hidden layer.
CHUNK, STEP, WIDTH, STRIDE, DIM, FILTERS, HIDDEN = 256, 224, 8, 2, 6, 32, 16
_BLOCK = 256


@dataclass
class QualityModel:
    params: dict[str, np.ndarray]
    constant: float | None = None


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks of a text's bytes, the last one filled up with zeros."""
    n = max(1, -(-max(0, len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _windows(vectors: np.ndarray) -> np.ndarray:
    """(chunks, places, WIDTH * DIM) without copying, from (chunks, CHUNK, DIM)."""
    c, d = vectors.shape[0], vectors.shape[2]
    s = vectors.strides
    places = (CHUNK - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(vectors, (c, places, WIDTH * d), (s[0], STRIDE * s[1], s[2]))


def hidden(params: dict[str, np.ndarray], block: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden units of each chunk of a block, and what the way back needs."""
    vectors = params["bytes"][block]
    windows = _windows(vectors)
    answers = windows.reshape(-1, WIDTH * DIM) @ params["filters"]
    answers = answers.reshape(len(block), -1, FILTERS)
    best = answers.argmax(1)
    top = np.take_along_axis(answers, best[:, None, :], 1)[:, 0] + params["filter_bias"]
    pooled = np.maximum(top, 0)
    units = np.maximum(pooled @ params["hidden"] + params["hidden_bias"], 0)
    return units, (windows, best, top, pooled)


def combine(params: dict[str, np.ndarray], mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    z = np.concatenate([mean, most], 1) @ params["out"] + params["out_bias"]
    return 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))


def predict(model: QualityModel, raws: list[bytes]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(raws), model.constant)
    total, most, count = np.zeros((len(raws), HIDDEN)), np.zeros((len(raws), HIDDEN)), np.zeros((len(raws), 1))

    def take(block: list[np.ndarray], owner: list[int]) -> None:
        if block:
            units, _ = hidden(model.params, np.concatenate(block))
            np.add.at(total, owner, units)
            np.maximum.at(most, owner, units)
            np.add.at(count, owner, 1)

    block, owner = [], []
    for k, raw in enumerate(raws):
        cut = chunks(raw)
        for at in range(0, len(cut), _BLOCK):
            part = cut[at : at + _BLOCK]
            block.append(part)
            owner += [k] * len(part)
            if len(owner) >= _BLOCK:
                take(block, owner)
                block, owner = [], []
    take(block, owner)
    return combine(model.params, total / np.maximum(count, 1), most)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape, by: (rng.standard_normal(shape) / by**0.5).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    return {
        "bytes": draw(256, DIM, by=1),
        "filters": draw(WIDTH * DIM, FILTERS, by=WIDTH * DIM),
        "filter_bias": zero(FILTERS),
        "hidden": draw(FILTERS, HIDDEN, by=FILTERS),
        "hidden_bias": zero(HIDDEN),
        "out": draw(2 * HIDDEN, 1, by=2 * HIDDEN),
        "out_bias": zero(1),
    }


def fit(
    texts_: list[str], y: list[int], weight: list[float], epochs: int = 8, most_chunks: int = 12, seed: int = 7
) -> QualityModel:
    """Adam over mini-batches of 16 texts; an epoch sees at most ``most_chunks`` chunks, drawn anew, of each text."""
    if len(set(y)) < 2:
        return QualityModel({}, float(np.mean(y)) if y else 0.5)
    rng = np.random.default_rng(seed)
    params = _start(rng)
    cut = [chunks(t.encode()) for t in texts_]
    y_, weight_ = np.array(y, np.float32), np.array(weight, np.float32)
    m = {k: np.zeros_like(p) for k, p in params.items()}
    v = {k: np.zeros_like(p) for k, p in params.items()}
    step, size = 0, 16
    rounds = epochs * -(-len(cut) // size)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), size):
            batch = order[at : at + size]
            parts = [c if len(c := cut[i]) <= most_chunks else c[rng.choice(len(c), most_chunks, False)] for i in batch]
            n = np.array([len(p) for p in parts])
            begin = np.cumsum(n) - n
            block = np.concatenate(parts)
            units, (windows, best, top, pooled) = hidden(params, block)
            mean = np.add.reduceat(units, begin) / n[:, None]
            most = np.maximum.reduceat(units, begin)
            p = combine(params, mean, most)
            dz = ((p - y_[batch]) * weight_[batch] / len(batch)).astype(np.float32)[:, None]
            both = np.concatenate([mean, most], 1)
            g = {"out": both.T @ dz, "out_bias": dz.sum(0)}
            back = dz @ params["out"].T
            owner = np.repeat(np.arange(len(batch)), n)
            d_units = (back[:, :HIDDEN] / n[:, None])[owner] + back[owner, HIDDEN:] * (units == most[owner])
            d_units *= units > 0
            g["hidden"], g["hidden_bias"] = pooled.T @ d_units, d_units.sum(0)
            d_top = (d_units @ params["hidden"].T) * (top > 0)
            chosen = windows[np.arange(len(block))[:, None], best]  # (chunks, filters, WIDTH * DIM)
            g["filters"] = np.einsum("cfw,cf->wf", chosen, d_top)
            g["filter_bias"] = d_top.sum(0)
            spread = (d_top[:, :, None] * params["filters"].T[None]).reshape(-1, DIM)
            places = best[:, :, None] * STRIDE + np.arange(WIDTH)
            codes = block[np.arange(len(block))[:, None, None], places].ravel()
            g["bytes"] = np.stack([np.bincount(codes, spread[:, k], 256) for k in range(DIM)], 1)
            step += 1
            rate = 0.01 * min(1.0, 1.2 - step / rounds)
            for k, p_ in params.items():
                gk = g[k].astype(np.float32) + 1e-5 * p_
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.99 * v[k] + 0.01 * gk * gk
                params[k] = p_ - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return QualityModel({k: p.astype(np.float32) for k, p in params.items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1200) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each class, none of them held out."""
    return fit(*labelled_sample(docs, labels, label, per_class))


def scorer(df: DataFrame, model: QualityModel):
    """A column function that scores whole texts; for use in ``select`` and ``filter``."""
    shared = df.sparkSession.sparkContext.broadcast((model.params, model.constant))  # workers need not have this package

    @F.arrow_udf(DoubleType())
    def run(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for at in range(0, len(column), 256):
            raws = [(t or "").encode() for t in column.slice(at, 256).to_pylist()]
            out.append(predict(QualityModel(*shared.value), raws))
        return pa.array(np.concatenate(out), pa.float64())

    return run


def score(
    df: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    shared = df.sparkSession.sparkContext.broadcast((model.params, model.constant))  # workers need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 256):
            got = predict(QualityModel(*shared.value), [t.encode() for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
