"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `size` words. Every passage is encoded (word shapes, symbols, repetition, and
hashed word grams through a learned table), gated attention learned from document labels alone weighs the passages,
and the weighted representation is scored.

Repetition counts 3-word windows of the passage that stand elsewhere in its document, so a passage is never judged
without its document.

Defined cases: a null or empty text is one empty passage and gets that passage's score; with no labelled rows to
learn from every score is the constant 0.5; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.training import Adam, labelled_sample, sigmoid
from quire.llm.wordgrams import WordTable, gram_ids

SHAPES = 10


@dataclass
class Mil:
    params: dict[str, np.ndarray]
    mean: np.ndarray
    std: np.ndarray
    size: int


def word_shapes(words: list[str], buckets: int) -> np.ndarray:
    """Per word: shape features, then the bucket of the lower-cased word's own gram."""
    out = np.zeros((len(words), SHAPES + 1), np.float32)
    for i, w in enumerate(words):
        letters = sum(map(str.isalpha, w))
        digits = sum(map(str.isdigit, w))
        other = len(w) - letters - digits
        out[i, :SHAPES] = (
            len(w) / 10, letters / len(w), digits / len(w), other / len(w), w.isupper(), letters == 0,
            "!" in w, any(c in "#*$%&|<>" for c in w), w[-1] in ".,;:?!", other > 1,
        )
    if words:
        owners, ids = gram_ids([w.lower() for w in words], buckets, longest=0)
        out[owners, SHAPES] = ids
    return out


def encode(texts: list[str | None], table: WordTable, embed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Features of all passages of all texts, the passages per text, and (passage of word, word bucket, words per passage)."""
    table.start()
    per_text = [table.index((t or "").split()) for t in texts]
    rows = table.table()
    sizes = np.array([len(p) for p in per_text], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *per_text])
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passages = np.maximum(1, -(-sizes // size))
    first = np.cumsum(passages) - passages
    owner = first[doc] + place // size
    total = int(passages.sum())
    count = np.bincount(owner, minlength=total)
    divisor = np.maximum(count, 1)[:, None]
    shapes = np.stack([np.bincount(owner, rows[flat, k], total) for k in range(SHAPES)], 1) / divisor
    # 3-word windows seen before in the same document
    repeated = np.zeros(len(flat))
    if len(flat) > 2:
        mixed = flat.astype(np.uint64) + np.uint64(1)
        window = (mixed[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (mixed[2:] * np.uint64(0x165667B19E3779F9))
        window += doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        inside = doc[:-2] == doc[2:]
        order = np.argsort(window, kind="stable")
        same = np.zeros(len(window), bool)
        equal = window[order][1:] == window[order][:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
        repeated[: len(window)] = same & inside
    share = np.bincount(owner, repeated, total) / divisor[:, 0]
    buckets = rows[flat, SHAPES].astype(np.int64)
    key = owner * np.int64(len(embed)) + buckets
    distinct = np.bincount(np.unique(key) // len(embed), minlength=total) / divisor[:, 0]
    scale = np.stack([share, distinct, np.minimum(count, size) / size, np.log1p(passages)[np.repeat(np.arange(len(texts)), passages)] / 5], 1)
    return np.concatenate([shapes, scale], 1), passages, (owner, buckets, divisor)


def embedded(parts: tuple, embed: np.ndarray, total: int) -> np.ndarray:
    owner, buckets, divisor = parts
    return np.stack([np.bincount(owner, embed[buckets, k], total) for k in range(embed.shape[1])], 1) / divisor


def forward(p: dict, x: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, dict]:
    """x: passage features. Logit of each document, and what the backward pass needs."""
    doc = np.repeat(np.arange(len(passages)), passages)
    start = np.cumsum(passages) - passages
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    s = (t * g) @ p["a"]
    e = np.exp(s - np.maximum.reduceat(s, start)[doc])
    alpha = e / np.add.reduceat(e, start)[doc]
    z = np.add.reduceat(alpha[:, None] * h, start)
    return z @ p["c"] + p["d"], {"doc": doc, "start": start, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "x": x}


def backward(p: dict, k: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    doc, h, t, g, alpha = k["doc"], k["h"], k["t"], k["g"], k["alpha"]
    grads = {"c": k["z"].T @ d_logit, "d": d_logit.sum(keepdims=True)}
    dz = (d_logit[:, None] * p["c"])[doc]
    dh = alpha[:, None] * dz
    d_alpha = (dz * h).sum(1)
    ds = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, k["start"])[doc])
    grads["a"] = (t * g).T @ ds
    dtg = ds[:, None] * p["a"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    grads["v"], grads["u"] = h.T @ dt, h.T @ dg
    dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
    grads["w"], grads["b"] = k["x"].T @ dh, dh.sum(0)
    return grads, dh @ p["w"].T


def train_mil(sample: list[tuple[str, str]], positive: str = "1", size: int = 48, buckets: int = 4096, width: int = 4, hidden: int = 16, epochs: int = 30, seed: int = 11) -> Mil | None:
    """sample: (label, text). Rows are weighted so that the classes keep their given shares in the loss."""
    if len({label for label, _ in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([label == positive for label, _ in sample], float)
    embed = rng.normal(0, 0.1, (buckets, width))
    table = WordTable(lambda words: word_shapes(words, buckets))
    fixed, passages, (owner, bucket, divisor) = encode([t for _, t in sample], table, embed, size)
    mean, std = fixed.mean(0), fixed.std(0) + 1e-3
    fixed = (fixed - mean) / std
    n = fixed.shape[1] + width
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"w": init(n, hidden), "b": np.zeros(hidden), "v": init(hidden, hidden), "u": init(hidden, hidden), "a": init(hidden), "c": init(hidden), "d": np.zeros(1), "embed": embed}
    adam = Adam(p, 0.01, 1e-4)
    begin = np.cumsum(passages) - passages
    word_begin = np.searchsorted(owner, np.arange(len(fixed) + 1))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            own = np.concatenate([np.arange(begin[i], begin[i] + passages[i]) for i in batch])
            words = np.concatenate([np.arange(word_begin[o], word_begin[o + 1]) for o in own])
            local = np.repeat(np.arange(len(own)), word_begin[own + 1] - word_begin[own])
            parts = (local, bucket[words], divisor[own])
            x = np.concatenate([fixed[own], embedded(parts, p["embed"], len(own))], 1)
            logit, kept = forward(p, x, passages[batch])
            grads, dx = backward(p, kept, (sigmoid(logit) - y[batch]) / len(batch))
            per_word = (dx[:, -width:] / divisor[own])[local]
            grads["embed"] = np.stack([np.bincount(parts[1], per_word[:, k], buckets) for k in range(width)], 1)
            adam.step(grads)
    return Mil(p, mean, std, size)


def score_texts(texts: list[str | None], model: Mil, table: WordTable) -> np.ndarray:
    embed = model.params["embed"]
    fixed, passages, parts = encode(texts, table, embed, model.size)
    x = np.concatenate([(fixed - model.mean) / model.std, embedded(parts, embed, len(fixed))], 1)
    return sigmoid(forward(model.params, x, passages)[0])


def fit_quality_mil(docs: DataFrame, labels: DataFrame, per_label: int = 1200, **options) -> Mil | None:
    """labels: (doc_id, label 0/1) that may be learned from."""
    return train_mil(labelled_sample(docs, labels, per_label), **options)


def score_quality(docs: DataFrame, model: Mil | None) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        table = WordTable(lambda words: word_shapes(words, len(m.params["embed"])))
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "score": score_texts(part["text"].tolist(), m, table)})

    return rows.mapInPandas(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
