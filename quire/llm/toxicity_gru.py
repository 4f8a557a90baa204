"""Toxicity by a bidirectional gated recurrent network with attention pooling over overlapping windows.

A word's input joins a learned vector of the word, the mean of learned vectors of its character n-grams, and the
word's log odds in the labelled rows. Both directions run over windows of `length` words, `stride` apart;
attention pools each window's states, and a document's logit is the soft maximum of its windows' logits. The
network is trained in numpy by back-propagation through time; every word of every text lies in a scored window.

Defined cases: a null or empty text is one empty window and gets that window's score; with no labelled rows to
learn from every score is 0; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.training import Adam, labelled_sample, sigmoid
from quire.llm.wordgrams import WordTable, gram_ids, normal

SHARP = 2.0
#: Of the character n-grams.
LONGEST = 4


@dataclass
class Gru:
    params: dict[str, np.ndarray]
    length: int
    stride: int


def _log_odds(sample: list[tuple[bool, list[str]]], buckets: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket of whole words: log odds that a document with the word is positive, and 1 where `least` documents
    have it. Rarer words are unknown to the network, which sees their characters alone, so it can't learn them by heart."""
    seen = {True: np.zeros(buckets), False: np.zeros(buckets)}
    total = {True: 1, False: 1}
    for positive, words in sample:
        seen[positive][np.unique(gram_ids(sorted(set(words)), buckets, 0)[1])] += 1
        total[positive] += 1
    rate = lambda k: (seen[k] + 1) / (total[k] + 2)
    known = (seen[True] + seen[False] >= least).astype(float)
    weight = known * (seen[True] + seen[False]) / (seen[True] + seen[False] + 5)
    return weight * np.log(rate(True) / rate(False)), known[:, None]


def word_inputs(words: list[str], p: dict) -> np.ndarray:
    """The network's input vectors of words: log odds, word vector, mean character vector."""
    plain = [normal(w) for w in words]
    _, own = gram_ids(plain, len(p["odds"]), 0)
    owners, ids = gram_ids(plain, len(p["chars"]), LONGEST)
    n = np.bincount(owners, minlength=len(words))[:, None]
    chars = np.stack([np.bincount(owners, p["chars"][ids, k], len(words)) for k in range(p["chars"].shape[1])], 1)
    return np.concatenate([p["odds"][own][:, None], p["words"][own] * p["known"][own], chars / np.maximum(n, 1)], 1)


def windows_of(sizes: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows per text, and each window's first word within its text. An empty text has one window."""
    n = 1 + np.maximum(0, -(-(sizes - length) // stride))
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return n, number * stride


def run_direction(gates: np.ndarray, live: np.ndarray, u: np.ndarray, keep: bool = False):
    """gates: (step, window, 3h) from the inputs; live: (step, window, 1). States (step, window, h)."""
    steps, batch, h3 = gates.shape
    h = h3 // 3
    state = np.zeros((batch, h), gates.dtype)
    states, kept = np.empty((steps, batch, h), gates.dtype), []
    for t in range(steps):
        hu = state @ u
        rz = 1 / (1 + np.exp(-(gates[t, :, : 2 * h] + hu[:, : 2 * h])))
        r, z = rz[:, :h], rz[:, h:]
        n = np.tanh(gates[t, :, 2 * h :] + r * hu[:, 2 * h :])
        new = state + live[t] * (1 - z) * (n - state)
        if keep:
            kept.append((state, r, z, n, hu[:, 2 * h :]))
        state = states[t] = new
    return states, kept


def back_direction(d_states: np.ndarray, kept: list, live: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u."""
    steps, batch, h = d_states.shape
    d_gates, du, carry = np.empty((steps, batch, 3 * h)), np.zeros_like(u), np.zeros((batch, h))
    for t in range(steps - 1, -1, -1):
        state, r, z, n, hn = kept[t]
        d = carry + d_states[t]
        dl = d * live[t]
        dn = dl * (1 - z) * (1 - n * n)
        dz = -dl * (n - state) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        d_hu = np.concatenate([dr, dz, dn * r], 1)
        d_gates[t] = np.concatenate([dr, dz, dn], 1)
        du += state.T @ d_hu
        carry = d - dl * (1 - z) + d_hu @ u.T
    return d_gates, du


def window_logits(p: dict, gates: np.ndarray, live: np.ndarray, keep: bool = False):
    """gates: (step, window, 6h), both directions. live: (step, window, 1)."""
    h = p["u1"].shape[0]
    f, kept1 = run_direction(gates[:, :, : 3 * h], live, p["u1"], keep)
    b, kept2 = run_direction(gates[::-1, :, 3 * h :], live[::-1], p["u2"], keep)
    states = np.concatenate([f, b[::-1]], 2)
    a = np.tanh(states @ p["att"])
    s = a @ p["v"] + (live[:, :, 0] - 1) * 30
    e = np.exp(s - s.max(0))
    alpha = e / e.sum(0)
    c = (alpha[:, :, None] * states).sum(0)
    logit = c @ p["c"] + p["d"]
    return (logit, (kept1, kept2, states, a, alpha, c)) if keep else logit


def pool(logit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's windows, and each window's share in it."""
    start, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    e = np.exp(SHARP * (logit - np.maximum.reduceat(logit, start)[doc]))
    w = e / np.add.reduceat(e, start)[doc]
    return np.add.reduceat(w * logit, start), w


def _laid_out(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, doc: np.ndarray, left: np.ndarray, length: int):
    position = left + np.arange(length)[:, None]
    inside = position < sizes[doc]
    return np.where(inside, flat[np.clip(begins[doc] + position, 0, max(len(flat) - 1, 0))] if len(flat) else 0, 0), inside


def train_gru(sample: list[tuple[str, str]], positive: str = "1", length: int = 32, stride: int = 16, hidden: int = 6, buckets: int = 1 << 13, width: int = 6, epochs: int = 5, least: int = 8, drop: float = 0.4, seed: int = 5) -> Gru | None:
    """sample: (label, text). drop: the share of a batch's words that are hidden, so that no single word suffices."""
    if len({label for label, _ in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([label == positive for label, _ in sample], float)
    split = [[normal(w) for w in text.split()] for _, text in sample]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    odds, known = _log_odds([(bool(k), w) for k, w in zip(y, split, strict=True)], buckets, least)
    p = {
        "odds": odds, "known": known,
        "words": rng.normal(0, 0.1, (buckets, width)), "chars": rng.normal(0, 0.1, (buckets // 4, width)),
        "w": init(1 + 2 * width, 6 * hidden), "b": np.zeros(6 * hidden), "u1": init(hidden, 3 * hidden), "u2": init(hidden, 3 * hidden),
        "att": init(2 * hidden, hidden), "v": init(hidden), "c": init(2 * hidden), "d": np.full(1, -1.0),
    }
    adam = Adam({k: v for k, v in p.items() if k not in ("odds", "known")}, 0.01, 1e-4)
    names: dict[str, int] = {}
    ids = [np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in split]
    vocabulary = list(names)
    _, own = gram_ids(vocabulary, buckets, 0)
    owners, grams = gram_ids(vocabulary, len(p["chars"]), LONGEST)
    order = np.argsort(owners, kind="stable")
    owners, grams = owners[order], grams[order]
    gram_at = np.searchsorted(owners, np.arange(len(vocabulary) + 1))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 48)):
            sizes = np.array([len(ids[i]) for i in batch], np.int64)
            flat = np.concatenate([ids[i] for i in batch])
            if not len(flat):
                continue
            used, flat = np.unique(flat, return_inverse=True)
            n, left = windows_of(sizes, length, stride)
            doc = np.repeat(np.arange(len(batch)), n)
            at, inside = _laid_out(flat, np.cumsum(sizes) - sizes, sizes, doc, left, length)
            live = inside[:, :, None].astype(float)
            take = np.concatenate([np.arange(gram_at[k], gram_at[k + 1]) for k in used])
            local = np.repeat(np.arange(len(used)), gram_at[used + 1] - gram_at[used])
            per = np.maximum(np.bincount(local, minlength=len(used)), 1)[:, None]
            chars = np.stack([np.bincount(local, p["chars"][grams[take], k], len(used)) for k in range(width)], 1) / per
            seen = known[own[used]] * (rng.random((len(used), 1)) >= drop)
            shown = rng.random((len(used), 1)) >= drop
            x = np.concatenate([p["odds"][own[used]][:, None] * seen, p["words"][own[used]] * seen, chars * shown], 1)
            logit, (kept1, kept2, states, a, alpha, c) = window_logits(p, (x @ p["w"] + p["b"])[at], live, keep=True)
            pooled, share = pool(logit, n)
            wrong = (sigmoid(pooled) - y[batch]) / len(batch)
            d_logit = wrong[doc] * share * (1 + SHARP * (logit - pooled[doc]))
            g = {"c": c.T @ d_logit, "d": d_logit.sum(keepdims=True)}
            dc = d_logit[:, None] * p["c"]
            d_alpha = (states * dc).sum(2)
            ds = alpha * (d_alpha - (alpha * d_alpha).sum(0))
            g["v"] = np.einsum("tbh,tb->h", a, ds)
            da = ds[:, :, None] * p["v"] * (1 - a * a)
            g["att"] = np.einsum("tbi,tbj->ij", states, da)
            d_states = alpha[:, :, None] * dc + da @ p["att"].T
            h = hidden
            d1, g["u1"] = back_direction(d_states[:, :, :h], kept1, live, p["u1"])
            d2, g["u2"] = back_direction(d_states[::-1, :, h:], kept2, live[::-1], p["u2"])
            d_gates = np.concatenate([d1, d2[::-1]], 2) * live
            by_word = np.stack([np.bincount(at.ravel(), d_gates[:, :, k].ravel(), len(used)) for k in range(6 * h)], 1)
            g["w"], g["b"] = x.T @ by_word, by_word.sum(0)
            dx = by_word @ p["w"].T
            g["words"] = np.stack([np.bincount(own[used], dx[:, 1 + k] * seen[:, 0], buckets) for k in range(width)], 1)
            to_gram = (dx[:, 1 + width :] * shown / per)[local]
            g["chars"] = np.stack([np.bincount(grams[take], to_gram[:, k], len(p["chars"])) for k in range(width)], 1)
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            adam.step({k: v * min(1.0, 5.0 / max(size, 1e-9)) for k, v in g.items()})
    return Gru(p, length, stride)


def word_gates(model: Gru):
    """Gate inputs of words, both directions; the recurrence adds only what comes from the states."""

    def compute(words: list[str]) -> np.ndarray:
        p = model.params
        return (word_inputs(words, p) @ p["w"] + p["b"]).astype(np.float32) if words else np.zeros((0, len(p["b"])), np.float32)

    return compute


def score_texts(texts: list[str | None], model: Gru, table: WordTable, block: int = 4096) -> np.ndarray:
    small = {k: model.params[k].astype(np.float32) for k in ("u1", "u2", "att", "v", "c", "d")}
    table.start()
    per_text = [table.index((t or "").split()) for t in texts]
    rows = table.table()
    if not len(rows):
        rows = np.zeros((1, 6 * len(small["u1"])), np.float32)
    sizes = np.array([len(x) for x in per_text], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *per_text])
    begins = np.cumsum(sizes) - sizes
    n, left = windows_of(sizes, model.length, model.stride)
    doc = np.repeat(np.arange(len(texts)), n)
    logit = np.empty(len(doc), np.float32)
    for k in range(0, len(doc), block):
        at, inside = _laid_out(flat, begins, sizes, doc[k : k + block], left[k : k + block], model.length)
        logit[k : k + block] = window_logits(small, rows[at], inside[:, :, None].astype(np.float32))
    return sigmoid(pool(logit.astype(np.float64), n)[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 1200, **options) -> Gru | None:
    """labels: (doc_id, label 0/1) that may be learned from."""
    return train_gru(labelled_sample(docs, labels, per_label), **options)


def score_toxicity(docs: DataFrame, model: Gru | None) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        table = WordTable(word_gates(m), limit=200_000)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "score": score_texts(part["text"].tolist(), m, table)})

    return rows.mapInPandas(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
