"""Language of each word by a linear-chain conditional random field.

Emissions are sums of learned weights of affixes, character n-grams and whole words (the lexicon), all hashed;
transitions are learned from sequences in which spans of different languages follow each other, as in
code-switched text. Words are labelled by forward-backward; a document's language is the label with most mass.

Words are labelled in segments of `core` words with `margin` words of context on either side, so that a text of
any length is covered whole in bounded memory.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text if nothing could be
learned; repeated rows are labelled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.training import Adam, labelled_sample
from quire.llm.wordgrams import WordTable, gram_ids, gram_sums, normal

UNKNOWN = "und"


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # bucket x language
    moves: np.ndarray  # from x to, in logs
    first: np.ndarray


def forward_backward(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (batch, step, label) and expected moves (label, label). mask: 0 at steps past a sequence's end."""
    batch, steps, n = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    e = np.where(mask[:, :, None] > 0, e, 1.0).astype(emit.dtype)
    a, start = np.exp(moves - moves.max()).astype(emit.dtype), np.exp(first - first.max()).astype(emit.dtype)
    alpha = np.empty((steps, batch, n), emit.dtype)
    cur = start * e[:, 0]
    alpha[0] = cur / cur.sum(1, keepdims=True)
    for t in range(1, steps):
        cur = (alpha[t - 1] @ a) * e[:, t]
        alpha[t] = cur / cur.sum(1, keepdims=True)
    beta = np.ones((batch, n), emit.dtype)
    post, expected = np.empty_like(alpha), np.zeros((n, n))
    post[steps - 1] = alpha[steps - 1]
    for t in range(steps - 2, -1, -1):
        ahead = np.where(mask[:, t + 1, None] > 0, beta * e[:, t + 1], 1.0)
        joint = alpha[t][:, :, None] * a * ahead[:, None, :]
        norm = joint.sum((1, 2), keepdims=True)
        live = mask[:, t + 1, None, None] / norm
        expected += (joint * live).sum(0)
        back = ahead @ a.T
        beta = np.where(mask[:, t + 1, None] > 0, back / back.sum(1, keepdims=True), 1.0 / n).astype(emit.dtype)
        p = alpha[t] * beta
        post[t] = p / p.sum(1, keepdims=True)
    return post.transpose(1, 0, 2), expected


def posteriors(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """As forward_backward() without masks and expected moves: (step, batch, label) to the same."""
    e = np.exp(emit - emit.max(2, keepdims=True))
    a, start = np.exp(moves - moves.max()).astype(e.dtype), np.exp(first - first.max()).astype(e.dtype)
    alpha = np.empty_like(e)
    cur = start * e[0]
    alpha[0] = cur / cur.sum(1, keepdims=True)
    for t in range(1, len(e)):
        cur = (alpha[t - 1] @ a) * e[t]
        cur /= cur.sum(1, keepdims=True)
        alpha[t] = cur
    beta = np.ones_like(e[0])
    for t in range(len(e) - 2, -1, -1):
        beta = (beta * e[t + 1]) @ a.T
        beta /= beta.sum(1, keepdims=True)
        alpha[t] *= beta
    return alpha / alpha.sum(2, keepdims=True)


def train_crf(sample: list[tuple[str, str]], buckets: int = 1 << 15, steps: int = 64, epochs: int = 3, spans: int = 400, seed: int = 7) -> Crf | None:
    """sample: (lang, text). Trains on sequences of `steps` words put together from spans of 4 to 32 words."""
    langs = sorted({lang for lang, _ in sample})
    by_lang: dict[str, list[list[str]]] = {x: [] for x in langs}
    for lang, text in sample:
        words = [w for w in map(normal, text.split()) if any(c.isalpha() for c in w)]
        if words:
            by_lang[lang].append(words)
    langs = [x for x in langs if by_lang[x]]
    if not langs:
        return None
    rng, n = np.random.default_rng(seed), len(langs)
    words: dict[str, int] = {}
    sequences, labels = [], []
    for _ in range(spans * n):
        seq, lab = [], []
        while len(seq) < steps:
            k = int(rng.integers(n))
            source = by_lang[langs[k]][int(rng.integers(len(by_lang[langs[k]])))]
            at, size = int(rng.integers(len(source))), int(rng.integers(4, 33))
            span = source[at : at + size]
            seq += [words.setdefault(w, len(words)) for w in span]
            lab += [k] * len(span)
        sequences.append(seq[:steps])
        labels.append(lab[:steps])
    x, y = np.array(sequences), np.array(labels)
    vocabulary = list(words)
    owners, ids = gram_ids(vocabulary, buckets)
    order = np.argsort(owners, kind="stable")
    owners, ids = owners[order], ids[order]
    # naive Bayes log odds as a start
    counts = np.zeros((buckets, n))
    word_label = np.zeros((len(vocabulary), n))
    np.add.at(word_label, (x.ravel(), y.ravel()), 1)
    for k in range(n):
        counts[:, k] = np.bincount(ids, word_label[owners, k], buckets)
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * buckets))
    seen = counts.sum(1) > 0
    params = {
        "weights": np.where(seen[:, None], 0.25 * (logs - logs.mean(1, keepdims=True)), 0.0),
        "moves": np.where(np.eye(n) > 0, 2.0, 0.0).astype(float),
        "first": np.zeros(n),
    }
    adam, mask = Adam(params, 0.02), np.ones((64, steps))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb = x[batch], y[batch]
            used = np.unique(xb)
            table = np.zeros((len(vocabulary), n))
            take = np.isin(owners, used)
            for k in range(n):
                table[:, k] = np.bincount(owners[take], params["weights"][ids[take], k], len(vocabulary))
            post, expected = forward_backward(table[xb], mask[:1].repeat(len(batch), 0), params["moves"], params["first"])
            wrong = post.copy()
            np.put_along_axis(wrong, yb[:, :, None], np.take_along_axis(wrong, yb[:, :, None], 2) - 1, 2)
            by_word = np.zeros((len(vocabulary), n))
            np.add.at(by_word, xb.ravel(), wrong.reshape(-1, n))
            grad = np.zeros((buckets, n))
            for k in range(n):
                grad[:, k] = np.bincount(ids[take], by_word[owners[take], k], buckets)
            observed = np.zeros((n, n))
            np.add.at(observed, (yb[:, :-1].ravel(), yb[:, 1:].ravel()), 1)
            adam.step({"weights": grad / len(batch), "moves": (expected - observed) / len(batch), "first": wrong[:, 0].mean(0)})
    return Crf(langs, params["weights"].astype(np.float32), params["moves"], params["first"])


def label_texts(texts: list[str | None], crf: Crf, table: WordTable, core: int = 96, margin: int = 16, block: int = 4096) -> np.ndarray:
    """Mass of each language in each text: sums of the posteriors of its words that have a letter."""
    n, mass = len(crf.langs), np.zeros((len(texts), len(crf.langs)))
    table.start()
    per_text = [table.index((t or "").split()) for t in texts]
    rows = table.table()
    flat = np.concatenate([np.zeros(0, np.int64), *per_text])
    sizes = np.array([len(p) for p in per_text], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    segments = -(-sizes // core)
    owner = np.repeat(np.arange(len(texts)), segments)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    left = number * core
    steps = np.arange(-margin, core + margin)
    for at in range(0, len(owner), block):
        o, at_word = owner[at : at + block], left[at : at + block]
        position = at_word + steps[:, None]
        inside = (position >= 0) & (position < sizes[o])
        emit = rows[np.where(inside, flat[np.clip(begins[o] + position, 0, max(len(flat) - 1, 0))], 0)]
        has_letter = emit[:, :, n] > 0
        emit = emit[:, :, :n] * (inside & has_letter)[:, :, None]
        post = posteriors(emit, crf.moves, crf.first)[margin : margin + core]
        counted = (inside & has_letter)[margin : margin + core]
        np.add.at(mass, o, (post * counted[:, :, None]).sum(0))
    return mass


def word_rows(crf: Crf):
    """Emissions of words, and 1 in a last column if they have a letter."""

    def compute(words: list[str]) -> np.ndarray:
        plain = [normal(w) for w in words]
        sums, _ = gram_sums(plain, crf.weights)
        letters = np.fromiter((any(c.isalpha() for c in w) for w in words), np.float32, len(words))
        return np.concatenate([sums, letters[:, None]], 1)

    return compute


def fit_language_crf(docs: DataFrame, train: str, per_label: int = 300, **options) -> Crf | None:
    """train: SQL condition on rows of docs (doc_id, text, lang) that may be learned from."""
    rows = docs.where(train)
    sample = labelled_sample(rows, rows.select("doc_id", F.col("lang").alias("label")), per_label)
    return train_crf(sample, **options)


def label_languages(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score, mass (by language) for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, mass map<string,double>"
    if crf is None:
        return rows.selectExpr("doc_id", f"'{UNKNOWN}' AS lang_pred", "0.0D AS score", "CAST(map() AS map<string,double>) AS mass")
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        table = WordTable(word_rows(model))
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                mass = label_texts(part["text"].tolist(), model, table)
                total = mass.sum(1)
                best = mass.argmax(1)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "lang_pred": [model.langs[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)],
                        "score": [float(min(1.0, m[b] / t)) if t > 0 else 0.0 for m, b, t in zip(mass, best, total, strict=True)],
                        "mass": [dict(zip(model.langs, map(float, m), strict=True)) for m in mass],
                    }
                )

    return rows.mapInPandas(task, schema)
