"""The registered classifier queries against plain versions of their models, word by word."""

import math
import zlib

import numpy as np
import pytest

from quire.llm import language_crf, quality_mil, queries, toxicity_gru
from quire.llm.training import labelled_sample
from quire.llm.wordgrams import WordTable, gram_ids, normal

RNG = np.random.default_rng(21)
VOCABULARY = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(2, 7))) for _ in range(300)]
ENDS = {"aa": "um", "bb": "ski", "cc": "ez"}


def corpus():
    rng, rows, labels = np.random.default_rng(22), [], []
    for i in range(260):
        lang = list(ENDS)[i % 3]
        w = [VOCABULARY[k] + ENDS[lang] for k in rng.integers(len(VOCABULARY), size=int(rng.integers(8, 150)))]
        toxic, good = int(rng.random() < 0.35), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), "grumf" if rng.random() < 0.5 else "zlork!")
        rows.append((i, " ".join(w if good else [x + "***" for x in w]), lang))
        labels.append((i, good, toxic))
    rows += [(900, None, "aa"), (901, "", None), (902, "!!! ...", "bb"), (903, " ".join(VOCABULARY * 4), None), (900, "again um", "aa"), (None, "no id", "cc")]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    rows, labels = corpus()
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def held(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def plain_gru(text, model):
    """Score of a text by loops over windows, steps and states."""
    p, words = model.params, (text or "").split()
    vectors = toxicity_gru.word_inputs(words, p) @ p["w"] + p["b"] if words else np.zeros((0, len(p["b"])))
    h = p["u1"].shape[0]
    one = lambda x: 1 / (1 + math.exp(-x))

    def walk(gates, u):
        state, out = np.zeros(h), []
        for g in gates:
            hu = state @ u
            r, z = np.array([one(x) for x in g[:h] + hu[:h]]), np.array([one(x) for x in g[h : 2 * h] + hu[h : 2 * h]])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * hu[2 * h :])
            out.append(state)
        return out

    logits, start = [], 0
    while True:
        window = vectors[start : start + model.length]
        ahead, back = walk(window[:, : 3 * h], p["u1"]), walk(window[::-1, 3 * h :], p["u2"])[::-1]
        states = [np.concatenate(x) for x in zip(ahead, back, strict=True)] or [np.zeros(2 * h)]
        e = np.exp([np.tanh(s @ p["att"]) @ p["v"] for s in states])
        logits.append(float(sum(a * s for a, s in zip(e / e.sum(), states, strict=True)) @ p["c"] + p["d"][0]))
        if start + model.length >= len(words):
            break
        start += model.stride
    e = np.exp(toxicity_gru.SHARP * np.array(logits))
    return one(float((e / e.sum()) @ np.array(logits)))


def test_toxicity_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    model = toxicity_gru.fit_toxicity(docs, labels.where("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 <> 0"))
    rows, truth = corpus()
    found = queries.QUERIES["op5_toxicity_gru"](spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["held_out"]) for r in found) == sorted((i is None, i, held(i, 5, 0)) for i, _, _ in rows)
    by_id = {r["doc_id"]: r["score"] for r in found if r["doc_id"] not in (900, None)}
    assert all(abs(by_id[i] - plain_gru(t, model)) < 1e-3 for i, t, _ in rows if i in by_id)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    unseen = [(by_id[i] >= 0.5) == bool(y) for i, _, y in truth if held(i, 5, 0)]
    assert len(unseen) > 30 and np.mean(unseen) >= 0.85


def plain_mil(text, model):
    """Score of a text by loops over passages and words."""
    p, words, size = model.params, (text or "").split(), model.size
    sets = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = [sets.count(s) > 1 for s in sets] + [False] * 2
    h = []
    passages = max(1, -(-len(words) // size))
    for k in range(passages):
        part = words[k * size : (k + 1) * size]
        n = max(1, len(part))
        shapes = quality_mil.word_shapes(part, len(p["embed"]))
        own = [int(b) for b in shapes[:, -1]]
        fixed = [*(shapes[:, : quality_mil.SHAPES].sum(0) / n), sum(repeated[k * size : k * size + len(part)]) / n, len(set(own)) / n, min(len(part), size) / size, math.log1p(passages) / 5]
        x = np.concatenate([(np.array(fixed) - model.mean) / model.std, sum((p["embed"][b] for b in own), np.zeros(p["embed"].shape[1])) / n])
        h.append(np.tanh(x @ p["w"] + p["b"]))
    s = np.array([(np.tanh(x @ p["v"]) / (1 + np.exp(-x @ p["u"]))) @ p["a"] for x in h])
    e = np.exp(s - s.max())
    return 1 / (1 + math.exp(-float(sum(a * x for a, x in zip(e / e.sum(), h, strict=True)) @ p["c"] + p["d"][0])))


def test_quality_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality AS label")
    model = quality_mil.fit_quality_mil(docs, labels.where("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 <> 0"))
    rows, truth = corpus()
    found = queries.QUERIES["op9_quality_mil"](spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["held_out"]) for r in found) == sorted((i is None, i, held(i, 5, 0)) for i, _, _ in rows)
    by_id = {r["doc_id"]: r["score"] for r in found if r["doc_id"] not in (900, None)}
    assert all(abs(by_id[i] - plain_mil(t, model)) < 1e-6 for i, t, _ in rows if i in by_id)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert np.mean([(by_id[i] >= 0.3) == bool(y) for i, y, _ in truth if held(i, 5, 0)]) >= 0.9


def plain_mass(text, crf):
    """Posterior mass of each language by a plain forward-backward over the whole text."""
    words = (text or "").split()
    if not words:
        return np.zeros(len(crf.langs))
    emit = np.zeros((len(words), len(crf.langs)))
    letters = [any(c.isalpha() for c in w) for w in words]
    for i, w in enumerate(words):
        if letters[i]:
            emit[i] = crf.weights[gram_ids([normal(w)], len(crf.weights))[1]].sum(0)
    e, a = np.exp(emit - emit.max(1, keepdims=True)), np.exp(crf.moves)
    f, b = [np.exp(crf.first) * e[0]], [np.ones(len(crf.langs))]
    for x in e[1:]:
        f.append((f[-1] / f[-1].sum()) @ a * x)
    for x in e[:0:-1]:
        y = a @ (x * b[-1])
        b.append(y / y.sum())
    post = np.array(f) * np.array(b[::-1])
    return ((post / post.sum(1, keepdims=True)) * np.array(letters)[:, None]).sum(0)


def test_language_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    crf = language_crf.fit_language_crf(docs, "crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 <> 1 AND text IS NOT NULL AND lang IS NOT NULL")
    rows, _ = corpus()
    found = queries.QUERIES["op10_language_crf"](spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["held_out"]) for r in found) == sorted((i is None, i, held(i, 3, 1)) for i, _, _ in rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] not in (900, None)}
    for i, t, _ in rows:
        if i in by_id:
            mass = plain_mass(t, crf)
            r = by_id[i]
            assert r["lang_pred"] == (crf.langs[mass.argmax()] if mass.sum() > 0 else "und")
            assert abs(r["score"] - (mass.max() / mass.sum() if mass.sum() > 0 else 0)) < 0.02, "segments agree with the whole text"
    assert {r["lang_pred"] for r in found if r["doc_id"] == 900} == {"und", "aa"}
    assert np.mean([by_id[i]["lang_pred"] == lang for i, _, lang in rows[:260] if held(i, 3, 1)]) >= 0.95


def test_segments_of_mixed_text():
    rng = np.random.default_rng(5)
    word = lambda lang: VOCABULARY[int(rng.integers(len(VOCABULARY)))] + ENDS[lang]
    sample = [(lang, " ".join(word(lang) for _ in range(40))) for lang in ENDS for _ in range(30)]
    crf = language_crf.train_crf(sample, spans=60)
    text = " ".join(word(list(ENDS)[(i // 37) % 3]) for i in range(1500))
    mass = language_crf.label_texts([text, ""], crf, WordTable(language_crf.word_rows(crf)))
    assert np.abs(mass[0] - plain_mass(text, crf)).max() < 0.5 and mass[1].sum() == 0


def test_sample_takes_all_labels(spark):
    rows = [(i, f"text {i}", f"l{i % 90:02d}") for i in range(360)] + [(1000, "y" * 30_000, "l00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    sample = labelled_sample(docs, docs.select("doc_id", "label"), per_label=50)
    assert {label for label, _ in sample} == {f"l{k:02d}" for k in range(90)} and max(len(t) for _, t in sample) < 20_000


def test_sample_of_a_repeated_id(spark):
    """An id that stands on thousands of texts teaches by one of them; the sample keeps its bound."""
    rows = [(7, f"text number {k}", "a") for k in range(3000)] + [(k, f"other {k}", "b") for k in range(100, 160)] + [(None, "no id", "a"), (8, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    sample = labelled_sample(docs, docs.select("doc_id", "label"), per_label=100)
    assert len(sample) == 61 and sum(label == "a" for label, _ in sample) == 1
    assert sample == labelled_sample(docs.repartition(2), docs.select("doc_id", "label"), per_label=100)
