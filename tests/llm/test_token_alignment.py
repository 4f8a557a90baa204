"""Cross-tokenizer alignment against a plain version with sets of offsets."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from quire.llm import queries, token_alignment
from quire.llm.token_alignment import align_tokenizers, gallop, token_groups

SCHEMA = "doc_id long, text string, pairs string, n_a string, a int"
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "Straße größer naïve café — „Zitat“", None, "", " ", "\n\n\t x  y   z ", "one<|endoftext|>two", "<s>a</s> <unk> <0x41>",
    "a▁b", "日本語のテキスト and 中文", "\u0000nul\x07bell", "🙂🙃 emoji 👩‍👩‍👧", "ﬁne ﬂow K Å", "a" * 5000, " " * 3000, "x", "The quick brown fox jumps over the lazy dog.",
    " ".join(f"word{i} thing{i % 97}" for i in range(4000)), "﻿bom", "é combining", "1234567890 3.14159 0x7f", "don't can't we'll", "\r\nline\r\nline",
]


def byte_level():
    """The byte that each character of a byte-level entry stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table = byte_level()

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = b"".join(x for _, x in left) == whole and b"".join(x for _, x in right) == whole
        return (left, right) if same else ([], [])

    def groups(text):
        left, right = tokens(text)
        ends = []
        for side in (left, right):
            at, found = 0, []
            for i, x in side:
                at += len(x)
                found.append((at, i))
            ends.append(found)
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        begin, out = 0, []
        for stop in common:
            group = []
            for side in ends:
                n = next(k for k, (e, _) in enumerate(side) if e == stop) + 1
                group.append([i for _, i in side[:n]])
                del side[:n]
            out.append((begin, stop, *group))
            begin = stop
        return len(left), len(right), out

    return groups


def expected(texts, plain):
    found = [plain(t) for t in texts]
    counts = Counter((a[-1], b[-1]) for _, _, gs in found for _, _, a, b in gs)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for n_a, n_b, gs in found:
        links = [(a[-1], b[-1]) for _, _, a, b in gs]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in gs)
        digest = hashlib.sha256(shown.encode()).hexdigest() if n_a else ""
        rows.append((n_a, n_b, len(gs), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


def test_gallop():
    rng = np.random.default_rng(4)
    for n, m in [(0, 0), (0, 5), (1, 1), (3, 1000), (1000, 3), (500, 500), (2000, 70), (129, 64)]:
        a, b = (np.sort(rng.choice(3000, size=k, replace=False)) for k in (n, m))
        left, right = gallop(a, b)
        wanted = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[left].tolist() == wanted and b[right].tolist() == wanted
    far, near = np.array([5, 10**9]), np.arange(100)
    assert [x.tolist() for x in gallop(far, near)] == [[0], [5]]


def test_alignment_brute(spark, plain, monkeypatch):
    docs = spark.createDataFrame([(k if k != 5 else None, t, "p", "n", 1) for k, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    wanted = dict(zip([k if k != 5 else None for k in range(len(TEXTS))], expected(TEXTS, plain)))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = align_tokenizers(docs).collect()
    assert len(found) == len(TEXTS)
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in found} == wanted
    assert align_tokenizers(docs.limit(0)).count() == 0
    twice = align_tokenizers(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(TEXTS) and all(r["count_sum"] == 2 * wanted[r["doc_id"]][5] for r in twice)


def test_groups(spark, plain):
    docs = spark.createDataFrame([(k, t, "p", "n", 1) for k, t in enumerate(TEXTS[:12])], SCHEMA)
    found = {}
    for r in token_groups(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["stop"], list(r["a_ids"]), list(r["b_ids"])))
    assert {k: sorted(v) for k, v in found.items()} == {k: plain(t)[2] for k, t in enumerate(TEXTS[:12]) if plain(t)[2]}


def test_query(spark, plain):
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    wanted = dict(zip((d for d, _ in texts), expected([t for _, t in texts], plain)))
    found = queries.QUERIES["op13_token_alignment"](spark, folder).collect()
    assert len(found) == len(texts)
    assert {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found} == wanted


def test_long_batches(spark, plain, monkeypatch):
    """Batches that are cut by characters give what single texts give."""
    import pyarrow as pa

    monkeypatch.setattr(token_alignment, "BATCH_CHARS", 50)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(TEXTS))), "text": TEXTS})
    cut = list(token_alignment._texts(batch))
    assert [t for _, ts in cut for t in ts] == [t or "" for t in TEXTS] and all(len(ts) == 1 or sum(map(len, ts)) <= 50 for _, ts in cut)
