"""The Merkle manifest against a plain version that builds and climbs one tree at a time."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle
from quire.llm.merkle import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, digest string, proof string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*shown)


def plain_tree(nodes):
    """Levels of digests, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_climb(levels, at, digest, proof):
    for level in levels[:-1]:
        run, slot = level[at - at % 8 : at - at % 8 + 8], at % 8
        proof += run[:slot] + run[slot + 1 :]
        digest = sha(*run[:slot], digest, *run[slot + 1 :])
        at //= 8
    return digest, proof


def plain(rows):
    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        found = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            found = plain_leaf(doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        by_lang[lang].append((doc_id is not None, doc_id or 0, leaf, found))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([r[2] for r in sorted(by_lang[x])]) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (known, doc_id, leaf, found) in enumerate(sorted(by_lang[x])):
            digest, proof = plain_climb(trees[x], at, found, [])
            digest, proof = plain_climb(top, k, digest, proof)
            out.append((doc_id if known else None, leaf, trees[x][-1][0], top[-1][0], sha(*proof), digest, digest == top[-1][0]))
    return out


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, f"Text {rng.randrange(9)} of É row {i % 50}" if i % 11 else None, rng.choice(langs), rng.choice(["web", None, "Buch"]), rng.choice([None, i])) for i in range(n)]


CASES = {
    "many": rows(700, ["en", "de", None, "", "ü", "zz"]),
    "one group": rows(64, ["en"]),
    "nine": rows(9, ["en"]),
    "one row": rows(1, ["en"]),
    "one row each": [(k, "A", f"l{k}", None, None) for k in range(20)],
    "one group of one": [(0, "X", None, "s", 1), *rows(70, ["fr"])],
    "repeated": [(3, "Same Text", "en", "s", 9)] * 30 + [(3, "same text", "en", "s", 9)] * 5 + [(None, "No Id", "en", None, None)] * 4 + [(None, None, None, None, None)] * 3,
}


@pytest.mark.parametrize("case", CASES)
def test_manifest(spark, case):
    docs = spark.createDataFrame([(*r, "t", 1, "d", "p") for r in CASES[case]], SCHEMA).repartition(3)
    found = merkle_manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == Counter(plain(CASES[case]))


def test_empty_and_untouched(spark):
    docs = spark.createDataFrame([(*r, "t", 1, "d", "p") for r in CASES["nine"]], SCHEMA)
    assert merkle_manifest(docs.limit(0)).count() == 0
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    found = merkle_manifest(docs, changed=F.lit("0" * 64)).collect()
    assert not any(r["verified"] for r in found) and len(found) == 9
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    assert all(len(r["proof"]) == 64 * (7 if r["doc_id"] < 8 else 0) + 64 for r in found)


def test_copies_of_runs(spark, monkeypatch):
    """Runs that many rows come by are stored in copies; which one a row meets changes nothing."""
    monkeypatch.setattr(merkle, "ASKED", 2)
    docs = spark.createDataFrame([(*r, "t", 1, "d", "p") for r in CASES["many"]], SCHEMA).repartition(3)
    found = merkle_manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == Counter(plain(CASES["many"]))
