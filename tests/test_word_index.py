"""The word index as a log of segments: pruned reads, deltas, tombstones, compactions that die and run again."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import index as I
from quire.operators import retrieval as R
from quire.operators import word_index as W

def words():
    return I.word_tokens(F.col("text"))


VOCABULARY = [f"w{k}" for k in range(60)]


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(2)


def changes(seed, n=25):
    rng = random.Random(seed)
    return {rng.randrange(80): None if rng.random() < 0.25 else " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 12))) for _ in range(n)}


def asked(spark):
    rows = [(k, " ".join(random.Random(k).sample(VOCABULARY, 2)) + f" w{k} w{k + 1}") for k in range(12)] + [(90, "absent"), (91, "")]
    return spark.createDataFrame(rows, "query_id long, query string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def result(spark, index):
    return rows(R.fts_channel(asked(spark), index, index.lengths(), 10).select("query_id", "chunk_id", F.round("score", 8)))


def rebuilt(spark, texts, path):
    return W.create_index(table(spark, {k: t for k, t in texts.items() if t is not None}), words(), path, buckets=8)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """A base and five change sets, and what the texts are in the end."""
    root, texts = str(tmp_path_factory.mktemp("log")), {k: " ".join(random.Random(k).choices(VOCABULARY, k=9)) for k in range(70)}
    index = W.create_index(table(spark, texts), words(), f"{root}/i", buckets=8)
    for n in range(1, 6):
        index = W.apply_changes(table(spark, changes(n)), words(), f"{root}/i", n, buckets=8)
        texts |= changes(n)
    return index, texts, root


def test_base_and_deltas(spark, log):
    index, texts, root = log
    assert len(index.segments) == 6
    whole = rebuilt(spark, texts, f"{root}/whole")
    assert rows(index.postings()) == rows(whole.postings()) and rows(index.lengths()) == rows(whole.lengths())
    assert result(spark, index) == result(spark, whole) != []
    some = spark.createDataFrame([(k,) for k in range(0, 80, 2)], "chunk_id long")
    assert {c for _, c, _ in result(spark, index.within(some))} <= set(range(0, 80, 2))


def test_one_term_reads_one_bucket(spark, log):
    index, _, root = log
    term = spark.createDataFrame([("w7",)], "term string")
    found = index.postings(term)
    plan = found._jdf.queryExecution().toString()
    filters = [line for line in plan.split("PartitionFilters: [")[1:] if "bucket" in line.split("]")[0]]
    assert len(filters) == 6
    bucket = spark.range(1).select(W.bucket_of(8, F.lit("w7"))).first()[0]
    # of one segment, whose plan has no exchange, the scan's own count of files
    scan = W.WordIndex(spark, index.root, index.segments[:1])._newest("postings", f"{W.POSTINGS}, bucket int", F.col("bucket") == bucket)
    scan.collect()
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().head()
    files = leaf.metrics().apply("numFiles").value()
    folder = f"{root}/i/postings/{index.segments[0].name}"
    assert files == len(glob.glob(f"{folder}/bucket={bucket}/*.parquet")) and 0 < 2 * files < len(glob.glob(f"{folder}/*/*.parquet"))
    assert {r["term"] for r in found.collect()} == {"w7"}
    assert index.postings(term.limit(0)).count() == 0


def test_compaction_dies_and_runs_again(spark, log, monkeypatch):
    index, texts, root = log
    want, before = rows(index.postings()), result(spark, index)
    real, calls = spark.createDataFrame, []

    def dies(*args, **kwargs):
        calls.append(1)
        raise KeyboardInterrupt

    # the meta row is made last: all else is written when it dies
    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(KeyboardInterrupt):
        W.compact(index, index.segments[1:4])
    monkeypatch.undo()
    assert calls and spark.createDataFrame == real
    assert os.path.isdir(f"{root}/i/postings/{W.Segment(1, 3, 8).name}")
    again = W.open_index(spark, f"{root}/i")
    assert again.segments == index.segments and rows(again.postings()) == want
    part = W.compact(again, again.segments[1:4])
    assert [(s.low, s.high) for s in part.segments] == [(0, 0), (1, 3), (4, 4), (5, 5)]
    assert rows(part.postings()) == want and result(spark, part) == before
    # a change set that the compaction holds is not written again, one that it doesn't replaces itself
    assert W.apply_changes(table(spark, {0: "late"}), words(), f"{root}/i", 2, buckets=8).segments == part.segments
    assert rows(W.apply_changes(table(spark, changes(5)), words(), f"{root}/i", 5, buckets=8).postings()) == want
    full = W.compact(part)
    W.clear_dead(full, [*index.segments, *part.segments[1:2]])
    last = W.open_index(spark, f"{root}/i")
    assert [(s.low, s.high) for s in last.segments] == [(0, 5)] and rows(last.postings()) == want and result(spark, last) == before


def test_no_index_yet(spark, tmp_path):
    index = W.open_index(spark, f"{tmp_path}/none")
    assert index.segments == () and index.postings().count() == 0 and index.lengths().count() == 0
    empty = W.create_index(table(spark, {1: "x"}).limit(0), words(), f"{tmp_path}/empty", buckets=4)
    assert empty.postings().count() == 0 and result(spark, empty) == []


def test_compaction_goes_by_rounds_and_moves_no_postings(spark, tmp_path, monkeypatch):
    """Rounds of few touched chunks give the same rows; no write of an index of few buckets shuffles postings (F2)."""
    root = f"{tmp_path}/rounds"
    W.create_index(table(spark, {k: f"alpha w{k} w{k % 3} w{k}" for k in range(40)}), words(), root, buckets=8)
    W.apply_changes(table(spark, {k: f"beta w{k}" for k in range(0, 44, 4)}), words(), root, 1, buckets=8)
    index = W.apply_changes(table(spark, {k: None for k in range(0, 40, 6)}), words(), root, 2, buckets=8)
    want, before, lengths = rows(index.postings()), result(spark, index), sorted(tuple(r) for r in index.lengths().collect())
    assert len(rows(index.postings())) > 0 and len(W._ranges(index._read("touched", index.segments[0], "chunk_id long"))) == 1
    monkeypatch.setattr(W, "ROUND", 10)
    assert len(W._ranges(index._read("touched", index.segments[0], "chunk_id long"))) > 3
    plans, write = [], W._write_postings
    monkeypatch.setattr(W, "_write_postings", lambda df, *a: (plans.append(df), write(df, *a)))
    new = W.compact(index)
    assert len(plans) > 1 and len(new.segments) == 1
    assert rows(new.postings()) == want and result(spark, new) == before and sorted(tuple(r) for r in new.lengths().collect()) == lengths
    for df in plans:
        moved = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "positions" in x]
        assert not moved
    # a round that is run again by a smaller size leaves no rows of another run behind
    monkeypatch.setattr(W, "ROUND", 1000)
    again = W.compact(W.WordIndex(spark, index.root, index.segments))
    assert rows(again.postings()) == want
