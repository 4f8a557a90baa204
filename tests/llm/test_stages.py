"""Each stage of the pipeline on odd tables: nulls in any column, empty and long texts, repeated rows, clashing columns."""

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _maybe int, _gone string, _w string, blob string, key long, kept boolean, spans string, first long"
LONG = " ".join(f"word{i} thing{i % 977}" for i in range(30_000))
GOOD = " ".join(f"good{i} text{i * 7 % 61}" for i in range(60))
OTHER = " ".join(f"other{i} page{i * 5 % 53}" for i in range(60))


def rows():
    texts = [(1, GOOD), (1, GOOD), (2, OTHER), (3, None), (4, ""), (None, GOOD), (None, None), (5, LONG), (6, GOOD + " tail"), (7, OTHER.replace("other3 ", "password = abcdefgh1 ")), (8, " \n\t"), (2, OTHER)]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "s", len(t) if t else None, k, "g", "w", None, k, None, "s", None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    leak = " ".join(OTHER.split()[20:50])
    spark.createDataFrame([(0, leak), (None, leak), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    docs = spark.createDataFrame(rows(), COLUMNS)
    out = stage(spark, docs, folder)
    found = out.collect()
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0
    if name == "packing":
        assert sum(r["start"] == 0 for r in found) == len(rows())
        return
    assert out.columns == docs.columns and empty.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in found)
    every = sorted((i is None, i or 0, t is None) for i, t, *_ in rows())
    if name == "quality_rules":
        assert ids == sorted([(False, 1, False)] * 2 + [(False, 2, False)] * 2 + [(True, 0, False), (False, 5, False), (False, 6, False), (False, 7, False)])
    elif name == "near_duplicates":
        assert ids == [x for x in every if x[1] not in (6, 7)]
    elif name == "decontamination":
        assert ids == [x for x in every if x[1] not in (2, 7)]
    else:
        assert ids == every and sorted(r["_maybe"] for r in found) == list(range(len(rows())))
        masked = {r["doc_id"]: r for r in found}[7]
        assert "[secret]" in masked["text"] and "abcdefgh1" not in masked["text"] and masked["n_chars"] == len(masked["text"])
        assert sorted(r["text"] or "" for r in found if r["doc_id"] != 7) == sorted(t or "" for i, t, *_ in rows() if i != 7)
