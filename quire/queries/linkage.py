"""Queries of group D: duplicates and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import linkage as L
from quire.queries.registry import registry
from quire.views import with_views

QUERIES, ORACLES, query = registry()

_EXACT = "e AS (SELECT m AS paper_id, paper_id AS candidate_id, 'exact_hash' AS reason, 1.0::DOUBLE AS score FROM (SELECT paper_id, min(paper_id) OVER (PARTITION BY file_hash) AS m FROM papers) WHERE paper_id > m)\n"


@query("d1_exact_duplicates", with_views("papers", _EXACT + "SELECT * FROM e"))
def _(lib):
    return L.exact_duplicates(lib.papers, "paper_id", "file_hash")


def _with_ids(lib):
    return lib.papers.select(
        "paper_id", F.expr("CASE WHEN paper_id % 3 = 0 THEN concat('10.1/', paper_id div 6) END").alias("doi"),
        F.expr("CASE WHEN paper_id % 2 = 0 THEN concat('2401.', paper_id div 12) END").alias("arxiv_id"),
    )


@query(
    "d2_identifier_duplicates",
    """WITH p AS (SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id // 6) END AS doi, CASE WHEN doc_id % 2 = 0 THEN '2401.' || (doc_id // 12) END AS arxiv_id FROM documents),
a AS (SELECT min(paper_id) OVER (PARTITION BY doi) AS m, paper_id AS c, 'doi' AS reason FROM p WHERE doi IS NOT NULL
  UNION ALL SELECT min(paper_id) OVER (PARTITION BY arxiv_id), paper_id, 'arxiv_id' FROM p WHERE arxiv_id IS NOT NULL)
SELECT m AS paper_id, c AS candidate_id, max(reason) AS reason, 1.0::DOUBLE AS score FROM a WHERE c > m GROUP BY m, c""",
)
def _(lib):
    return L.identifier_duplicates(_with_ids(lib))


@query("d3_fuzzy_titles")
def _(lib):
    return L.fuzzy_title_pairs(lib.papers)


@query("d4_token_set_ratio")
def _(lib):
    t = lib.papers.select("paper_id", "title_norm", F.concat("title_norm", F.lit(" "), "venue").alias("other"))
    return t.select("paper_id", F.round(L.token_set_ratio(F.col("title_norm"), F.col("other")), 6).alias("score"))


def _decided(lib):
    pairs = L.exact_duplicates(lib.papers, "paper_id", "file_hash")
    return pairs, pairs.select("paper_id", "candidate_id", F.expr("element_at(array('keep_left', 'dismiss'), CAST(candidate_id % 2 + 1 AS int))").alias("action"))


@query(
    "d6_merge_duplicates",
    with_views(
        "papers",
        _EXACT.rstrip() + """,
g AS (SELECT paper_id AS k, arg_min(year, l) AS y FROM (SELECT e.paper_id, e.candidate_id AS l, p.year FROM e JOIN papers p ON e.candidate_id = p.paper_id WHERE e.candidate_id % 2 = 0 AND p.year IS NOT NULL) GROUP BY 1)
SELECT p.paper_id, coalesce(year, g.y) AS year, deleted OR p.paper_id IN (SELECT candidate_id FROM e WHERE candidate_id % 2 = 0) AS deleted FROM papers p LEFT JOIN g ON p.paper_id = g.k""",
    ),
)
def _(lib):
    pairs, decisions = _decided(lib)
    return L.merge_duplicates(lib.papers, lib.notes, pairs, decisions, ["year"])[0].select("paper_id", "year", "deleted")


@query(
    "d6_moved_notes",
    with_views("papers notes", _EXACT.rstrip() + """
SELECT note_id, coalesce(t.k, n.paper_id) AS paper_id FROM notes n LEFT JOIN (SELECT candidate_id, min(paper_id) AS k FROM e WHERE candidate_id % 2 = 0 GROUP BY 1) t ON n.paper_id = t.candidate_id"""),
)
def _(lib):
    pairs, decisions = _decided(lib)
    return L.merge_duplicates(lib.papers, lib.notes, pairs, decisions, ["year"])[1].select("note_id", "paper_id")


@query("d7_list_duplicates", with_views("papers", _EXACT.rstrip() + "\nSELECT e.paper_id, e.candidate_id, a.title, b.title AS candidate_title FROM e JOIN papers a ON e.paper_id = a.paper_id JOIN papers b ON e.candidate_id = b.paper_id"))
def _(lib):
    return L.list_duplicates(L.exact_duplicates(lib.papers, "paper_id", "file_hash"), lib.papers).select("paper_id", "candidate_id", "title", "candidate_title")


@query("d8_best_match")
def _(lib):
    inputs = lib.table("benchmark").select(F.col("item_id").alias("input_id"), T.normalize_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    return L.best_match(inputs, lib.papers.select(F.col("paper_id").alias("candidate_id"), F.col("title_norm").alias("title")))


@query("d9_score_repo_candidates")
def _(lib):
    found = lib.papers.select(
        "paper_id", "title", F.expr("CASE WHEN paper_id % 4 = 0 THEN concat('2401.', paper_id) END").alias("arxiv_id"), F.concat(F.lit("https://github.com/x/"), "paper_id").alias("url"),
        F.substring("title_norm", 1, 30).alias("name"), F.concat_ws(" ", F.lit("code for 2401."), "paper_id").alias("description"), (F.col("paper_id") % 1500).alias("stars"), (F.col("paper_id") % 10 == 0).alias("linked"),
    )
    return L.score_repo_candidates(found.drop("title", "arxiv_id"), found.select("paper_id", "title", "arxiv_id"))


@query("d10_merge_search_results")
def _(lib):
    base = lib.papers.select(F.expr("paper_id div 40").alias("query_id"), "paper_id", "title")
    results = base.withColumn("source", F.explode(F.array(F.lit("web"), F.lit("papers")))).select(
        "query_id", "source", (F.col("paper_id") % 10).cast("int").alias("rank"), "title", F.concat(F.lit("https://example.org/"), "paper_id").alias("url"),
        F.expr("CASE WHEN paper_id % 2 = 0 THEN concat('10.1/', paper_id) END").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
    )
    return L.merge_search_results(results).select("query_id", "title", "url", F.size("votes").alias("n_votes"))
