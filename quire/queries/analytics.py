"""Queries of groups J, M and Q: panels, ledgers, evaluation, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import analytics as A
from quire.operators import index as I
from quire.operators.linkage import exact_duplicates
from quire.queries.registry import registry
from quire.views import with_views

QUERIES, ORACLES, query = registry()


@query("j1_overview", with_views("live chunks notes", """SELECT (SELECT count(*) FROM live) AS n_papers, (SELECT sum(page_count)::BIGINT FROM live) AS n_pages, (SELECT count(*) FROM live WHERE year IS NULL) AS no_year,
(SELECT count(*) FROM chunks WHERE paper_id IN (SELECT paper_id FROM live)) AS n_chunks, (SELECT sum(n_tokens)::BIGINT FROM chunks WHERE paper_id IN (SELECT paper_id FROM live)) AS n_tokens, (SELECT count(*) FROM notes) AS n_notes"""))
def _(lib):
    return A.overview(lib.papers, lib.chunks, lib.notes)


@query("j2_by_year", with_views("live", "SELECT year, count(*) AS n FROM live WHERE year IS NOT NULL GROUP BY 1"))
def _(lib):
    return A.counts_by(lib.live, "year")


@query("j2_by_venue", with_views("live", "SELECT venue, count(*) AS n FROM live GROUP BY 1 ORDER BY n DESC, venue LIMIT 12"))
def _(lib):
    return A.counts_by(lib.live, "venue", 12)


@query("j3_zero_filled", with_views("live", "SELECT coalesce(k, reading_status) AS reading_status, coalesce(n, 0) AS n FROM (SELECT unnest(['unread', 'reading', 'read', 'reviewed', 'dropped']) AS k) FULL JOIN (SELECT reading_status, count(*) AS n FROM live GROUP BY 1) ON k = reading_status"))
def _(lib):
    return A.zero_filled_counts(lib.live, "reading_status", ["unread", "reading", "read", "reviewed", "dropped"])


@query("j5_code_coverage", with_views("live notes", "SELECT count(*) FILTER (paper_id IN (SELECT paper_id FROM notes WHERE paper_id IS NOT NULL)) AS with_repo, count(*) FILTER (paper_id NOT IN (SELECT paper_id FROM notes WHERE paper_id IS NOT NULL)) AS without_repo FROM live"))
def _(lib):
    return A.code_coverage(lib.papers, lib.notes.where("paper_id IS NOT NULL"))


@query("j6_panels", with_views("live chunks notes", """SELECT 'chunk_kinds' AS panel, kind AS key, count(*) AS value FROM chunks GROUP BY ALL UNION ALL SELECT 'note_kinds', kind, count(*) FROM notes GROUP BY ALL
UNION ALL SELECT 'ingest', ingest_status, count(*) FROM live GROUP BY ALL"""))
def _(lib):
    return A.panels({"chunk_kinds": A.counts_by(lib.chunks, "kind"), "note_kinds": A.counts_by(lib.notes, "kind"), "ingest": A.counts_by(lib.live, "ingest_status")})


@query("j7_paper_stats", with_views("papers", "SELECT venue, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS deleted, count(*) FILTER (NOT deleted AND ingest_status = 'failed') AS needs_attention FROM papers GROUP BY 1"))
def _(lib):
    live = ~F.col("deleted")
    return lib.papers.groupBy("venue").agg(F.count_if(live).alias("live"), F.count_if("deleted").alias("deleted"), F.count_if(live & (F.col("ingest_status") == "failed")).alias("needs_attention"))


@query("j8_missing_deep_read", with_views("live notes", "SELECT paper_id FROM live WHERE paper_id NOT IN (SELECT paper_id FROM notes WHERE kind = 'deep_read' AND paper_id IS NOT NULL)"))
def _(lib):
    return lib.live.join(lib.notes.where("kind = 'deep_read'").select("paper_id"), "paper_id", "left_anti").select("paper_id")


@query("j8_todo_counts", with_views("live notes papers", """SELECT (SELECT count(*) FROM live WHERE ingest_status = 'failed') AS failed, (SELECT count(*) FROM live WHERE ingest_status = 'pending') AS pending,
(SELECT count(*) FROM live WHERE paper_id NOT IN (SELECT paper_id FROM notes WHERE kind = 'deep_read' AND paper_id IS NOT NULL)) AS unread, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM papers GROUP BY file_hash)) AS duplicates"""))
def _(lib):
    return A.todo_counts(lib.papers, lib.notes, exact_duplicates(lib.papers, "paper_id", "file_hash"))


@query("j9_usage_summary", with_views("usage", """SELECT kind, count(*) FILTER (NOT blocked) AS calls, count(*) FILTER (blocked) AS blocked, sum(CASE WHEN blocked THEN 0 ELSE input_tokens END)::BIGINT AS input_tokens,
sum(CASE WHEN blocked THEN 0 ELSE output_tokens END)::BIGINT AS output_tokens, round((sum(CASE WHEN blocked THEN 0 ELSE input_tokens END) * 3.0 + sum(CASE WHEN blocked THEN 0 ELSE output_tokens END) * 15.0) / 1e6, 6) AS cost FROM usage GROUP BY ROLLUP (kind)"""))
def _(lib):
    return A.usage_summary(lib.usage, 3.0, 15.0)


@query("j10_top_consumers", with_views("usage", "SELECT ref, sum(input_tokens + output_tokens)::BIGINT AS tokens, count(*) AS calls FROM usage WHERE NOT blocked GROUP BY 1 ORDER BY tokens DESC, ref LIMIT 10"))
def _(lib):
    return A.top_consumers(lib.usage)


@query("j11_rolling_usage", with_views("usage", """u AS (SELECT event_id, sum(CASE WHEN blocked THEN 0 ELSE input_tokens + output_tokens END) OVER (PARTITION BY ref ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)::BIGINT AS used FROM usage)
SELECT event_id, used, greatest(0, 50000 - used) AS remaining, used > 50000 AS over FROM u"""))
def _(lib):
    return A.rolling_usage(lib.usage, 50_000)


_CACHE = "c AS (SELECT 'u' || user_id AS key, event_id, ts AS created_at, ts + INTERVAL 60 MINUTES * (event_id % 48) AS expires_at FROM events)\n"


def _cache(lib):
    return lib.table("events").select(
        F.concat(F.lit("u"), "user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("ts").cast("timestamp") + F.make_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("expires_at"),
    )


@query("j12_cache_stats", f"WITH {_CACHE}SELECT count(*) AS total, count(*) FILTER (expires_at > TIMESTAMP '2024-01-20') AS alive, count(*) FILTER (expires_at <= TIMESTAMP '2024-01-20') AS expired FROM c")
def _(lib):
    return A.cache_stats(_cache(lib), "2024-01-20 00:00:00")


@query("j12_latest_valid", f"WITH {_CACHE}SELECT key, arg_max(event_id, (created_at, event_id)) AS event_id FROM c WHERE expires_at > TIMESTAMP '2024-01-20' GROUP BY 1")
def _(lib):
    return A.latest_valid(_cache(lib), "2024-01-20 00:00:00")


@query("j13_language_shares", """WITH n AS (SELECT source AS repo, lang, sum(n_chars) AS size FROM documents GROUP BY ALL)
SELECT repo, lang, percent FROM (SELECT repo, lang, round(size * 100 / sum(size) OVER (PARTITION BY repo), 1) AS percent, row_number() OVER (PARTITION BY repo ORDER BY size DESC, lang) AS k FROM n) WHERE k <= 6""")
def _(lib):
    return A.language_shares(lib.table("documents").select(F.col("source").alias("repo"), "lang", F.col("n_chars").alias("size")))


@query("j14_job_rollup", with_views("job_events", """l AS (SELECT job, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (status = 'running') AS attempts, min(ts) AS a, max(ts) AS b FROM job_events GROUP BY 1)
SELECT job, status, attempts, round(epoch(b) - epoch(a), 3) AS seconds, status = 'running' AND epoch(TIMESTAMP '2024-01-30') - epoch(b) > 300 AS expired FROM l"""))
def _(lib):
    return A.job_rollup(lib.job_events, "2024-01-30 00:00:00")


_CASES = """cases AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'concept' ELSE 'named' END AS class, item_id % 20 AS expected FROM benchmark),
hits AS (SELECT vec_id % 30 AS query_id, vec_id // 30 + 1 AS rank, label + vec_id % 10 AS value FROM embeddings)
"""


def _cases(lib):
    return lib.table("benchmark").select(F.col("item_id").alias("query_id"), F.expr("CASE WHEN item_id % 3 = 0 THEN 'concept' ELSE 'named' END").alias("class"), (F.col("item_id") % 20).alias("expected"))


def _eval_hits(lib):
    return lib.vectors.select((F.col("chunk_id") % 30).alias("query_id"), F.expr("chunk_id div 30 + 1").alias("rank"), (F.col("label") + F.col("chunk_id") % 10).alias("value"))


@query("m1_eval_retrieval", f"WITH {_CASES}, r AS (SELECT c.query_id, class, min(rank) FILTER (value = expected) AS r, count(value) AS n FROM cases c LEFT JOIN hits h ON c.query_id = h.query_id GROUP BY ALL) SELECT class, count(*) AS n, count(*) FILTER (r = 1) AS top1, count(*) FILTER (r <= 3) AS top3, count(*) FILTER (n > 0) AS any_hit FROM r GROUP BY 1")
def _(lib):
    return A.eval_retrieval(_eval_hits(lib), _cases(lib))


@query("m2_eval_stability", f"WITH {_CASES}, a AS (SELECT query_id, value AS a FROM hits WHERE rank = 1), b AS (SELECT query_id, value + query_id % 2 AS b FROM hits WHERE rank = 1 AND query_id > 3) SELECT coalesce(a.query_id, b.query_id) AS query_id FROM a FULL JOIN b ON a.query_id = b.query_id WHERE a IS DISTINCT FROM b")
def _(lib):
    first = _eval_hits(lib)
    return A.eval_stability(first, first.where("query_id > 3").withColumn("value", F.col("value") + F.col("query_id") % 2))


@query("m3_filter_leaky_cases", with_views("papers queries", """t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z]{4,}')) AS w FROM papers)
SELECT query_id, query FROM queries WHERE NOT list_has_any(regexp_extract_all(lower(query), '[a-z]{4,}'), (SELECT list(w) FROM t))"""))
def _(lib):
    return A.filter_leaky_cases(lib.queries, lib.papers)


@query("q2_orphans", with_views("notes live", "SELECT note_id FROM notes WHERE paper_id IS NOT NULL AND paper_id NOT IN (SELECT paper_id FROM live)"))
def _(lib):
    return A.orphans(lib.notes, lib.live).select("note_id")


@query("q3_broken_unique", with_views("papers", "SELECT venue, title_norm, count(*) AS n FROM papers GROUP BY ALL HAVING count(*) > 1"))
def _(lib):
    return A.broken_unique(lib.papers, ["venue", "title_norm"])


@query("q4_chunks_without_tokens", with_views("chunks", "SELECT chunk_id FROM chunks WHERE n_tokens < 3"))
def _(lib):
    return lib.chunks.where("n_tokens < 3").select("chunk_id")


@query("q5_stale_chunks", with_views("chunks papers", "SELECT ingest_status, count(*) AS n FROM chunks c JOIN papers p ON c.paper_id = p.paper_id WHERE deleted GROUP BY 1"))
def _(lib):
    return lib.chunks.join(lib.papers.where("deleted").select("paper_id", "ingest_status"), "paper_id").groupBy("ingest_status").agg(F.count("*").alias("n"))


@query("c10_fingerprints", with_views("papers", "SELECT paper_id, substr(sha256(file_hash || chr(31) || venue || chr(31) || 'v2'), 1, 32) AS fingerprint FROM papers"))
def _(lib):
    return lib.papers.select("paper_id", I.fingerprint([F.col("file_hash"), F.col("venue")], "v2").alias("fingerprint"))
