"""Queries of group L: feeds run to their present end, with the batch result as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.index import word_tokens
from quire.queries.registry import registry
from quire.streaming import feeds as S
from quire.views import with_views

QUERIES, ORACLES, query = registry()


def _events(lib):
    """The events table as a stream of calls."""
    schema = lib.table("events").schema
    raw = S.stream_events(lib.spark, f"{lib.folder}/events.parque[t]", schema)
    return raw.select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("ref"), F.floor(F.col("value") * 100).alias("tokens"), F.col("ts").cast("timestamp").alias("created_at"))


@query("l1_stream_events", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(lib):
    return S.drained(_events(lib), "append").groupBy("kind").agg(F.count("*").alias("n"))


@query("l2_usage_windows", with_views("usage", "SELECT kind, epoch(time_bucket(INTERVAL 1 DAY, created_at))::BIGINT AS start, count(*) AS calls, sum(input_tokens)::BIGINT AS tokens FROM usage GROUP BY ALL"))
def _(lib):
    return S.drained(S.usage_windows(_events(lib)), "complete").withColumn("start", F.unix_timestamp("start"))


@query("l2_sliding_windows", with_views("usage", "SELECT kind, epoch(s)::BIGINT AS start, count(*) AS calls, sum(input_tokens)::BIGINT AS tokens FROM (SELECT *, unnest(list_transform(range(0, 24), lambda i: time_bucket(INTERVAL 1 HOUR, created_at) - to_hours(i))) AS s FROM usage) GROUP BY ALL"))
def _(lib):
    return S.drained(S.usage_windows(_events(lib), "24 hours", "1 hour"), "complete").withColumn("start", F.unix_timestamp("start"))


@query("l3_budget_gate")
def _(lib):
    return S.drained(S.budget_gate(_events(lib), 20_000), "append")


@query("l4_dedupe_jobs", "SELECT DISTINCT user_id AS ref FROM events")
def _(lib):
    return S.drained(S.dedupe_jobs(_events(lib), "ref"), "append").select("ref")


@query("l5_expired_leases")
def _(lib):
    jobs = _events(lib).select(F.col("ref").alias("job"), F.expr("CASE kind WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END").alias("status"), F.col("created_at").alias("ts"))
    return S.drained(S.expired_leases(jobs), "append")


@query("l6_sessions", with_views("usage", """g AS (SELECT ref, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM usage WINDOW w AS (PARTITION BY ref ORDER BY created_at)),
s AS (SELECT ref, created_at, sum(b) OVER (PARTITION BY ref ORDER BY created_at) AS s FROM g)
SELECT ref, floor(epoch(min(created_at)))::BIGINT AS start, count(*) AS n FROM s GROUP BY ref, s"""))
def _(lib):
    return S.drained(S.sessions(_events(lib), "6 hours"), "complete").withColumn("start", F.unix_timestamp("start"))


@query("l7_incremental_index", r"SELECT term, count(DISTINCT event_id) AS df FROM (SELECT event_id, unnest(regexp_extract_all(lower(event_type || ' ' || props), '[\p{L}\p{N}]+')) AS term FROM events) GROUP BY 1")
def _(lib):
    raw = S.stream_events(lib.spark, f"{lib.folder}/events.parque[t]", lib.table("events").schema)
    changes = raw.select(F.col("event_id").alias("chunk_id"), F.concat_ws(" ", "event_type", "props").alias("text"), F.col("event_id").alias("seq"))
    return S.incremental_index(changes, word_tokens(F.col("text"))).postings().groupBy("term").agg(F.count("*").alias("df"))


@query("l8_ttl_cache", "SELECT 'u' || user_id AS key, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS value FROM events GROUP BY 1")
def _(lib):
    rows = _events(lib).select(F.concat(F.lit("u"), "ref").alias("key"), F.col("event_id").alias("value"), "created_at")
    return S.drained(S.ttl_cache(rows), "update").where("alive").select("key", "value")
