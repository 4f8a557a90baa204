"""Panels, ledgers and job analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(papers: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """One row of totals over live papers."""
    p = papers.where("NOT deleted").agg(F.count("*").alias("n_papers"), F.sum("page_count").alias("n_pages"), F.count_if(F.col("year").isNull()).alias("no_year"))
    live = chunks.join(papers.where("NOT deleted").select("paper_id"), "paper_id", "left_semi")
    c = live.agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    n = notes.agg(F.count("*").alias("n_notes"))
    return p.join(F.broadcast(c)).join(F.broadcast(n))  # one row each


def todo_counts(papers: DataFrame, notes: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: live papers that failed, wait, or lack a deep reading, and undecided duplicates."""
    live = papers.where("NOT deleted")
    read = notes.where("kind = 'deep_read' AND paper_id IS NOT NULL").select("paper_id")
    state = live.agg(F.count_if(F.col("ingest_status") == "failed").alias("failed"), F.count_if(F.col("ingest_status") == "pending").alias("pending"))
    unread = live.join(read, "paper_id", "left_anti").agg(F.count("*").alias("unread"))
    return state.join(F.broadcast(unread)).join(F.broadcast(duplicates.agg(F.count("*").alias("duplicates"))))  # one row each


def counts_by(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    n = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n if most is None else n.orderBy(F.desc("n"), column).limit(most)


def zero_filled_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column, n: every known value, also the unused ones, and unknown values as they come."""
    known = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(n, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def code_coverage(papers: DataFrame, repos: DataFrame) -> DataFrame:
    live = papers.where("NOT deleted").select("paper_id")
    held = live.join(repos.select("paper_id").distinct().withColumn("r", F.lit(1)), "paper_id", "left")
    return held.agg(F.count("r").alias("with_repo"), F.count_if(F.col("r").isNull()).alias("without_repo"))


def panels(named: dict[str, DataFrame]) -> DataFrame:
    """panel, key, value: several counts as one long table."""
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("panel"), F.col(df.columns[0]).cast("string").alias("key"), F.col(df.columns[1]).cast("long").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def usage_summary(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """kind (null for all), calls, blocked, tokens and cost. Blocked calls cost nothing."""
    ok = ~F.col("blocked")
    tokens = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0))
    return usage.rollup("kind").agg(
        F.count_if(ok).alias("calls"), F.count_if(F.col("blocked")).alias("blocked"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
        F.round((tokens("input_tokens") * price_in + tokens("output_tokens") * price_out) / 1e6, 6).alias("cost"),
    )


def top_consumers(usage: DataFrame, limit: int = 10) -> DataFrame:
    n = usage.where("NOT blocked").groupBy("ref").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("calls"))
    return n.orderBy(F.desc("tokens"), "ref").limit(limit)


def rolling_usage(usage: DataFrame, quota: int, hours: int = 24) -> DataFrame:
    """event_id, used (tokens of the key in the trailing window, this call included), remaining, over."""
    window = Window.partitionBy("ref").orderBy(F.col("created_at").cast("timestamp").cast("double")).rangeBetween(-hours * 3600, 0)
    tokens = F.when(F.col("blocked"), 0).otherwise(F.col("input_tokens") + F.col("output_tokens"))
    used = usage.withColumn("used", F.sum(tokens).over(window))
    return used.select("event_id", "used", F.greatest(F.lit(0), F.lit(quota) - F.col("used")).alias("remaining"), (F.col("used") > quota).alias("over"))


def cache_stats(cache: DataFrame, now: str) -> DataFrame:
    alive = F.col("expires_at") > F.lit(now).cast("timestamp")
    return cache.agg(F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(~alive).alias("expired"))


def latest_valid(cache: DataFrame, now: str) -> DataFrame:
    """key, event_id: the newest entry of each key that has not expired."""
    alive = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
    return alive.groupBy("key").agg(F.max(F.struct("created_at", "event_id"))["event_id"].alias("event_id"))


def language_shares(repos: DataFrame, most: int = 6) -> DataFrame:
    """repo, lang, percent: the largest languages of repositories (repo, lang, size)."""
    per = repos.groupBy("repo", "lang").agg(F.sum("size").alias("size"))
    own = Window.partitionBy("repo")
    ranked = per.withColumn("percent", F.round(F.col("size") * 100 / F.sum("size").over(own), 1)).withColumn("k", F.row_number().over(own.orderBy(F.desc("size"), "lang")))
    return ranked.where(F.col("k") <= most).select("repo", "lang", "percent")


def job_rollup(events: DataFrame, now: str, lease_seconds: int = 300) -> DataFrame:
    """job, status, attempts, seconds, expired: the latest state of each job, and whether its lease has run out."""
    last = events.groupBy("job").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("last"), F.count_if(F.col("status") == "running").alias("attempts"), F.min("ts").alias("first")
    )
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last.ts").cast("double")
    return last.select("job", F.col("last.status").alias("status"), "attempts", F.round(F.col("last.ts").cast("double") - F.col("first").cast("double"), 3).alias("seconds"), ((F.col("last.status") == "running") & (age > lease_seconds)).alias("expired"))


# ---- evaluation and checks ----


def eval_retrieval(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """class, n, top1, top3, any_hit for cases (query_id, class, expected) and hits (query_id, rank, value)."""
    joined = cases.join(hits, "query_id", "left").groupBy("query_id", "class").agg(
        F.min(F.when(F.col("value") == F.col("expected"), F.col("rank"))).alias("r"), F.count("value").alias("n")
    )
    return joined.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("r") == 1).alias("top1"), F.count_if(F.col("r") <= 3).alias("top3"), F.count_if(F.col("n") > 0).alias("any_hit"))


def eval_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id of the cases whose best hit differs between two rounds of hits (query_id, rank, value)."""
    a = first.where("rank = 1").select("query_id", F.col("value").alias("a"))
    b = second.where("rank = 1").select("query_id", F.col("value").alias("b"))
    return a.join(b, "query_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("query_id")


def filter_leaky_cases(cases: DataFrame, titles: DataFrame) -> DataFrame:
    """cases (query_id, query) that share no Latin word of 4 letters with any title."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0)))
    held = titles.select(words("title").alias("w")).distinct()
    leaky = cases.select("query_id", words("query").alias("w")).join(held, "w", "left_semi").select("query_id").distinct()
    return cases.join(leaky, "query_id", "left_anti")


def orphans(notes: DataFrame, papers: DataFrame) -> DataFrame:
    return notes.where("paper_id IS NOT NULL").join(papers.select("paper_id"), "paper_id", "left_anti")


def broken_unique(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
