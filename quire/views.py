"""Library tables computed from the given ones by arithmetic on ids, in Spark and as SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T


class Library:
    """Papers, chunks, notes, tags and events over one folder of tables. Every frame is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        title = F.split_part("text", F.lit("\n"), F.lit(1))
        return self.table("documents").select(
            F.col("doc_id").alias("paper_id"), title.alias("title"), T.normalize_title(title).alias("title_norm"),
            F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 2000 + doc_id % 25 END").alias("year"),
            F.col("source").alias("venue"), F.col("lang").alias("language"), F.ceil(F.col("n_chars") / 3000).alias("page_count"),
            F.expr("element_at(array('unread', 'reading', 'read', 'reviewed'), CAST(doc_id % 4 + 1 AS int))").alias("reading_status"),
            F.expr("element_at(array('pending', 'parsed', 'indexed', 'failed'), CAST(doc_id div 4 % 4 + 1 AS int))").alias("ingest_status"),
            F.sha2("text", 256).alias("file_hash"), (F.col("doc_id") % 17 == 0).alias("deleted"),
        )

    @cached_property
    def live(self) -> DataFrame:
        return self.papers.where("NOT deleted")

    @cached_property
    def chunks(self) -> DataFrame:
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
        return lines.where("text <> ''").select(
            F.expr("doc_id * 100000 + ord").alias("chunk_id"), F.col("doc_id").alias("paper_id"), F.col("ord").cast("long").alias("ord"),
            F.expr("CASE WHEN ord % 13 = 12 THEN 'table' ELSE 'text' END").alias("kind"),
            F.expr("concat('S', ord div 10)").alias("section_path"), F.expr("ord div 20 + 1").alias("page_from"),
            F.expr("ord div 20 + 1").alias("page_to"), T.estimate_tokens(F.col("text")).alias("n_tokens"),
            (F.col("ord") % 10 == 0).alias("is_section_start"), "text",
        )

    @cached_property
    def notes(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("note_id"), F.expr("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id END").alias("paper_id"),
            F.expr("CASE WHEN quality = 1 THEN 'deep_read' ELSE 'manual' END").alias("kind"), (F.col("doc_id") % 4 + 1).alias("version"), F.col("toxic").cast("int").alias("toxic"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        docs = self.table("documents")
        named = docs.select(F.col("lang").alias("name"), F.lit("topic").alias("dimension")).distinct()
        venues = docs.select(F.col("source").alias("name"), F.lit("venue").alias("dimension")).distinct()
        fixed = self.spark.range(1).selectExpr("inline(array(struct('toxic' AS name, 'status' AS dimension), struct('unused' AS name, 'status' AS dimension)))")
        return named.unionByName(venues).unionByName(fixed)

    @cached_property
    def paper_tags(self) -> DataFrame:
        docs = self.table("documents")
        return docs.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("tag")).unionByName(docs.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("tag")))

    @cached_property
    def note_tags(self) -> DataFrame:
        return self.notes.where("toxic = 1").select("note_id", F.lit("toxic").alias("tag"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label", F.lit("m0").alias("model"))

    @cached_property
    def queries(self) -> DataFrame:
        """Four words of each benchmark item; from the middle of the ids on, the first two are hyphenated."""
        first = F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), 0), 1, 4)
        half = self.table("benchmark").agg(F.max("item_id").alias("last"))
        joined = self.table("benchmark").join(F.broadcast(half))  # one row
        return joined.select(
            F.col("item_id").alias("query_id"),
            F.when(F.col("item_id") * 2 > F.col("last"), F.concat_ws(" ", F.concat_ws("-", F.get(first, F.lit(0)), F.get(first, F.lit(1))), F.get(first, F.lit(2)), F.get(first, F.lit(3))))
            .otherwise(F.concat_ws(" ", first)).alias("query"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.expr("conv_id * 1000 + turn").alias("message_id"), "conv_id", "turn", "role", "text",
            F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(conv_id AS int), CAST(turn AS int))").alias("created_at"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("ref"), F.floor(F.col("value") * 100).alias("input_tokens"),
            F.floor(F.col("value") * 10).alias("output_tokens"), (F.col("event_id") % 50 == 0).alias("blocked"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        status = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END")
        return self.table("events").select("event_id", F.col("user_id").alias("job"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))

    @cached_property
    def catalog(self) -> DataFrame:
        """Papers as files on disk."""
        return self.papers.select(
            F.expr("concat('/lib/', venue, '/', paper_id, '.pdf')").alias("path_key"), "paper_id", "file_hash", F.expr("paper_id % 5 + 1").alias("mtime"), "page_count", "deleted"
        )

    @cached_property
    def snapshot(self) -> DataFrame:
        """The catalog's files some time later: some gone, rewritten, moved or copied."""
        kept = self.catalog.where("paper_id % 7 <> 0").select(
            F.expr("CASE WHEN paper_id % 7 = 2 THEN concat('/moved/', paper_id, '.pdf') ELSE path_key END").alias("path_key"),
            F.expr("CASE WHEN paper_id % 7 = 1 THEN sha2(concat(file_hash, 'x'), 256) ELSE file_hash END").alias("file_hash"),
            F.expr("CASE WHEN paper_id % 7 = 1 THEN mtime + 10 ELSE mtime END").alias("mtime"),
        )
        copies = self.catalog.where("paper_id % 7 = 3").select(F.expr("concat('/copy/', paper_id, '.pdf')").alias("path_key"), "file_hash", "mtime")
        return kept.unionByName(copies)


TOKENS_SQL = (
    "CAST(CASE WHEN {c} = '' THEN 0 ELSE (12 * length(regexp_replace({c}, '[^一-鿿぀-ヿ]', '', 'g')) + 3 * length(regexp_replace({c}, '[^A-Za-z]', '', 'g'))"
    " + 4 * (length({c}) - length(regexp_replace({c}, '[^一-鿿぀-ヿ]', '', 'g')) - length(regexp_replace({c}, '[^A-Za-z]', '', 'g')))) // 12 + 1 END AS BIGINT)"
)
TITLE_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({c}, '[{{}}]', '', 'g')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"

#: The same tables as common table expressions.
SQL = {
    "papers": f"""papers AS (SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, {TITLE_SQL.format(c="split_part(text, chr(10), 1)")} AS title_norm,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 2000 + doc_id % 25 END AS year, source AS venue, lang AS language, CAST(ceil(n_chars / 3000.0) AS BIGINT) AS page_count,
  ['unread', 'reading', 'read', 'reviewed'][doc_id % 4 + 1] AS reading_status, ['pending', 'parsed', 'indexed', 'failed'][doc_id // 4 % 4 + 1] AS ingest_status,
  sha256(text) AS file_hash, doc_id % 17 = 0 AS deleted FROM documents)""",
    "live": "live AS (SELECT * FROM papers WHERE NOT deleted)",
    "chunks": f"""chunks AS (SELECT doc_id * 100000 + ord AS chunk_id, doc_id AS paper_id, ord, CASE WHEN ord % 13 = 12 THEN 'table' ELSE 'text' END AS kind,
  'S' || (ord // 10) AS section_path, ord // 20 + 1 AS page_from, ord // 20 + 1 AS page_to, {TOKENS_SQL.format(c="t")} AS n_tokens, ord % 10 = 0 AS is_section_start, t AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS ord FROM documents) WHERE t <> '')""",
    "notes": """notes AS (SELECT doc_id AS note_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id END AS paper_id,
  CASE WHEN quality = 1 THEN 'deep_read' ELSE 'manual' END AS kind, 1 + doc_id % 4 AS version, toxic FROM labels)""",
    "tags": """tags AS (SELECT DISTINCT lang AS name, 'topic' AS dimension FROM documents UNION ALL SELECT DISTINCT source, 'venue' FROM documents
  UNION ALL SELECT 'toxic', 'status' UNION ALL SELECT 'unused', 'status')""",
    "paper_tags": "paper_tags AS (SELECT doc_id AS paper_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents)",
    "note_tags": "note_tags AS (SELECT doc_id AS note_id, 'toxic' AS tag FROM labels WHERE toxic = 1)",
    "pairs": "pairs AS (SELECT paper_id, tag FROM paper_tags UNION SELECT n.paper_id, t.tag FROM note_tags t JOIN notes n ON t.note_id = n.note_id WHERE n.paper_id IS NOT NULL)",
    "queries": r"""queries AS (SELECT item_id AS query_id, CASE WHEN item_id * 2 > (SELECT max(item_id) FROM benchmark) THEN array_to_string([w[1] || '-' || w[2], w[3], w[4]], ' ')
  ELSE array_to_string(w[1:4], ' ') END AS query FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark))""",
    "messages": "messages AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS created_at FROM conversations)",
    "usage": """usage AS (SELECT event_id, event_type AS kind, user_id AS ref, CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  event_id % 50 = 0 AS blocked, ts AS created_at FROM events)""",
    "job_events": "job_events AS (SELECT event_id, user_id AS job, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts FROM events)",
    "catalog": "catalog AS (SELECT '/lib/' || venue || '/' || paper_id || '.pdf' AS path_key, paper_id, file_hash, paper_id % 5 + 1 AS mtime, page_count, deleted FROM papers)",
    "snapshot": """snapshot AS (SELECT CASE WHEN paper_id % 7 = 2 THEN '/moved/' || paper_id || '.pdf' ELSE path_key END AS path_key,
  CASE WHEN paper_id % 7 = 1 THEN sha256(file_hash || 'x') ELSE file_hash END AS file_hash, CASE WHEN paper_id % 7 = 1 THEN mtime + 10 ELSE mtime END AS mtime FROM catalog WHERE paper_id % 7 <> 0
  UNION ALL SELECT '/copy/' || paper_id || '.pdf', file_hash, mtime FROM catalog WHERE paper_id % 7 = 3)""",
}
_NEEDS = {"live": ["papers"], "pairs": ["paper_tags", "note_tags", "notes"], "catalog": ["papers"], "snapshot": ["papers", "catalog"]}


def with_views(names: str, rest: str) -> str:
    """A query that sees the named tables. rest: `SELECT ...`, or further expressions `x AS (...), ... SELECT ...`."""
    wanted: list[str] = []
    for n in names.split():
        for m in [*_NEEDS.get(n, []), n]:
            if m not in wanted:
                wanted.append(m)
    rest = rest.strip()
    return "WITH " + ",\n".join(SQL[n] for n in wanted) + ("\n" if rest.upper().startswith("SELECT") else ",\n") + rest
