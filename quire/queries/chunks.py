"""Queries of group C: chunking and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import index as I
from quire.queries.registry import registry
from quire.views import TOKENS_SQL, with_views

QUERIES, ORACLES, query = registry()


#: The number of a heading, of one to four parts, from the number of its section.
_NUMBER = "array_to_string([s % 89 + 1, s % 7 + 1, s % 5 + 1, s % 3 + 1][1:s % 4 + 1], '.')"


def _pages(lib):
    """Chunks as pages of lines, each tenth line as a numbered heading of one to four levels."""
    s = F.floor(F.col("ord") / 10)
    number = F.array_join(F.slice(F.array(*((s % k + 1).cast("string") for k in (89, 7, 5, 3))), F.lit(1), (s % 4 + 1).cast("int")), ".")
    line = F.when(F.col("is_section_start"), F.concat(number, F.lit(" Part "), F.col("ord"))).otherwise(F.col("text"))
    lines = lib.chunks.select("paper_id", F.col("page_from").alias("page"), "ord", line.alias("line"))
    return lines.groupBy("paper_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), "\n").alias("text"))


def _sections_sql() -> str:
    known = ", ".join(f"'{n}'" for n in I.SECTION_NAMES)
    last = lambda k: f"max(CASE WHEN level = {k} THEN ord END) OVER w"
    over = lambda k: f"coalesce(max(CASE WHEN level < {k} THEN ord END) OVER w, -1)"
    title = lambda k: f"CASE WHEN level >= {k} AND {last(k)} > {over(k)} THEN arg_max(title, CASE WHEN level = {k} THEN ord END) OVER w END"
    path = ", ".join(title(k) for k in range(1, I.LEVELS + 1))
    return f"""l AS (SELECT paper_id, ord, page_from AS page, trim(CASE WHEN is_section_start THEN (SELECT {_NUMBER} FROM (SELECT ord // 10 AS s)) || ' Part ' || ord ELSE text END) AS line FROM chunks),
m AS (SELECT *, regexp_extract(line, '{I.NUMBERED}', ['num', 'roman', 'letter', 'title']) AS g, length(line) <= 110 AND NOT regexp_matches(line, '{I.NOISE}') AS fits FROM l),
h AS (SELECT *, fits AND g.title <> '' AS numbered, ends_with(g.title, '.') AND len(regexp_extract_all(g.title, '\\S+')) > 8 AS sentence,
  fits AND g.title = '' AND regexp_replace(lower(line), ':+$', '') IN ({known}) AND len(regexp_extract_all(line, '\\S+')) <= 6 AS known FROM m),
heads AS (SELECT paper_id, ord, page, CASE WHEN known THEN 1 WHEN g.num <> '' THEN len(string_split(g.num, '.')) WHEN g.roman <> '' THEN 1 ELSE 2 END AS level,
  CASE WHEN known THEN line WHEN g.num <> '' THEN g.num || ' ' || trim(g.title) ELSE trim(g.title) END AS title FROM h WHERE known OR numbered AND NOT sentence)
SELECT paper_id, level, title, page, concat_ws(' > ', {path}) AS section_path FROM heads WINDOW w AS (PARTITION BY paper_id ORDER BY ord)"""


@query("c1_detect_sections", with_views("chunks", _sections_sql()))
def _(lib):
    return I.detect_sections(_pages(lib)).where("title IS NOT NULL").select("paper_id", "level", "title", "page", "section_path")


@query(
    "c1_outline_sections",
    with_views("chunks", """e AS (SELECT paper_id, section_path AS title, page_from AS page, min(ord) AS seq FROM chunks WHERE ord % 30 < 10 AND is_section_start GROUP BY ALL),
n AS (SELECT *, lead(page) OVER (PARTITION BY paper_id ORDER BY page, seq) AS stop FROM e)
SELECT n.paper_id, n.title, n.page, max(c.page_from) AS page_to, count(DISTINCT c.page_from) AS n_pages FROM n JOIN chunks c ON n.paper_id = c.paper_id AND c.page_from >= n.page AND c.page_from < coalesce(n.stop, 1000000) GROUP BY ALL"""),
)
def _(lib):
    """Each third section as an entry of an outline."""
    outline = lib.chunks.where("ord % 30 < 10 AND is_section_start").groupBy("paper_id", F.col("section_path").alias("title"), F.col("page_from").alias("page")).agg(F.min("ord").alias("seq"))
    found = I.outline_sections(_pages(lib), outline.withColumn("level", F.lit(1)))
    return found.select("paper_id", "title", "page", "page_to", F.size(F.split("text", "\n\n")).cast("long").alias("n_pages"))


@query("c2_merge_wrapped")
def _(lib):
    return I.merge_wrapped(lib.chunks)


@query("c3_chunk_sections")
def _(lib):
    return I.chunk_sections(lib.chunks.withColumnRenamed("page_from", "page"), target=200, overlap=30)


@query("c4_chunk_markdown")
def _(lib):
    docs = lib.table("documents")
    md = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), F.substring(x, 1, 30), F.lit("\n\n"), x)).otherwise(F.concat(x, F.lit("\n")))), "\n")
    return I.chunk_markdown(docs.select(F.col("doc_id").alias("note_id"), md.alias("content_md"))).select("note_id", "chunk_no", "title")


@query(
    "c5_special_chunks",
    with_views("chunks", """n AS (SELECT paper_id, max(ord) + 1 AS nx FROM chunks GROUP BY 1)
SELECT c.paper_id, kind, nx + row_number() OVER (PARTITION BY c.paper_id ORDER BY kind, ord) - 1 AS ord, '[t' || ord || '] ' || text AS text FROM chunks c JOIN n ON c.paper_id = n.paper_id WHERE kind = 'table'"""),
)
def _(lib):
    blocks = lib.chunks.where("kind = 'table'").select("paper_id", "kind", "ord", F.col("text").alias("content"), F.concat(F.lit("t"), "ord").alias("label"))
    return I.special_chunks(blocks, lib.chunks.groupBy("paper_id").agg((F.max("ord") + 1).alias("next_ord")))


@query("c6_code_chunks")
def _(lib):
    langs = lib.table("pages").groupBy(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("name"), F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1).alias("lang")).agg(F.count("*").alias("n"), F.min("page_id").alias("p"))
    repos = langs.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("languages"), F.min("p").alias("paper_id"))
    return I.code_chunks(repos.select("paper_id", "name", F.concat(F.lit("https://"), "name").alias("url"), F.sha2("name", 256).alias("commit"), "languages", F.lit("readme").alias("readme"), F.lit("tree").alias("tree")))


@query(
    "c7_replace_chunks",
    with_views("chunks", """SELECT chunk_id, kind FROM chunks WHERE paper_id % 3 <> 0 OR kind = 'table' UNION ALL SELECT chunk_id + 50000, 'new' FROM chunks WHERE paper_id % 3 = 0 AND ord = 0"""),
)
def _(lib):
    own = lib.chunks.where("paper_id % 3 = 0")
    new = own.where("ord = 0").withColumn("chunk_id", F.col("chunk_id") + 50000).withColumn("kind", F.lit("new"))
    return I.replace_chunks(lib.chunks, new, own.select("paper_id").distinct(), keep=("table",)).select("chunk_id", "kind")


@query("c8_pending_index", with_views("live", "SELECT paper_id, ingest_status FROM live WHERE ingest_status IN ('pending', 'parsed', 'failed')"))
def _(lib):
    return I.pending_index(lib.papers).select("paper_id", "ingest_status")


@query("c9_enrich_metadata", with_views("papers", "SELECT paper_id, coalesce(year, 1990 + paper_id % 7) AS year, coalesce(nullif(CASE WHEN paper_id % 5 = 0 THEN '' ELSE venue END, ''), 'v' || paper_id) AS venue FROM papers"))
def _(lib):
    base = lib.papers.select("paper_id", "year", F.expr("CASE WHEN paper_id % 5 = 0 THEN '' ELSE venue END").alias("venue"))
    parsed = lib.papers.select("paper_id", (F.col("paper_id") % 7 + 1990).alias("year"), F.concat(F.lit("v"), "paper_id").alias("venue"))
    return I.enrich_metadata(base, parsed, "paper_id", ["year", "venue"]).select("paper_id", "year", "venue")


_PRINT = "substr(sha256(file_hash || chr(31) || 'read' || chr(31) || 'm0'), 1, 32)"


@query("c10_needs_recompute", with_views("papers", f"SELECT paper_id, 'read' AS stage, {_PRINT} AS fingerprint FROM papers WHERE paper_id % 2 = 1"))
def _(lib):
    inputs = lib.papers.select("paper_id", F.lit("read").alias("stage"), I.fingerprint([F.col("file_hash"), F.lit("read")], "m0").alias("fingerprint"))
    return I.needs_recompute(inputs, inputs.where("paper_id % 2 = 0"))


@query("c11_embedding_input", with_views("papers chunks", "SELECT chunk_id, title || ' | ' || section_path || chr(10) || substr(text, 1, 1200) AS input FROM chunks c JOIN papers p ON c.paper_id = p.paper_id"))
def _(lib):
    return I.embedding_input(lib.chunks, lib.papers)


@query("c12_pending_vectors", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(lib):
    return I.pending_vectors(lib.table("documents").select(F.col("doc_id").alias("chunk_id")), lib.vectors, "m0")


@query("c12_upsert_vectors", "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def _(lib):
    new = lib.vectors.where("chunk_id % 3 = 0").withColumn("label", F.col("label") + 100)
    return I.upsert_vectors(lib.vectors, new).select("chunk_id", "label")


@query("c13_embed")
def _(lib):
    def load():
        import numpy as np

        def encode(texts):
            out = np.zeros((len(texts), 8), np.float32)
            for i, t in enumerate(texts):
                b = np.frombuffer(t.encode(), np.uint8)
                out[i] = np.bincount(b % 8, minlength=8)[:8] / max(1, len(b))
            return out.tolist()

        return encode

    return I.embed(lib.table("documents"), load, "doc_id", "text").select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("c14_coverage", "SELECT 'm0' AS model, (SELECT count(*) FROM documents) AS n_chunks, count(*) AS n_vectors, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def _(lib):
    return I.coverage(lib.table("documents").select(F.col("doc_id").alias("chunk_id")), lib.vectors)


@query(
    "c14_index_stats",
    with_views("live chunks", """p AS (SELECT paper_id, count(*) AS c, sum(n_tokens) AS t FROM chunks GROUP BY 1)
SELECT ingest_status, count(*) AS n_papers, count(c) AS n_indexed, coalesce(sum(c), 0)::BIGINT AS n_chunks, coalesce(sum(t), 0)::BIGINT AS n_tokens FROM live LEFT JOIN p ON live.paper_id = p.paper_id GROUP BY 1"""),
)
def _(lib):
    return I.index_stats(lib.chunks, lib.papers)


@query(
    "c15_paper_text",
    with_views("chunks", """n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord, chunk_id) - 1 AS k, count(*) OVER (PARTITION BY paper_id) AS n FROM chunks WHERE section_path ILIKE '%s0%')
SELECT chunk_id, CASE WHEN n > 6 THEN 6 END AS next_offset FROM n WHERE k >= 2 AND k < 6"""),
)
def _(lib):
    return I.paper_text(lib.chunks, section="s0", offset=2, limit=4).select("chunk_id", "next_offset")


#: Section titles and kinds of papers, dealt by number.
_TITLES = ("Method", "Introduction", "Related work", "Main theorem", "Taxonomy", "System design", "References", "Results", "Outlook")
_KINDS = ("method", "theory", "survey", "system")


def _context_sql(room: int, least: int = 300) -> str:
    name = f"[{', '.join(repr(t) for t in _TITLES)}][s % {len(_TITLES)} + 1]"
    weights = " ".join(f"WHEN kind = '{k}' AND contains(lower(path), '{w}') THEN {v}" for k, ws in I.SECTION_WEIGHTS.items() for w, v in ws.items())
    ends = [(r"\n\n", 0, 0.5), *((e.replace(".", "\\.").replace("?", "\\?"), len(e), 0.5) for e in I.SENTENCE_ENDS), (" ", 0, 0.4)]
    # the place behind the last end in the head, if that is far enough
    place = lambda e: f"length(regexp_extract(head, '(?s)^(.*){e}', 1))"
    cut = " ".join(f"WHEN regexp_matches(head, '{e}') AND {place(e)} >= room * {least} THEN {place(e)} + {width}" for e, width, least in ends)
    return f"""parts AS (SELECT paper_id, ord // 10 AS s, trim(string_agg(text, chr(10) ORDER BY ord)) AS text FROM chunks WHERE kind = 'text' GROUP BY ALL),
named AS (SELECT paper_id, [{', '.join(repr(k) for k in _KINDS)}][paper_id % {len(_KINDS)} + 1] AS kind, s, 'S' || s || ' ' || {name} AS path, text FROM parts WHERE text <> ''),
weighed AS (SELECT *, CASE {weights} ELSE 1.0 END AS weight FROM named),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY weight DESC, s) AS k FROM weighed WHERE weight > 0),
fold(paper_id, k, room, n, dropped, path, used) AS (
  SELECT DISTINCT paper_id, 0::BIGINT, {room}::BIGINT, 0::BIGINT, 0::BIGINT, '', 0::BIGINT FROM ranked
  UNION ALL SELECT f.paper_id, r.k, f.room - x.used, f.n + (x.used > 0)::INT, f.dropped + (x.used < length(r.text))::INT, r.path, x.used FROM fold f JOIN ranked r ON f.paper_id = r.paper_id AND r.k = f.k + 1,
    LATERAL (SELECT CASE WHEN f.room < {least} THEN 0 WHEN length(r.text) <= f.room THEN length(r.text) ELSE (SELECT length(rtrim(substr(head, 1, CASE {cut} ELSE length(head) END), ' ' || chr(10) || chr(9) || chr(13)))
      FROM (SELECT substr(r.text, 1, f.room) AS head, f.room AS room) h) END AS used) x)
SELECT paper_id, max(n) AS n_sections, max(dropped) AS n_dropped, {room} - min(room) AS used_chars FROM fold GROUP BY paper_id"""


@query("c16_assemble_context", with_views("chunks", _context_sql(2500)).replace("WITH ", "WITH RECURSIVE ", 1))
def _(lib):
    s = F.floor(F.col("ord") / 10).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    texts = lib.chunks.where("kind = 'text'").groupBy("paper_id", s.alias("ord")).agg(text.alias("text"))
    sections = texts.withColumn("path", F.concat(F.lit("S"), "ord", F.lit(" "), of(_TITLES, F.col("ord"))))
    papers = lib.papers.select("paper_id", of(_KINDS, F.col("paper_id")).alias("kind"), "title", F.lit(None).cast("string").alias("abstract"))
    tables = lib.chunks.where("kind = 'table'").select("paper_id", "ord", F.col("section_path").alias("path"), "text")
    found = I.assemble_context(papers, sections, tables, max_chars=2500)
    return found.where("n_sections + n_dropped > 0").select("paper_id", "n_sections", "n_dropped", "used_chars")
