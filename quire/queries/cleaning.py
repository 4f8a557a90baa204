"""Queries of groups A and B: files, snapshots, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import cleaning as C
from quire.queries.registry import registry
from quire.sources import snapshot as S
from quire.views import TITLE_SQL, TOKENS_SQL, with_views

QUERIES, ORACLES, query = registry()


@query("a1_scan_files")
def _(lib):
    return S.scan_files(lib.spark, lib.folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "sha256")


@query("a2_rescan_files")
def _(lib):
    """A scan that knows every second file: the other half is hashed."""
    listed = S.list_files(lib.spark, lib.folder, "*.parquet")
    known = listed.withColumn("sha256", F.sha2("path", 256)).where(F.crc32("path") % 2 == 0)
    found = S.rescan_files(lib.spark, lib.folder, known, "*.parquet")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", (F.col("sha256") == F.sha2("path", 256)).alias("unread"))


_DIFF = with_views(
    "catalog snapshot",
    """c AS (SELECT * FROM catalog WHERE NOT deleted),
old AS (SELECT file_hash, min(path_key) AS was FROM c GROUP BY file_hash),
gone AS (SELECT file_hash, min(path_key) AS was FROM c WHERE path_key NOT IN (SELECT path_key FROM snapshot) GROUP BY file_hash),
fresh AS (SELECT s.*, row_number() OVER (PARTITION BY s.file_hash ORDER BY s.path_key) AS k FROM snapshot s WHERE s.path_key NOT IN (SELECT path_key FROM c)),
diff AS (
  SELECT s.path_key, CASE WHEN s.file_hash <> c.file_hash THEN 'changed' WHEN s.mtime <> c.mtime THEN 'touched' ELSE 'skipped' END AS status
  FROM snapshot s JOIN c ON s.path_key = c.path_key
  UNION ALL
  SELECT f.path_key, CASE WHEN gone.was IS NOT NULL AND f.k = 1 THEN 'moved' WHEN old.was IS NOT NULL OR f.k > 1 THEN 'duplicate'
    WHEN d.path_key IS NOT NULL THEN 'reappeared' ELSE 'added' END AS status
  FROM fresh f LEFT JOIN gone ON f.file_hash = gone.file_hash LEFT JOIN old ON f.file_hash = old.file_hash
  LEFT JOIN (SELECT DISTINCT path_key FROM catalog WHERE deleted) d ON f.path_key = d.path_key)
""",
)


@query("a2_snapshot_diff", _DIFF + "SELECT path_key, status FROM diff")
def _(lib):
    return S.snapshot_diff(lib.catalog, lib.snapshot)


@query(
    "a3_mark_missing",
    with_views(
        "catalog snapshot",
        "SELECT paper_id FROM catalog WHERE NOT deleted AND starts_with(path_key, '/lib/src1/') AND path_key NOT IN (SELECT path_key FROM snapshot)",
    ),
)
def _(lib):
    roots = lib.spark.createDataFrame([("/lib/src1/",)], "root string")
    return S.missing_under(lib.catalog, lib.snapshot, roots).select("paper_id")


@query("a4_scan_summary", _DIFF + "SELECT string_split(path_key, '/')[2] AS root, status, count(*) AS n FROM diff GROUP BY ALL")
def _(lib):
    return S.scan_summary(S.snapshot_diff(lib.catalog, lib.snapshot))


@query("a6_write_and_read", with_views("chunks", "SELECT kind, count(*) AS n, sum(n_tokens)::BIGINT AS tokens FROM chunks GROUP BY kind"))
def _(lib):
    back = S.rewritten(lib.chunks, "kind")
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))


@query("a7_untracked", with_views("catalog snapshot", "SELECT path_key FROM snapshot WHERE path_key NOT IN (SELECT path_key FROM catalog)"))
def _(lib):
    return S.untracked(lib.snapshot, lib.catalog)


@query(
    "a8_file_type_profile",
    r"""WITH f AS (SELECT regexp_extract(string_split(url, '://')[2], '^[^/?#]*', 0) AS repo, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages),
n AS (SELECT repo, ext, count(*) AS n FROM f WHERE ext <> '' GROUP BY ALL)
SELECT repo, ext, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, ext) AS k FROM n) WHERE k <= 12""",
)
def _(lib):
    files = lib.table("pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("repo"), F.col("url").alias("path"))
    return S.file_type_profile(files)


@query("b1_normalize_title", f"SELECT doc_id, {TITLE_SQL.format(c='split_part(text, chr(10), 1)')} AS title_norm FROM documents")
def _(lib):
    return lib.papers.select(F.col("paper_id").alias("doc_id"), "title_norm")


@query("b2_extract_identifiers")
def _(lib):
    return C.extract_identifiers(lib.table("documents")).select("doc_id", "arxiv_id", "doi", "arxiv_year")


@query(
    "b3_normalize_identifiers",
    r"""SELECT doc_id, regexp_replace(trim(a), 'v\d+$', '', 'i') AS arxiv, regexp_replace(regexp_replace(lower(trim(d)), '^https://doi\.org/', ''), '^doi:', '') AS doi,
  CASE WHEN CAST(substr(a, 1, 2) AS INT) > 91 THEN 1900 ELSE 2000 END + CAST(substr(a, 1, 2) AS INT) AS year
FROM (SELECT doc_id, lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '01.' || lpad(CAST(doc_id % 10000 AS VARCHAR), 5, '0') || 'v' || (doc_id % 4 + 1) AS a,
  CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1000/' ELSE 'doi:10.1000/' END || source AS d FROM documents)""",
)
def _(lib):
    ids = lib.table("documents").select(
        "doc_id",
        F.expr("concat(lpad(CAST(doc_id % 100 AS string), 2, '0'), '01.', lpad(CAST(doc_id % 10000 AS string), 5, '0'), 'v', doc_id % 4 + 1)").alias("a"),
        F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1000/' ELSE 'doi:10.1000/' END, source)").alias("d"),
    )
    return ids.select("doc_id", T.normalize_arxiv(F.col("a")).alias("arxiv"), T.normalize_doi(F.col("d")).alias("doi"), T.year_from_arxiv(F.col("a")).alias("year"))


@query("b4_title_spellings")
def _(lib):
    return C.clean_catalog(lib.papers).select("paper_id", F.posexplode("title_spellings").alias("k", "spelling"))


def _fold_sql(c: str) -> str:
    for letter, plain in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        c = f"replace({c}, '{letter}', '{plain}')"
    return f"translate({c}, '{T.FOLD_FROM}', '{T.FOLD_TO}')"


@query("b5_ascii_fold", f"SELECT doc_id, {_fold_sql('text')} AS folded FROM documents")
def _(lib):
    return lib.table("documents").select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


@query("b6_split_authors")
def _(lib):
    return lib.papers.select("paper_id", F.posexplode(T.split_authors(F.col("title"))).alias("k", "author"))


@query("b7_extract_abstract")
def _(lib):
    return lib.table("documents").select("doc_id", T.extract_abstract(F.concat(F.lit("Abstract\n"), "text", F.lit("\n\nIntroduction"))).alias("abstract"))


@query("b8_estimate_tokens", f"SELECT doc_id, {TOKENS_SQL.format(c='text')} AS n_tokens FROM documents")
def _(lib):
    return lib.table("documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"))


@query("b9_script_profile")
def _(lib):
    return C.profile_text(lib.queries, "query").select("query_id", "is_cjk", "cjk_run", F.array_join("terms", " ").alias("terms"))


@query("b10_cjk_ngrams", """SELECT doc_id, list_distinct_in_order AS grams FROM (SELECT doc_id, list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_in_order FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['图神经', '神经网', '经网络'] WHEN 1 THEN ['图神经', '神经网', '经网络', '学习'] WHEN 2 THEN ['学习', '图神经', '神经网', '经网络'] ELSE [] END AS g FROM documents))""")
def _(lib):
    """Each text with runs of Chinese before, behind or at both ends."""
    run, short = F.lit("图神经网络"), F.lit("学习")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(run, "text", run)).when(k == 1, F.concat(run, F.lit(" "), "text", short)).when(k == 2, F.concat(short, "text", run, F.lit("，"), short)).otherwise(F.col("text"))
    return lib.table("documents").select("doc_id", T.cjk_ngrams(text).alias("grams"))


@query(
    "b11_html_to_text",
    r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 4000) AS text FROM pages""",
)
def _(lib):
    return lib.table("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("b12_inverted_abstract", r"SELECT item_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS text FROM benchmark")
def _(lib):
    return C.inverted_abstract_to_text(C.word_positions(lib.table("benchmark"), "item_id", "text"), "item_id", "positions")


_SLUG = r"regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), 1, 80), '^-+|-+$', '', 'g')"


@query(
    "b13_unique_slugs",
    with_views(
        "papers",
        f"""b AS (SELECT paper_id, venue, CASE WHEN {_SLUG} = '' THEN 'untitled' ELSE {_SLUG} END AS base FROM papers),
n AS (SELECT *, row_number() OVER (PARTITION BY venue, base ORDER BY paper_id) AS n FROM b),
s AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY venue, slug ORDER BY n, paper_id) AS k FROM s)
SELECT paper_id, CASE WHEN k = 1 THEN slug ELSE slug || '-x-' || k END AS slug FROM k""",
    ),
)
def _(lib):
    return C.unique_slugs(lib.papers.select("paper_id", "venue", "title"), "venue", "title", "paper_id").select("paper_id", "slug")


@query("b14_content_hash", r"SELECT doc_id, sha256(regexp_replace(replace('updated: ' || n_chars || chr(10) || text, chr(13) || chr(10), chr(10)), '(?m)^updated:.*\n', '', 'g')) AS hash FROM documents")
def _(lib):
    return lib.table("documents").select("doc_id", T.content_hash(F.concat(F.lit("updated: "), "n_chars", F.lit("\n"), "text")).alias("hash"))


#: Documents as TeX files whose kind varies with the id: titles, blocks and sections that the signals know.
_TEX_TITLE = "CASE doc_id % 7 WHEN 0 THEN 'A Survey of ' WHEN 1 THEN '关于图的综述 ' WHEN 2 THEN 'A System for ' WHEN 3 THEN 'The framework ' ELSE '' END"
_TEX_BLOCK = r"CASE doc_id % 5 WHEN 0 THEN '\\begin{proof}x\\end{proof}' WHEN 1 THEN '\\lemma x \\qed ' WHEN 2 THEN '\\section{Our Implementation}' ELSE '' END"


def _kind_sql() -> str:
    count = lambda pattern: f"len(regexp_extract_all(body, '{pattern}'))"
    return f"""SELECT doc_id, CASE WHEN regexp_matches(lower(title), '{T.SURVEY_WORDS}') OR regexp_matches(title, '{T.SURVEY_TITLE}') THEN 'survey'
  WHEN {count(T.THEOREM_BLOCKS)} >= 3 OR ({count(T.THEOREM_COMMANDS)} >= 5 AND {count(T.PROOFS)} >= 3) THEN 'theory'
  WHEN regexp_matches(lower(title), '{T.SYSTEM_WORDS}') AND regexp_matches(body, '{T.SYSTEM_SECTION}') THEN 'system' ELSE 'method' END AS kind
FROM (SELECT *, title || chr(10) || text AS body FROM (SELECT doc_id, {_TEX_TITLE} || split_part(text, chr(10), 1) AS title,
  repeat({_TEX_BLOCK.replace(chr(92) * 2, chr(92))}, CAST(doc_id % 8 AS INT)) || text AS text FROM documents))"""


@query("b16_classify_paper", _kind_sql())
def _(lib):
    text = F.concat(F.repeat(F.expr(_TEX_BLOCK), F.expr("CAST(doc_id % 8 AS INT)")), "text")
    title = F.concat(F.expr(_TEX_TITLE), F.split_part("text", F.lit("\n"), F.lit(1)))
    return lib.table("documents").select("doc_id", T.classify_paper(title, text).alias("kind"))


@query("b17_repo_links", r"""SELECT page_id, ['https://github.com/' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || '/' || page_id, 'https://gitlab.com/x/y-' || page_id] AS links FROM pages""")
def _(lib):
    """Each page behind two links to its repository, one to another, and one to pages inside."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    text = F.concat(F.lit("HTTP://github.com/"), host, F.lit("/"), "page_id", F.lit(".git, see https://gitlab.com/x/y-"), "page_id", F.lit(") https://github.com/"), host, F.lit("/"), "page_id", F.lit("/tree https://github.com/x/blob "), "html")
    return lib.table("pages").select("page_id", T.repo_links(text).alias("links"))


_TEX = """WITH d AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 5 AS b FROM documents)
"""


def _tex(lib):
    """Each document as the body of a TeX file with a macro, an equation, a table and citations."""
    line = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    n = F.col("doc_id").cast("string")
    tex = F.concat_ws(
        "\n", line(r"\newcommand{\mac}{M\textbf{x{y{z}}}", n, "}"), F.lit(r"% \cite{hidden}"), line(r"\section{S", n, "}"), F.regexp_replace("text", r"[\\%{}&]", " "), line(r"uses \mac and \mac{} here"),
        line(r"\begin{equation}\label{e", n, "} x = ", n, r" \end{equation}"), line(r"\begin{table}\caption{T\emph{a {b {c}}}", n, r"}\label{t", n, r"}\end{table}"),
        line(r"\cite{k", (F.col("doc_id") % 7).cast("string"), ", k", (F.col("doc_id") % 5).cast("string"), "}"),
    )
    return lib.table("documents").select(F.col("doc_id").alias("paper_id"), tex.alias("content"))


@query("b20_latex_blocks", _TEX + """SELECT doc_id AS paper_id, 'formula' AS kind, 'x = ' || doc_id AS content, 'e' || doc_id AS label FROM d UNION ALL SELECT doc_id, 'table', 'T' || chr(92) || 'emph{a {b {c}}}' || doc_id, 't' || doc_id FROM d
UNION ALL SELECT doc_id, 'cite', 'k' || a || ', k' || b, NULL FROM d""")
def _(lib):
    return C.latex_blocks(_tex(lib)).select("paper_id", "kind", "content", "label")


@query("b20_latex_sections", r"""SELECT doc_id AS paper_id, 'S' || doc_id AS section_path, 1 AS level FROM documents""")
def _(lib):
    return C.latex_sections(C.strip_comments(_tex(lib))).select("paper_id", "section_path", "level")


@query("b21_tabular_cells", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, unnest([x, 'n' || i]) AS x, unnest([0, 1]) AS col FROM l)
SELECT doc_id AS paper_id, i AS row, col, trim(regexp_replace(regexp_replace(x, '[\\&{}]', ' ', 'g'), '\s+', ' ', 'g')) AS cell FROM c""")
def _(lib):
    """The lines of each document as rows of a table, with their numbers."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.regexp_replace(x, r"[\\&{}]", " "), F.lit(r" & \multicolumn{1}{c}{n"), i.cast("string"), F.lit("} ")))
    blocks = lib.table("documents").select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("ord"), F.array_join(rows, r"\\ \hline ").alias("content"))
    return C.tabular_to_cells(blocks).select("paper_id", "row", "col", "cell")


@query("b22_macro_usage", "SELECT doc_id AS paper_id, 'mac' AS name, 'M' || chr(92) || 'textbf{x{y{z}}}' || doc_id AS body, 2 AS n_uses FROM documents")
def _(lib):
    return C.macro_usage(_tex(lib))[0]


@query("b22_expanded_text", r"""WITH m AS (SELECT doc_id, 'M\textbf{x{y{z}}}' || doc_id AS m, regexp_replace(text, '[\\%{}&]', ' ', 'g') AS body FROM documents)
SELECT doc_id AS paper_id, sha256(array_to_string(['', '% \cite{hidden}', '\section{S' || doc_id || '}', body, 'uses ' || m || ' and ' || m || '{} here', '\begin{equation}\label{e' || doc_id || '} x = ' || doc_id || ' \end{equation}',
  '\begin{table}\caption{T\emph{a {b {c}}}' || doc_id || '}\label{t' || doc_id || '}\end{table}', '\cite{k' || doc_id % 7 || ', k' || doc_id % 5 || '}'], chr(10))) AS sha FROM m""")
def _(lib):
    return C.macro_usage(_tex(lib))[1].select("paper_id", F.sha2("content", 256).alias("sha"))


@query("b23_citation_edges", _TEX + "SELECT DISTINCT doc_id AS paper_id, unnest(['k' || a, 'k' || b]) AS cite_key FROM d")
def _(lib):
    return C.citation_edges(C.latex_blocks(_tex(lib)))


@query("b18_expansion_terms")
def _(lib):
    return lib.table("benchmark").select("item_id", F.posexplode(T.expansion_terms(F.col("text"))).alias("k", "term"))
