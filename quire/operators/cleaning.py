"""Cleaning jobs: whole tables of papers, texts, pages and notes, one narrow stage each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def clean_catalog(papers: DataFrame) -> DataFrame:
    """papers (title, file_path?, authors?) with normal forms of what identifies them."""
    return papers.withColumns(
        {
            "title_norm": T.normalize_title(F.col("title")),
            "title_ascii": T.ascii_fold(F.col("title")),
            "title_spellings": T.clean_title_candidates(F.col("title")),
            "short_name": T.extract_shortname(F.col("title")),
            "slug": T.slugify(F.col("title")),
        }
    )


def extract_identifiers(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with arxiv_id, doi and the year that the arxiv id tells."""
    return docs.withColumns({"arxiv_id": T.find_arxiv_id(F.col(text)), "doi": T.find_doi(F.col(text))}).withColumn("arxiv_year", T.year_from_arxiv(F.col("arxiv_id")))


def profile_text(docs: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    return docs.withColumns(
        {
            "n_tokens": T.estimate_tokens(c), "is_cjk": T.is_cjk(c), "cjk_run": T.longest_cjk_run(c),
            "terms": T.technical_terms(c), "cjk_grams": T.cjk_ngrams(c),
        }
    )


def unique_slugs(rows: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """rows with a slug that is unique within scope: the first of a base keeps it, later ones get -2, -3, ...

    A numbered slug can equal another row's own base; such rows get their number from a scope-wide second pass.
    """
    base = T.slugify(F.col(name))
    nth = F.row_number().over(Window.partitionBy(scope, "_base").orderBy(order))
    first = rows.withColumn("_base", base).withColumn("_n", nth)
    first = first.withColumn("slug", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", "_n")))
    clash = F.row_number().over(Window.partitionBy(scope, "slug").orderBy("_n", order))
    first = first.withColumn("_clash", clash)
    return first.withColumn("slug", F.when(F.col("_clash") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.lit("x"), "_clash"))).drop("_base", "_n", "_clash")


def inverted_abstract_to_text(rows: DataFrame, key: str, positions: str) -> DataFrame:
    """key, text from a map of word -> positions."""
    flat = rows.select(key, F.explode(positions).alias("word", "at")).select(key, "word", F.explode("at").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    return flat.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["word"]), " ").alias("text"))


def word_positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and a map of word -> ascending positions: the inverse of inverted_abstract_to_text."""
    words = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"\S+"), 0)).alias("at", "word"))
    lists = words.groupBy(key, "word").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("positions"))


def title_forms(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("*"), T.title_from_filename(F.col("path")).alias("title"))


# ---- TeX sources ----

HEADING = r"\\(section|subsection|subsubsection)\*?\{([^{}]*)\}"


def strip_comments(files: DataFrame, content: str = "content") -> DataFrame:
    """TeX without comments; an escaped percent sign and verbatim lines stay."""
    lines = F.split(content, "\n")
    clean = F.transform(lines, lambda x: F.regexp_replace(x, r"(?<!\\)%.*$", ""))
    verbatim = F.transform(
        lines,
        lambda x, i: F.size(F.filter(F.slice(lines, 1, i + 1), lambda y: y.contains("\\begin{verbatim}"))) > F.size(F.filter(F.slice(lines, 1, i), lambda y: y.contains("\\end{verbatim}"))),
    )
    kept = F.transform(F.arrays_zip(lines.alias("raw"), clean.alias("clean"), verbatim.alias("v")), lambda z: F.when(z["v"], z["raw"]).otherwise(z["clean"]))
    return files.withColumn(content, F.array_join(kept, "\n"))


def latex_sections(files: DataFrame) -> DataFrame:
    """paper_id, ord, level, title, section_path, body: one row per section, paths joined by ' > '."""
    marked = F.regexp_replace("content", r"\\(section|subsection|subsubsection)\*?\{", "\u0001$1\u0002")
    parts = files.select("paper_id", F.posexplode(F.split(marked, "\u0001")).alias("ord", "part")).where("ord > 0")
    level = F.expr("CASE substring_index(part, '\u0002', 1) WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 ELSE 3 END")
    rest = F.expr("substring(part, locate('\u0002', part) + 1)")
    rows = parts.select("paper_id", "ord", level.alias("level"), F.substring_index(rest, "}", 1).alias("title"), F.expr("trim(substring(substring(part, locate('\u0002', part) + 1), locate('}', substring(part, locate('\u0002', part) + 1)) + 1))").alias("body"))
    # a heading of a higher level starts a new scope, in which deeper titles of the old one don't count
    by_paper = Window.partitionBy("paper_id").orderBy("ord")
    rows = rows.withColumn("t1", F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(by_paper)).withColumn("g1", F.sum((F.col("level") == 1).cast("int")).over(by_paper))
    in_1 = Window.partitionBy("paper_id", "g1").orderBy("ord")
    rows = rows.withColumn("t2", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(in_1)).withColumn("g2", F.sum((F.col("level") <= 2).cast("int")).over(in_1))
    path = F.concat_ws(" > ", "t1", F.when(F.col("level") >= 2, F.when(F.col("level") == 2, F.col("title")).otherwise(F.col("t2"))), F.when(F.col("level") == 3, F.col("title")))
    return rows.select("paper_id", "ord", "level", "title", path.alias("section_path"), "body")


def braced(depth: int = 12) -> str:
    """A pattern of what stands between two braces, with pairs of braces nested so deep and escaped ones anywhere."""
    inner = r"(?:[^{}\\]++|\\.)*+"
    for _ in range(depth):
        inner = rf"(?:[^{{}}\\]++|\\.|\{{{inner}\}})*+"
    return inner


def latex_blocks(files: DataFrame) -> DataFrame:
    """paper_id, kind, ord, content, label: equations, captions of figures and tables, and citation keys of TeX files."""
    found = lambda kind, env: F.transform(
        F.regexp_extract_all("content", F.lit(rf"(?s)\\begin\{{({env})\*?\}}(.*?)\\end\{{\1\*?\}}"), 2),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("ord"),
            (F.trim(F.regexp_replace(x, r"\\label\{[^}]*\}", "")) if kind == "formula" else F.regexp_extract(x, rf"\\caption(?:\[[^\]]*\])?\{{({braced()})\}}", 1)).alias("content"),
            F.nullif(F.regexp_extract(x, r"\\label\{([^}]*)\}", 1), F.lit("")).alias("label"),
        ),
    )
    cites = F.transform(
        F.regexp_extract_all("content", F.lit(r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), 1),
        lambda x, i: F.struct(F.lit("cite").alias("kind"), i.alias("ord"), x.alias("content"), F.lit(None).cast("string").alias("label")),
    )
    blocks = F.concat(found("formula", "equation|align|gather"), found("figure", "figure"), found("table", "table"), cites)
    return strip_comments(files).select("paper_id", F.inline(blocks))


def citation_edges(blocks: DataFrame, most: int = 500) -> DataFrame:
    """paper_id, cite_key: distinct, the first `most` keys of a paper in alphabetical order."""
    keys = blocks.where("kind = 'cite'").select("paper_id", F.explode(F.split("content", r"\s*,\s*")).alias("cite_key"))
    keys = keys.where("trim(cite_key) <> ''").select("paper_id", F.trim("cite_key").alias("cite_key")).distinct()
    return keys.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("cite_key"))).where(F.col("n") <= most).drop("n")


def tabular_to_cells(blocks: DataFrame) -> DataFrame:
    """paper_id, ord, row, col, cell of table bodies, rules dropped and multicolumn cells unwrapped."""
    body = F.regexp_replace("content", r"\\(toprule|midrule|bottomrule|hline|cmidrule\S*|cline\{[^}]*\})", "")
    body = F.regexp_replace(body, r"\\multi(?:column|row)\{[^}]*\}\{[^}]*\}\{([^{}]*)\}", "$1")
    rows = blocks.select("paper_id", "ord", F.posexplode(F.split(body, r"\\\\")).alias("row", "line")).where("trim(line) <> ''")
    return rows.select("paper_id", "ord", "row", F.posexplode(F.split("line", r"(?<!\\)&")).alias("col", "cell")).withColumn("cell", F.trim(F.regexp_replace("cell", r"\s+", " ")))


def macro_usage(files: DataFrame, most_chars: int = 60) -> tuple[DataFrame, DataFrame]:
    """Short argument-less macros with their use counts, and the files with them expanded, longest name first."""
    pattern = rf"(?s)\\(?:newcommand|renewcommand|def)\*?\{{?\\([A-Za-z]+)\}}?\{{({braced()})\}}"
    names, bodies = F.regexp_extract_all("content", F.lit(pattern), 1), F.regexp_extract_all("content", F.lit(pattern), 2)
    macros = F.filter(F.arrays_zip(names.alias("name"), bodies.alias("body")), lambda m: F.length(m["body"]) <= most_chars)
    held = files.withColumn("macros", F.array_sort(F.transform(macros, lambda m: F.struct((-F.length(m["name"])).alias("k"), m["name"].alias("name"), m["body"].alias("body")))))
    rest = F.regexp_replace("content", pattern, "")
    used = held.select("paper_id", rest.alias("rest"), F.inline("macros")).select(
        "paper_id", "name", "body", F.size(F.regexp_extract_all("rest", F.concat(F.lit(r"(\\"), F.col("name"), F.lit(r")(?![A-Za-z])")), 1)).alias("n_uses")
    )
    expanded = F.aggregate(
        "macros", rest,
        lambda text, m: F.regexp_replace(text, F.concat(F.lit(r"\\"), m["name"], F.lit(r"(?![A-Za-z])")), F.regexp_replace(m["body"], r"([\\$])", r"\\$1")),
    )
    return used, held.select("paper_id", expanded.alias("content"))
