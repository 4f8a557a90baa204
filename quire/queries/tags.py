"""Queries of group I: tags, facets, browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import normalize_title
from quire.operators import tags as T
from quire.queries.registry import registry
from quire.views import with_views

QUERIES, ORACLES, query = registry()


def _tags(lib):
    alias = F.when(F.col("dimension") == "venue", F.array(F.concat(F.lit("Venue "), F.regexp_extract("name", r"\d+", 0)))).otherwise(F.array().cast("array<string>"))
    return lib.tags.select(F.concat("dimension", F.lit(":"), "name").alias("tag_id"), "name", alias.alias("aliases"))


def _names(lib):
    """Each source in three spellings, one of which no tag knows."""
    n = F.col("source")
    return lib.table("documents").select(F.col("doc_id").alias("paper_id"), F.expr("element_at(array(upper(source), concat('venue ', substring(source, 4)), concat('Other ', lang)), CAST(doc_id % 3 + 1 AS int))").alias("name"), n)


_NAMES = "n AS (SELECT doc_id AS paper_id, source, lang, doc_id % 3 AS k, CASE doc_id % 3 WHEN 0 THEN upper(source) WHEN 1 THEN 'venue ' || substr(source, 4) ELSE 'Other ' || lang END AS name FROM documents)"


@query("i1_resolve_tags", f"WITH {_NAMES}\nSELECT DISTINCT name, 'venue:' || source AS tag_id FROM n WHERE k < 2")
def _(lib):
    return T.resolve_tags(_names(lib), _tags(lib))


@query("i2_attach_tags", f"WITH {_NAMES}\nSELECT DISTINCT paper_id, CASE WHEN k < 2 THEN 'venue:' || source ELSE 'other-' || lang END AS tag_id FROM n")
def _(lib):
    links = lib.spark.createDataFrame([], "paper_id long, tag_id string")
    return T.attach_tags(links, _names(lib), _tags(lib))[0]


@query("i2_grown_tags", with_views("tags", f"{_NAMES}\nSELECT count(*) AS n_tags, sum(n_aliases)::BIGINT AS n_aliases FROM (SELECT CASE WHEN dimension = 'venue' THEN 1 + (SELECT count(DISTINCT name) FROM n WHERE k = 1 AND n.source = tags.name) ELSE 0 END AS n_aliases FROM tags UNION ALL SELECT DISTINCT 0 FROM n WHERE k = 2 GROUP BY lang)").replace("SELECT DISTINCT 0 FROM n WHERE k = 2 GROUP BY lang", "SELECT 0 FROM n WHERE k = 2 GROUP BY lang"))
def _(lib):
    links = lib.spark.createDataFrame([], "paper_id long, tag_id string")
    grown = T.attach_tags(links, _names(lib), _tags(lib))[1]
    return grown.agg(F.count("*").alias("n_tags"), F.sum(F.size("aliases")).alias("n_aliases"))


def _pairs(lib):
    return T.paper_tag_pairs(lib.paper_tags, lib.note_tags, lib.notes)


@query("i3_paper_tag_pairs", with_views("pairs", "SELECT paper_id, tag FROM pairs"))
def _(lib):
    return _pairs(lib)


_FACETS = "f AS (SELECT dimension, name, (SELECT count(DISTINCT p.paper_id) FROM pairs p JOIN live l ON p.paper_id = l.paper_id WHERE p.tag = tags.name) AS n_papers FROM tags)\n"


@query("i4_tag_facets", with_views("live pairs tags", _FACETS + "SELECT * FROM f"))
def _(lib):
    return T.tag_facets(_pairs(lib), lib.tags, lib.live)


@query("i5_papers_with_all_tags", with_views("pairs", "SELECT paper_id FROM pairs WHERE tag IN ('en', 'toxic') GROUP BY 1 HAVING count(DISTINCT tag) = 2"))
def _(lib):
    return T.papers_with_all_tags(_pairs(lib), ["en", "toxic"])


@query("i6_usage_counts", with_views("paper_tags note_tags", "SELECT tag, count(*) AS n FROM (SELECT tag FROM paper_tags UNION ALL SELECT tag FROM note_tags) GROUP BY 1"))
def _(lib):
    return T.usage_counts(lib.paper_tags, lib.note_tags)


_TREE = "t AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS tag_id, source AS name, CASE WHEN substr(source, 4) = '0' THEN NULL WHEN substr(source, 4) IN ('18', '19') THEN 37 - CAST(substr(source, 4) AS BIGINT) ELSE CAST(substr(source, 4) AS BIGINT) // 2 END AS parent_id FROM documents)"


@query("i7_tag_tree", f"WITH RECURSIVE {_TREE}, r AS (SELECT tag_id, 0 AS depth, name AS path FROM t WHERE parent_id IS NULL UNION ALL SELECT t.tag_id, depth + 1, path || ' / ' || t.name FROM t JOIN r ON t.parent_id = r.tag_id) SELECT * FROM r")
def _(lib):
    n = F.substring("source", 4, 9).cast("long")
    tree = lib.table("documents").select(n.alias("tag_id"), F.col("source").alias("name"), F.when(n == 0, None).when(n >= 18, 37 - n).otherwise(F.floor(n / 2)).alias("parent_id")).distinct()
    return T.tag_tree(tree)


@query("i8_list_tags", with_views("tags", "SELECT name FROM tags WHERE dimension = 'venue' AND name ILIKE '%1%'"))
def _(lib):
    return lib.tags.where((F.col("dimension") == "venue") & F.col("name").ilike("%1%")).select("name").orderBy("name")


def _suggestions(lib):
    return lib.table("documents").select(
        F.col("doc_id").alias("target"), F.col("source").alias("name"), F.lit("venue").alias("dimension"), (F.col("doc_id") % 10 / 10).alias("confidence"),
        F.expr("CASE WHEN doc_id % 97 = 0 THEN 'rejected' ELSE 'pending' END").alias("status"),
    )


@query("i9_admit_suggestions", """WITH e AS (SELECT doc_id, source, CASE WHEN doc_id % 97 = 0 THEN 'rejected' ELSE 'pending' END AS s FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS target, source AS name, 'venue:' || source AS tag_id FROM documents WHERE source NOT IN (SELECT source FROM e WHERE s = 'rejected') AND doc_id NOT IN (SELECT doc_id FROM e WHERE s = 'pending')""")
def _(lib):
    all_ = _suggestions(lib)
    return T.admit_suggestions(all_.drop("status"), all_.where("target % 3 = 0"), _tags(lib)).select("target", "name", "tag_id")


@query("i10_suggestion_stats", """WITH s AS (SELECT CASE WHEN doc_id % 97 = 0 THEN 'rejected' WHEN doc_id % 10 = 0 OR doc_id % 10 >= 7 THEN 'accepted' ELSE 'pending' END AS status FROM documents)
SELECT 'venue' AS dimension, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM s""")
def _(lib):
    return T.suggestion_stats(T.resolve_suggestions(_suggestions(lib), 0.7))


@query("i11_default_dimension", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'misc' ELSE lang END AS dimension FROM documents")
def _(lib):
    return lib.table("documents").select("doc_id", T.default_dimension(F.expr("CASE doc_id % 8 WHEN 0 THEN NULL WHEN 4 THEN '  ' ELSE lang END")).alias("dimension"))


@query("i12_import_tags", with_views("paper_tags notes", "SELECT paper_id, tag FROM paper_tags UNION SELECT paper_id, kind FROM notes WHERE paper_id IS NOT NULL UNION SELECT paper_id, 'note' FROM notes WHERE paper_id IS NOT NULL"))
def _(lib):
    notes = lib.notes.withColumn("tags", F.array(F.concat(F.lit(" "), "kind"), F.lit("note"), F.lit(" ")))
    return T.import_tags_from_notes(notes, lib.paper_tags)


@query("i13_list_papers", with_views("live notes", "SELECT paper_id FROM live WHERE year >= 2010 AND paper_id IN (SELECT paper_id FROM notes) AND paper_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)"))
def _(lib):
    without = lib.vectors.where("label = 3").select(F.col("chunk_id").alias("paper_id"))
    return T.list_papers(lib.papers, F.col("year") >= 2010, lib.notes, without).select("paper_id")


@query("i14_keyset_page", with_views("live", "SELECT paper_id, k FROM (SELECT paper_id, coalesce(year, -1) AS k, row_number() OVER (ORDER BY coalesce(year, -1) DESC, paper_id DESC) AS n FROM live) WHERE n > 25 AND n <= 50"))
def _(lib):
    key = F.coalesce(F.col("year"), F.lit(-1))
    _, cursor = T.keyset_page(lib.live, key, "k", "paper_id", 25)
    return T.keyset_page(lib.live, key, "k", "paper_id", 25, cursor)[0].select("paper_id", "k")


@query("i13_list_page", with_views("live notes", """r AS (SELECT paper_id, coalesce(year, -1) AS sort_key FROM live WHERE venue IS NOT NULL AND paper_id IN (SELECT paper_id FROM notes)),
k AS (SELECT *, row_number() OVER (ORDER BY sort_key, paper_id) AS n, count(*) OVER () AS total FROM r) SELECT paper_id, sort_key, total FROM k WHERE n > 10 AND n <= 20"""))
def _(lib):
    """The second page of ten, from the oldest year, and the number of all."""
    filters = {"where": F.col("venue").isNotNull(), "having": lib.notes}
    _, cursor, total = T.list_page(lib.papers, "year_asc", 10, **filters)
    page, _, _ = T.list_page(lib.papers, "year_asc", 10, cursor, **filters)
    return page.select("paper_id", "sort_key", F.lit(total).cast("long").alias("total"))


@query("i15_list_notes", with_views("notes", "SELECT note_id FROM notes WHERE kind = 'manual' OR paper_id IS NULL"))
def _(lib):
    return lib.notes.where("kind = 'manual' OR paper_id IS NULL").select("note_id")


@query("i16_filter_options", with_views("papers", "SELECT DISTINCT 'year' AS kind, CAST(year AS VARCHAR) AS value FROM papers WHERE year IS NOT NULL UNION ALL SELECT * FROM (SELECT DISTINCT 'venue', venue FROM papers ORDER BY 2 LIMIT 200)"))
def _(lib):
    return T.filter_options(lib.papers)


@query("i17_paper_detail", with_views("papers pairs notes", """SELECT p.paper_id, p.title, t.tags, n.notes FROM papers p LEFT JOIN (SELECT paper_id, list_sort(list(tag)) AS tags FROM pairs GROUP BY 1) t ON p.paper_id = t.paper_id
LEFT JOIN (SELECT paper_id, array_to_string(list(note_id || ':' || kind ORDER BY note_id), ',') AS notes FROM notes WHERE paper_id IS NOT NULL GROUP BY 1) n ON p.paper_id = n.paper_id"""))
def _(lib):
    d = T.paper_detail(lib.papers, _pairs(lib), lib.notes)
    return d.select("paper_id", "title", "tags", F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["note_id"], n["kind"])), ",").alias("notes"))


def _patches(lib):
    """One patch for each fourth paper, and before it another for each eighth."""
    seq = F.explode(F.when(F.col("paper_id") % 8 == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    return lib.papers.where("paper_id % 4 = 0").select("paper_id", "year", "venue", seq.alias("seq")).select("paper_id", "seq", F.expr("CASE WHEN paper_id % 8 = 0 THEN 'year' ELSE 'venue' END").alias("column"), F.expr("CASE WHEN paper_id % 16 = 0 THEN 'bad' WHEN paper_id % 8 = 0 THEN '1999' WHEN seq = 1 THEN 'zzz' ELSE 'x' END").alias("value"))


@query("i18_update_rows", with_views("papers", "SELECT paper_id, CASE WHEN paper_id % 16 = 8 THEN 1999 ELSE year END AS year, CASE WHEN paper_id % 8 = 4 THEN 'x' ELSE venue END AS venue FROM papers"))
def _(lib):
    allowed = {"year": F.col("value").rlike(r"^\d{4}$"), "venue": F.length("value") < 100}
    return T.update_rows(lib.papers.select("paper_id", "year", "venue"), _patches(lib), "paper_id", allowed)[0]


@query("i18_derived_title", with_views("papers", """SELECT paper_id, CASE WHEN paper_id % 6 = 0 THEN 'A New, Title: ' || paper_id ELSE title END AS title,
  CASE WHEN paper_id % 6 = 0 THEN 'a new title ' || paper_id ELSE title_norm END AS title_norm FROM papers"""))
def _(lib):
    """Changed titles take their normalised form along; a patch that changes nothing doesn't."""
    rows = lib.papers.select("paper_id", "title", "title_norm")
    new = F.when(F.col("paper_id") % 6 == 0, F.concat(F.lit("A New, Title: "), "paper_id")).otherwise(F.col("title"))
    patches = rows.where("paper_id % 3 = 0").select("paper_id", F.lit(1).alias("seq"), F.lit("title").alias("column"), new.alias("value"))
    return T.update_rows(rows, patches, "paper_id", {"title": F.col("value").isNotNull()}, {"title_norm": ("title", normalize_title(F.col("title")))})[0]


_ACTIONS = "CASE paper_id % 10 WHEN 0 THEN array('delete', 'restore') WHEN 1 THEN array('restore', 'delete') WHEN 2 THEN array('purge') WHEN 3 THEN array('purge', 'restore') WHEN 4 THEN array('other') ELSE array() END"


def _lifecycle(lib):
    actions = lib.papers.select("paper_id", F.posexplode(F.expr(_ACTIONS)).alias("seq", "action"))
    return T.apply_lifecycle(lib.papers.select("paper_id", "deleted"), lib.notes.select("note_id", "paper_id"), actions)


@query("i18_lifecycle", with_views("papers", "SELECT paper_id, CASE paper_id % 10 WHEN 0 THEN false WHEN 1 THEN true ELSE deleted END AS deleted FROM papers WHERE paper_id % 10 NOT IN (2, 3)"))
def _(lib):
    return _lifecycle(lib)[0]


@query("i18_freed_notes", with_views("notes", "SELECT note_id, CASE WHEN paper_id % 10 IN (2, 3) THEN NULL ELSE paper_id END AS paper_id FROM notes"))
def _(lib):
    return _lifecycle(lib)[1]


@query("i18_rejected_patches", "SELECT doc_id AS paper_id FROM documents WHERE doc_id % 16 = 0")
def _(lib):
    allowed = {"year": F.col("value").rlike(r"^\d{4}$"), "venue": F.length("value") < 100}
    return T.update_rows(lib.papers.select("paper_id", "year", "venue"), _patches(lib), "paper_id", allowed)[1].select("paper_id")


@query("j4_by_tag_dimension", with_views("live pairs tags", _FACETS.rstrip() + "\nSELECT dimension, name, n_papers FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n_papers DESC, name) AS k FROM f WHERE n_papers > 0) WHERE k <= 8"))
def _(lib):
    return T.top_by_dimension(_pairs(lib), lib.tags, lib.live)


@query("q1_check_facets", with_views("live pairs tags", _FACETS + "SELECT name FROM f WHERE false"))
def _(lib):
    """Tags whose facet differs from a count of its papers: none."""
    facets = T.tag_facets(_pairs(lib), lib.tags, lib.live)
    counted = _pairs(lib).join(lib.live.select("paper_id"), "paper_id").groupBy("tag").agg(F.count("*").alias("n"))
    return facets.join(counted, facets["name"] == counted["tag"], "left").where(F.col("n_papers") != F.coalesce("n", F.lit(0))).select("name")


@query("q2_untagged_papers", with_views("live pairs", "SELECT paper_id FROM live WHERE paper_id NOT IN (SELECT paper_id FROM pairs WHERE tag = 'toxic')"))
def _(lib):
    return lib.live.join(_pairs(lib).where("tag = 'toxic'"), "paper_id", "left_anti").select("paper_id")
