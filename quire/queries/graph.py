"""Queries of group K: entities, flags, note history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import graph as K
from quire.queries.registry import registry
from quire.sources.snapshot import rewritten

QUERIES, ORACLES, query = registry()

_NORM = r"trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g'))"
_ENT = f"""WITH ws AS (SELECT doc_id, name, i FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), LATERAL (SELECT unnest(w) AS name, unnest(range(1, len(w) + 1)) AS i)),
raw AS (SELECT doc_id * 10000000 + i AS seq, name, CASE WHEN i % 2 = 0 THEN 'concept' ELSE 'method' END AS type, {_NORM} AS norm FROM ws),
e AS (SELECT norm, arg_min(name, seq) AS name, arg_min(type, seq) AS type, count(*) AS n FROM raw WHERE length(norm) >= 3 AND norm NOT IN ({", ".join(repr(g) for g in K.GENERIC)}) GROUP BY norm),
rel AS (SELECT a.doc_id AS note_id, a.norm AS src, b.norm AS dst, CASE WHEN a.i % 2 = 0 THEN 'uses' ELSE 'extends' END AS type FROM (SELECT doc_id, i, {_NORM} AS norm FROM ws) a JOIN (SELECT doc_id, i, {_NORM} AS norm FROM ws) b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  WHERE a.norm IN (SELECT norm FROM e) AND b.norm IN (SELECT norm FROM e) AND a.norm <> b.norm),
edges AS (SELECT src, dst, type, count(*) AS weight FROM rel GROUP BY ALL)
"""


def _mentions(lib):
    """Every word of every document."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    flat = lib.table("documents").select("doc_id", F.posexplode(words).alias("i", "name")).withColumn("i", F.col("i") + 1)
    return flat.select("doc_id", "i", (F.col("doc_id") * 10_000_000 + F.col("i")).alias("seq"), "name", F.when(F.col("i") % 2 == 0, "concept").otherwise("method").alias("type"), F.array().cast("array<string>").alias("aliases"))


def _relations(lib, entities):
    """Every pair of neighbouring words."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    # bound to names inside, so that the words are taken and normalised once
    follow = lambda w, n: F.transform(w, lambda x, i: F.struct(x.alias("name"), F.get(w, i + 1).alias("dst"), F.get(n, i).alias("a"), F.get(n, i + 1).alias("b"), (i + 1).alias("i")))
    pairs = F.transform(F.array(F.struct(words.alias("w"), K.normalize_words(F.col("text")).alias("n"))), lambda x: follow(x["w"], x["n"]))[0]
    flat = lib.table("documents").select("doc_id", F.inline(pairs)).where("dst IS NOT NULL")
    raw = flat.select(F.col("doc_id").alias("note_id"), F.col("name").alias("src"), "dst", "a", "b", F.when(F.col("i") % 2 == 0, "uses").otherwise("extends").alias("type"), F.concat_ws(" ", "name", "dst").alias("quote"))
    return K.build_relations(raw, entities)


@query("k1_normalize_entity", _ENT + "SELECT DISTINCT norm FROM raw")
def _(lib):
    return _mentions(lib).select(K.normalize_entity(F.col("name")).alias("norm")).distinct()


@query("k2_build_entities", _ENT + "SELECT norm, name, type, n FROM e")
def _(lib):
    return K.build_entities(_mentions(lib)).select("norm", "name", "type", "n")


@query("k3_build_relations", _ENT + "SELECT src, dst, type, weight FROM edges")
def _(lib):
    return _relations(lib, K.build_entities(_mentions(lib))).select("src", "dst", "type", "weight")


@query("k4_replace_links", "SELECT DISTINCT doc_id AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS norm FROM documents")
def _(lib):
    links = lib.table("documents").select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("norm"))
    return K.replace_links(links, links.where("paper_id % 2 = 0").withColumn("norm", F.lit("new")), "paper_id")


@query("k5_pending_graph", "SELECT doc_id AS note_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(lib):
    return lib.notes.join(lib.vectors.select(F.col("chunk_id").alias("note_id")), "note_id", "left_anti").select("note_id")


@query("k6_top_entities", _ENT + "SELECT norm, n FROM e ORDER BY n DESC, norm LIMIT 25")
def _(lib):
    return K.build_entities(_mentions(lib)).select("norm", "n").orderBy(F.desc("n"), "norm").limit(25)


@query("k7_entity_detail", _ENT + "SELECT src AS norm, 'out' AS direction, dst AS other, type, weight FROM edges WHERE starts_with(src, 'th') UNION ALL SELECT dst, 'in', src, type, weight FROM edges WHERE starts_with(dst, 'th')")
def _(lib):
    entities = rewritten(K.build_entities(_mentions(lib)))  # for the relations, and for those that are asked
    return K.entity_detail(_relations(lib, entities), entities.where("norm LIKE 'th%'").select("norm"))


def _marked(lib):
    """Documents as notes: each seventh line marked, each fifth a heading."""
    md = F.array_join(
        F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("- " + K.MARK + " 待核："), x)).when(i % 5 == 0, F.concat(F.lit("## S"), i.cast("string"))).otherwise(x)), "\n"
    )
    return lib.table("documents").select(F.col("doc_id").alias("note_id"), md.alias("content_md"))




@query("k8_extract_flags")
def _(lib):
    return K.extract_flags(_marked(lib))


@query("k9_flag_summary", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id AS note_id, count(DISTINCT ((i // 5 + CASE WHEN (i // 5 * 5) % 7 = 3 THEN -1 ELSE 0 END), trim(x, ' -—·' || chr(9)))) AS n FROM l WHERE i % 7 = 3 AND trim(x, ' -—·' || chr(9)) <> '' GROUP BY 1""")
def _(lib):
    flags = K.extract_flags(_marked(lib))
    return K.flags_with_state(flags, flags.limit(0).select("flag_id", F.lit("done").alias("state"))).groupBy("note_id").agg(F.count("*").alias("n"))


@query("k10_mark_flags", "SELECT doc_id AS flag_id, CASE WHEN doc_id % 6 = 0 THEN 'ignored' WHEN doc_id % 6 = 2 THEN 'done' ELSE 'done' END AS state FROM documents WHERE doc_id % 6 <> 4")
def _(lib):
    ids = lib.table("documents").select(F.col("doc_id").alias("flag_id"))
    states = ids.select("flag_id", F.lit("done").alias("state"), F.lit("").alias("comment"))
    marks = ids.where("flag_id % 2 = 0").select("flag_id", F.expr("element_at(array('ignored', 'whatever', 'none'), CAST(flag_id div 2 % 3 + 1 AS int))").alias("state"), F.lit("c").alias("comment"))
    return K.mark_flags(states, marks).select("flag_id", "state")


def _history(lib):
    notes = lib.table("documents").select(F.col("doc_id").alias("note_id"), (F.col("doc_id") % 4 + 1).alias("version"), F.col("text").alias("content"))
    edits = notes.where("note_id % 3 = 0").select("note_id", F.lit(1).alias("seq"), F.expr("CASE WHEN note_id % 2 = 0 THEN version ELSE 99 END").alias("expected_version"), F.expr("CASE WHEN note_id % 9 = 0 THEN content ELSE concat(content, '\n', 'added') END").alias("new_content"))
    return notes, K.apply_edits(notes, edits)


#: After up to three edits: the first as above; a second that expects what the first makes; a third that expects nothing.
_REPLAY = """WITH a AS (SELECT doc_id, 1 + doc_id % 4 AS v, doc_id % 6 = 0 AND doc_id % 9 <> 0 AS first, doc_id % 3 = 0 AND doc_id % 2 = 1 AS clash, doc_id % 5 = 0 AS asks, doc_id % 7 = 0 AS third, text FROM documents)"""


def _replayed(lib):
    notes = lib.table("documents").select(F.col("doc_id").alias("note_id"), (F.col("doc_id") % 4 + 1).alias("version"), F.col("text").alias("content"))
    first = notes.where("note_id % 3 = 0").selectExpr("note_id", "1 AS seq", "CASE WHEN note_id % 2 = 0 THEN version ELSE 99 END AS expected_version", "CASE WHEN note_id % 9 = 0 THEN content ELSE concat(content, '\n', 'added') END AS new_content")
    second = notes.where("note_id % 5 = 0").selectExpr("note_id", "2 AS seq", "version + 1 AS expected_version", "'a second text' AS new_content")
    third = notes.where("note_id % 7 = 0").selectExpr("note_id", "3 AS seq", "CAST(NULL AS LONG) AS expected_version", "'a third one' AS new_content")
    return K.apply_edits(notes, third.unionByName(first).unionByName(second))


@query("k11_apply_edits", _REPLAY + """ SELECT doc_id AS note_id, v + first::INT + (first AND asks)::INT + third::INT AS version,
  CASE WHEN third THEN 11 WHEN first AND asks THEN 13 WHEN first THEN length(text) + 6 ELSE length(text) END AS n FROM a""")
def _(lib):
    return _replayed(lib)[0].select("note_id", "version", F.length("content").cast("long").alias("n"))


@query("k11_conflicts", _REPLAY + " SELECT doc_id AS note_id, v AS version, 99 AS expected_version FROM a WHERE clash UNION ALL SELECT doc_id, v, v + 1 FROM a WHERE asks AND NOT first")
def _(lib):
    return _replayed(lib)[2]


@query("k11_revisions", _REPLAY + """ SELECT doc_id AS note_id, v AS version, length(text) AS n FROM a WHERE first UNION ALL SELECT doc_id, v + 1, length(text) + 6 FROM a WHERE first AND asks
UNION ALL SELECT doc_id, v + first::INT + (first AND asks)::INT, CASE WHEN first AND asks THEN 13 WHEN first THEN length(text) + 6 ELSE length(text) END FROM a WHERE third""")
def _(lib):
    return _replayed(lib)[1].select("note_id", "version", F.length("content").cast("long").alias("n"))


@query("k12_content_at", "SELECT doc_id AS note_id, sha256(CASE WHEN doc_id % 4 = 1 THEN text ELSE text || chr(10) || 'added' END) AS h FROM documents WHERE doc_id % 4 = 1 OR (doc_id % 4 = 0 AND doc_id % 6 = 0 AND doc_id % 9 <> 0)")
def _(lib):
    notes, (now, revisions, _) = _history(lib)
    return K.content_at(now, revisions, 2).select("note_id", F.sha2("content", 256).alias("h"))


@query("k12_restore", "SELECT doc_id AS note_id, 3 + doc_id % 4 AS version, length(text) AS n FROM documents WHERE doc_id % 6 = 0 AND doc_id % 9 <> 0 AND doc_id % 4 = 2")
def _(lib):
    """Notes of version 3 whose edit made them version 4, back at the content of version 3."""
    notes, (now, revisions, _) = _history(lib)
    edits = K.restore(now, revisions, 3)
    return K.apply_edits(now, edits)[0].join(edits, "note_id", "left_semi").select("note_id", "version", F.length("content").cast("long").alias("n"))


@query("q3_check_versions", "SELECT doc_id AS note_id, 1 + doc_id % 4 AS version, 1 + doc_id % 4 AS highest FROM documents WHERE doc_id % 6 = 0 AND doc_id % 9 <> 0 AND doc_id % 5 = 0")
def _(lib):
    """Each fifth note as if its version had not been raised by its edit."""
    notes, (now, revisions, _) = _history(lib)
    kept = F.when(F.col("note_id") % 5 == 0, F.col("old")).otherwise(F.col("version"))
    return K.check_versions(now.join(notes.select("note_id", F.col("version").alias("old")), "note_id").select("note_id", kept.alias("version")), revisions)


@query("k13_revision_diff", "SELECT doc_id AS note_id, CASE WHEN doc_id % 6 = 0 AND doc_id % 9 <> 0 THEN 1 ELSE 0 END::BIGINT AS added, 0::BIGINT AS removed FROM documents")
def _(lib):
    notes, (now, _, _) = _history(lib)
    return K.revision_diff(notes, now, "note_id")


@query("k14_sync_state", """WITH s AS (SELECT doc_id, doc_id % 5 AS k FROM documents)
SELECT doc_id AS note_id, CASE k WHEN 0 THEN 'clean' WHEN 1 THEN 'missing' WHEN 2 THEN 'modified' WHEN 3 THEN 'dirty' ELSE 'conflict' END AS state FROM s""")
def _(lib):
    ids = lib.table("documents").select(F.col("doc_id").alias("note_id"))
    k = F.col("note_id") % 5
    disk = ids.where(k != 1).select("note_id", F.when(k.isin(2, 4), "disk").otherwise("base").alias("hash"))
    library = ids.select("note_id", F.when(k.isin(3, 4), "library").otherwise("base").alias("hash"))
    return K.sync_state(disk, library, ids.select("note_id", F.lit("base").alias("hash")))
