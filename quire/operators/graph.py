"""Entities and relations, review flags, note history and sync state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.snapshot import rewritten

#: Names too general to be an entity.
GENERIC = ("method", "model", "approach", "paper", "result", "results", "dataset", "framework", "system", "this", "that")


def normalize_entity(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normalize_words(text: Column) -> Column:
    """normalize_entity of each run of \\S of a text, in one pass over it."""
    # a mark stands for what is neither letter, digit nor white space, so that words stay as many as they are
    marked = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", "\u0001")
    return F.transform(F.regexp_extract_all(marked, F.lit(r"\S+"), 0), lambda w: F.trim(F.replace(w, F.lit("\u0001"), F.lit(" "))))


def is_useful(norm: Column) -> Column:
    return (F.length(norm) >= 3) & ~norm.isin(*GENERIC)


def build_entities(raw: DataFrame) -> DataFrame:
    """norm, name, type, aliases, n from raw mentions (seq, name, type, aliases): the first spelling names it.

    An alias never joins two entities: a double is better than a wrong merge.
    """
    norm = normalize_entity(F.col("name")).alias("norm")
    # spellings are counted before they are normalised and before anything moves: a frequent one is one row per task; a
    # filter on what an explode makes isn't evaluated below the count
    spelt = raw.groupBy("name", "type").agg(F.min("seq").alias("seq"), F.count("*").alias("n")).select("*", F.explode(F.array(norm)).alias("norm"))
    named = spelt.where(is_useful(F.col("norm"))).groupBy("norm").agg(F.min(F.struct("seq", "name", "type")).alias("f"), F.sum("n").alias("n"))
    aliased = raw.where(F.size("aliases") > 0).select(norm, F.explode("aliases").alias("a")).where(is_useful(F.col("norm")))
    aliases = aliased.distinct().groupBy("norm").agg(F.sort_array(F.collect_list("a")).alias("aliases"))
    return named.join(aliases, "norm", "left").select(
        "norm", F.col("f.name").alias("name"), F.col("f.type").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "n", F.col("f.seq").alias("seq")
    )


def alias_map(entities: DataFrame) -> DataFrame:
    """key, norm: an entity's own norm, else the first-seen entity that has the alias."""
    own = entities.select(F.col("norm").alias("key"), F.lit(0).alias("p"), "seq", "norm")
    other = entities.select(F.explode("aliases").alias("a"), "seq", "norm").select(normalize_entity(F.col("a")).alias("key"), F.lit(1).alias("p"), "seq", "norm")
    return own.unionByName(other).groupBy("key").agg(F.min(F.struct("p", "seq", "norm"))["norm"].alias("norm"))


def build_relations(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, type, weight, evidence from raw relations (note_id, src, dst, type, quote); unresolved, empty and self
    edges are dropped. Evidence holds the first 20 quotes in order, weight counts all. raw may bring a and b, which are
    src and dst normalised."""
    keys = rewritten(alias_map(entities))  # looked up four times
    rows = raw.where("src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL")
    if "a" not in raw.columns:
        rows = rows.select("*", F.inline(F.array(F.struct(normalize_entity(F.col("src")).alias("a"), normalize_entity(F.col("dst")).alias("b")))))
    rows = rows.where("a <> b")
    # only an alias can be a key that is no useful name, or stand for another one
    if keys.where(~is_useful(F.col("key"))).isEmpty():
        rows = rows.where(is_useful(F.col("a")) & is_useful(F.col("b")))
    rows = rows.where("trim(quote) <> ''").select("a", "b", "type", "note_id", F.substring("quote", 1, 500).alias("quote"))
    own = keys.where("key <> norm").isEmpty()

    def resolved(df: DataFrame) -> DataFrame:
        if own:
            df = df.join(keys.select(F.col("key").alias("a")), "a", "left_semi").join(keys.select(F.col("key").alias("b")), "b", "left_semi")
            return df.withColumnsRenamed({"a": "src", "b": "dst"})
        src = df.join(keys.select(F.col("key").alias("a"), F.col("norm").alias("src")), "a")
        return src.join(keys.select(F.col("key").alias("b"), F.col("norm").alias("dst")), "b").where("src <> dst").drop("a", "b")

    def first(df: DataFrame, *by: str) -> DataFrame:
        # a limited rank keeps so many rows of each key in a task before they move
        return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("note_id", "quote"))).where("k <= 20").drop("k")

    # names are counted before they are resolved, so that a frequent pair moves as one row per task
    weights = resolved(rows.groupBy("a", "b", "type").agg(F.count("*").alias("weight")))
    quotes = resolved(first(rows, "a", "b", "type"))
    if not own:
        weights, quotes = weights.groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight")), first(quotes, "src", "dst", "type")
    evidence = quotes.groupBy("src", "dst", "type").agg(F.array_sort(F.collect_list(F.struct("note_id", "quote"))).alias("evidence"))
    return weights.join(evidence, ["src", "dst", "type"], "left")


def replace_links(links: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """links with all rows of the keys in new replaced by new, each once."""
    return links.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*links.columns)).distinct()


def entity_detail(relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """norm, direction, other, type, weight for wanted entities (norm)."""
    out = relations.select(F.col("src").alias("norm"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "type", "weight")
    into = relations.select(F.col("dst").alias("norm"), F.lit("in").alias("direction"), F.col("src").alias("other"), "type", "weight")
    return out.unionByName(into).join(wanted, "norm", "left_semi")


# ---- review flags ----

#: The mark, the section before the first heading, and what decides the class of a flag, in this order.
MARK = "⚠️"
PREFACE = "（前言）"
FLAG_KINDS = (
    ("paper", r"(对不上|矛盾|不吻合|不一致|缺(?:乏)?证据|反直觉|有偏|偏差|归属|未说明|未明确|歧义|应(?:该)?落|差\s*[\d.]+|不成立|可疑|张力)"),
    ("repro", r"(超参|复现必需|未给出.{0,6}(?:取值|数值|配置)|参数未|配置未|复现时)"),
    ("unavailable", r"(提供|给定|摘录|截断|原文|正文|文本|转录|排版|图表?未|表号|Tab\.|Table|图\s*\[|<ref>|未含|未见|未出现|无法核对|不可得|节选|缺失)"),
)


def extract_flags(notes: DataFrame, mark: str = MARK) -> DataFrame:
    """flag_id, note_id, section, text, kind of the marked lines of notes (note_id, content_md)."""
    lines = notes.where(F.contains("content_md", F.lit(mark))).select("note_id", F.posexplode(F.split("content_md", r"\r?\n")).alias("n", "line"))
    heading = F.nullif(F.regexp_extract("line", r"^#{2,3}\s+(.+?)\s*$", 1), F.lit(""))
    lines = lines.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(Window.partitionBy("note_id").orderBy("n")))
    text = F.regexp_replace(F.trim("line"), r"^[-*+]\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^\[[ xX]\]\s*", ""), mark + r"\s*待核[：:]?", "")
    text = F.regexp_replace(text, r"^[ \-—·\t]+|[ \-—·\t]+$", "")
    marked = lines.where(F.col("heading").isNull() & F.contains("line", F.lit(mark)))
    rows = marked.select("note_id", F.coalesce("section", F.lit(PREFACE)).alias("section"), text.alias("text")).where("text <> ''")
    kind = F.lit("other")
    for name, pattern in reversed(FLAG_KINDS):
        kind = F.when(F.col("text").rlike(pattern), name).otherwise(kind)
    flag_id = F.substring(F.sha2(F.concat_ws("\u0000", F.col("note_id").cast("string"), "section", "text"), 256), 1, 16)
    return rows.select(flag_id.alias("flag_id"), "note_id", "section", "text", kind.alias("kind")).distinct()


def flags_with_state(flags: DataFrame, states: DataFrame) -> DataFrame:
    return flags.join(states.select("flag_id", "state"), "flag_id", "left").withColumn("state", F.coalesce("state", F.lit("open")))


def mark_flags(states: DataFrame, marks: DataFrame) -> DataFrame:
    """states after marks (flag_id, state, comment): unknown states are done, comments are cut; none unmarks."""
    clean = marks.withColumn("state", F.when(F.col("state").isin("done", "ignored", "none"), F.col("state")).otherwise("done")).withColumn("comment", F.substring("comment", 1, 1024))
    return states.join(clean, "flag_id", "left_anti").unionByName(clean.where("state <> 'none'").select(*states.columns))


# ---- history ----


def apply_edits(notes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """notes, revisions, conflicts after edits (note_id, seq, expected_version, new_content), applied in turn by seq.

    An edit that expects another version than its note has by then is a conflict and changes nothing; one that brings no
    new content is ignored; else the old content becomes a revision and the version grows by one. Edits of unknown notes
    are ignored.

    The notes and their edits are sorted by note and replayed as they come; one content is held at a time, however many
    edits a note has.
    """
    known = notes.select("note_id", F.lit(0).alias("edit"), F.lit(0).cast("long").alias("seq"), F.col("version").cast("long").alias("version"), "content")
    made = edits.select("note_id", F.lit(1), F.col("seq").cast("long"), F.col("expected_version").cast("long"), "new_content")
    rows = known.union(made).repartition("note_id").sortWithinPartitions("note_id", "edit", "seq", "version", "content")
    out = to_arrow_schema(StructType(rows.select("note_id", F.lit("").alias("what"), "version", F.col("version").alias("expected_version"), "content").schema))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note, version, content = None, None, None
        for batch in batches:
            done = []
            for key, edit, _, number, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not edit:
                    if version is not None:
                        done.append((note, "note", version, None, content))
                    note, version, content = key, number, text
                elif version is None or key != note:
                    continue
                elif number is not None and number != version:
                    done.append((note, "conflict", version, number, None))
                elif text is not None and text != content:
                    done.append((note, "revision", version, None, content))
                    version, content = version + 1, text
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * len(out), out)], schema=out)
        if version is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((note, "note", version, None, content), out)], schema=out)

    kinds = dict(rows.dtypes)
    replayed = rows.mapInArrow(replay, f"note_id {kinds['note_id']}, what string, version long, expected_version long, content {kinds['content']}")
    of = lambda what, *columns: replayed.where(F.col("what") == what).select(*columns)
    return of("note", "note_id", "version", "content"), of("revision", "note_id", "version", "content"), of("conflict", "note_id", "version", "expected_version")


def content_at(notes: DataFrame, revisions: DataFrame, version: int) -> DataFrame:
    every = notes.select("note_id", "version", "content").unionByName(revisions.select("note_id", "version", "content"))
    return every.where(F.col("version") == version)


def restore(notes: DataFrame, revisions: DataFrame, version: int) -> DataFrame:
    """Edits (note_id, seq, expected_version, new_content) that bring each note's content at a version back as a new one."""
    was = revisions.where(F.col("version") == version).select("note_id", F.col("content").alias("new_content"))
    return notes.select("note_id", F.lit(0).alias("seq"), F.col("version").alias("expected_version")).join(was, "note_id")


def check_versions(notes: DataFrame, revisions: DataFrame) -> DataFrame:
    """note_id, version, highest of the notes whose version is not above that of all their revisions."""
    highest = revisions.groupBy("note_id").agg(F.max("version").alias("highest"))
    return notes.select("note_id", "version").join(highest, "note_id").where("version <= highest")


def revision_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, added, removed: lines, counted as often as they stand, between two texts (key, content)."""
    lines = lambda df, n: df.select(key, F.explode(F.split("content", "\n")).alias("line")).groupBy(key, "line").agg(F.count("*").alias(n))
    both = lines(old, "a").join(lines(new, "b"), [key, "line"], "full_outer").na.fill(0, ["a", "b"])
    return both.groupBy(key).agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"))


def sync_state(disk: DataFrame, library: DataFrame, baseline: DataFrame) -> DataFrame:
    """note_id, state of each library note (note_id, hash) against the file and what both were at the last sync."""
    h = lambda df, name: df.select("note_id", F.col("hash").alias(name))
    rows = h(library, "l").join(h(disk, "d"), "note_id", "left").join(h(baseline, "b"), "note_id", "left")
    base = F.coalesce("b", "l")
    on_disk, in_library = ~F.col("d").eqNullSafe(base), ~F.col("l").eqNullSafe(base)
    state = F.when(F.col("d").isNull(), "missing").when(F.col("d") == F.col("l"), "clean").when(on_disk & in_library, "conflict").when(on_disk, "modified").otherwise("dirty")
    return rows.select("note_id", state.alias("state"))
