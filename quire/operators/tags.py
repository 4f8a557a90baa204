"""Tags, facets and browsing of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import slugify


def resolve_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """name, tag_id: exact name in either case, else slug, else alias; tags has (tag_id, name, aliases)."""
    keys = F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("p"), F.lower("name").alias("key")), F.struct(F.lit(1).alias("p"), slugify(F.col("name")).alias("key"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(2).alias("p"), F.lower(a).alias("key"))),
    ))
    known = tags.select("tag_id", keys.alias("k")).select("tag_id", "k.p", "k.key")
    asked = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("q"), F.lower("name").alias("key")), F.struct(F.lit(1).alias("q"), slugify(F.col("name")).alias("key"))))).alias("a"))
    found = asked.select("name", "a.q", "a.key").join(known, "key").where("p = q OR (p = 2 AND q = 0)")
    return found.groupBy("name").agg(F.min(F.struct("p", "tag_id"))["tag_id"].alias("tag_id"))


def attach_tags(links: DataFrame, requests: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and tags after requests (paper_id, name): names resolve or make a new tag, named by the slug; each link once.

    A name that resolved by its slug or an alias in a new spelling becomes an alias of its tag.
    """
    found = requests.select("name").distinct().join(resolve_tags(requests, tags), "name", "left").withColumn("new_id", slugify(F.col("name")))
    made = found.where("tag_id IS NULL").groupBy("new_id").agg(F.min("name").alias("name"))
    made = made.select(F.col("new_id").alias("tag_id"), "name", F.array().cast("array<string>").alias("aliases"))
    spelled = found.where("tag_id IS NOT NULL").groupBy("tag_id").agg(F.sort_array(F.collect_set("name")).alias("_seen"))
    grown = tags.join(spelled, "tag_id", "left")
    fresh = F.filter("_seen", lambda s: F.lower(s) != F.lower("name"))
    grown = grown.withColumn("aliases", F.when(F.col("_seen").isNull(), F.col("aliases")).otherwise(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), fresh)))
    name_to = found.select("name", F.coalesce("tag_id", "new_id").alias("tag_id"))
    linked = requests.join(name_to, "name").select("paper_id", "tag_id").unionByName(links.select("paper_id", "tag_id")).distinct()
    return linked, grown.select("tag_id", "name", "aliases").unionByName(made)


def paper_tag_pairs(paper_tags: DataFrame, note_tags: DataFrame, notes: DataFrame) -> DataFrame:
    """The one definition of a paper's tags: its own and those of its notes."""
    own_notes = note_tags.join(notes.select("note_id", "paper_id").where("paper_id IS NOT NULL"), "note_id").select("paper_id", "tag")
    return paper_tags.select("paper_id", "tag").unionByName(own_notes).distinct()


def tag_facets(pairs: DataFrame, tags: DataFrame, live: DataFrame) -> DataFrame:
    """dimension, name, n_papers: live papers per tag, zero for unused ones."""
    n = pairs.join(live.select("paper_id"), "paper_id", "left_semi").groupBy("tag").agg(F.countDistinct("paper_id").alias("n"))
    return tags.join(n, tags["name"] == n["tag"], "left").select("dimension", "name", F.coalesce("n", F.lit(0)).alias("n_papers"))


def papers_with_all_tags(pairs: DataFrame, wanted: list[str]) -> DataFrame:
    hit = pairs.where(F.col("tag").isin(*wanted)).groupBy("paper_id").agg(F.countDistinct("tag").alias("n"))
    return hit.where(F.col("n") == len(set(wanted))).select("paper_id")


def usage_counts(paper_tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    return paper_tags.select("tag").unionByName(note_tags.select("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_tree(tags: DataFrame) -> DataFrame:
    """tag_id, depth, path of tags (tag_id, name, parent_id): from the roots down. Tags in a cycle have no root and are
    left out."""
    tags.select("tag_id", "name", "parent_id").createOrReplaceTempView("quire_tags")
    return tags.sparkSession.sql("""
        WITH RECURSIVE tree(tag_id, depth, path) AS (
          SELECT tag_id, 0, name FROM quire_tags WHERE parent_id IS NULL
          UNION ALL SELECT t.tag_id, depth + 1, concat(path, ' / ', t.name) FROM quire_tags t JOIN tree ON t.parent_id = tree.tag_id)
        SELECT tag_id, depth, path FROM tree""")


def admit_suggestions(new: DataFrame, existing: DataFrame, tags: DataFrame) -> DataFrame:
    """new suggestions (target, name, dimension, confidence) worth keeping, with the tag that each resolves to.

    Blank and overlong names, names ever rejected, and ones already pending for the target are dropped.
    """
    ok = new.where((F.trim("name") != "") & (F.length("name") <= 120)).dropDuplicates(["target", "name"])
    ok = ok.join(existing.where("status = 'rejected'").select(F.lower("name").alias("_r")).distinct(), F.lower("name") == F.col("_r"), "left_anti")
    ok = ok.join(existing.where("status = 'pending'").select("target", "name").distinct(), ["target", "name"], "left_anti")
    return ok.join(resolve_tags(ok, tags), "name", "left").select("target", "name", "dimension", "confidence", "tag_id")


def resolve_suggestions(suggestions: DataFrame, least: float) -> DataFrame:
    """suggestions after accepting all pending ones of enough confidence; none and 0 count as certain."""
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    return suggestions.withColumn("status", F.when((F.col("status") == "pending") & (sure >= least), "accepted").otherwise(F.col("status")))


def suggestion_stats(suggestions: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return suggestions.groupBy("dimension").agg(n("pending"), n("accepted"), n("rejected"))


def default_dimension(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("misc"))


def import_tags_from_notes(notes: DataFrame, paper_tags: DataFrame) -> DataFrame:
    """paper_tags plus the tags of notes (paper_id, tags array); nothing is ever removed."""
    listed = notes.where("paper_id IS NOT NULL").select("paper_id", F.explode("tags").alias("tag")).select("paper_id", F.trim("tag").alias("tag")).where("tag <> ''")
    return paper_tags.select("paper_id", "tag").unionByName(listed).distinct()


def list_papers(papers: DataFrame, where: Column | None = None, having: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Live papers that meet a condition, and that stand (not) in other tables by paper_id."""
    rows = papers.where("NOT deleted")
    rows = rows if where is None else rows.where(where)
    rows = rows if having is None else rows.join(having.select("paper_id"), "paper_id", "left_semi")
    return rows if without is None else rows.join(without.select("paper_id"), "paper_id", "left_anti")


def keyset_page(rows: DataFrame, key: Column, key_name: str, key_id: str, limit: int, after: tuple | None = None, descending: bool = True) -> tuple[DataFrame, tuple | None]:
    """A page of rows in the order of (key, id), the cursor of the next one, or None at the end.

    Ties go by id in the same direction, so no row is met twice; the cursor is the last returned row's. The page, which is
    short by its limit, comes to the driver together with the row after it, so the rows are sorted once.
    """
    keyed = rows.withColumn(key_name, key)
    shown = keyed
    if after is not None:
        k, i = F.lit(after[0]), F.lit(after[1])
        past = (F.col(key_name) < k) | ((F.col(key_name) == k) & (F.col(key_id) < i)) if descending else (F.col(key_name) > k) | ((F.col(key_name) == k) & (F.col(key_id) > i))
        shown = keyed.where(past)
    order = [F.desc(key_name), F.desc(key_id)] if descending else [F.asc(key_name), F.asc(key_id)]
    found = shown.orderBy(*order).limit(limit + 1).collect()
    cursor = (found[limit - 1][key_name], found[limit - 1][key_id]) if len(found) > limit else None
    return rows.sparkSession.createDataFrame(found[:limit], keyed.schema), cursor


#: Orders of a list of papers: their key over the columns of papers, and whether it goes down.
SORTS = {
    "title": (lambda: F.coalesce("title", F.lit("")), False),
    "year": (lambda: F.coalesce("year", F.lit(-1)), True),
    "year_asc": (lambda: F.coalesce("year", F.lit(-1)), False),
    "added": (lambda: F.col("paper_id"), True),
}


def list_page(papers: DataFrame, sort: str = "added", limit: int = 50, after: tuple | None = None, **filters) -> tuple[DataFrame, tuple | None, int]:
    """A page of list_papers(papers, **filters) in one of SORTS (added if unknown), the next cursor, and how many there are."""
    rows = list_papers(papers, **filters)
    key, descending = SORTS.get(sort, SORTS["added"])
    page, cursor = keyset_page(rows, key(), "sort_key", "paper_id", limit, after, descending)
    return page, cursor, rows.count()


def filter_options(papers: DataFrame, most: int = 200) -> DataFrame:
    """kind, value: years from the newest, and the first venues in order."""
    years = papers.where("year IS NOT NULL").select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value")).distinct()
    venues = papers.where("venue IS NOT NULL").select(F.lit("venue").alias("kind"), F.col("venue").alias("value")).distinct().orderBy("value").limit(most)
    return years.unionByName(venues)


def paper_detail(papers: DataFrame, pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """papers with their sorted tags and notes nested."""
    t = pairs.groupBy("paper_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    n = notes.where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("note_id", "kind"))).alias("notes"))
    return papers.join(t, "paper_id", "left").join(n, "paper_id", "left")


def update_rows(base: DataFrame, patches: DataFrame, key: str, allowed: dict[str, Column], derived: dict[str, tuple[str, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """base with valid patches (key, seq, column, value) applied, and the rejected patches.

    allowed: column -> condition over `value` that makes it valid. Of several patches of a column the last by seq wins.
    derived: column -> the column that it follows, and its value over the new row where that has changed.
    """
    valid = F.lit(False)
    for c, ok in allowed.items():
        valid = valid | ((F.col("column") == c) & ok)
    valid = F.coalesce(valid, F.lit(False))
    wide = patches.where(valid).groupBy(key).agg(*(F.max_by("value", F.when(F.col("column") == c, F.col("seq"))).alias(f"_{c}") for c in allowed))
    out = base.join(wide, key, "left")
    changed = {f"_changed_{c}": ~F.coalesce(F.col(f"_{c}").cast(base.schema[c].dataType), F.col(c)).eqNullSafe(F.col(c)) for c in allowed}
    out = out.withColumns(changed).withColumns({c: F.coalesce(F.col(f"_{c}").cast(base.schema[c].dataType), F.col(c)) for c in allowed})
    for c, (source, value) in (derived or {}).items():
        out = out.withColumn(c, F.when(F.col(f"_changed_{source}"), value).otherwise(F.col(c)))
    return out.select(*base.columns), patches.where(~valid)


def apply_lifecycle(papers: DataFrame, notes: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers and notes after actions (paper_id, seq, action of delete, restore or purge).

    The last of delete and restore sets `deleted`; a purged paper goes for good, whatever comes later, and its notes stay
    without a paper. Actions on unknown papers and unknown actions do nothing.
    """
    known = actions.where("action IN ('delete', 'restore', 'purge')").groupBy("paper_id")
    last = known.agg(F.max_by("action", F.when(F.col("action") != "purge", F.col("seq"))).alias("_last"), F.bool_or(F.col("action") == "purge").alias("_purged"))
    met = papers.join(last, "paper_id", "left").where("NOT coalesce(_purged, false)")
    deleted = F.when(F.col("_last").isNull(), F.col("deleted")).otherwise(F.col("_last") == "delete")
    gone = papers.select("paper_id").join(last.where("_purged").select("paper_id"), "paper_id", "left_semi").distinct().withColumn("_gone", F.lit(True))
    freed = notes.join(gone, "paper_id", "left").withColumn("paper_id", F.when(F.col("_gone"), None).otherwise(F.col("paper_id")))
    return met.withColumn("deleted", deleted).select(*papers.columns), freed.select(*notes.columns)


def top_by_dimension(pairs: DataFrame, tags: DataFrame, live: DataFrame, most: int = 8) -> DataFrame:
    """dimension, name, n_papers: the most used tags of each dimension."""
    k = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n_papers"), "name"))
    return tag_facets(pairs, tags, live).where("n_papers > 0").withColumn("k", k).where(F.col("k") <= most).drop("k")
