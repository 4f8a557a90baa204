"""Files as tables: scanning, comparing with a catalog, writing and reading indexes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.parts import hashed, hashed_further, joined_lines

#: Bytes up to which a file is hashed by one task; larger ones are read in parts of about this size.
PART = 128 << 20
#: Names of files that Spark's text reader would unpack; they are hashed by one task whatever their size.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


def _files(spark: SparkSession, roots: str | list[str], pattern: str) -> DataFrame:
    """path, size, mtime, uri, content of the files below roots; hidden ones and caches are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    files = files.where(~F.col("path").rlike(r"/(\.[^/]+|__MACOSX|node_modules|__pycache__)(/|$)"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("_metadata.file_path").alias("uri"), "content")


def _names(paths: list[str]) -> list[str]:
    """Paths as Spark's readers take them: brackets and the like in names are no patterns."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def list_files(spark: SparkSession, root: str | list[str], pattern: str = "*.pdf") -> DataFrame:
    """path, size, mtime of the files below root, none of which is opened."""
    return _files(spark, root, pattern).drop("uri", "content")


def _read_whole(files: DataFrame) -> DataFrame:
    return files.select("path", "size", "mtime", F.sha2("content", 256).alias("sha256"))


def scan_files(spark: SparkSession, root: str | list[str], pattern: str = "*.pdf", part: int = PART) -> DataFrame:
    """path, size, mtime, sha256 of the files below root, all of which are read.

    The paths of files of more than `part` bytes go to the driver, whose listing holds those of all files anyway.
    """
    # files are skipped by their size before they are opened
    found = _read_whole(_files(spark, root, pattern).where(F.col("size") <= part))
    listed = list_files(spark, root, pattern).where(F.col("size") > part)
    large = [r["path"] for r in listed.select("path").toLocalIterator()]
    packed = [p for p in large if re.search(PACKED, p)]
    if packed:
        found = found.unionByName(_read_whole(_files(spark, _names(packed), pattern)))
    plain = _names([p for p in large if not re.search(PACKED, p)])
    return found.unionByName(_read_in_parts(spark, plain, pattern, part)) if plain else found


def _read_in_parts(spark: SparkSession, names: list[str], pattern: str, part: int) -> DataFrame:
    """path, size, mtime, sha256 of large files.

    Spark splits files at line feeds, so they are read as lines by all tasks and stored as pieces. SHA-256 goes through
    a file in order: a round for each part takes all files a part further, and only the state of the hash goes on.
    """
    files = _files(spark, names, pattern).drop("content")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(names)
    lines = lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(joined_lines, "uri string, start long, seq long, bytes binary")
    pieces = rewritten(pieces.withColumns({"n": F.length("bytes"), "part": F.expr(f"start div {part}")}), "part")
    held = pieces.groupBy("uri").agg(F.sum("n").alias("held"))
    # what lines leave out, a last line feed and a byte order mark, goes along in place of a number
    left = F.col("size") - F.coalesce("held", F.lit(0))
    states = files.join(held, "uri", "left").select("uri", F.lit(-1).cast("long").alias("start"), left.alias("seq"), F.lit(None).cast("binary").alias("bytes"))
    for k in range(files.agg(F.max("size")).first()[0] // part + 1):
        now = states.unionByName(pieces.where(F.col("part") == k).select(states.columns))
        now = now.repartition(4 * len(names), "uri").sortWithinPartitions("uri", "start", "seq")
        states = rewritten(now.mapInArrow(hashed_further, "uri string, start long, seq long, bytes binary"))
    digests = states.mapInArrow(hashed, "uri string, sha256 string")
    return files.join(digests, "uri").select("path", "size", "mtime", "sha256")


def rescan_files(spark: SparkSession, root: str, known: DataFrame, pattern: str = "*.pdf", batch: int = 10_000, part: int = PART) -> DataFrame:
    """As scan_files, but files whose path, size and mtime stand in known (path, size, mtime, sha256) keep its hash unread.

    The paths of the others go to the driver, whose listing holds those of all files anyway, and are read batch by batch.
    """
    same = ["path", "size", "mtime"]
    listed = list_files(spark, root, pattern)
    found = listed.join(known.select(*same, "sha256"), same)
    changed = [r["path"] for r in listed.join(known.select(*same), same, "left_anti").select("path").toLocalIterator()]
    for at in range(0, len(changed), batch):
        found = found.unionByName(scan_files(spark, _names(changed[at : at + batch]), pattern, part))
    return found


def read_corpus(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_index(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces only the partitions that df has rows for."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def rewritten(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/index-{uuid.uuid4().hex}"
    write_index(df, path, list(partition_by))
    return df.sparkSession.read.parquet(path)


def snapshot_diff(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """path_key, status of each file of snapshot (path_key, file_hash, mtime) against catalog (and deleted).

    A known path is skipped, touched or changed. A new path is moved if its hash belongs to a live path that is gone
    (the first such path of a hash), a duplicate if the hash is known otherwise, reappeared if a deleted row has the
    path, else added.
    """
    live = catalog.where("NOT deleted").select("path_key", F.col("file_hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    known = snapshot.join(live, "path_key").select(
        "path_key", F.when(F.col("file_hash") != F.col("old_hash"), "changed").when(F.col("mtime") != F.col("old_mtime"), "touched").otherwise("skipped").alias("status")
    )
    fresh = snapshot.join(live, "path_key", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("file_hash").orderBy("path_key")))
    gone = live.join(snapshot, "path_key", "left_anti").select(F.col("old_hash").alias("file_hash")).distinct().withColumn("gone", F.lit(True))
    held = live.select(F.col("old_hash").alias("file_hash")).distinct().withColumn("held", F.lit(True))
    deleted = catalog.where("deleted").select("path_key").distinct().withColumn("back", F.lit(True))
    new = fresh.join(gone, "file_hash", "left").join(held, "file_hash", "left").join(deleted, "path_key", "left")
    status = F.when(F.col("gone") & (F.col("k") == 1), "moved").when(F.col("held") | (F.col("k") > 1), "duplicate").when(F.col("back"), "reappeared").otherwise("added")
    return known.unionByName(new.select("path_key", status.alias("status")))


def missing_under(catalog: DataFrame, snapshot: DataFrame, roots: DataFrame) -> DataFrame:
    """Live rows of catalog that a scan of roots (root) should have seen, and didn't. roots is a short list."""
    unseen = catalog.where("NOT deleted").join(snapshot.select("path_key"), "path_key", "left_anti")
    scanned = [r["root"] for r in roots.select("root").distinct().collect()]
    under = F.lit(False)
    for root in scanned:
        under = under | F.col("path_key").startswith(root)
    return unseen.where(under)


def scan_summary(diff: DataFrame) -> DataFrame:
    """root (first folder of the path), status, n."""
    return diff.groupBy(F.regexp_extract("path_key", "^/([^/]*)", 1).alias("root"), "status").agg(F.count("*").alias("n"))


def untracked(snapshot: DataFrame, catalog: DataFrame) -> DataFrame:
    return snapshot.select("path_key").join(catalog.select("path_key"), "path_key", "left_anti")


def file_type_profile(files: DataFrame, most: int = 12) -> DataFrame:
    """repo, ext, n: the most frequent extensions of each repository's files (repo, path)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    n = files.select("repo", ext.alias("ext")).where("ext <> ''").groupBy("repo", "ext").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "ext"))
    return n.withColumn("k", rank).where(F.col("k") <= most).drop("k")
