"""A word index on files: immutable segments of postings, of which a search reads the buckets of its terms alone.

Below the root lie, for each segment, `postings/<low>-<high>` (partitioned by a bucket of the term and sorted by term),
`lengths/<low>-<high>`, `touched/<low>-<high>` (the chunks that it changes or deletes) and, written last,
`meta/<low>-<high>`: a segment without it was cut off and doesn't count, and is overwritten when its job runs again.
Numbers are those of changes, in order: a change set is the segment n-n, and a compaction of changes low to high is the
segment low-high, which takes the place of all segments inside its range as soon as its meta row is there.

Of a chunk, the newest segment that touched it counts. Readers drop older rows by an anti join with the touched chunks
of newer segments, after the bucket filter; a compaction does so once and for all, bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.index import build_postings, doc_lengths

POSTINGS = "term string, chunk_id long, tf long, positions array<int>"


@dataclass(frozen=True)
class Segment:
    low: int
    high: int
    buckets: int

    @property
    def name(self) -> str:
        return f"{self.low:012d}-{self.high:012d}"

    def holds(self, other: Segment) -> bool:
        return self != other and self.low <= other.low and other.high <= self.high


@dataclass(frozen=True)
class WordIndex:
    """Live segments, oldest first, all with the same number of buckets. only: chunks (chunk_id) that may be found, None for all that the index holds."""

    spark: SparkSession
    root: str
    segments: tuple[Segment, ...]
    only: DataFrame | None = None

    def within(self, chunks: DataFrame) -> WordIndex:
        return replace(self, only=chunks.select("chunk_id"))

    def _read(self, kind: str, segment: Segment, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{segment.name}")

    def _newest(self, kind: str, schema: str, condition: Column | None = None, few: Column | None = None) -> DataFrame:
        """The rows of all segments that no newer segment has touched. few: chunks to keep to, of which so few are touched
        that all tasks may have them."""
        found, newer = None, None
        for s in reversed(self.segments):
            rows = self._read(kind, s, schema)
            rows = rows if condition is None else rows.where(condition)
            rows = rows if few is None else rows.where(few)
            rows = rows if newer is None else rows.join(newer if few is None else F.broadcast(newer), "chunk_id", "left_anti")
            found = rows if found is None else found.unionByName(rows)
            touched = self._read("touched", s, "chunk_id long")
            touched = touched if few is None else touched.where(few)
            newer = touched if newer is None else newer.unionByName(touched).distinct()
        if found is None:
            found = self.spark.createDataFrame([], schema)
        return found if self.only is None else found.join(self.only, "chunk_id", "left_semi")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, chunk_id, tf, positions: of all terms, or of those in terms (term), read from their buckets alone.

        The buckets asked for are collected: at most as many numbers as there are buckets.
        """
        if terms is None or not self.segments:
            return self._newest("postings", f"{POSTINGS}, bucket int").drop("bucket")
        asked = terms.select("term").distinct()
        (n,) = {s.buckets for s in self.segments}
        numbers = asked.agg(F.collect_set(bucket_of(n)).alias("numbers")).first()["numbers"]
        condition = F.col("bucket").isin(sorted(numbers)) if numbers else F.lit(False)
        return self._newest("postings", f"{POSTINGS}, bucket int", condition).drop("bucket").join(asked, "term", "left_semi")

    def lengths(self) -> DataFrame:
        return self._newest("lengths", "chunk_id long, len long")


def bucket_of(buckets: int, term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Of an index of up to so many buckets postings are written where they are made, a file for each task and bucket. Of more
#: they move to their bucket first, so that files don't get too many.
AT_HOME = 16


def _write(df: DataFrame, root: str, kind: str, segment: Segment, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{root}/{kind}/{segment.name}")


def _write_postings(postings: DataFrame, root: str, segment: Segment, mode: str = "overwrite") -> None:
    dealt = postings.select("term", "chunk_id", "positions", bucket_of(segment.buckets).alias("bucket"))
    if segment.buckets > AT_HOME:
        # a frequent term's bucket is dealt to as many tasks as its size asks for; what can be made again from the rest doesn't move
        dealt = dealt.hint("rebalance", "bucket")
    dealt = dealt.select("term", "chunk_id", F.size("positions").cast("long").alias("tf"), "positions", "bucket")
    dealt.sortWithinPartitions("bucket", "term", "chunk_id").write.mode(mode).partitionBy("bucket").parquet(f"{root}/postings/{segment.name}")


def _commit(spark: SparkSession, root: str, segment: Segment, touched: DataFrame) -> None:
    """Makes a segment count whose postings and lengths are written."""
    _write(touched.select("chunk_id").distinct(), root, "touched", segment)
    _write(spark.createDataFrame([(segment.low, segment.high, segment.buckets)], "low long, high long, buckets int").coalesce(1), root, "meta", segment)


def _live(spark: SparkSession, root: str) -> tuple[Segment, ...]:
    """Committed segments that no other one holds; none if there is no index yet."""
    try:
        # one row per segment that was ever committed and not cleared
        rows = spark.read.schema("low long, high long, buckets int").option("recursiveFileLookup", "true").parquet(f"{root}/meta").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    every = {Segment(r["low"], r["high"], r["buckets"]) for r in rows}
    return tuple(sorted((s for s in every if not any(o.holds(s) for o in every)), key=lambda s: s.high))


def create_index(chunks: DataFrame, tokens: Column, root: str, buckets: int = 256, number: int = 0) -> WordIndex:
    """Writes all of chunks (chunk_id, text) as the first segment."""
    return apply_changes(chunks, tokens, root, number, buckets)


def apply_changes(changes: DataFrame, tokens: Column, root: str, number: int, buckets: int = 256) -> WordIndex:
    """Adds changes (chunk_id, text; a null text deletes) as segment `number`; the same number again replaces it.

    A change set that a compaction already holds is not written again.
    """
    spark = changes.sparkSession
    segment = Segment(number, number, buckets)
    if not any(s.holds(segment) for s in _live(spark, root)):
        kept = changes.where("text IS NOT NULL")
        _write_postings(build_postings(kept, tokens), root, segment)
        _write(doc_lengths(kept, tokens), root, "lengths", segment)
        _commit(spark, root, segment, changes)
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> WordIndex:
    return WordIndex(spark, root, _live(spark, root))


#: Touched chunks that a round of a compaction takes, about.
ROUND = 2_000_000


def _ranges(touched: DataFrame) -> list[Column]:
    """Ranges of chunk_id that hold about ROUND of touched each; rows without an id are in the first."""
    rounds = -(-touched.count() // ROUND)
    if rounds < 2:
        return [F.lit(True)]
    edges = sorted(set(touched.agg(F.percentile_approx("chunk_id", [k / rounds for k in range(1, rounds)], 100 * rounds)).first()[0]))
    c = F.col("chunk_id")
    return [c.isNull() | (c < edges[0]), *((c >= a) & (c < b) for a, b in zip(edges, edges[1:], strict=False)), c >= edges[-1]]


def compact(index: WordIndex, segments: Sequence[Segment] | None = None) -> WordIndex:
    """Merges neighbouring segments, by default all, into one. May die at any point and run again.

    Postings don't move: the chunks that newer segments touched go to all tasks, in rounds by ranges of ids, so that a round
    has no more than about ROUND of them. Where a file holds near ids only, a round reads but the files of its range.
    """
    merged = tuple(segments or index.segments)
    if len(merged) < 2:
        return index
    part = replace(index, segments=merged, only=None)
    new = Segment(merged[0].low, merged[-1].high, merged[0].buckets)
    of = [part._read("touched", s, "chunk_id long") for s in merged]
    newer = of[1]
    for rows in of[2:]:
        newer = newer.unionByName(rows)
    for k, few in enumerate(_ranges(newer)):
        mode = "append" if k else "overwrite"
        _write_postings(part._newest("postings", f"{POSTINGS}, bucket int", few=few), index.root, new, mode)
        _write(part._newest("lengths", "chunk_id long, len long", few=few), index.root, "lengths", new, mode)
    _commit(index.spark, index.root, new, of[0].unionByName(newer))
    return open_index(index.spark, index.root)


def clear_dead(index: WordIndex, dead: Sequence[Segment]) -> None:
    """Empties segments that a compaction has replaced; no reader may still hold them."""
    for s in dead:
        for kind, schema in (("meta", "low long, high long, buckets int"), ("postings", POSTINGS), ("lengths", "chunk_id long, len long"), ("touched", "chunk_id long")):
            index.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{index.root}/{kind}/{s.name}")
