"""Secret scan over a stored ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. The ledger is a table in a folder: one row for each blob that a
run scanned, with the (rule, version) pairs that were run on it and what they found. A run scans one copy of each blob,
by those rules alone whose version the ledger lacks for it, appends its rows, and findings of the rules' present
versions are joined back to all rows that hold the blob. A run that dies leaves no row, and its blobs are due again; a
row that is there twice counts once.

Texts move only where they must: a bitmap of the blobs that stand in several rows or in the ledger tells the rest,
which are scanned where they are read.

Defined cases: a null text counts as empty and has no findings; rows with the same id or a null id are each
reported; an empty table gives an empty result and an empty ledger; other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import flagged, shared_dir, stored

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

ASSIGN = (
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


@dataclass(frozen=True)
class SecretRule:
    """value: the group that must have min_chars characters; 0 is the whole match."""

    kind: str
    pattern: str
    value: int = 0
    min_chars: int = 1
    base: bool = False
    version: int = 1

    @property
    def pair(self) -> str:
        return f"{self.kind}:{self.version}"


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"
FOUND = f"array<struct<pair:string,spans:{SPANS}>>"
LEDGER = f"blob binary, done array<string>, found {FOUND}"

RULES = (
    SecretRule("assign", ASSIGN, 2, 8, True),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    SecretRule("hex", "[0-9a-f]+", 0, 32, True),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    # the head is bounded, so that a run of heads without a dot costs no more than its length times the bound
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,120}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, version=2),
)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def blobs_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's integers, those before it merged, from 0 on. In blocks of about the root of its length, as a
    fold copies its array at each step."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def fold(v: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(v, F.struct(first.alias("at"), zero["out"].alias("out")), step)

    def blocks(v: Column) -> Column:
        size = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(v)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda k: F.slice(v, k * size + 1, size))

    def over(b: Column) -> Column:
        totals = F.transform(b, lambda v: F.aggregate(v, F.lit(0), lambda acc, x: merge(acc, x)))
        firsts = fold(totals, F.lit(0))["out"]
        return F.flatten(F.transform(F.arrays_zip(b.alias("v"), firsts.alias("f")), lambda z: fold(z["v"], z["f"])["out"]))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.array(blocks(values)), over)[0])


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """All matches of a rule in text as (start, order, end, kind), in code points, end exclusive."""
    # a run of lower hex digits that is long enough; maximal runs are the same with or without the bound
    pattern = "[0-9a-f]{32,}" if rule.kind == "hex" and rule.pattern == "[0-9a-f]+" and rule.min_chars == 32 else rule.pattern
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(m: Column, g: Column) -> Column:
        # before match i stand i + 1 gaps and i matches
        steps = F.transform(m, lambda x, i: F.length(x) + F.get(g, i))
        ends = F.transform(F.array(steps), lambda s: F.transform(running(s, lambda a, b: a + b), lambda before, i: before + F.get(s, i)))[0]
        span = lambda e, i: F.struct((e - F.length(F.get(m, i))).alias("start"), F.lit(order).alias("order"), e.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.transform(ends, span)
        if rule.min_chars <= 1:
            return found
        return F.filter(found, lambda s, i: F.length(F.regexp_extract(F.get(m, i), rule.pattern, rule.value)) >= rule.min_chars)

    return F.when(
        text.rlike(pattern),
        F.transform(F.arrays_zip(F.array(matches).alias("m"), F.array(gaps).alias("g")), lambda z: placed(z["m"], z["g"]))[0],
    ).otherwise(F.array().cast(SPANS))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """blob, done, found: all rows of all runs; none where no run has written."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def unseen_blobs(docs: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """One row per blob that lacks some rule in the ledger (or a few, for repeated rows): blob, text, due (its pairs)."""
    every = F.array(*(F.lit(r.pair) for r in rules)).cast("array<string>")
    rows = blobs_of(docs)
    seen = ledger.select("blob", F.explode_outer("done").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("done"))
    blobs = rows.groupBy("blob").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(seen, "blob", "left")
    blobs = stored(blobs.select("blob", "first", "n", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("due"), F.col("done").isNotNull().alias("known")), "ledger-blobs")
    # a blob of one row that no run has seen is scanned where it is read
    special = blobs.where("n > 1 OR known").select("blob")
    here = flagged(rows, F.col("blob"), special).where("NOT quire__maybe").select("blob", "text", every.alias("due"))
    todo = stored(flagged(blobs, F.col("blob"), special).where("quire__maybe AND size(due) > 0").select(F.col("blob").alias("_blob"), "first", "due"), "ledger-due")
    doubtful = flagged(flagged(rows, F.col("blob"), special).where("quire__maybe").drop("quire__maybe"), F.col("blob"), todo.select("_blob")).where("quire__maybe")
    chosen = doubtful.join(todo, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("first")))
    return here.unionByName(chosen.select("blob", "text", "due"))


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Ledger rows for blobs (blob, text, due): each rule runs where it is due."""
    none = F.array().cast(SPANS)
    parts = [
        F.struct(F.lit(r.pair).alias("pair"), F.when(F.array_contains("due", r.pair), spans_of(F.col("text"), r, k)).otherwise(none).alias("spans"))
        for k, r in enumerate(rules)
    ]
    found = F.filter(F.array(*parts), lambda x: F.size(x["spans"]) > 0) if parts else F.array()
    return blobs.select("blob", F.col("due").alias("done"), found.cast(FOUND).alias("found"))


def scan_new(docs: DataFrame, folder: str, rules: tuple[SecretRule, ...] = RULES) -> None:
    """Scans what the ledger in folder lacks, and appends it."""
    due = unseen_blobs(docs, read_ledger(docs.sparkSession, folder), rules)
    scan_blobs(due, rules).write.mode("append").parquet(folder)


def findings(ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """blob, spans: what the present versions of the rules found, for the blobs with findings."""
    present = F.array(*(F.lit(r.pair) for r in rules)).cast("array<string>")
    found = ledger.select("blob", F.explode("found").alias("f")).where(F.array_contains(present, F.col("f.pair")))
    # at most one row per rule, and per run that scanned it twice
    return found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.spans")))).alias("spans"))


#: Copies of a finding to which the rows of its blob are dealt.
SALTS = 16


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def scan_secrets(docs: DataFrame, folder: str | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans for every row of docs, by the ledger in folder (a new one if none is named)."""
    folder = folder or new_ledger(docs.sparkSession)
    scan_new(docs, folder, rules)
    found = stored(findings(read_ledger(docs.sparkSession, folder), rules), "ledger-found")
    rows = flagged(blobs_of(docs).drop("text"), F.col("blob"), found.select("blob"))
    # rows without findings are spread, and so are copies of one blob, which may be a third of all rows
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("string")
    dealt = rows.withColumn("quire__key", F.concat_ws("-", F.when(F.col("quire__maybe"), F.col("blob")).otherwise("none"), salt))
    held = found.select("spans", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.concat_ws("-", "blob", k.cast("string")))).alias("quire__key"))
    return dealt.join(held, "quire__key", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


#: Code points of the blocks in which a text is cut.
CUT = 1024


def masked_text(text: Column, spans: Column, mask: str) -> Column:
    """text with each run of characters inside any of the spans, ascending, as one mask."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), 0)

    def cut(b: Column, a: Column, e: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        return F.substring(F.array_join(F.slice(b, first + 1, F.floor(e / CUT).cast("int") - first + 1), ""), a % CUT + 1, e - a)

    def joined(b: Column, s: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), lambda p, q: F.greatest(p, q))
        pieces = F.transform(F.arrays_zip(s.alias("s"), reached.alias("r")), lambda z: F.when(z["s"]["start"] >= z["r"], F.concat(cut(b, z["r"], z["s"]["start"]), F.lit(mask))).otherwise(""))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), cut(b, last, F.length(text)))

    both = F.arrays_zip(F.array(blocks).alias("b"), F.array(spans).alias("s"))
    return F.transform(both, lambda z: joined(z["b"], z["s"]))[0]


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, mask: str = "[secret]", folder: str | None = None) -> DataFrame:
    """docs with every found span replaced by mask; n_chars follows the new text where there is such a column.

    Spans may overlap: characters inside any span go, and each run of them becomes one mask. Rows with null or repeated
    ids are masked by their own texts; null and empty texts stay; an empty table stays empty; all columns stay.
    """
    folder = folder or new_ledger(docs.sparkSession)
    scan_new(docs, folder, rules)
    found = stored(findings(read_ledger(docs.sparkSession, folder), rules), "ledger-found").select(F.col("blob").alias("quire__b"), F.col("spans").alias("quire__s"))
    rows = flagged(docs.withColumn("quire__h", blob_of(F.col("text"))), F.col("quire__h"), found.select("quire__b"))
    masked = rows.where("quire__maybe").join(found, F.col("quire__h") == F.col("quire__b"), "left")
    masked = masked.withColumn("text", F.when(F.col("quire__s").isNull(), F.col("text")).otherwise(masked_text(F.col("text"), F.col("quire__s"), mask)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("quire__s").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.where("NOT quire__maybe").select(*docs.columns).unionByName(masked.select(*docs.columns))
