"""Citations, quotes and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build_context(hits: DataFrame) -> DataFrame:
    """query_id, context: hits (query_id, rank, source, locator, text) as numbered blocks in rank order."""
    blocks = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "source", "locator", "text"))),
        lambda h: F.concat(F.lit("["), h["rank"], F.lit("] "), h["source"], F.lit(" ("), h["locator"], F.lit(")\n"), h["text"]),
    )
    return hits.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"))


#: A marker such as [1] or [1, 2], and a quote of 8 to 300 characters right behind it, in any of the usual glyphs.
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]\s*(?:[\"“「『«]([^\"”」』»]{8,300})[\"”」』»])?"


def extract_citations(answers: DataFrame) -> DataFrame:
    """answer_id, marker, quote: distinct markers with the first quote that follows any of their places, else null."""
    at = lambda g: F.regexp_extract_all("answer", F.lit(CITATION), g)
    flat = answers.select("answer_id", F.posexplode(F.arrays_zip(at(1).alias("m"), at(2).alias("q"))).alias("i", "c"))
    each = flat.select("answer_id", "i", F.explode(F.split("c.m", r"\s*,\s*")).alias("m"), F.nullif(F.col("c.q"), F.lit("")).alias("quote"))
    first = F.min_by("quote", F.when(F.col("quote").isNotNull(), F.col("i")))
    return each.groupBy("answer_id", F.col("m").cast("int").alias("marker")).agg(first.alias("quote"))


def plain(c: Column) -> Column:
    """Lower case without spaces and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def quote_share(quote: Column, source: Column) -> Column:
    """1 if the quote stands in the source; else the share of its 4-character windows, two apart, that do. Both plain."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(quote) - 3, F.lit(1)), F.lit(2)), lambda i: F.substring(quote, i, F.lit(4)))
    held = F.size(F.filter(windows, lambda w: F.contains(source, w)))
    return F.when(quote.isNull() | source.isNull(), F.lit(None)).when(F.length(quote) == 0, 0.0).when(F.contains(source, quote), 1.0).otherwise(held / F.size(windows))


def verify_citations(answers: DataFrame, hits: DataFrame, threshold: float = 0.42) -> DataFrame:
    """answer_id, marker, share, state: verified, unverified (no quote) or mismatched; out_of_range without such a hit.

    hits: (answer_id, rank, text)."""
    cited = extract_citations(answers).join(hits.select("answer_id", F.col("rank").alias("marker"), "text"), ["answer_id", "marker"], "left")
    share = F.round(quote_share(plain(F.col("quote")), plain(F.col("text"))), 6)
    state = F.when(F.col("text").isNull(), "out_of_range").when(F.col("quote").isNull(), "unverified").when(share >= threshold, "verified").otherwise("mismatched")
    return cited.select("answer_id", "marker", share.alias("share"), state.alias("state"))


def grounded(citations: DataFrame) -> DataFrame:
    """answer_id, grounded, counts by state."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return citations.groupBy("answer_id").agg(F.bool_and(F.col("state") != "mismatched").alias("grounded"), n("verified"), n("unverified"), n("mismatched"))


def contamination(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, share of the item's distinct 8-word grams that stand in the document.

    The items are the stated, small side; their grams are sent to the executors when they are few, and a document's
    grams meet them before anything is moved.
    """
    from quire.operators.retrieval import small_side

    def grams(df: DataFrame, key: str) -> DataFrame:
        w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))
        return df.select(key, w.alias("w")).where(F.size("w") > 0).select(key, F.explode(F.array_distinct(runs)).alias("g"))

    items = grams(benchmark, "item_id")
    size = items.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = grams(documents, "doc_id").join(small_side(items, 500_000), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("k"))
    return shared.join(small_side(size), "item_id").withColumn("share", F.round(F.col("k") / F.col("n"), 6)).where(F.col("share") >= least).select("doc_id", "item_id", "share")


#: Words that point at something said before.
ANAPHORA = r"(?i)\b(it|its|this|that|these|those|they|them|he|she|former|latter|above|previous)\b|它|这|那|上述|前者|后者"


def needs_context(messages: DataFrame) -> DataFrame:
    """message_id, needs_context of user messages."""
    short = (F.length(F.trim("text")) <= 12) & ~F.col("text").rlike("[A-Za-z]{3}")
    return messages.where("role = 'user'").select("message_id", (F.col("text").rlike(ANAPHORA) | short).alias("needs_context"))


def history_window(messages: DataFrame, turns: int = 6, most: int = 4000) -> DataFrame:
    """conv_id, history, fingerprint: the last user and assistant turns, markers stripped from answers, each cut."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("message_id")))
    last = messages.where("role IN ('user', 'assistant')").withColumn("k", k).where(F.col("k") <= turns)
    text = F.when(F.col("role") == "assistant", F.regexp_replace("text", r"\[\d+(?:,\s*\d+)*\]", "")).otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "message_id", F.concat("role", F.lit(": "), F.substring(text, 1, most)).alias("line"))))
    history = F.transform(lines, lambda s: s["line"])
    return last.groupBy("conv_id").agg(F.array_join(history, "\n").alias("history"), F.substring(F.sha2(F.array_join(F.slice(history, F.greatest(F.size(history) - 1, F.lit(1)), F.lit(2)), "\n"), 256), 1, 16).alias("fingerprint"))


def truncate_after(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """messages without those strictly after the edited one (conv_id, message_id) of their conversation."""
    at = edits.join(messages.select("conv_id", "message_id", "created_at"), ["conv_id", "message_id"]).groupBy("conv_id").agg(F.min(F.struct("created_at", "message_id")).alias("_at"))
    return messages.join(at, "conv_id", "left").where(F.col("_at").isNull() | (F.struct("created_at", "message_id") <= F.col("_at"))).drop("_at")


def conversation_list(messages: DataFrame, pinned: DataFrame) -> DataFrame:
    """conv_id, pinned, n_messages, title, last_at, position: pinned ones first, then the newest."""
    rows = messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("message_id"))), 1, 60).alias("title"), F.max("created_at").alias("last_at")
    )
    rows = rows.join(pinned.select("conv_id", F.lit(True).alias("pinned")), "conv_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return rows.orderBy(F.desc("pinned"), F.desc("last_at"), "conv_id")
