"""Structured Streaming jobs over event feeds. Each has a batch twin, against which it is tested."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quire.operators.word_index import WordIndex, apply_changes, compact, open_index
from quire.sources.snapshot import shared_folder


def stream_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; the checkpoint of the query remembers the position. A path may be a folder that grows,
    or a pattern, which may also stand for one file."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote below root, a new shared folder if none is named.

    complete: the last state of the result; append and update: all rows that were emitted. Each micro-batch replaces
    its own part, so a batch that is run again, or a stream that is resumed on the same root, doubles nothing.
    """
    spark = stream.sparkSession
    root = root or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/all" if mode == "complete" else f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{root}/out/all")
    parts = spark.read.option("basePath", f"{root}/out").schema(stream.schema.add("batch", "long")).parquet(f"{root}/out")
    return parts.select(*stream.columns)


def usage_windows(events: DataFrame, length: str = "24 hours", slide: str | None = None, late: str = "10 days") -> DataFrame:
    """kind, start, calls, tokens per window of events (kind, created_at, tokens)."""
    window = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    rows = events.withWatermark("created_at", late).groupBy(window.alias("w"), "kind").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return rows.select("kind", F.col("w.start").alias("start"), "calls", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 days") -> DataFrame:
    """ref, start, n: activity without a pause longer than gap."""
    rows = events.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("w"), "ref").agg(F.count("*").alias("n"))
    return rows.select("ref", F.col("w.start").alias("start"), "n")


def dedupe_jobs(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])


def admit(times: list[float], tokens: list[int], held: list[tuple[float, int]], limit: int, seconds: float) -> tuple[list[bool], list[tuple[float, int]]]:
    """Which calls fit in the budget of the trailing window, and what the window holds then. A blocked call uses nothing."""
    out = []
    for t, n in zip(times, tokens, strict=True):
        held = [h for h in held if h[0] > t - seconds]
        ok = sum(h[1] for h in held) + n <= limit
        out.append(ok)
        held += [(t, n)] if ok else []
    return out, held


def budget_gate(events: DataFrame, limit: int, hours: int = 24, late: str = "10 days") -> DataFrame:
    """event_id, ref, admitted for events (event_id, ref, created_at, tokens): state per ref is the window's admitted calls."""
    seconds = hours * 3600.0

    def gate(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["created_at", "event_id"])
        times = (pdf["created_at"].astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1}[pdf["created_at"].dt.unit]).tolist()
        held = list(zip(*state.get, strict=True)) if state.exists else []
        ok, held = admit(times, pdf["tokens"].tolist(), held, limit, seconds)
        state.update(([h[0] for h in held], [int(h[1]) for h in held]))
        state.setTimeoutTimestamp(max(int(times[-1] * 1000) + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "ref": key[0], "admitted": ok})

    return events.withWatermark("created_at", late).groupBy("ref").applyInPandasWithState(
        gate, "event_id long, ref long, admitted boolean", "times array<double>, tokens array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def expired_leases(events: DataFrame, lease: int = 300, attempts: int = 3, late: str = "1 hour") -> DataFrame:
    """job, action: requeue or fail when a running job (job, status, ts) has shown no life for a lease."""

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, tries, _ = state.get
            state.remove()
            if status == "running":
                yield pd.DataFrame({"job": [key[0]], "action": ["requeue" if tries < attempts else "fail"]})
            return
        pdf = pd.concat(list(batches)).sort_values("ts")
        tries = (state.get[1] if state.exists else 0) + int((pdf["status"] == "running").sum())
        last = pdf["ts"].iloc[-1]
        at = int(last.timestamp() * 1000)
        state.update((pdf["status"].iloc[-1], tries, at))
        state.setTimeoutTimestamp(max(at + lease * 1000, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", late).groupBy("job").applyInPandasWithState(
        watch, "job long, action string", "status string, tries int, at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def ttl_cache(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """key, value, alive: the newest value (key, value, created_at) as it comes, and once more, not alive, at its expiry."""

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, _ = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "alive": [False]})
            return
        last = pd.concat(list(batches)).sort_values("created_at").iloc[-1]
        at = int(last["created_at"].timestamp() * 1000)
        if not state.exists or at >= state.get[1]:
            state.update((str(last["value"]), at))
            state.setTimeoutTimestamp(max(at + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"key": [key[0]], "value": [str(last["value"])], "alive": [True]})

    return events.withWatermark("created_at", late).groupBy("key").applyInPandasWithState(
        keep, "key string, value string, alive boolean", "value string, at long", "update", GroupStateTimeout.EventTimeTimeout
    )


def incremental_index(changes: DataFrame, tokens: Column, root: str | None = None, most: int = 8) -> WordIndex:
    """A stored word index kept in step with a stream of chunk changes (chunk_id, text, seq; a null text deletes).

    Each micro-batch is a segment under its number, so a batch that is run again replaces itself, and a stream that is
    resumed on the same root goes on from what is there. As soon as there are more than `most` segments they are merged.
    """
    spark = changes.sparkSession
    root = root or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("chunk_id").agg(F.max_by("text", "seq").alias("text"))
        index = apply_changes(last, tokens, f"{root}/index", number, buckets=16)
        if len(index.segments) > most:
            compact(index)

    query = changes.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
    return open_index(spark, f"{root}/index")
