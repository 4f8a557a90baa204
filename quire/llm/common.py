"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other scripts keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; one of our own only where none is set."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


#: A set of keys is summed up in so many bits, whatever its size: at most 8 MB, which may be broadcast.
BITS = 26


def flagged(df: DataFrame, key: Column, members: DataFrame, name: str = "quire__maybe") -> DataFrame:
    """df with a boolean column: false where key is certainly not among the one column of members, or null.

    A bitmap of hashed keys of fixed size is broadcast, so that rows that can't meet members need not move. Where it
    says true, a join must decide; the fuller it is, the more rows move. Nothing else depends on the size of members.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS)) + 1
    one = slot(F.col(members.columns[0]))
    bits = members.select(F.bitmap_bucket_number(one).alias("quire__bucket"), F.bitmap_bit_position(one).alias("quire__bit"))
    bits = bits.groupBy("quire__bucket").agg(F.bitmap_construct_agg("quire__bit").alias("quire__bits"))
    at = F.bitmap_bit_position(slot(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("quire__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = key.isNotNull() & F.col("quire__bits").isNotNull() & (F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1)
    return df.join(F.broadcast(bits), F.bitmap_bucket_number(slot(key)) == F.col("quire__bucket"), "left").withColumn(name, F.coalesce(found, F.lit(False))).drop("quire__bucket", "quire__bits")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids, which is stored and has distinct ids. Null ids stay."""
    gone = ids.select(F.col("doc_id").alias("quire__gone"))
    rows = flagged(docs, F.col("doc_id"), gone)
    doubtful = rows.where("quire__maybe").join(gone, F.col("doc_id") == F.col("quire__gone"), "left_anti")
    return rows.where("NOT quire__maybe").unionByName(doubtful).drop("quire__maybe")


def released(*tables: DataFrame) -> None:
    """Frees the space of stored tables that are not read again."""
    for df in tables:
        path = df.inputFiles()[:1]
        if path:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path[0].rsplit("/", 1)[0])
