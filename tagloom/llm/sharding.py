"""Rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only.

Every shard bids for a record with a hash of (record key, shard); the highest bid
wins. A further shard only adds bids, so records move to it and nowhere else.

Defined results: a null key is a key of its own; equal keys share a shard; a null
text counts no bytes. Identical rows get neighbouring slots. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that the two engines compare exactly as a double.
BID_DIGITS = 13
#: Leading digits of a key's digest which split the numbering of a shard over tasks.
SLOT_DIGITS = 4


def record_digest(key: Column) -> Column:
    text = F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("k"), key.cast("string")))
    return F.md5(text)


def bid(digest: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) for a uniform u from the digest of record and shard."""
    digits = F.substring(F.md5(F.concat(digest, F.lit(":"), shard.cast("string"))), 1, BID_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**BID_DIGITS))
    return -weight / F.log(u)


def winner(digest: Column, weights: Sequence[float]) -> Column:
    """The shard (index into ``weights``) with the highest bid."""
    bids = [
        F.struct(bid(digest, F.lit(i), F.lit(float(w))).alias("bid"), F.lit(-i).alias("neg"))
        for i, w in enumerate(weights)
    ]
    return (-F.array_max(F.array(*bids))["neg"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """Add ``digest``, ``shard`` and ``grown_shard`` (with one more shard of weight 1)."""
    digest = F.col("digest")
    more = len(weights)
    bids = docs.withColumn("digest", record_digest(F.col(key))).withColumn("shard", winner(digest, weights))
    # Only the new shard can win against the present winner.
    rivals = F.array(*[F.lit(float(w)) for w in weights])
    present = bid(digest, F.col("shard"), F.element_at(rivals, F.col("shard") + 1))
    grown = F.when(bid(digest, F.lit(more), F.lit(1.0)) > present, more).otherwise(F.col("shard"))
    return bids.withColumn("grown_shard", grown.cast("int"))


def number_slots(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Gapless ``slot`` from 0 within ``shard``, ordered by digest and ``columns``.

    Equal rows are counted first. The numbering is split by leading digits of the
    digest; each part is numbered for itself and raised by the rows of the parts
    before it, so that no task holds a shard.
    """
    units = rows.groupBy("shard", "digest", *columns).agg(F.count(F.lit(1)).alias("_n"))
    units = units.withColumn("_part", F.substring("digest", 1, SLOT_DIGITS))
    sizes = units.groupBy("shard", "_part").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_part").orderBy("digest", *columns)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_base")
    placed = units.join(bases, ["shard", "_part"]).withColumn("_first", first)
    each = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return each.withColumn("slot", (F.col("_first") + F.col("_k")).cast("long")).drop("_n", "_part", "_base", "_first", "_k")


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    body = F.col(text).cast("string")
    slim = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    numbered = number_slots(assign_shards(slim, weights, "key"), ["key", "size", "text_crc32", "grown_shard"])
    out = numbered.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    return out


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, [1.0] * 40)
