"""Sharding by weighted rendezvous hashing.

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from md5; the
shard with the largest ``-weight / ln(u)`` takes the key. A shard's share is
proportional to its weight, the choice depends on the key and the shard list
alone, and adding a shard moves only the rows that the new shard wins.

All of it is DataFrame expressions. Slots (positions inside a shard) need a
running count per shard: rows are counted per (shard, bucket), the at most
shards x BUCKETS counts are summed up in order, and only rows of one bucket
are ranked together. Equal rows are counted first and expanded last, so a
repeated row does not pile up in one task.

Defined cases: null key = the key ``\\N``; null text = size 1, crc 0; repeated
rows keep one slot each; rows with one key share a shard; empty table = empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024          # ranked groups per shard; bounds the table of offsets
EXPAND = 4096           # equal rows expanded by one inner sequence


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("\\N"))


def _uniform(text: Column) -> Column:
    """The first 52 bits of md5, centred in their interval of (0, 1)."""
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that takes ``key``; ties go to the smaller number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    bids = [F.struct((F.lit(-float(w)) / F.log(_uniform(F.concat(key_text(key), F.lit(f"|{s}"))))).alias("score"),
                     F.lit(-s).alias("minus_shard")) for s, w in enumerate(weights)]
    best = F.array_max(F.array(*bids))
    return (-best["minus_shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with the column ``shard`` added (an existing one is replaced)."""
    return df.withColumn(shard, rendezvous_shard(F.col(key), weights))


def bucket_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key_text(key)), 1, 8), 16, 10).cast("long") % F.lit(BUCKETS)


def shard_layout(df: DataFrame, key: str, text: str, weights: Sequence[float],
                 grown_weight: float = 1.0) -> DataFrame:
    """Per row of ``df``: key, size, text_crc32, law, shard, slot (0, 1, ... in its
    shard), grown_shard (its shard after one more shard of ``grown_weight``)."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(F.col(key).alias("k"), (F.length(raw).cast("long") + 1).alias("size"),
                     F.crc32(raw).alias("crc"))
    parts = ["k", "size", "crc"]
    counted = (rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("shard", rendezvous_shard(F.col("k"), weights))
               .withColumn("grown", rendezvous_shard(F.col("k"), [*weights, grown_weight]))
               .withColumn("bucket", bucket_of(F.col("k"))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counted.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
              .select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    inside = (Window.partitionBy("shard", "bucket").orderBy(F.col("k").asc_nulls_first(), "crc", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (counted.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(F.broadcast(starts), ["shard", "bucket"]))   # at most shards x BUCKETS rows
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {EXPAND}"))))
    one_by_one = pieces.withColumn("i", F.explode(F.sequence(
        F.col("piece") * EXPAND, F.least((F.col("piece") + 1) * EXPAND, F.col("n")) - 1)))
    return one_by_one.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"),
                             F.lit("key").alias("law"), "shard",
                             (F.col("start") + F.col("ahead") + F.col("i")).cast("long").alias("slot"),
                             F.col("grown").alias("grown_shard"))
