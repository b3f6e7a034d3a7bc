"""Knowledge-base operators over a chunk table (DataFrame level).

A chunk table has at least ``kb, source, ingest_seq, doc_id, chunk_no, text``
(plus ``chunk_id`` and optionally ``embedding``). Deletes are tombstones
``(kb, name, seq)`` applied with anti joins, so nothing is rewritten in place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.functions.text import basename
from corpusworks.session import broadcast_if_small


def list_documents(chunks: DataFrame, source_col: str = "source") -> DataFrame:
    """A1/O2: chunk count per file name (basename of source), sorted
    case-insensitively; rows without a source are ignored.

    Hash aggregate with map-side partial counts, so a source holding a large
    share of all chunks costs one partial row per task before the shuffle.
    """
    return (chunks.filter(F.col(source_col).isNotNull())
            .groupBy(basename(source_col, None).alias("filename"))
            .agg(F.count(F.lit(1)).alias("chunk_count"))
            .orderBy(F.lower("filename"), "filename"))


def list_bases(chunks: DataFrame, kb_col: str = "kb") -> DataFrame:
    """Names of the knowledge bases present (a partition-column distinct)."""
    return chunks.select(F.col(kb_col).alias("kb")).distinct().orderBy("kb")


def matches_name(source_col: str, name_col: str):
    """K3 match rule: basename(source) = name OR source = name."""
    return (basename(source_col, None) == F.col(name_col)) | (F.col(source_col) == F.col(name_col))


def apply_tombstones(chunks: DataFrame, tombstones: DataFrame, source_col: str = "source") -> DataFrame:
    """Hide chunks matched by a tombstone of the same kb whose seq is at
    or after the chunk's ingest_seq (a file added again later reappears).

    The OR of the match rule is split into two equi anti joins (on the
    basename and on the full source), so both stay hash/broadcast joins and
    never become a nested loop.
    """
    t = broadcast_if_small(
        tombstones.select(F.col("kb").alias("_kb"), F.col("name").alias("_name"), F.col("seq").alias("_seq")))
    c = chunks.withColumn("_base", basename(source_col, None))
    by_base = c.join(t, (c["kb"] == t["_kb"]) & (c["_base"] == t["_name"]) & (c["ingest_seq"] <= t["_seq"]),
                     "left_anti")
    by_full = by_base.join(t, (by_base["kb"] == t["_kb"]) & (by_base[source_col] == t["_name"])
                           & (by_base["ingest_seq"] <= t["_seq"]), "left_anti")
    return by_full.drop("_base")


def removed_counts(chunks: DataFrame, tombstones: DataFrame, source_col: str = "source") -> DataFrame:
    """K3 report: per tombstone name the number of chunks it removes (0 = no match)."""
    t = broadcast_if_small(tombstones.select("kb", "name", "seq"))
    c = chunks.select("kb", source_col, "ingest_seq").withColumn("_base", basename(source_col, None))
    hit_base = c.join(t, (c["kb"] == t["kb"]) & (c["_base"] == t["name"]) & (c["ingest_seq"] <= t["seq"]))
    hit_full = c.join(t, (c["kb"] == t["kb"]) & (c[source_col] == t["name"]) & (c["ingest_seq"] <= t["seq"])
                      & (c["_base"] != t["name"]))
    hits = (hit_base.select(t["kb"], t["name"]).unionByName(hit_full.select(t["kb"], t["name"]))
            .groupBy("kb", "name").agg(F.count(F.lit(1)).alias("removed")))
    return (t.select("kb", "name").distinct()
            .join(hits, ["kb", "name"], "left")
            .select("kb", "name", F.coalesce("removed", F.lit(0)).cast("long").alias("removed")))


def keep_requested(rows: DataFrame, requested: DataFrame, on: str | list[str]) -> DataFrame:
    """Left-semi join - keep rows whose key is in ``requested``
    (broadcast when the key list passes the size check)."""
    return rows.join(broadcast_if_small(requested), on, "left_semi")


def drop_requested(rows: DataFrame, requested: DataFrame, on: str | list[str]) -> DataFrame:
    """Left-anti join - drop rows whose key is in ``requested``
    (broadcast when the key list passes the size check)."""
    return rows.join(broadcast_if_small(requested), on, "left_anti")


def names_frame(spark, kb: str, names: Iterable[str], seq: int) -> DataFrame:
    return spark.createDataFrame([(kb, n, int(seq)) for n in names], "kb string, name string, seq long")
