"""Catalogue: chunking, knowledge-base listing and ingest report over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.functions import text as tf
from corpusworks.operators import chunk as ch
from corpusworks.operators import knowledge as kb
from corpusworks.plans.registry import query
from corpusworks.session import load_table

SIZE, OVERLAP, STEP = K.CHUNK_SIZE, K.CHUNK_OVERLAP, K.CHUNK_SIZE - K.CHUNK_OVERLAP

# DuckDB: C2 chunk starts per document (independent formulation of the rule)
_SQL_STARTS = f"""
  SELECT doc_id, source, lang, text,
         unnest(generate_series(0, greatest(length(text) - {OVERLAP} - 1, 0), {STEP})) AS start
  FROM documents WHERE length(text) > 0"""


def doc_chunks(spark, sf_dir, size=SIZE, overlap=OVERLAP):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return ch.fixed_stride_chunks(docs, "text", size, overlap)


@query("c2_fixed_stride_chunks", f"""
WITH s AS ({_SQL_STARTS})
SELECT doc_id, (start // {STEP})::INTEGER AS chunk_no, start::INTEGER AS start,
       sha256(concat_ws(chr(1), source, CAST(doc_id AS VARCHAR), CAST(start // {STEP} AS VARCHAR))) AS chunk_id,
       substring(text, start + 1, {SIZE}) AS text
FROM s""")
def c2_fixed_stride_chunks(spark, sf_dir):
    c = doc_chunks(spark, sf_dir)
    return c.select("doc_id", "chunk_no", "start", ch.chunk_id("source", "doc_id", "chunk_no").alias("chunk_id"),
                    "text")


@query("a1_chunks_per_source", f"""
WITH s AS ({_SQL_STARTS})
SELECT regexp_extract(source, '[^/]*$') AS filename, count(*)::BIGINT AS chunk_count
FROM s WHERE source IS NOT NULL GROUP BY 1""")
def a1_chunks_per_source(spark, sf_dir):
    return kb.list_documents(doc_chunks(spark, sf_dir))


@query("c1_recursive_chunks")
def c1_recursive_chunks(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ch.recursive_chunks(docs, "text", SIZE, OVERLAP).select("doc_id", "chunk_no", "start", "text")


@query("u7_chunk_table_function")
def u7_chunk_table_function(spark, sf_dir):
    ch.register_chunk_table_function(spark, "chunk_text")
    load_table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("cw_u7_documents")
    return spark.sql(f"""SELECT d.doc_id, c.chunk_no, c.chunk AS text
                         FROM cw_u7_documents d, LATERAL chunk_text(d.text, {SIZE}, {OVERLAP}) c""")


@query("s8_ingest_report", f"""
SELECT lang, source, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars,
       sum(CASE WHEN length(text) > 0 THEN (greatest(length(text) - {OVERLAP} - 1, 0) // {STEP}) + 1 ELSE 0 END)::BIGINT
         AS chunks
FROM documents GROUP BY ROLLUP (lang, source)""")
def s8_ingest_report(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return (docs.rollup("lang", "source")
            .agg(F.count(F.lit(1)).alias("docs"),
                 F.sum(F.length("text")).cast("long").alias("chars"),
                 F.sum(ch.stride_chunk_count("text", SIZE, OVERLAP)).cast("long").alias("chunks")))


@query("a7_totals", """
SELECT count(*)::BIGINT AS n_docs, sum(length(text))::BIGINT AS n_chars,
       sum(strlen(text))::BIGINT AS n_bytes, max(length(text))::BIGINT AS max_chars,
       count(DISTINCT source)::BIGINT AS n_sources
FROM documents""")
def a7_totals(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n_docs"),
                    F.sum(F.length("text")).cast("long").alias("n_chars"),
                    F.sum(F.octet_length("text")).cast("long").alias("n_bytes"),
                    F.max(F.length("text")).cast("long").alias("max_chars"),
                    F.countDistinct("source").cast("long").alias("n_sources"))


@query("f4_format_size", """
WITH s AS (SELECT source, sum(strlen(text))::BIGINT AS n FROM documents GROUP BY source
           UNION ALL SELECT 'all', sum(strlen(text))::BIGINT FROM documents
           UNION ALL SELECT 'doc' || doc_id, strlen(text)::BIGINT FROM documents),
q AS (SELECT source, n,
             CASE WHEN n < 1024 THEN NULL WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576
                  ELSE 1073741824 END AS u FROM s),
r AS (SELECT source, n, u, (n * 10) // u AS q0, (n * 10) % u AS rem FROM q)
SELECT source, n AS size_bytes,
       CASE WHEN u IS NULL THEN n::VARCHAR || ' B'
            ELSE (CASE WHEN rem * 2 > u OR (rem * 2 = u AND q0 % 2 = 1) THEN q0 + 1 ELSE q0 END // 10)::VARCHAR
                 || '.' || (CASE WHEN rem * 2 > u OR (rem * 2 = u AND q0 % 2 = 1) THEN q0 + 1 ELSE q0 END % 10)::VARCHAR
                 || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS size
FROM r""")
def f4_format_size(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    per_source = docs.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("size_bytes"))
    total = docs.agg(F.sum(F.octet_length("text")).cast("long").alias("size_bytes")).select(
        F.lit("all").alias("source"), "size_bytes")
    per_doc = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"),
                          F.octet_length("text").cast("long").alias("size_bytes"))
    sizes = per_source.unionByName(total).unionByName(per_doc)
    return sizes.select("source", "size_bytes", tf.format_size("size_bytes").alias("size"))


@query("a8_bases", """SELECT DISTINCT source AS kb FROM documents WHERE length(text) > 0""")
def a8_bases(spark, sf_dir):
    # one knowledge base per source: the bases that the documents make
    return kb.list_bases(load_table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("source").alias("kb")))
