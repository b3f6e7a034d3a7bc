"""Catalogue: file scans over files that Spark writes from the driver's tables, the reader registry
and the user's embedder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusworks.functions import text as tf
from corpusworks.operators import embed as em
from corpusworks.plans.registry import query
from corpusworks.plans.sqlfrag import sql_strip
from corpusworks.session import load_table, scratch_dir
from corpusworks.sources import files as fs

TITLE_CHARS = 40


def documents(spark, sf_dir, *columns):
    return load_table(spark, sf_dir, "documents").select(*columns)


@query("s1_text_scan", """
SELECT source, sum(length(text) + 1)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY source""")
def s1_text_scan(spark, sf_dir):
    """Text files in a folder per source, read whole."""
    path = scratch_dir(spark, "s1-files")
    documents(spark, sf_dir, "source", "text").where("text IS NOT NULL").write.partitionBy("source").text(path)
    docs, _ = fs.scan_documents(spark, path)
    return docs.groupBy(F.regexp_extract("source", "/source=([^/]*)/", 1).alias("source")).agg(
        F.sum(F.length("text")).cast("long").alias("n_chars"))


_SQL_CSV = f"""
SELECT 'doc_id: ' || doc_id || chr(10) || 'source: ' || source || chr(10) || 'title: '
       || {sql_strip(f"left(coalesce(text, ''), {TITLE_CHARS})")} AS text FROM documents"""


def csv_files(spark, sf_dir):
    """The documents as CSV files with a header; titles hold commas, quotes and line ends."""
    path = scratch_dir(spark, "csv-files")
    (documents(spark, sf_dir, "doc_id", "source", F.substring(F.coalesce("text", F.lit("")), 1, TITLE_CHARS).alias("title"))
     .write.option("header", True).option("escape", '"').csv(path))
    return path


@query("s2_csv_scan", _SQL_CSV)
def s2_csv_scan(spark, sf_dir):
    docs, _ = fs.scan_documents(spark, csv_files(spark, sf_dir))
    return docs.select("text")


_SQL_JSON = """
SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5 FROM documents"""


def json_files(spark, sf_dir):
    path = scratch_dir(spark, "json-files")
    documents(spark, sf_dir, "doc_id", "text").write.json(path)
    return path


def _json_documents(docs):
    return docs.select(F.get_json_object("text", "$.doc_id").alias("doc_id"),
                       F.md5(F.get_json_object("text", "$.text")).alias("text_md5"))


@query("s3_json_scan", _SQL_JSON)
def s3_json_scan(spark, sf_dir):
    """JSON files read whole: no valid value, so every line is a document."""
    return _json_documents(fs.scan_documents(spark, json_files(spark, sf_dir))[0])


@query("s4_json_lines_scan", _SQL_JSON)
def s4_json_lines_scan(spark, sf_dir):
    """The same files scanned by lines."""
    return _json_documents(fs.scan_documents(spark, json_files(spark, sf_dir), line_formats=(".json",))[0])


@query("s7_quarantine", """
SELECT '.csv' AS ext, count(*)::BIGINT AS documents, CAST(NULL AS VARCHAR) AS reason FROM documents
UNION ALL SELECT DISTINCT '.parquet', 0, 'unsupported format' FROM documents""")
def s7_quarantine(spark, sf_dir):
    """A folder of readable and unreadable files: documents and reasons by extension."""
    path = csv_files(spark, sf_dir)
    documents(spark, sf_dir, "doc_id").write.parquet(f"{path}/more")
    docs, bad = fs.scan_documents(spark, path)
    found = docs.groupBy("ext").agg(F.count(F.lit(1)).alias("documents"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(bad.select("ext", F.lit(0).cast("long").alias("documents"), "reason").distinct())


@query("u5_reader_registry", "SELECT count(*)::BIGINT AS n_lines FROM documents")
def u5_reader_registry(spark, sf_dir):
    """A reader of the caller's takes the place of the one for CSV files."""
    path = scratch_dir(spark, "u5-files")
    documents(spark, sf_dir, "doc_id", "lang").write.csv(path)
    docs, _ = fs.scan_documents(spark, path, extractors={".csv": lambda content: [str(content.count(b"\n"))]})
    return docs.agg(F.sum(F.col("text").cast("long")).alias("n_lines"))


@query("u3_user_embedder", """
SELECT doc_id, length(text)::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words
FROM documents WHERE text IS NOT NULL""")
def u3_user_embedder(spark, sf_dir):
    """A model of the caller's, made once per worker: two numbers per text."""
    def make_model():
        def predict(texts):
            return np.array([[len(t), t.count(" ") + 1] for t in texts], np.float32)
        return predict

    made = em.embed_with(documents(spark, sf_dir, "doc_id", "text").where("text IS NOT NULL"), make_model, "text", 2)
    return made.select("doc_id", F.col("embedding")[0].cast("double").alias("n_chars"),
                       F.col("embedding")[1].cast("double").alias("n_words"))


@query("f17_file_stem", "SELECT doc_id, source || '.v' || (doc_id % 3) AS stem FROM documents")
def f17_file_stem(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "source")
    name = F.concat(F.col("source"), F.lit(".v"), (F.col("doc_id") % 3).cast("string"), F.lit(".json"))
    return d.select("doc_id", tf.file_stem(name).alias("stem"))
