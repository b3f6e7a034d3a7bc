"""Catalogue: scalar functions and routing over pages / part / events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.functions import text as tf
from corpusworks.plans.registry import query
from corpusworks.session import load_table
from corpusworks.sources.files import rows_as_documents

_FORMAT_CASE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in K.FORMAT_BY_EXTENSION.items()) + \
    " ELSE 'unsupported' END"


@query("s6_route_by_extension", f"""
WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS file FROM pages),
e AS (SELECT page_id, file, lower(regexp_extract(file, '(?s)^\\.*[^.].*(\\.[^.]*)$', 1)) AS ext FROM b)
SELECT page_id, file, ext, {_FORMAT_CASE} AS format FROM e""")
def s6_route_by_extension(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages")
    return (p.select("page_id", tf.basename("url").alias("file"), tf.file_ext("url").alias("ext"))
            .withColumn("format", tf.reader_for_ext("ext")))


@query("s2_rows_as_documents", """
SELECT p_partkey,
       'p_partkey: ' || coalesce(CAST(p_partkey AS VARCHAR), '') || chr(10) ||
       'p_name: ' || coalesce(p_name, '') || chr(10) ||
       'p_brand: ' || coalesce(p_brand, '') || chr(10) ||
       'p_type: ' || coalesce(p_type, '') || chr(10) ||
       'p_size: ' || coalesce(CAST(p_size AS VARCHAR), '') || chr(10) ||
       'p_retailprice: ' || coalesce(CAST(p_retailprice AS VARCHAR), '') AS text
FROM part""")
def s2_rows_as_documents(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    return rows_as_documents(p, p.columns, keep=["p_partkey"])


@query("f6_safe_name", r"""
SELECT p_partkey, regexp_replace(p_name || ' ' || p_brand, '[^\p{L}\p{N}_-]', '_', 'g') AS safe_name FROM part""")
def f6_safe_name(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    return p.select("p_partkey", tf.safe_name(F.concat_ws(" ", "p_name", "p_brand")).alias("safe_name"))


@query("f7_session_id", r"""
SELECT event_id,
       strftime(ts, '%Y%m%d_%H%M%S') || '_' || left(sha256(CAST(event_id AS VARCHAR)), 6) AS session_id,
       regexp_replace(event_type, '[^\p{L}\p{N}_-]', '_', 'g') || '_' ||
       strftime(ts, '%Y%m%d_%H%M%S') || '_' || left(sha256(CAST(event_id AS VARCHAR)), 6) || '.json' AS file_name
FROM events""")
def f7_session_id(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    sid = tf.session_id("ts", "event_id")
    return e.select("event_id", sid.alias("session_id"),
                    F.concat(tf.safe_name("event_type"), F.lit("_"), sid, F.lit(".json")).alias("file_name"))


@query("f8_short_date", """
WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN props
                                 WHEN event_type = 'signup' THEN ''
                                 ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created FROM events)
SELECT event_id, created,
       CASE WHEN created IS NULL OR created = '' THEN ''
            ELSE coalesce(strftime(try_strptime(created, '%Y-%m-%d %H:%M:%S'), '%d/%m %H:%M'), left(created, 16))
       END AS short_date
FROM s""")
def f8_short_date(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    created = (F.when(F.col("event_type") == "error", F.col("props"))
               .when(F.col("event_type") == "signup", F.lit(""))
               .otherwise(tf.time_string("ts")))
    return e.select("event_id", created.alias("created")).withColumn("short_date", tf.short_date("created"))
