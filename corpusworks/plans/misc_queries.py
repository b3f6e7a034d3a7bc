"""Catalogue: knowledge-base append/delete, preference match, lookup, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators import chunk as ch
from corpusworks.operators import knowledge as kb
from corpusworks.operators import relational as rel
from corpusworks.operators.kbstore import KnowledgeBaseStore
from corpusworks.plans.registry import query
from corpusworks.session import load_table, scratch_dir

STEP = K.CHUNK_SIZE - K.CHUNK_OVERLAP
_SQL_CHUNKS = f"""
  SELECT doc_id, source, unnest(generate_series(0, greatest(length(text) - {K.CHUNK_OVERLAP} - 1, 0), {STEP})) AS start
  FROM documents WHERE length(text) > 0"""

READDED_SOURCE = "src3"
DELETED_NAMES = ["src1", "src5", "missing.txt"]


def chunk_table(spark, sf_dir, kb_name="docs", seq=1, source_filter=None):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    if source_filter is not None:
        d = d.filter(F.col("source") == source_filter)
    c = ch.fixed_stride_chunks(d, "text")
    return c.select(F.lit(kb_name).alias("kb"), F.lit(seq).cast("long").alias("ingest_seq"), "source", "doc_id",
                    "chunk_no", "text")


@query("k2_append_counts", f"""
WITH c AS ({_SQL_CHUNKS})
SELECT source AS filename, count(*)::BIGINT AS chunk_count
FROM (SELECT source FROM c UNION ALL SELECT source FROM c WHERE source = '{READDED_SOURCE}') GROUP BY source""")
def k2_append_counts(spark, sf_dir):
    base = chunk_table(spark, sf_dir, seq=1)
    again = chunk_table(spark, sf_dir, seq=2, source_filter=READDED_SOURCE)  # K2: no de-duplication
    return kb.list_documents(base.unionByName(again))


@query("k2_append", f"""
SELECT source, doc_id, CASE WHEN source = '{READDED_SOURCE}' THEN 2 ELSE 1 END::BIGINT AS ingests
FROM documents WHERE regexp_matches(text, '[^ \t\n\x0B\x0C\r]')""")
def k2_append(spark, sf_dir):
    """A base of all documents to which one source is appended again: how often each document is in it."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    store = KnowledgeBaseStore(spark, scratch_dir(spark, "k2-store"))
    store.create("docs", d, id_col="doc_id")
    store.append("docs", d.where(F.col("source") == READDED_SOURCE), id_col="doc_id")
    return (store.chunks("docs", columns=["doc_id"]).groupBy("source", "doc_id")
            .agg(F.countDistinct("ingest_seq").alias("ingests")))


_SQL_NAMES = ", ".join(f"('{n}')" for n in DELETED_NAMES)


@query("k3_delete_document", f"""
WITH c AS ({_SQL_CHUNKS}), t(name) AS (VALUES {_SQL_NAMES})
SELECT source AS filename, count(*)::BIGINT AS chunk_count FROM c
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name = regexp_extract(c.source, '[^/]*$') OR t.name = c.source)
GROUP BY source""")
def k3_delete_document(spark, sf_dir):
    base = chunk_table(spark, sf_dir, seq=1)
    tomb = kb.names_frame(spark, "docs", DELETED_NAMES, seq=1)
    return kb.list_documents(kb.apply_tombstones(base, tomb))


@query("k3_removed_count", f"""
WITH c AS ({_SQL_CHUNKS}), t(name) AS (VALUES {_SQL_NAMES})
SELECT t.name, count(c.source)::BIGINT AS removed
FROM t LEFT JOIN c ON t.name = regexp_extract(c.source, '[^/]*$') OR t.name = c.source GROUP BY t.name""")
def k3_removed_count(spark, sf_dir):
    base = chunk_table(spark, sf_dir, seq=1)
    tomb = kb.names_frame(spark, "docs", DELETED_NAMES, seq=1)
    return kb.removed_counts(base, tomb).select("name", "removed")


PREFERENCES = ["red anvil", "blue", "gizmo"]
_SQL_PREFS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PREFERENCES))


@query("j4_ranked_preference", f"""
WITH prefs(pref_rank, pref) AS (VALUES {_SQL_PREFS}),
m AS (SELECT p.p_brand, p.p_type, arg_min(p.p_name, pr.pref_rank * 1000000000000 + p.p_partkey) AS best
      FROM part p JOIN prefs pr ON strpos(lower(p.p_name), pr.pref) > 0 GROUP BY 1, 2),
f AS (SELECT p_brand, p_type, arg_min(p_name, p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT f.p_brand, f.p_type, coalesce(m.best, f.first) AS chosen, m.best IS NOT NULL AS matched
FROM f LEFT JOIN m USING (p_brand, p_type)""")
def j4_ranked_preference(spark, sf_dir):
    p = load_table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_name").alias("name"),
                                                 F.col("p_partkey").alias("pos"))
    r = rel.ranked_preference(p, rel.preference_table(spark, PREFERENCES), ["p_brand", "p_type"])
    return r.select("p_brand", "p_type", "chosen", "matched")


EVENT_GROUPS = {"click": "interaction", "view": "interaction", "purchase": "revenue"}


@query("j5_lookup_default", """
WITH m(k, v) AS (VALUES ('click', 'interaction'), ('view', 'interaction'), ('purchase', 'revenue'))
SELECT e.event_type, coalesce(m.v, 'other') AS mapped, count(*)::BIGINT AS n
FROM events e LEFT JOIN m ON m.k = e.event_type GROUP BY 1, 2""")
def j5_lookup_default(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_type")
    m = rel.lookup_with_default(e, EVENT_GROUPS, "event_type", "other")
    return m.groupBy("event_type", "mapped").agg(F.count(F.lit(1)).alias("n"))


@query("a6_union_names", """
SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier)""")
def a6_union_names(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").select("c_name")
    s = load_table(spark, sf_dir, "supplier").select("s_name")
    return rel.union_names(c, s)
