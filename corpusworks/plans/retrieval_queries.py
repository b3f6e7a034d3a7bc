"""Catalogue: kNN retrieval, embeddings, retrieval prompts, generation hook."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators import embed as em
from corpusworks.operators import knn
from corpusworks.operators import prompts as pr
from corpusworks.operators.kbstore import KnowledgeBaseStore
from corpusworks.plans.registry import query
from corpusworks.plans.sqlfrag import sql_str
from corpusworks.session import load_table, scratch_dir

# all-vs-all over the embeddings table, self excluded, squared L2, k = 3
_SQL_KNN = f"""
  d AS (SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(range(1, len(q.embedding) + 1),
                        lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) ** 2)) AS dist
        FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id),
  r AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank
        FROM d),
  nn AS (SELECT query_id, rank, vec_id, dist FROM r WHERE rank <= {K.TOP_K})"""


def neighbours(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.knn_topk(q, e, K.TOP_K, "query_id", "embedding", "vec_id", "embedding", "l2", exclude_self=True)


@query("j1_knn_topk", f"""
WITH {_SQL_KNN}
SELECT query_id, rank::INTEGER AS rank, vec_id, round(dist, 6) AS dist FROM nn""")
def j1_knn_topk(spark, sf_dir):
    nn = neighbours(spark, sf_dir)
    return nn.select("query_id", "rank", "vec_id", F.round("dist", 6).alias("dist"))


def _sql_dense(table: str, id_col: str, dim: int) -> str:
    """DuckDB: hashed term counts -> L2-normalised dense FLOAT vector (zeros for no terms)."""
    return f"""
  SELECT d.{id_col} AS id,
         list_transform(range(0, {dim}), lambda b: CASE WHEN c.norm > 0
                        THEN (coalesce(c.m[b], 0) / c.norm)::FLOAT ELSE 0.0::FLOAT END) AS embedding
  FROM {table} d LEFT JOIN (
    SELECT id, map_from_entries(list(struct_pack(k := bucket, v := n))) AS m, sqrt(sum(n * n)) AS norm
    FROM (SELECT id, bucket, count(*)::BIGINT AS n FROM (
            SELECT {id_col} AS id,
                   (('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))), 1, 6))::BIGINT
                    % {dim})::INTEGER AS bucket
            FROM {table}) GROUP BY 1, 2)
    GROUP BY id) c ON c.id = d.{id_col}"""


# questions = all benchmark items; context = the nearest chunks (cosine of hashed embeddings) of a
# stored base of all documents, cut at fixed strides
def questions(spark, sf_dir):
    return load_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def document_base(spark, sf_dir):
    store = KnowledgeBaseStore(spark, scratch_dir(spark, "retrieval-store"))
    store.create("docs", load_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), recursive=False,
                 id_col="doc_id")
    return store


def retrieved_chunks(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q, document_base(spark, sf_dir).retrieve(q, "docs")


_SQL_QV = "qv AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
_SQL_NEAREST = f"""
  chunks AS (SELECT sha256(concat_ws(chr(1), 'docs', source, '1', CAST(doc_id AS VARCHAR), CAST(start // 800 AS VARCHAR),
                                     substr(text, start + 1, 1000))) AS chunk_id, source, substr(text, start + 1, 1000) AS text
             FROM (SELECT doc_id, source, text, unnest(generate_series(0, greatest(length(text) - 201, 0), 800)) AS start
                   FROM documents WHERE length(text) > 0)),
  q AS ({_sql_dense('benchmark', 'item_id', 64)}),
  c AS ({_sql_dense('chunks', 'chunk_id', 64)}),
  d AS (SELECT q.id AS query_id, c.id AS chunk_id,
               list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE))
                 AS dot,
               sqrt(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE ** 2))) *
               sqrt(list_sum(list_transform(range(1, 65), lambda i: c.embedding[i]::DOUBLE ** 2))) AS den
        FROM q, c),
  r AS (SELECT query_id, chunk_id, CASE WHEN den > 0 THEN 1.0 - dot / den ELSE 1.0 END AS dist FROM d),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rank FROM r)"""
_SQL_QNN = f"""{_SQL_NEAREST},
  nn AS (SELECT k.query_id, k.rank, chunks.text, chunks.source
         FROM k JOIN chunks USING (chunk_id) WHERE k.rank <= {K.TOP_K})"""


@query("p3_retrieval_prompt", f"""
WITH {_SQL_QV}, {_SQL_QNN},
  ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS c FROM nn GROUP BY query_id)
SELECT qv.query_id,
       CASE WHEN ctx.c IS NOT NULL AND ctx.c <> '' THEN replace({sql_str(K.RAG_SYSTEM_TEMPLATE)}, '{{CONTEXT}}', ctx.c)
            ELSE {sql_str(K.PLAIN_SYSTEM_PROMPT)} END AS system,
       qv.question AS human
FROM qv LEFT JOIN ctx USING (query_id)""")
def p3_retrieval_prompt(spark, sf_dir):
    qv, nn = retrieved_chunks(spark, sf_dir)
    p = pr.retrieval_prompt(nn, qv.select("query_id", "question"))
    return p.select("query_id", "system", "human")


@query("p4_answer_with_sources", f"""
WITH {_SQL_QV}, {_SQL_QNN},
  src AS (SELECT query_id, string_agg(DISTINCT regexp_extract(source, '[^/]*$'), ', '
                                      ORDER BY regexp_extract(source, '[^/]*$')) AS s FROM nn GROUP BY query_id)
SELECT qv.query_id,
       CASE WHEN src.s IS NOT NULL AND src.s <> '' THEN qv.question || {sql_str(K.SOURCES_PREFIX)} || src.s
            ELSE qv.question END AS answer
FROM qv LEFT JOIN src USING (query_id)""")
def p4_answer_with_sources(spark, sf_dir):
    qv, nn = retrieved_chunks(spark, sf_dir)
    # answers from the echo stand-in generator: the question itself
    answers = qv.select("query_id", F.col("question").alias("answer"))
    return pr.answer_with_sources(answers, nn)


@query("u6_batch_generate", f"""
WITH {_SQL_QV}, {_SQL_QNN},
  ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS c FROM nn GROUP BY query_id),
  p AS (SELECT qv.query_id, qv.question,
               CASE WHEN ctx.c IS NOT NULL AND ctx.c <> '' THEN replace({sql_str(K.RAG_SYSTEM_TEMPLATE)}, '{{CONTEXT}}', ctx.c)
                    ELSE {sql_str(K.PLAIN_SYSTEM_PROMPT)} END AS system FROM qv LEFT JOIN ctx USING (query_id))
SELECT query_id, md5(system) || ' ' || length(question) AS answer, CAST(NULL AS VARCHAR) AS error FROM p""")
def u6_batch_generate(spark, sf_dir):
    """The generation hook, with a stand-in model whose answer depends on the whole prompt."""
    def digest(systems, humans):
        return [f"{hashlib.md5(s.encode()).hexdigest()} {len(h)}" for s, h in zip(systems, humans)]

    qv, nn = retrieved_chunks(spark, sf_dir)
    p = pr.retrieval_prompt(nn, qv.select("query_id", "question"))
    return pr.generate(p, digest).select("query_id", "answer", "error")


@query("v1_hashed_terms", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents)
SELECT doc_id, (('0x' || substr(md5(word), 1, 6))::BIGINT % 256)::INTEGER AS bucket, count(*)::BIGINT AS n
FROM w GROUP BY 1, 2""")
def v1_hashed_terms(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return em.hashed_terms(d, "doc_id", "text", 256).select("doc_id", "bucket", F.col("n").cast("long"))


@query("v1_embed_dense", f"SELECT id AS doc_id, embedding FROM ({_sql_dense('documents', 'doc_id', 64)})")
def v1_embed_dense(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return em.embed_hashed(d, "text", em.DEFAULT_DIM).select("doc_id", "embedding")


@query("j1_text_retrieval", f"""
WITH {_SQL_NEAREST}
SELECT query_id, rank::INTEGER AS rank, chunk_id, round(dist, 6) AS dist FROM k WHERE rank <= {K.TOP_K}""")
def j1_text_retrieval(spark, sf_dir):
    """Benchmark questions -> the 3 nearest chunks of a stored base (cosine)."""
    _, nn = retrieved_chunks(spark, sf_dir)
    return nn.select("query_id", "rank", "chunk_id", F.round("dist", 6).alias("dist"))


@query("v3_chunk_ids_and_sources", f"""
SELECT sha256(concat_ws(chr(1), source, CAST(doc_id AS VARCHAR), CAST(start // 800 AS VARCHAR))) AS chunk_id,
       source
FROM (SELECT doc_id, source, unnest(generate_series(0, greatest(length(text) - 201, 0), 800)) AS start
      FROM documents WHERE length(text) > 0)""")
def v3_chunk_ids_and_sources(spark, sf_dir):
    """V3: full read of ids + metadata of a chunk table (vectors never read)."""
    from corpusworks.operators.chunk import chunk_id, fixed_stride_chunks
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    c = fixed_stride_chunks(d, "text")
    return c.select(chunk_id("source", "doc_id", "chunk_no").alias("chunk_id"), "source")
