"""Catalogue: corpus concatenation, prompts, SFT samples, token blocks, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators import concat as cc
from corpusworks.operators import prompts as pr
from corpusworks.operators import sft
from corpusworks.operators import tokens as tk
from corpusworks.plans.registry import query
from corpusworks.plans.sqlfrag import sql_str, sql_strip
from corpusworks.session import load_table, stored

SEP2 = "chr(10) || chr(10)"
NOTICE = sql_str(K.CAP_NOTICE)


def docs(spark, sf_dir):
    return load_table(spark, sf_dir, "documents").select("doc_id", "source", "text")


@query("a4_concat_layout", f"""
SELECT source, doc_id, length(text)::BIGINT AS length,
       coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       (sum(length(text) + 2) OVER (PARTITION BY source) - 2)::BIGINT AS total
FROM documents""")
def a4_concat_layout(spark, sf_dir):
    return cc.concat_layout(docs(spark, sf_dir), ["source"], ["doc_id"])


_SQL_FULL = f"""SELECT source, string_agg(text, {SEP2} ORDER BY doc_id) AS full_text FROM documents GROUP BY source"""


@query("a5_capped_concat", f"""
WITH f AS ({_SQL_FULL}),
c AS (SELECT source, length(full_text)::BIGINT AS full_length,
             CASE WHEN length(full_text) > {K.CONTENT_CAP} THEN left(full_text, {K.CONTENT_CAP}) || {NOTICE}
                  ELSE full_text END AS t FROM f)
SELECT source, full_length, md5(t) AS text_md5, length(t)::BIGINT AS text_length FROM c""")
def a5_capped_concat(spark, sf_dir):
    c = cc.capped_concat(docs(spark, sf_dir), ["source"], ["doc_id"], "text", K.CONTENT_CAP, K.CAP_NOTICE)
    return c.select("source", "full_length", F.md5("text").alias("text_md5"),
                    F.length("text").cast("long").alias("text_length"))


@query("p1_content_prompt", f"""
WITH f AS ({_SQL_FULL}),
c AS (SELECT source, CASE WHEN length(full_text) > {K.CONTENT_CAP} THEN left(full_text, {K.CONTENT_CAP}) || {NOTICE}
                          ELSE full_text END AS t FROM f),
p AS (SELECT source, replace({sql_str(K.CONTENT_PROMPT_TEMPLATE)}, '{{CONTENT}}', t) AS prompt FROM c)
SELECT source, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_length FROM p""")
def p1_content_prompt(spark, sf_dir):
    p = pr.content_prompt(docs(spark, sf_dir), ["source"], ["doc_id"])
    return p.select("source", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_length"))


# instructions per knowledge source (a literal template, one row per source)
_BRAIN_SQL_INSTR = "'Sen ' || source || ' kaynağının uzmanısın.'"


@query("p2_brain_prompt", f"""
WITH f AS ({_SQL_FULL}),
c AS (SELECT source, CASE WHEN length(full_text) > {K.BRAIN_CAP} THEN left(full_text, {K.BRAIN_CAP})
                          ELSE full_text END AS t FROM f),
p AS (SELECT source, CASE WHEN t <> '' THEN {_BRAIN_SQL_INSTR} || {sql_str(K.BRAIN_HEADER)} || t
                          ELSE {_BRAIN_SQL_INSTR} END AS prompt FROM c)
SELECT source, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_length FROM p""")
def p2_brain_prompt(spark, sf_dir):
    d = docs(spark, sf_dir)
    instr = d.select("source").distinct().select(
        "source", F.concat(F.lit("Sen "), F.col("source"), F.lit(" kaynağının uzmanısın.")).alias("instructions"))
    p = pr.brain_prompt(d, instr, ["source"], ["doc_id"])
    return p.select("source", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_length"))


# ---------------------------------------------------------------- SFT (delimiter '\n')

_SQL_PARAS = f"""
  SELECT doc_id, para_no::INTEGER AS para_no, {sql_strip("raw")} AS para FROM (
    SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS para_no, unnest(parts) AS raw
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
_SQL_P5 = f"""
  SELECT doc_id, para_no, 0 AS form, {sql_str(K.SFT_SUMMARY_INSTRUCTION)} AS instruction,
         left(para, {K.SFT_INPUT_CUT}) AS input, para AS output
  FROM p WHERE length(para) > {K.SFT_SUMMARY_MIN}"""
_SQL_P6 = f"""
  SELECT doc_id, para_no, 1 AS form, {sql_str(K.SFT_TOPIC_PREFIX)} || left(s[1], {K.SFT_TOPIC_CUT}) AS instruction,
         '' AS input, para AS output
  FROM (SELECT doc_id, para_no, para,
               list_filter(list_transform(regexp_split_to_array(para, '[.!?]'), lambda x: {sql_strip("x")}),
                           lambda x: length(x) > {K.SFT_SENTENCE_MIN}) AS s
        FROM p WHERE length(para) > {K.SFT_TOPIC_MIN})
  WHERE len(s) >= 2"""


def sft_paras(spark, sf_dir):
    return sft.paragraphs(docs(spark, sf_dir), "doc_id", "text", "\n")


@query("p5_sft_summary", f"WITH p AS ({_SQL_PARAS}) {_SQL_P5}")
def p5_sft_summary(spark, sf_dir):
    return sft.summary_samples(sft_paras(spark, sf_dir))


@query("p6_sft_topic", f"WITH p AS ({_SQL_PARAS}) {_SQL_P6}")
def p6_sft_topic(spark, sf_dir):
    return sft.topic_samples(sft_paras(spark, sf_dir))


@query("p7_sft_dataset", f"WITH p AS ({_SQL_PARAS}) {_SQL_P5} UNION ALL {_SQL_P6}")
def p7_sft_dataset(spark, sf_dir):
    return sft.sft_dataset(docs(spark, sf_dir), "doc_id", "text", "\n")


@query("p8_sft_text", f"""
WITH p AS ({_SQL_PARAS}), s AS ({_SQL_P5} UNION ALL {_SQL_P6})
SELECT doc_id, para_no, form,
       '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input
       || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text
FROM s""")
def p8_sft_text(spark, sf_dir):
    return sft.render_samples(sft.sft_dataset(docs(spark, sf_dir), "doc_id", "text", "\n"))


# ---------------------------------------------------------------- token blocks

_PAT = tk.SIMPLE_TOKEN_PATTERN.replace("'", "''")
_SQL_TOKENS = f"""
  t AS (SELECT doc_id, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS token
        FROM (SELECT doc_id, regexp_extract_all(text, '{_PAT}') AS toks FROM documents)),
  v AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM t)),
  g AS (SELECT t.doc_id, t.pos, v.token_id FROM t JOIN v USING (token))"""


def token_arrays(spark, sf_dir):
    """source, doc_id, ids: every document's tokens as their ranks among all distinct tokens."""
    cut = docs(spark, sf_dir).select("source", "doc_id", F.regexp_extract_all(
        F.col("text"), F.lit(tk.SIMPLE_TOKEN_PATTERN), 0).alias("tokens"))
    vocab = stored(tk.token_vocabulary(cut.select(F.explode("tokens").alias("token"))), "vocabulary")
    return tk.lookup_ids(cut, "tokens", vocab.select("token", F.array("token_id").alias("ids")), [])


@query("c5_token_blocks_corpus", f"""
WITH {_SQL_TOKENS},
  q AS (SELECT token_id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS gpos FROM g),
  n AS (SELECT count(*) AS n FROM q),
  b AS (SELECT gpos // 64 AS block_no, gpos, token_id FROM q
        UNION ALL SELECT gpos // 64 - 1, gpos, token_id FROM q WHERE gpos >= 64)
SELECT block_no, md5(string_agg(token_id::VARCHAR, ',' ORDER BY gpos)) AS ids_md5
FROM b, n WHERE block_no * 64 < n.n - 128 GROUP BY block_no""")
def c5_token_blocks_corpus(spark, sf_dir):
    b = tk.array_blocks(token_arrays(spark, sf_dir), ["doc_id"])
    return b.select("block_no", tk.ids_digest("ids").alias("ids_md5"))


@query("c5_blocks_separated", f"""
WITH {_SQL_TOKENS},
  a AS (SELECT source, doc_id, pos, token_id FROM g JOIN documents USING (doc_id)
        UNION ALL SELECT source, doc_id, 1000000000 + k, -k FROM documents, (VALUES (1), (2)) v(k)),
  q AS (SELECT token_id, row_number() OVER (ORDER BY source, doc_id, pos) - 1 AS gpos FROM a),
  n AS (SELECT count(*) - 2 AS n FROM q),
  b AS (SELECT block_no, gpos, token_id FROM q, (VALUES (0), (1), (2)) v(k), LATERAL (SELECT gpos // 40 - k AS block_no) x
        WHERE block_no >= 0 AND gpos < block_no * 40 + 96)
SELECT block_no, md5(string_agg(token_id::VARCHAR, ',' ORDER BY gpos)) AS ids_md5
FROM b, n WHERE block_no * 40 < n.n - 96 GROUP BY block_no""")
def c5_blocks_separated(spark, sf_dir):
    """Documents in (source, doc_id) order, two separator ids between them, blocks of 96 with stride 40."""
    b = tk.array_blocks(token_arrays(spark, sf_dir), ["source", "doc_id"], size=96, stride=40, sep_ids=(-1, -2))
    return b.select("block_no", tk.ids_digest("ids").alias("ids_md5"))


@query("c5_token_blocks_per_doc", f"""
WITH {_SQL_TOKENS},
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  b AS (SELECT doc_id, pos // 64 AS block_no, pos, token_id FROM g
        UNION ALL SELECT doc_id, pos // 64 - 1, pos, token_id FROM g WHERE pos >= 64)
SELECT b.doc_id, block_no, md5(string_agg(token_id::VARCHAR, ',' ORDER BY pos)) AS ids_md5
FROM b JOIN n USING (doc_id) WHERE block_no * 64 < n.n - 128 GROUP BY b.doc_id, block_no""")
def c5_token_blocks_per_doc(spark, sf_dir):
    b = tk.row_blocks(token_arrays(spark, sf_dir), ["doc_id"])
    return b.select("doc_id", "block_no", tk.ids_digest("ids").alias("ids_md5"))


@query("c6_gates", f"""
WITH p AS ({_SQL_PARAS}), s AS ({_SQL_P5} UNION ALL {_SQL_P6}),
  t AS (SELECT sum(len(regexp_extract_all(text, '{_PAT}'))) AS n FROM documents)
SELECT 'corpus_chars' AS gate, (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS value,
       {K.CORPUS_MIN_CHARS}::BIGINT AS required,
       (sum(length(text)) + 2 * (count(*) - 1)) >= {K.CORPUS_MIN_CHARS} AS ok FROM documents
UNION ALL
SELECT 'token_blocks', (CASE WHEN n > 128 THEN (n - 128 - 1) // 64 + 1 ELSE 0 END)::BIGINT, {K.MIN_BLOCKS}::BIGINT,
       (CASE WHEN n > 128 THEN (n - 128 - 1) // 64 + 1 ELSE 0 END) >= {K.MIN_BLOCKS} FROM t
UNION ALL
SELECT 'sft_samples', count(*)::BIGINT, {K.SFT_MIN_SAMPLES}::BIGINT, count(*) >= {K.SFT_MIN_SAMPLES} FROM s""")
def c6_gates(spark, sf_dir):
    from corpusworks.operators.gates import corpus_gates
    d = docs(spark, sf_dir)
    return corpus_gates(d, "text", sft.sft_dataset(d, "doc_id", "text", "\n"))
