"""Catalogue queries of the training-data operators, with DuckDB twins where SQL
can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks.llm import (bpe_codec, chat, decontaminate, lattice, line_dedup, near_dup, pii_crf, prefix_trie, quality,
                             secret_ledger, sharding, topk, whitening)
from corpusworks.llm.common import scratch_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def tokenizer_files(rank_path: str | None = None) -> tuple[str, str]:
    """Rank file and split pattern; the file's place is a parameter."""
    import public_tokenizers
    return rank_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def piece_file(path: str | None = None) -> str:
    """Vocabulary of scored pieces; the file's place is a parameter."""
    import public_tokenizers
    return path or public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ 3 sharding
_U = "((('0x' || substr(md5(k || '|{s}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
_BIDS = ", ".join("struct_pack(a := -1.0 / ln(" + _U.format(s=s) + f"), b := -{s})" for s in range(17))
_SHARD_SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '\\N') AS k, strlen(coalesce(text, '')) + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                            lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, k, size, xor(list_reduce(list_concat([4294967295::BIGINT], bytes),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
b AS (SELECT *, [{_BIDS}] AS bids FROM c),
s AS (SELECT doc_id, k, size, text_crc32, -(list_max(bids[1:16])).b AS shard, -(list_max(bids)).b AS grown_shard FROM b)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 8))::BIGINT % 1024,
                          doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


@query("op3_sharding", _SHARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_layout(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 16)


# ------------------------------------------------------ 5 byte-level BPE
@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode(docs, "text", path, pattern).select("doc_id", "ids", "n_tokens")
    return (bpe_codec.decode(coded, "ids", path, pattern)
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("raw", 256).alias("decoded_sha256")))


# ------------------------------------------------------------------ 6 personal data
def _joined(spans, what) -> F.Column:
    return F.concat_ws(",", F.transform(spans, what))


def _span(x) -> F.Column:
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))


@query("op6_pii_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    base = F.filter("pii", lambda x: x["base"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii_crf.KINDS[:4]],
                        F.sha2(_joined(base, _span), 256).alias("base_sha256"),
                        _joined(F.col("pii"), _span).alias("spans"))


# ------------------------------------------------------------------ 7 chat formatting
@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)],
                                 "conv_id long, turn long, role string, text string")
    typed = rows.unionByName(more).withColumn("parts", chat.text_parts(F.col("text")))
    turns = chat.format_turns(typed, "conv_id", "turn", "role", "parts")
    return chat.conversation_digests(turns, "conv_id", "turn")


# ------------------------------------------------------------------ 9 secrets
@query("op9_secret_ledger")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_ledger.BlobLedger(spark, scratch_dir(spark, "ledger"))
    ledger.scan(docs, "doc_id", "text")
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secret_ledger.BASE_RULES]))
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return ledger.path_findings().select(
        F.col("path").cast("long").alias("doc_id"), *[count(r.kind) for r in secret_ledger.BASE_RULES],
        F.sha2(_joined(base, _span), 256).alias("base_sha256"), _joined(F.col("findings"), _span).alias("spans"))


# ------------------------------------------------------------------ 8 line dedup
_LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op8_line_dedup", _LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex(spark, scratch_dir(spark, "lines"))
    index.insert(docs)
    return index.clean(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# ------------------------------------------------------------------ 10 quality
@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


# ------------------------------------------------------------------ 4 near-duplicates
@query("op4_near_dup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=near_dup.PERCENT)


# ------------------------------------------------------------------ 2 decontamination
@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------------ 1 exact top-k
_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT
             AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op1_topk", _TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


# ------------------------------------------------------------------ 11 conversation prefix trie
_TRIE_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
g AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, md5(length(r) || ':' || r || t) AS m FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos FROM k),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
                 regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM g), tab),
b AS (SELECT c.conv_id, 0 AS part, o.pos, o.t, o.m FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, o.pos, o.t, o.m FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
s AS (SELECT conv_id, length(t) AS chars, m, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM b),
p AS (SELECT conv_id, d, chars, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent,
             d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id,
             count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM q GROUP BY node),
f AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT a.node, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.node IS NULL) AS n_leaves
      FROM n LEFT JOIN f ON f.node = n.node JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.depth GROUP BY a.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, w.n_leaves,
       w.saved_tokens, n.ends_sha256
FROM n JOIN w ON w.node = n.node LEFT JOIN f ON f.node = n.node LEFT JOIN n u ON u.node = n.parent"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(
        table(spark, sf_dir, "conversations"), base=F.expr("conv - conv % 100"),
        head=F.crc32(F.col("conv").cast("string").cast("binary")) % 6, most=6)


# ------------------------------------------------------------------ 12 language-model scoring
@query("op12_lattice_score")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), "doc_id", "text", piece_file())


# ------------------------------------------------------------------ 13 embedding whitening
@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
            .withColumn("deviation", F.expr("try_cast(deviation AS bigint)")))
