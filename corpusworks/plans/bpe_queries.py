"""Catalogue: byte-level BPE word table, training, vocabulary, encoding and
the training-corpus build (P9). Every query trains for itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators import bpe
from corpusworks.operators import tokens as tk
from corpusworks.plans.registry import query
from corpusworks.session import load_table

# DuckDB twin of the GPT-2 style split. RE2 has no lookahead, so the words are
# first cut with the same alternatives minus the lookahead one (whitespace runs
# then stay whole) and the lookahead's effect is re-applied on the token list:
# a whitespace run of 2+ chars before a token keeps all but its last char; that
# last char is its own token unless it is a space, which instead starts the next
# token (a contraction after it splits as " '" + letters, joined with a following
# letter run).
WSC = r"\t\n\x0B\x0C\r "  # Java's \s spelled out (RE2's \s lacks \x0B)
P1 = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WSC + r"\p{L}\p{N}]+|[" + WSC + r"]+")
CONTR = "('''s', '''t', '''re', '''ve', '''m', '''ll', '''d')"


def ISWS(x: str) -> str:
    """SQL: the token is a whitespace run."""
    return f"regexp_full_match({x}, '[{WSC}]+')"


def LONGSP(x: str) -> str:
    """SQL: the token is a whitespace run of 2+ chars ending in a space."""
    return f"({ISWS(x)} AND length({x}) >= 2 AND right({x}, 1) = ' ')"


WORDS = f"""
  t AS (SELECT regexp_extract_all(text, '{P1.replace(chr(39), chr(39) * 2)}') AS L FROM documents),
  x AS (SELECT L, len(L) AS n FROM t),
  e AS (SELECT flatten(list_transform(range(1, n + 1), lambda i:
          CASE
            WHEN {ISWS("L[i]")} AND length(L[i]) >= 2 AND i < n THEN
              CASE WHEN right(L[i], 1) = ' ' THEN [left(L[i], length(L[i]) - 1)]
                   ELSE [left(L[i], length(L[i]) - 1), right(L[i], 1)] END
            WHEN i > 1 AND NOT {ISWS("L[i]")} AND {LONGSP("L[i-1]")} THEN
              CASE WHEN L[i] IN {CONTR} THEN
                     [' ''', substr(L[i], 2) || CASE WHEN i < n AND regexp_full_match(L[i+1], '\\p{{L}}+')
                                                     THEN L[i+1] ELSE '' END]
                   ELSE [' ' || L[i]] END
            WHEN i > 2 AND L[i-1] IN {CONTR} AND {LONGSP("L[i-2]")} AND regexp_full_match(L[i], '\\p{{L}}+')
              THEN []::VARCHAR[]
            ELSE [L[i]] END)) AS toks FROM x),
  w AS (SELECT unnest(toks) AS word FROM e),
  wc AS (SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word)"""
SQL_C7 = f"WITH {WORDS} SELECT word, n FROM wc"
SQL_C8 = f"""WITH {WORDS},
  h AS (SELECT lower(hex(word)) AS hx, n FROM wc),
  p AS (SELECT n, unnest(list_transform(range(0, length(hx) // 2 - 1),
                 lambda j: struct_pack(l := substr(hx, 2 * j + 1, 2), r := substr(hx, 2 * j + 3, 2)))) AS pr FROM h)
SELECT pr.l AS "left", pr.r AS "right", sum(n)::BIGINT AS n FROM p GROUP BY 1, 2"""


def trained(spark, sf_dir, vocab_size=K.VOCAB_SIZE, min_frequency=K.MIN_PAIR_FREQUENCY):
    """(vocab, merges, final_words) of the documents."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.train_from_documents(docs, "text", vocab_size, min_frequency)


@query("c7_word_counts", SQL_C7)
def c7_word_counts(spark, sf_dir):
    return tk.word_counts(load_table(spark, sf_dir, "documents").select("text"), "text", tk.PRETOKEN_PATTERN)


@query("c8_first_pair_counts", SQL_C8)
def c8_first_pair_counts(spark, sf_dir):
    """Round-1 pair counts of the byte-level word table (bytes as hex)."""
    docs = load_table(spark, sf_dir, "documents").select("text")
    w = tk.word_counts(docs, "text", tk.PRETOKEN_PATTERN)
    words = w.select(F.col("n").cast("long"), bpe.byte_symbols("word").alias("syms"))
    return bpe._pairs(words).select("left", "right", F.col("cnt").alias("n"))


@query("c8_bpe_merges")
def c8_bpe_merges(spark, sf_dir):
    _, merges, _ = trained(spark, sf_dir)
    return bpe.merges_frame(spark, merges)


@query("c10_vocabulary")
def c10_vocabulary(spark, sf_dir):
    vocab, _, _ = trained(spark, sf_dir)
    return vocab.select("id", "token", "kind", "count")


def _fingerprints(ids):
    """doc_id, n_tokens and an order-sensitive fingerprint of each array of ids."""
    hashes = F.transform("ids", lambda x, i: F.pmod(F.xxhash64(i, x), F.lit(2147483647)))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_fingerprint"),
                      F.array_max("ids").alias("max_id"))


@query("c9_encode")
def c9_encode(spark, sf_dir):
    """Every document as BPE ids: doc_id, n_tokens, fingerprint of (pos, id) pairs."""
    _, _, ids = bpe.train_and_encode(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _fingerprints(ids)


@query("c9_encode_new")
def c9_encode_new(spark, sf_dir):
    """Texts that training has not seen, all turns of the conversations, by the documents' vocabulary."""
    vocab, merges, _ = trained(spark, sf_dir)
    turns = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = bpe.encode_words(bpe.apply_merges(tk.word_counts(turns, "text"), merges), vocab)
    ids = bpe.encode_arrays(turns, "text", words)
    return ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"),
                      F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query("p9_training_blocks")
def p9_training_blocks(spark, sf_dir):
    """Corpus gate -> BPE -> encode whole corpus in (source, doc_id) order, separators between
    documents -> 128-token blocks with stride 64 (labels = copy of input_ids) -> block gate."""
    from corpusworks.operators.gates import check, corpus_gates
    docs = load_table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    check(corpus_gates(docs, "text").filter(F.col("gate") == "corpus_chars"))
    vocab, merges, ids = bpe.train_and_encode(docs)
    return bpe.training_blocks(ids, ["source", "doc_id"], vocab, merges)
