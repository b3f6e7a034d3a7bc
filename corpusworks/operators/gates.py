"""Corpus / block / sample gates as a report (gate, value, required, ok).

All three values are plain aggregates over lineages the job needs anyway;
``check`` raises in the driver when a gate fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators.tokens import SIMPLE_TOKEN_PATTERN, block_count


def _row(df: DataFrame, gate: str, value, required: int) -> DataFrame:
    v = value.cast("long")
    return df.agg(v.alias("value")).select(F.lit(gate).alias("gate"), F.col("value"),
                                           F.lit(required).cast("long").alias("required"),
                                           (F.col("value") >= required).alias("ok"))


def corpus_gates(docs: DataFrame, text_col: str, samples: DataFrame | None = None,
                 token_pattern: str = SIMPLE_TOKEN_PATTERN, sep_len: int = 2) -> DataFrame:
    chars = _row(docs, "corpus_chars",
                 F.coalesce(F.sum(F.length(text_col)), F.lit(0)) + sep_len * (F.count(F.lit(1)) - 1),
                 K.CORPUS_MIN_CHARS)
    ntok = F.coalesce(F.sum(F.size(F.regexp_extract_all(F.col(text_col), F.lit(token_pattern), 0))), F.lit(0))
    blocks = _row(docs, "token_blocks", block_count(ntok), K.MIN_BLOCKS)
    out = chars.unionByName(blocks)
    if samples is not None:
        out = out.unionByName(_row(samples, "sft_samples", F.count(F.lit(1)), K.SFT_MIN_SAMPLES))
    return out


def check(report: DataFrame) -> None:
    """Raise ValueError listing the failed gates (report has few rows)."""
    failed = report.filter(~F.col("ok")).collect()
    if failed:
        raise ValueError("; ".join(f"{r['gate']}: {r['value']} < {r['required']}" for r in failed))
