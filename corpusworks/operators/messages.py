"""Fenced code blocks and prose segments of messages.

A message is split on the fence; odd parts are code (an unclosed fence still
counts), even parts are prose. A code part with a newline has its first line
(stripped) as language and the rest as code; otherwise the language is empty
and the whole part is code. Code and prose are stripped; empty prose is
dropped. A message without a fence is one prose segment, unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.functions.text import strip

FENCE = "```"


def _parts(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.col(text_col).contains(FENCE).alias("_fenced"),
                     F.posexplode(F.split(F.col(text_col), FENCE, -1)).alias("part_no", "part"))


def code_blocks(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """one row per code block: keep + part_no, lang, code."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    p = _parts(df, text_col, keep).filter(F.col("part_no") % 2 == 1)
    nl = F.instr("part", "\n")
    lang = F.when(nl > 0, strip(F.substring_index("part", "\n", 1))).otherwise(F.lit(""))
    body = F.when(nl > 0, F.expr("substring(part, instr(part, '\\n') + 1)")).otherwise(F.col("part"))
    return p.select(*keep, F.col("part_no").cast("int").alias("part_no"), lang.alias("lang"),
                    strip(body).alias("code"))


def prose_segments(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """one row per prose segment: keep + part_no, text."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    p = _parts(df, text_col, keep).filter(F.col("part_no") % 2 == 0)
    seg = F.when(F.col("_fenced"), strip("part")).otherwise(F.col("part"))
    return (p.select(*keep, F.col("part_no").cast("int").alias("part_no"), seg.alias("text"))
            .filter(F.length("text") > 0))
