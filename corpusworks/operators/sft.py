"""Instruction-tuning samples from documents (P5-P8, C6's sample gate).

Paragraphs = parts of the text split on a delimiter, stripped, non-empty.
Summary form (P5): paragraph longer than 50 chars. Topic form (P6): paragraph
longer than 100 chars with at least two sentences (split on . ! ?, stripped)
longer than 20 chars. Everything is a row-local expression (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.functions.text import strip


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               delimiter: str = K.PARAGRAPH_SEP) -> DataFrame:
    """id, para_no (position in the split), para (stripped, non-empty)."""
    p = df.select(id_col, F.posexplode(F.split(F.col(text_col), _quote(delimiter), -1)).alias("para_no", "_p"))
    return p.select(id_col, F.col("para_no").cast("int").alias("para_no"), strip("_p").alias("para")) \
        .filter(F.length("para") > 0)


def summary_samples(paras: DataFrame, id_col: str = "doc_id", min_len: int = K.SFT_SUMMARY_MIN,
                    input_cut: int = K.SFT_INPUT_CUT,
                    instruction: str = K.SFT_SUMMARY_INSTRUCTION) -> DataFrame:
    """P5."""
    return paras.filter(F.length("para") > min_len).select(
        id_col, "para_no", F.lit(0).alias("form"), F.lit(instruction).alias("instruction"),
        F.substring("para", 1, input_cut).alias("input"), F.col("para").alias("output"))


def sentences(para_col: str = "para", min_len: int = K.SFT_SENTENCE_MIN):
    """Stripped sentences longer than ``min_len`` (split on '.', '!', '?')."""
    parts = F.split(F.col(para_col), "[.!?]", -1)
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: F.length(s) > min_len)


def topic_samples(paras: DataFrame, id_col: str = "doc_id", min_len: int = K.SFT_TOPIC_MIN,
                  sentence_min: int = K.SFT_SENTENCE_MIN, topic_cut: int = K.SFT_TOPIC_CUT,
                  prefix: str = K.SFT_TOPIC_PREFIX) -> DataFrame:
    """P6."""
    s = paras.filter(F.length("para") > min_len).withColumn("_s", sentences("para", sentence_min))
    return s.filter(F.size("_s") >= 2).select(
        id_col, "para_no", F.lit(1).alias("form"),
        F.concat(F.lit(prefix), F.substring(F.col("_s")[0], 1, topic_cut)).alias("instruction"),
        F.lit("").alias("input"), F.col("para").alias("output"))


def sft_dataset(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                delimiter: str = K.PARAGRAPH_SEP) -> DataFrame:
    """Both forms per paragraph; order key (id, para_no, form)."""
    p = paragraphs(df, id_col, text_col, delimiter)
    return summary_samples(p, id_col).unionByName(topic_samples(p, id_col))


def render_samples(samples: DataFrame, template: str = K.SFT_TEMPLATE) -> DataFrame:
    """text = instruction/input/response layout."""
    head, rest = template.split("{instruction}")
    mid, rest = rest.split("{input}")
    mid2, tail = rest.split("{output}")
    text = F.concat(F.lit(head), F.col("instruction"), F.lit(mid), F.col("input"), F.lit(mid2), F.col("output"),
                    F.lit(tail))
    keep = [c for c in samples.columns if c not in ("instruction", "input", "output")]
    return samples.select(*keep, text.alias("text"))
