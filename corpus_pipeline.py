"""The corpus pipeline: five stages over ``documents``, each calling one of the
operators of ``corpusworks.llm``. A stage's result is written and read again as
the next one's documents.

1. quality: documents that the weak-label classifier rejects go.
2. lines: lines repeated in many documents stay in the last of them only.
3. near_duplicates: one document of each group of near copies (five-word
   similarity of 0.8 or more) stays.
4. decontamination: documents that hold a benchmark item go.
5. tokens: byte-level BPE ids, decoded back as a check.

Stages 1 and 4 decide by a row's own text, whatever its id. Stage 3 decides by
id and text, so only rows go whose own text is a copy; rows with a null id can't
be told apart there and stay. In stage 2 rows that repeat an id count as one
document. Empty tables stay empty. SQL can't express the classifier, so there is no SQL twin; tests/llm holds each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks.llm import bpe_codec, decontaminate, line_dedup, near_dup, quality
from corpusworks.llm.common import keep, scratch_dir, table
from corpusworks.llm.queries import tokenizer_files

NEAR_PERCENT = 80           # five-word similarity from which the pipeline takes documents as copies


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality.classify(docs, labels).where("accepted").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = line_dedup.LineIndex(spark, scratch_dir(spark, "lines"))
    index.insert(docs)
    return index.clean(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_copies(docs, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    checked = bpe_codec.round_trip(docs, "text", path, pattern)
    whole = F.coalesce("text", F.lit("")) == F.col("text_decoded")
    return checked.select("doc_id", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("tokens", token_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
