"""Scan a folder of session JSON files (one session per file).

Two layouts are read: a dict with metadata (model_name, session_id,
created_at, updated_at, message_count, messages) and the older bare list of
messages. The first non-blank character picks the parser; files that are
neither (numbers, broken JSON) and sessions without messages are skipped.
Files are read whole (``wholetext``), one row per file, spread over tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks import constants as K
from corpusworks.functions import text as tf
from corpusworks.operators.sessions import MESSAGE_STRUCT
from corpusworks.session import stored

DICT_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("message_count", T.LongType()),
    T.StructField("messages", T.ArrayType(MESSAGE_STRUCT)),
])
LIST_SCHEMA = T.ArrayType(MESSAGE_STRUCT)


def read_session_files(spark: SparkSession, path: str, missing_model: str = K.UNKNOWN_MODEL_NAME) -> DataFrame:
    """One row per readable session file: filename, filepath, model_name,
    session_id, created_at, updated_at, message_count, messages."""
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.json").text(path)
           .select(F.col("_metadata.file_path").alias("filepath"), F.col("value")))
    first = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    parsed = raw.select("filepath", first.alias("_k"),
                        F.when(first == "{", F.from_json("value", DICT_SCHEMA)).alias("_d"),
                        F.when(first == "[", F.from_json("value", LIST_SCHEMA)).alias("_l"))
    filename = tf.basename("filepath", None)
    d, lst = F.col("_d"), F.col("_l")

    def either(of_dict, of_list):
        return F.when(d.isNotNull(), of_dict).otherwise(of_list)

    # one pass for both layouts: files are opened once
    return parsed.filter(d.isNotNull() | lst.isNotNull()).select(
        "filepath", filename.alias("filename"),
        either(F.coalesce("_d.model_name", F.lit(missing_model)), tf.file_stem(filename)).alias("model_name"),
        either(F.coalesce("_d.session_id", F.lit("")), F.lit("")).alias("session_id"),
        either(F.coalesce("_d.created_at", F.lit("")), F.coalesce(F.get(lst, 0)["time"], F.lit(""))).alias("created_at"),
        either(F.coalesce("_d.updated_at", "_d.created_at", F.lit("")),
               F.coalesce(F.get(lst, F.size(lst) - 1)["time"], F.lit(""))).alias("updated_at"),
        either(F.coalesce("_d.message_count", F.size(F.coalesce("_d.messages", F.array())).cast("long")),
               F.size(lst).cast("long")).alias("message_count"),
        either(F.coalesce("_d.messages", F.array().cast(LIST_SCHEMA)), lst).alias("messages")).filter(F.size("messages") > 0)


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """S10 + A2 + O1: session summaries newest first, with preview (F5) and
    short date (F8)."""
    s = read_session_files(spark, path)
    first = F.coalesce(F.col("messages")[0]["content"], F.lit(""))
    found = stored(s.select("filename", "filepath", "model_name", "session_id", "created_at", "updated_at",
                            "message_count", tf.preview(first).alias("preview"),
                            tf.short_date("created_at").alias("date_short")), "sessions")      # sorting reads twice
    return found.orderBy(F.desc("updated_at"), "filename")


def load_session(spark: SparkSession, path: str, filepath: str) -> DataFrame:
    """One session by its path (absolute, or relative to the scanned folder
    ``path``), defaults model_name='genel', session_id=''."""
    s = read_session_files(spark, path, missing_model=K.DEFAULT_MODEL_NAME)
    bare = lambda p: re.sub(r"^[a-z0-9]+:/+", "/", p)
    wanted = bare(filepath) if bare(filepath).startswith("/") else f"{bare(path).rstrip('/')}/{filepath}"
    return s.filter(F.regexp_replace("filepath", r"^[a-z0-9]+:/+", "/") == wanted)


def write_session_files(records: DataFrame, path: str, key_col: str = "session_id") -> None:
    """Sink: one JSON file per session (a folder per key), the dict layout. Each task moves its own
    files into place, the driver does not move them one by one."""
    (records.withColumn("_key", F.col(key_col)).repartition("_key")
     .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("_key").json(path))
