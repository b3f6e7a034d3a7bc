"""Chat-session operators over the long form (one row per message).

Long form columns: ``session, turn, role, content, time`` (time is the
'yyyy-MM-dd HH:mm:ss' string the sessions store). Per-session values are
computed with hash aggregates (partial + final) and joined back, never with
a per-session window or by collecting a whole session, so one session holding
a large share of all messages is handled by map-side partial aggregation and
AQE's skew-join split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks import constants as K
from corpusworks.functions import text as tf

MESSAGE_STRUCT = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("time", T.StringType()),
])

SESSION_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("message_count", T.LongType()),
    T.StructField("messages", T.ArrayType(MESSAGE_STRUCT)),
])


def session_stats(turns: DataFrame, key: str = "session", order: str = "turn") -> DataFrame:
    """Per session: first/last message time, first content, message count."""
    return (turns.groupBy(key)
            .agg(F.min_by("time", order).alias("created_at"),
                 F.max_by("time", order).alias("last_time"),
                 F.min_by("content", order).alias("first_content"),
                 F.count(F.lit(1)).alias("message_count")))


def session_summary(turns: DataFrame, key: str = "session", order: str = "turn",
                    preview_len: int = K.PREVIEW_LEN) -> DataFrame:
    """A2 on the long form: created_at = first message time, updated_at = last
    message time, message_count, preview of the first message (F5).
    Sorted newest first (O1)."""
    s = session_stats(turns, key, order)
    out = s.select(key, "created_at", F.col("last_time").alias("updated_at"),
                   F.col("message_count").cast("long").alias("message_count"),
                   tf.preview("first_content", preview_len).alias("preview"))
    return newest_first(out, key)


def newest_first(summary: DataFrame, tie: str) -> DataFrame:
    """O1: by updated_at descending, ties by ``tie``."""
    return summary.orderBy(F.desc("updated_at"), F.asc(tie))


def with_session_fields(turns: DataFrame, key: str = "session", order: str = "turn") -> DataFrame:
    """K5 flat form: every message row carries created_at and message_count of
    its session (aggregate, then equi-join back on the session key)."""
    s = session_stats(turns, key, order).select(key, "created_at",
                                                F.col("message_count").cast("long").alias("message_count"))
    return turns.join(s, key)


def session_records(turns: DataFrame, key: str = "session", order: str = "turn",
                    model_name: str | None = None, updated_at: str = "now") -> DataFrame:
    """K5 nested record per session (the sessions store's JSON layout):
    model_name, session_id, created_at, updated_at, message_count, messages.

    This is an export format: one session becomes one record, so it is meant
    for sessions of bounded length; the long form is the scalable store.
    ``updated_at``: "now" (write time, as a live session does) or "last"
    (time of the last message, deterministic).
    """
    msgs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.col("role"),
                                                F.col("content"), F.col("time"))))
    g = turns.groupBy(key).agg(msgs.alias("_m"))
    m = F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"),
                                             x["time"].alias("time")))
    upd = (F.element_at(F.col("_m"), -1)["time"] if updated_at == "last"
           else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    return g.select(
        (F.lit(model_name) if model_name is not None else F.col(key).cast("string")).alias("model_name"),
        F.col(key).cast("string").alias("session_id"),
        F.coalesce(F.col("_m")[0]["time"], F.lit("")).alias("created_at"),
        upd.alias("updated_at"),
        F.size("_m").cast("long").alias("message_count"),
        m.alias("messages"))


def write_session_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """K5 sink: JSON lines, UTF-8 kept (Spark writes non-ASCII as is)."""
    records.write.mode(mode).json(path)


def read_session_records(spark, path: str) -> DataFrame:
    return spark.read.schema(SESSION_SCHEMA).json(path)


def records_summary(records: DataFrame, filename_col: str = "filename",
                    preview_len: int = K.PREVIEW_LEN) -> DataFrame:
    """A2 on nested records: stored message_count trusted if present, else
    counted; updated_at falls back to created_at; records without messages
    are skipped."""
    first = F.col("messages")[0]
    return (records.filter(F.size("messages") > 0)
            .select(filename_col, "model_name", "session_id",
                    F.coalesce("created_at", F.lit("")).alias("created_at"),
                    F.coalesce("updated_at", "created_at", F.lit("")).alias("updated_at"),
                    F.coalesce(F.col("message_count"), F.size("messages").cast("long")).alias("message_count"),
                    tf.preview(first["content"], preview_len).alias("preview")))


def append_turns(exchanges: DataFrame, key: str = "session", time_col: str = "time") -> DataFrame:
    """K6: one exchange -> a 'human' row (input, else question) and an 'ai'
    row (output, else answer); blank sides are skipped; both share a time."""
    cols = set(exchanges.columns)

    def pick(a, b):
        return tf.first_present(*[c for c in (a, b) if c in cols])

    human = pick("input", "question")
    ai = pick("output", "answer")
    pair = F.array(F.struct(F.lit(0).alias("msg_no"), F.lit("human").alias("role"), human.alias("content")),
                   F.struct(F.lit(1).alias("msg_no"), F.lit("ai").alias("role"), ai.alias("content")))
    keep = [c for c in exchanges.columns if c not in ("input", "question", "output", "answer")]
    out = exchanges.select(*keep, F.explode(F.filter(pair, lambda x: x["content"].isNotNull())).alias("_m"))
    return out.select(*keep, "_m.msg_no", "_m.role", "_m.content")


def delete_sessions(turns: DataFrame, ids: DataFrame, key: str = "session") -> DataFrame:
    """K7: drop every message of the listed sessions (left anti join; the id
    list is broadcast when it passes the size check)."""
    from corpusworks.session import broadcast_if_small
    return turns.join(broadcast_if_small(ids.select(key).distinct()), key, "left_anti")


def replay(turns: DataFrame, key: str = "session", order: str = "turn",
           human_roles=("human",)) -> DataFrame:
    """Messages in order with the display role."""
    return (turns.select(key, order, tf.display_role("role", human_roles).alias("role"), "content", "time")
            .orderBy(key, order))
