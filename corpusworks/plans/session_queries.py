"""Catalogue: chat sessions and message functions over ``conversations``.

The driver's table has no time column; message time is derived as
2024-01-01 + conv_id hours + turn minutes (same rule in the oracle SQL).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusworks.functions import text as tf
from corpusworks.operators import messages as msg
from corpusworks.operators import sessions as ss
from corpusworks.plans.registry import query
from corpusworks.plans.sqlfrag import sql_strip
from corpusworks.session import load_table

SQL_TIME = ("strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn), "
            "'%Y-%m-%d %H:%M:%S')")
SQL_TURNS = f"SELECT conv_id, turn, role, text AS content, {SQL_TIME} AS time FROM conversations"
SQL_FENCED = "SELECT conv_id, turn, replace(text, '. ', '```') AS text FROM conversations"



def turns(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    # timezone-independent (TIMESTAMP_NTZ arithmetic), like the oracle's naive timestamps
    t = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(
        hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))
    return c.select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content"),
                    tf.time_string(t).alias("time"))


def fenced(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit("```")).alias("text"))


@query("f5_message_preview", """
SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview
FROM conversations""")
def f5_message_preview(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tf.preview("text").alias("preview"))


@query("f9_role_mapping", """
SELECT conv_id, turn, CASE WHEN role IN ('user') THEN 'user' ELSE 'ai' END AS role FROM conversations""")
def f9_role_mapping(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tf.display_role("role", ("user",)).alias("role"))


@query("f12_code_blocks", f"""
WITH f AS ({SQL_FENCED}),
p AS (SELECT conv_id, turn, string_split(text, '```') AS parts FROM f),
e AS (SELECT conv_id, turn, unnest(generate_series(0, len(parts) - 1)) AS part_no, unnest(parts) AS part FROM p)
SELECT conv_id, turn, part_no::INTEGER AS part_no,
       CASE WHEN strpos(part, chr(10)) > 0 THEN {sql_strip("split_part(part, chr(10), 1)")} ELSE '' END AS lang,
       {sql_strip("CASE WHEN strpos(part, chr(10)) > 0 THEN substring(part, strpos(part, chr(10)) + 1) ELSE part END")}
         AS code
FROM e WHERE part_no % 2 = 1""")
def f12_code_blocks(spark, sf_dir):
    return msg.code_blocks(fenced(spark, sf_dir), "text", ["conv_id", "turn"])


@query("f13_prose_segments", f"""
WITH f AS ({SQL_FENCED}),
p AS (SELECT conv_id, turn, strpos(text, '```') > 0 AS fenced, string_split(text, '```') AS parts FROM f),
e AS (SELECT conv_id, turn, fenced, unnest(generate_series(0, len(parts) - 1)) AS part_no, unnest(parts) AS part
      FROM p),
s AS (SELECT conv_id, turn, part_no::INTEGER AS part_no,
             CASE WHEN fenced THEN {sql_strip("part")} ELSE part END AS text FROM e WHERE part_no % 2 = 0)
SELECT * FROM s WHERE length(text) > 0""")
def f13_prose_segments(spark, sf_dir):
    return msg.prose_segments(fenced(spark, sf_dir), "text", ["conv_id", "turn"])


@query("k5_session_records", f"""
WITH t AS ({SQL_TURNS}),
s AS (SELECT conv_id, arg_min(time, turn) AS created_at, count(*)::BIGINT AS message_count FROM t GROUP BY conv_id)
SELECT t.conv_id, s.created_at, s.message_count, t.turn, t.role, t.content
FROM t JOIN s USING (conv_id)""")
def k5_session_records(spark, sf_dir):
    flat = ss.with_session_fields(turns(spark, sf_dir))
    return flat.select(F.col("session").alias("conv_id"), "created_at", "message_count", "turn", "role", "content")


@query("a2_session_summary", f"""
WITH t AS ({SQL_TURNS})
SELECT conv_id, arg_min(time, turn) AS created_at, arg_max(time, turn) AS updated_at,
       count(*)::BIGINT AS message_count,
       CASE WHEN length(arg_min(content, turn)) > 50 THEN left(arg_min(content, turn), 50) || '...'
            ELSE arg_min(content, turn) END AS preview
FROM t GROUP BY conv_id""")
def a2_session_summary(spark, sf_dir):
    return ss.session_summary(turns(spark, sf_dir)).withColumnRenamed("session", "conv_id")


# exchanges: a user message and the assistant message right after it
SQL_EXCHANGES = """
SELECT u.conv_id, u.turn, u.text AS input, a.text AS output
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


@query("k6_append_turn", f"""
WITH ex AS ({SQL_EXCHANGES})
SELECT conv_id, turn, 0 AS msg_no, 'human' AS role, input AS content FROM ex WHERE coalesce(input, '') <> ''
UNION ALL
SELECT conv_id, turn, 1 AS msg_no, 'ai' AS role, output AS content FROM ex WHERE coalesce(output, '') <> ''""")
def k6_append_turn(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    ex = u.join(a, ["conv_id", "turn"], "left")
    return ss.append_turns(ex).select("conv_id", "turn", "msg_no", "role", "content")


@query("k7_delete_sessions", """
SELECT conv_id, turn, role, text FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.role = 'system' AND s.conv_id = c.conv_id)""")
def k7_delete_sessions(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations")
    doomed = c.filter(F.col("role") == "system").select("conv_id")
    return ss.delete_sessions(c, doomed, "conv_id").select("conv_id", "turn", "role", "text")


@query("o4_replay_session", f"""
WITH t AS ({SQL_TURNS})
SELECT conv_id, turn, CASE WHEN role IN ('user') THEN 'user' ELSE 'ai' END AS role, content, time FROM t""")
def o4_replay_session(spark, sf_dir):
    r = ss.replay(turns(spark, sf_dir), human_roles=("user",))
    return r.withColumnRenamed("session", "conv_id")


@query("j3_keep_labelled", """
SELECT doc_id, source FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def j3_keep_labelled(spark, sf_dir):
    from corpusworks.operators.knowledge import keep_requested
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    good = load_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return keep_requested(d, good, "doc_id")
