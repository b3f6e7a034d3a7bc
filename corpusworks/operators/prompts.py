"""Prompt operators (P1-P4) and the batch generation hook."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks import constants as K
from corpusworks.functions import text as tf
from corpusworks.operators.concat import capped_concat


def content_prompt(docs: DataFrame, group_cols: list[str], order_cols: list[str], text_col: str = "text",
                   system_prompt: str | None = None, cap: int = K.CONTENT_CAP,
                   notice: str = K.CAP_NOTICE) -> DataFrame:
    """content = first ``cap`` characters of the group's corpus (+notice
    when cut); prompt = default template with the content, or the custom
    prompt with every '{CONTENT}' replaced (no placeholder: content dropped)."""
    c = capped_concat(docs, group_cols, order_cols, text_col, cap, notice)
    template = system_prompt if system_prompt is not None else K.CONTENT_PROMPT_TEMPLATE
    return c.select(*group_cols, tf.fill_template(F.lit(template), F.col(text_col)).alias("prompt"))


def brain_prompt(docs: DataFrame, instructions: DataFrame, group_cols: list[str], order_cols: list[str],
                 text_col: str = "text", cap: int = K.BRAIN_CAP, header: str = K.BRAIN_HEADER) -> DataFrame:
    """Instructions, plus header + content (cut at ``cap``, no notice)
    only when the content is non-empty. ``instructions`` has group_cols +
    ``instructions``; groups without documents keep the instructions alone."""
    c = capped_concat(docs, group_cols, order_cols, text_col, cap, None)
    j = instructions.join(c, group_cols, "left")
    content = F.coalesce(F.col(text_col), F.lit(""))
    return j.select(*group_cols, F.when(content != "", F.concat(F.col("instructions"), F.lit(header), content))
                    .otherwise(F.col("instructions")).alias("prompt"))


def retrieval_prompt(neighbours: DataFrame, questions: DataFrame, query_col: str = "query_id",
                     rank_col: str = "rank", text_col: str = "text", question_col: str = "question",
                     template: str = K.RAG_SYSTEM_TEMPLATE, plain: str = K.PLAIN_SYSTEM_PROMPT) -> DataFrame:
    """context = neighbour texts joined by a blank line in rank order
    (k rows per query, bounded); system = template with the context, or the
    plain prompt when there is none; messages = [system, human]."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(rank_col), F.col(text_col).alias("_t"))))
    ctx = neighbours.groupBy(query_col).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "\n\n")
                                            .alias("_ctx"))
    j = questions.join(ctx, query_col, "left")
    has = F.col("_ctx").isNotNull() & (F.col("_ctx") != "")
    system = F.when(has, F.replace(F.lit(template), F.lit("{CONTEXT}"), F.col("_ctx"))).otherwise(F.lit(plain))
    out = j.select(query_col, system.alias("system"), F.col(question_col).alias("human"))
    return out.withColumn("messages", F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("human").alias("role"), F.col("human").alias("content"))))


def answer_with_sources(answers: DataFrame, neighbours: DataFrame, query_col: str = "query_id",
                        source_col: str = "source", answer_col: str = "answer",
                        prefix: str = K.SOURCES_PREFIX) -> DataFrame:
    """P4 + A3: append the sorted distinct basenames of the retrieved rows'
    sources, only when rows were retrieved."""
    src = neighbours.groupBy(query_col).agg(
        F.array_join(F.sort_array(F.collect_set(tf.basename(source_col))), ", ").alias("_src"))
    j = answers.join(src, query_col, "left")
    return j.select(query_col, F.when(F.col("_src").isNotNull() & (F.col("_src") != ""),
                                      F.concat(F.col(answer_col), F.lit(prefix), F.col("_src")))
                    .otherwise(F.col(answer_col)).alias(answer_col))


def generate(prompts: DataFrame, fn: Callable[[list[str], list[str]], list[str]], query_col: str = "query_id",
             system_col: str = "system", human_col: str = "human", batch_size: int = 32) -> DataFrame:
    """Apply a user ``fn(systems, humans) -> answers`` per Arrow batch.
    A failing batch is retried row by row; a failing row's answer is the
    error text, and ``error`` carries the message."""
    def run(it):
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                b = pdf.iloc[s:s + batch_size]
                sys_, hum = b[system_col].tolist(), b[human_col].tolist()
                answers, errors = [], []
                try:
                    got = list(fn(sys_, hum))
                    if len(got) != len(b):
                        raise ValueError(f"generator returned {len(got)} answers for {len(b)} prompts")
                    answers, errors = [str(a) for a in got], [None] * len(b)
                except Exception:  # noqa: BLE001 - isolate the failing rows
                    for s1, h1 in zip(sys_, hum):
                        try:
                            answers.append(str(fn([s1], [h1])[0]))
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            answers.append(f"{K.ERROR_PREFIX}{e}")
                            errors.append(str(e))
                yield pd.DataFrame({query_col: b[query_col].to_numpy(), "answer": answers, "error": errors})

    qtype = prompts.schema[query_col].dataType
    schema = T.StructType([T.StructField(query_col, qtype), T.StructField("answer", T.StringType()),
                           T.StructField("error", T.StringType())])
    return prompts.select(query_col, system_col, human_col).mapInPandas(run, schema)


def echo_generator(systems: list[str], humans: list[str]) -> list[str]:
    """Stand-in generator for tests: answers with the question."""
    return list(humans)
