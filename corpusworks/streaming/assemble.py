"""Assemble a token stream into messages.

Input rows: key columns, ``seq`` (0-based), ``token``, ``event`` in
{'token', 'source', 'stop', 'done'}, ``ts`` (event time). Per message the tokens are
concatenated in ``seq`` order; a 'source' names a document behind the answer. A 'stop' at
seq s ends the message with the stop notice (whatever comes after s is ignored); 'done' at
seq s ends it. Either way the names of its sources follow as a footer. A message
is emitted once, when its end event and every seq before it have arrived -
events may come out of order, more than once and across micro-batches. State lives per
message key: the text up to the first gap, and only what lies beyond the gap event by event.
A message that never ends is emitted as 'expired' with what it
has once the watermark passes its last event + ``timeout``. Finished keys keep
a small marker until then so late events are ignored.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusworks import constants as K
from corpusworks.functions.text import basename

STATE_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),        # of seq 0 .. next - 1
    T.StructField("next", T.LongType()),
    T.StructField("beyond", T.StringType()),      # JSON {"gap": {seq: [token, event]}, "sources": [...]}
    T.StructField("finished", T.BooleanType()),
    T.StructField("max_ts_ms", T.LongType()),
])


def footer_of(sources: list[str], prefix: str) -> str:
    """The distinct file names of the sources in order, behind the prefix; nothing without a source."""
    names = sorted({x.rsplit("/", 1)[-1] for x in sources if x})
    return prefix + ", ".join(names) if names else ""


def assemble_fn(key_cols: list[str], timeout_ms: int, stop_notice: str, sources_prefix: str):
    def fn(key, pdfs, state):
        def emit(text, status):
            row = {c: [v] for c, v in zip(key_cols, key)}
            row.update({"text": [text], "status": [status]})
            return pd.DataFrame(row)

        text, at, beyond, finished, max_ts = state.get if state.exists or state.hasTimedOut else ("", 0, None, False, 0)
        held = json.loads(beyond) if beyond else {"gap": {}, "sources": []}
        gap, sources = {int(s): tuple(v) for s, v in held["gap"].items()}, held["sources"]
        if state.hasTimedOut:
            if not finished:
                rest = "".join(gap[s][0] or "" for s in sorted(gap) if gap[s][1] == "token")
                yield emit(text + rest, "expired")
            state.remove()
            return
        parts = [text]
        for pdf in pdfs:
            if len(pdf):
                max_ts = max(int(max_ts or 0), int(pd.to_datetime(pdf["ts"]).max().value // 1_000_000))
            if finished:
                continue
            for s, tok, ev in zip(pdf["seq"], pdf["token"], pdf["event"]):
                if int(s) >= at:
                    gap.setdefault(int(s), (tok, ev))
            while not finished and at in gap:
                tok, ev = gap.pop(at)
                at += 1
                if ev == "token":
                    parts.append(tok or "")
                elif ev == "source":
                    sources.append(tok)
                else:
                    end = stop_notice if ev == "stop" else ""
                    yield emit("".join(parts) + end + footer_of(sources, sources_prefix), "stopped" if end else "done")
                    finished, parts, gap, sources = True, [""], {}, []
        state.update(("".join(parts), at, json.dumps({"gap": gap, "sources": sources}), finished, int(max_ts)))
        # expire timeout after the last event; never before the current watermark
        state.setTimeoutTimestamp(max(int(max_ts) + timeout_ms, state.getCurrentWatermarkMs() + 1))
    return fn


def assemble_messages(events: DataFrame, key_cols: list[str], watermark: str = "10 minutes",
                      timeout_ms: int = 10 * 60 * 1000, stop_notice: str = K.STOP_NOTICE,
                      sources_prefix: str = K.SOURCES_PREFIX) -> DataFrame:
    """Streaming (or batch) DataFrame of token events -> one row per message:
    key columns, text, status ('done' | 'stopped' | 'expired')."""
    out_fields = [events.schema[c] for c in key_cols] + [T.StructField("text", T.StringType()),
                                                         T.StructField("status", T.StringType())]
    ev = events.select(*key_cols, F.col("seq").cast("long").alias("seq"), "token", "event", "ts")
    if events.isStreaming:
        ev = ev.withWatermark("ts", watermark)
    return ev.groupBy(*key_cols).applyInPandasWithState(
        assemble_fn(key_cols, timeout_ms, stop_notice, sources_prefix), T.StructType(out_fields), STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def assemble_batch(events: DataFrame, key_cols: list[str], stop_notice: str = K.STOP_NOTICE,
                   sources_prefix: str = K.SOURCES_PREFIX) -> DataFrame:
    """Batch twin of T1 with native expressions: end = first stop/done seq."""
    ends = (events.filter(F.col("event").isin("stop", "done"))
            .groupBy(*key_cols).agg(F.min_by(F.struct("seq", "event"), "seq").alias("_end")))
    before = events.join(ends, key_cols).filter(F.col("seq") < F.col("_end.seq"))
    token = F.when(F.col("event") == "token", F.struct("seq", "token"))
    body = before.groupBy(*key_cols).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(token)), lambda x: x["token"]), "").alias("_b"),
        F.sort_array(F.collect_set(F.when(F.col("event") == "source", basename("token", None)))).alias("_s"))
    out = ends.join(body, key_cols, "left")
    footer = F.when(F.size("_s") > 0, F.concat(F.lit(sources_prefix), F.array_join("_s", ", "))).otherwise("")
    stopped = F.col("_end.event") == "stop"
    return out.select(*key_cols, F.concat(F.coalesce("_b", F.lit("")), F.when(stopped, F.lit(stop_notice)).otherwise(""),
                                          footer).alias("text"),
                      F.when(stopped, "stopped").otherwise("done").alias("status"))
