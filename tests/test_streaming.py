"""Streams: token assembly (normal, stopped, out of order, never ending),
batch = stream for summaries and progress."""

import datetime as dt


from corpusworks import constants as K
from corpusworks.session import scratch_dir
from corpusworks.streaming import assemble, runner, summaries

T0 = dt.datetime(2024, 1, 1)


def ev(conv, seq, tok, kind, sec):
    return (conv, seq, tok, kind, T0 + dt.timedelta(seconds=sec))


SCHEMA = "conv_id long, seq long, token string, event string, ts timestamp"


def stage(spark, batches, name):
    path = scratch_dir(spark, name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/b{i:03d}")
    return path


def test_token_assembly_stream(spark):
    b1 = [ev(1, 0, "Mer", "token", 0), ev(1, 1, "haba", "token", 1),        # normal
          ev(2, 0, "a", "token", 0), ev(2, 1, "", "stop", 1),               # stopped
          ev(3, 2, "", "done", 2), ev(3, 0, "x", "token", 0),               # out of order
          ev(4, 0, "never", "token", 0)]                                      # never ends
    b2 = [ev(1, 2, "", "done", 2), ev(2, 2, "late", "token", 2), ev(3, 1, "y", "token", 1)]
    b3 = [ev(9, 0, "tick", "token", 4000)]                                   # moves the watermark on
    b4 = [ev(9, 1, "", "done", 4001)]
    src = stage(spark, [b1, b2, b3, b4], "t1-src")
    files = [f"{src}/b{i:03d}" for i in range(4)]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = scratch_dir(spark, "t1-o"), scratch_dir(spark, "t1-c")
    msgs = assemble.assemble_messages(stream, ["conv_id"], watermark="10 seconds", timeout_ms=1000)
    runner.run_available_now(msgs, out, ck)
    got = {r["conv_id"]: (r["text"], r["status"]) for r in spark.read.parquet(out).collect()}
    assert got[1] == ("Merhaba", "done")
    assert got[2] == ("a" + K.STOP_NOTICE, "stopped")
    assert got[3] == ("xy", "done")
    assert got[4] == ("never", "expired")
    assert got[9] == ("tick", "done")
    assert files


def test_token_assembly_batch_twin(spark):
    rows = [ev(1, 1, "b", "token", 1), ev(1, 0, "a", "token", 0), ev(1, 2, "", "done", 2),
            ev(2, 0, "a", "token", 0), ev(2, 1, "", "stop", 1), ev(2, 2, "z", "token", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r["text"] for r in assemble.assemble_batch(df, ["conv_id"]).collect()}
    assert got == {1: "ab", 2: "a" + K.STOP_NOTICE}


def test_footer_on_done_and_stop_and_events_twice(spark):
    b1 = [ev(1, 0, "dir/b.txt", "source", 0), ev(1, 2, "there", "token", 2), ev(1, 5, "", "done", 5),
          ev(2, 0, "x/a.txt", "source", 0), ev(2, 1, "part", "token", 1), ev(2, 2, "", "stop", 2)]
    b2 = [ev(1, 1, "so ", "token", 1), ev(1, 2, "there", "token", 2), ev(1, 3, "a.txt", "source", 3), ev(2, 3, "late", "token", 3)]
    b3 = [ev(1, 4, "z/b.txt", "source", 4), ev(1, 1, "so ", "token", 1)]
    src = stage(spark, [b1, b2, b3], "t1-foot")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = scratch_dir(spark, "t1-fo")
    runner.run_available_now(assemble.assemble_messages(stream, ["conv_id"]), out, scratch_dir(spark, "t1-fc"))
    want = {1: ("so there" + K.SOURCES_PREFIX + "a.txt, b.txt", "done"),
            2: ("part" + K.STOP_NOTICE + K.SOURCES_PREFIX + "a.txt", "stopped")}
    assert {r["conv_id"]: (r["text"], r["status"]) for r in spark.read.parquet(out).collect()} == want
    batch = spark.createDataFrame([*b1, b2[0], b2[2], b2[3], b3[0]], SCHEMA)
    assert {r["conv_id"]: (r["text"], r["status"]) for r in assemble.assemble_batch(batch, ["conv_id"]).collect()} == want


def test_summary_stream_equals_batch(spark):
    rows = [(i % 5, T0 + dt.timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    path = scratch_dir(spark, "t3-src")
    df.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log, ck = scratch_dir(spark, "t3-log"), scratch_dir(spark, "t3-ck")
    runner.run_upserts(summaries.running_summary(stream, "user_id"), log, ck)
    s = runner.latest_by_key(spark.read.parquet(log), ["user_id"])
    b = summaries.running_summary(df, "user_id")
    assert sorted(map(tuple, s.select("user_id", "n", "first_ts", "last_ts").collect())) == \
        sorted(map(tuple, b.collect()))


def test_progress_latest_and_zero_total(spark):
    rows = [("j", 1, 10, 0.9, T0), ("j", 5, 10, 0.5, T0 + dt.timedelta(seconds=5)),
            ("k", 3, 0, 1.0, T0)]
    df = spark.createDataFrame(rows, "job string, step long, total long, loss double, ts timestamp")
    got = {r["job"]: (r["step"], round(r["pct"], 6), r["loss"]) for r in summaries.latest_progress(df).collect()}
    assert got == {"j": (5, 0.675, 0.5), "k": (3, 0.45, 1.0)}
    iv = spark.createDataFrame([(50,), (10,)], "t long").select(summaries.log_interval("t")).collect()
    assert [r[0] for r in iv] == [2, 1]
