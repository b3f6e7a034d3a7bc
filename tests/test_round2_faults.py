"""Data faults found in review: each case must keep its rows."""

from corpusworks.operators import concat
from corpusworks.operators.kbstore import KnowledgeBaseStore
from corpusworks.sources import sessions
from corpusworks.streaming.ingest import ingest_stream


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, text string")


def test_base_names_stay_strings(spark, tmp_dir):
    store = KnowledgeBaseStore(spark, f"{tmp_dir}/s")
    store.create("007", texts(spark, ("a.txt", "one")))
    store.create("7", texts(spark, ("b.txt", "two")))
    assert [r["filename"] for r in store.list_documents("007").collect()] == ["a.txt"]
    assert [r["filename"] for r in store.list_documents("7").collect()] == ["b.txt"]


def test_stream_append_and_drop_do_not_clash(spark, tmp_dir):
    store = KnowledgeBaseStore(spark, f"{tmp_dir}/s")
    store.create("kb", texts(spark, ("first.txt", "x")))
    src, ck = f"{tmp_dir}/in", f"{tmp_dir}/ck"

    def feed(name):
        texts(spark, (name, "streamed")).coalesce(1).write.mode("append").parquet(src)
        ingest_stream(spark.readStream.schema("source string, text string").parquet(src), store, "kb", ck)

    def names():
        return {r["filename"] for r in store.list_documents("kb").collect()}

    feed("s1.txt")
    store.append("kb", texts(spark, ("manual.txt", "y")))
    feed("s2.txt")
    assert names() == {"first.txt", "s1.txt", "manual.txt", "s2.txt"}
    store.drop("kb")
    store.create("kb", texts(spark, ("again.txt", "z")))
    feed("s3.txt")
    assert names() == {"again.txt", "s3.txt"}


def test_null_groups_and_texts_are_kept(spark):
    df = spark.createDataFrame([(None, 1, "ab"), (None, 2, None), ("g", 1, "x"), ("g", 2, "y")],
                               "grp string, ord int, text string")
    got = {r["grp"]: (r["text"], r["full_length"]) for r in
           concat.capped_concat(df, ["grp"], ["ord"], cap=100, notice=None, sep="--").collect()}
    assert got["g"] == ("x--y", 4)
    assert got[None][0] == "ab--" and got[None][1] == len(got[None][0])


def test_session_by_exact_path(spark, tmp_dir):
    for name in ("a.json", "aa.json"):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write('{"model_name": "m", "session_id": "%s", "messages": [{"role": "user", "content": "hi"}]}' % name)
    got = sessions.load_session(spark, tmp_dir, "a.json").collect()
    assert [r["session_id"] for r in got] == ["a.json"]
    assert sessions.load_session(spark, tmp_dir, f"{tmp_dir}/aa.json").count() == 1


def test_null_and_repeated_order_keys_multiply_no_row(spark):
    rows = [("s", 1, "aa"), ("s", None, "bb"), ("s", None, "cc"), ("s", None, "dd"), ("s", 1, "aa"), (None, None, None)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    for sep, cap in (("|", 100), ("|", 7), ("", 100), ("", 5)):
        got = {r["source"]: (r["text"], r["full_length"]) for r in
               concat.capped_concat(df, ["source"], ["doc_id"], "text", cap, None, sep).collect()}
        text, length = got["s"]
        assert length == len(sep.join(["aa", "aa", "bb", "cc", "dd"])) and len(text) == min(cap, length)
        if cap == 100:
            parts = text.split("|") if sep else [text[i:i + 2] for i in range(0, 10, 2)]
            assert sorted(parts) == ["aa", "aa", "bb", "cc", "dd"] and parts[3:] == ["aa", "aa"]     # null keys first
        assert got[None] == ("", 0)
