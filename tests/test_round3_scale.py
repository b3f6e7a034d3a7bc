"""Faults that show at size, on small rows: what is read whole, and what one task holds."""

import json

import numpy as np
import pyarrow as pa

from corpusworks import constants as K
from corpusworks.operators import knn
from corpusworks.sources import files as fs


def _write_json(folder):
    lines = [{"doc_id": i, "text": f"line {i} " + "x" * 50} for i in range(40)]
    (folder / "lines.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    (folder / "list.json").write_text(json.dumps(lines[:3], indent=1))
    (folder / "object.json").write_text(json.dumps(lines[0], indent=1))
    return lines


def _documents(found):
    return sorted((r["source"].rsplit("/", 1)[1], r["ordinal"], json.dumps(json.loads(r["text"]))) for r in found.collect())


def test_files_scanned_by_lines_are_not_opened_whole(spark, tmp_path):
    """a reader of whole files refuses what is above its largest length as soon as it opens it."""
    lines = _write_json(tmp_path)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        docs, bad = fs.scan_documents(spark, str(tmp_path), line_formats=(".json",), max_bytes=1 << 20)
        found = _documents(docs)
        assert len([x for x in found if x[0] == "lines.json"]) == len(lines) and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_large_json_files_are_scanned_by_lines(spark, tmp_path, monkeypatch):
    """the same documents, whether a JSON file is read whole or by lines; the large ones are never opened whole."""
    _write_json(tmp_path)
    whole = _documents(fs.scan_documents(spark, str(tmp_path))[0])
    monkeypatch.setattr(fs, "WHOLE_BYTES", 100)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        docs, bad = fs.scan_documents(spark, str(tmp_path), max_bytes=1 << 20)
        assert _documents(docs) == whole and len(whole) == 44 and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_knn_holds_a_bounded_number_of_distances(spark, monkeypatch):
    """Arrow batches are bounded by bytes, and a block's distances come in parts."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.withColumnRenamed("vec_id", "query_id")
    whole = knn.knn_topk(queries, df, 3, exclude_self=True).orderBy("query_id", "rank").collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    vectors = np.array([r[1] for r in rows])
    ids = pa.array([list(range(60))])
    batch = pa.RecordBatch.from_arrays([pa.array([4]), ids, pa.array([vectors.tobytes()]), ids, pa.array([vectors.tobytes()])],
                                       names=["dims", "qids", "qvecs", "cids", "cvecs"])
    monkeypatch.setattr(knn, "MAX_CELLS", 600)
    parts = list(knn._search(3, "l2", True)([batch]))
    assert len(parts) == 6                                  # ten queries of sixty distances at a time
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(r["query_id"], r["vec_id"], r["dist"]) for r in whole]


def test_tokens_meet_a_large_table_once_a_block(spark, tmp_path, monkeypatch):
    """What is shuffled are the distinct tokens of a block of rows; any block size gives the same ids."""
    import random

    from corpusworks.operators import tokens as tk
    draw = random.Random(5)
    rows = [(i, None if i == 7 else [draw.choice(["a", "b", "c", "zz", None]) for _ in range(draw.randrange(0, 900))]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, toks array<string>").coalesce(1)
    ids = {"a": [1, 2], "b": [3], "c": []}
    table = spark.createDataFrame(list(ids.items()), "token string, ids array<long>")
    want = [(k, [i for t in toks or [] for i in ids.get(t, [0])]) for k, toks in rows]
    for block, out in ((1 << 22, 1 << 20), (500, 100)):
        monkeypatch.setattr(tk, "BLOCK_TOKENS", block)
        monkeypatch.setattr(tk, "OUT_IDS", out)
        found = tk.lookup_ids(df, "toks", table, [0], max_rows=0)
        assert sorted((r["k"], list(r["ids"])) for r in found.collect()) == want
    blocks = df.selectExpr("k", "coalesce(toks, array()) AS toks").mapInArrow(
        tk._row_blocks(["k"], "toks"), "_block long, _rows array<struct<_n:int,k:long>>, _codes binary, _tokens array<string>")
    packed = blocks.selectExpr("size(_tokens) AS n", "size(_rows) AS rows").collect()
    assert max(r["n"] for r in packed) <= 5 and sum(r["rows"] for r in packed) == 60


def test_a_stream_source_has_files_as_its_table_has_partitions(spark):
    """no task writes or reads a fixed part of all documents."""
    from corpusworks.streaming import runner
    table = spark.range(4000).repartition(40)
    n, per_trigger = runner.files_and_trigger(table, 4)
    assert (n, per_trigger) == (40, 10)
    path = runner.stage_as_stream_source(spark, table, "many", ["id"], n)
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) == 40 and back.distinct().count() == 4000


def test_sessions_of_both_layouts_are_read_in_one_pass(spark, tmp_path):
    """one scan of the files, and sorting does not open them again."""
    from corpusworks.sources import sessions as src
    message = [{"role": "human", "content": "hi", "time": "2024-01-01 00:00:00"}]
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "s", "messages": message}))
    (tmp_path / "b.json").write_text(json.dumps(message * 2))
    for name, text in (("c.json", "[]"), ("d.json", "3"), ("e.json", "{broken")):
        (tmp_path / name).write_text(text)
    found = src.read_session_files(spark, str(tmp_path))
    assert {(r["filename"], r["model_name"], r["session_id"], r["message_count"], r["updated_at"]) for r in found.collect()} == {
        ("a.json", K.UNKNOWN_MODEL_NAME, "s", 1, ""), ("b.json", "b", "", 2, "2024-01-01 00:00:00")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert "FileScan text" not in src.list_sessions(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_and_ids_made_once(spark, monkeypatch):
    """training counts the words of the blocks that are encoded later, and the table of ids is derived once."""
    import random

    from corpusworks.operators import bpe
    from corpusworks.operators import tokens as tk
    draw = random.Random(9)
    texts = [None, "", "  ", *(" ".join(draw.choice(["low", "lower", "it's", "newest", "ö 12"]) for _ in range(40)) for _ in range(30))]
    docs = spark.createDataFrame([(i % 29 or None, t) for i, t in enumerate(texts)], "k long, text string").repartition(3)
    want = {(r["word"], r["n"]) for r in tk.word_counts(docs).collect()}
    vocab, merges, final = bpe.train_from_documents(docs, "text", 300)
    ids = bpe.encode_arrays(docs, "text", bpe.encode_words(final, vocab))
    whole = sorted(((r["k"] or 0, r["ids"]) for r in ids.collect()))
    for size in (1 << 22, 90):
        monkeypatch.setattr(tk, "BLOCK_TOKENS", size)
        blocks = tk.packed_tokens(bpe._cut_words(docs, "text", tk.PRETOKEN_PATTERN), "text")
        counts = tk.packed_counts(blocks)
        assert "regexp" not in counts._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["word"], r["n"]) for r in counts.collect()} == want
        vocab2, merges2, ids2 = bpe.train_and_encode(docs, "text", 300)
        assert merges2 == merges and vocab2.collect() == vocab.collect()
        assert sorted(((r["k"] or 0, r["ids"]) for r in ids2.collect())) == whole and ids2.columns == ["k", "ids"]

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    table = spark.createDataFrame([("a", [1]), ("b", [2, 3])], "token string, ids array<long>").mapInArrow(seen, "token string, ids array<long>")
    rows = spark.createDataFrame([(1, ["a", "b", "c"])], "k long, toks array<string>")
    assert [r["ids"] for r in tk.lookup_ids(rows, "toks", table, [0], max_rows=0).collect()] == [[1, 2, 3, 0]]
    assert made.value == 2
