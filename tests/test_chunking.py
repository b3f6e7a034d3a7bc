"""Chunking: C2 rule, C1 contract invariants, U7 table function."""

import random

import pytest

from corpusworks.operators import chunk as ch


def py_stride(text, size, overlap):
    if not text:
        return []
    step, out, s = size - overlap, [], 0
    while True:
        out.append(text[s:s + size])
        if s + size >= len(text):
            return out
        s += step


@pytest.mark.parametrize("size,overlap", [(1000, 200), (10, 3), (5, 0), (7, 6)])
def test_fixed_stride_matches_python(spark, size, overlap):
    rnd = random.Random(7)
    texts = ["", "a", "x" * size, "y" * (size + 1)] + ["".join(rnd.choice("ab c\n") for _ in range(rnd.randint(0, 60)))
                                                     for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {}
    for r in ch.fixed_stride_chunks(df, "text", size, overlap).collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], r["text"]))
    for i, t in enumerate(texts):
        assert [x[1] for x in sorted(got.get(i, []))] == py_stride(t, size, overlap)
    counts = dict(df.select("id", ch.stride_chunk_count("text", size, overlap)).collect())
    assert all(counts[i] == len(py_stride(t, size, overlap)) for i, t in enumerate(texts))


def test_chunk_args_checked():
    with pytest.raises(ValueError):
        ch.check_chunk_args(100, 100)
    with pytest.raises(ValueError):
        ch.check_chunk_args(100, -1)


def test_recursive_contract():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "x" * 40]
    for _ in range(200):
        parts = []
        for _ in range(rnd.randint(0, 80)):
            parts.append(rnd.choice(words))
            parts.append(rnd.choice([" ", " ", "\n", "\n\n", "  "]))
        text = "".join(parts)
        size, overlap = rnd.choice([(30, 5), (50, 10), (100, 0), (45, 20)])
        res = ch.recursive_split(text, size, overlap)
        assert ch.chunk_invariants_hold(text, res, size, overlap)


def test_recursive_chunks_dataframe_and_udtf(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten " * 5), (2, "")],
                               "doc_id long, text string")
    got = ch.recursive_chunks(df, "text", 40, 10).collect()
    assert got and all(len(r["text"]) <= 40 for r in got) and {r["doc_id"] for r in got} == {1}
    ch.register_chunk_table_function(spark, "chunk_text_t")
    df.createOrReplaceTempView("t_docs")
    u = spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk FROM t_docs d, LATERAL chunk_text_t(d.text, 40, 10) c")
    assert sorted((r[0], r[1], r[2]) for r in u.collect()) == sorted((r["doc_id"], r["chunk_no"], r["text"])
                                                                        for r in got)


def test_chunk_id_deterministic(spark):
    df = spark.createDataFrame([("s", 1, 0)], "s string, d long, c int")
    a = df.select(ch.chunk_id("s", "d", "c")).first()[0]
    b = df.select(ch.chunk_id("s", "d", "c")).first()[0]
    assert a == b and len(a) == 64
