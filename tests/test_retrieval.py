"""kNN join against brute force; prompts; generation hook; embeddings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators import embed as em
from corpusworks.operators import knn
from corpusworks.operators import prompts as pr


def brute(q, c, k, exclude_self, metric="l2"):
    out = []
    for qi, qv in q:
        ds = []
        for ci, cv in c:
            if exclude_self and ci == qi:
                continue
            a, b = np.asarray(qv, float), np.asarray(cv, float)
            if metric == "l2":
                d = float(((a - b) ** 2).sum())
            else:
                den = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1.0 - float(a @ b) / den if den > 0 else 1.0
            ds.append((d, ci))
        ds.sort()
        out += [(qi, r + 1, ci, round(d, 9)) for r, (d, ci) in enumerate(ds[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric,exclude", [("l2", False), ("l2", True), ("cosine", False)])
def test_knn_brute_force(spark, metric, exclude):
    rnd = np.random.default_rng(5)
    c = [(i, [float(x) for x in rnd.normal(size=8).astype(np.float32)]) for i in range(300)]
    c += [(300, c[0][1]), (301, c[0][1])]  # exact duplicates -> ties by id
    q = [(i, c[i][1]) for i in range(0, 40, 3)] + [(1000, [0.0] * 8)]
    qdf = spark.createDataFrame(q, "query_id long, embedding array<float>")
    cdf = spark.createDataFrame(c, "vec_id long, embedding array<float>").repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["dist"], 9))
                 for r in knn.knn_topk(qdf, cdf, 3, metric=metric, exclude_self=exclude).collect())
    cf = [(i, np.asarray(v, np.float32).astype(float).tolist()) for i, v in c]
    qf = [(i, np.asarray(v, np.float32).astype(float).tolist()) for i, v in q]
    assert got == brute(qf, cf, 3, exclude, metric)


def test_knn_query_blocks(spark):
    rnd = np.random.default_rng(9)
    c = [(i, rnd.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(c, "vec_id long, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    one = sorted(tuple(r) for r in knn.knn_topk(q, df, 2, exclude_self=True).collect())
    many = sorted(tuple(r) for r in knn.knn_topk(q, df, 2, exclude_self=True, max_block_rows=16).collect())
    assert one == many and len(one) == 240


def test_retrieval_prompt_and_sources(spark):
    nn = spark.createDataFrame([(1, 2, "second", "/a/y.txt"), (1, 1, "first", "/b/x.txt"), (1, 3, "third", "/c/x.txt")],
                               "query_id long, rank int, text string, source string")
    qs = spark.createDataFrame([(1, "soru"), (2, "yalnız")], "query_id long, question string")
    p = {r["query_id"]: r for r in pr.retrieval_prompt(nn, qs).collect()}
    assert p[1]["system"] == K.RAG_SYSTEM_TEMPLATE.replace("{CONTEXT}", "first\n\nsecond\n\nthird")
    assert p[2]["system"] == K.PLAIN_SYSTEM_PROMPT and p[2]["messages"][1]["content"] == "yalnız"
    ans = spark.createDataFrame([(1, "cevap"), (2, "yok")], "query_id long, answer string")
    a = {r["query_id"]: r["answer"] for r in pr.answer_with_sources(ans, nn).collect()}
    assert a == {1: "cevap" + K.SOURCES_PREFIX + "x.txt, y.txt", 2: "yok"}


def test_generate_isolates_errors(spark):
    p = spark.createDataFrame([(1, "s", "ok"), (2, "s", "boom"), (3, "s", "fine")],
                              "query_id long, system string, human string")

    def fn(systems, humans):
        if "boom" in humans:
            raise RuntimeError("bad row")
        return [h.upper() for h in humans]

    got = {r["query_id"]: (r["answer"], r["error"]) for r in pr.generate(p, fn).collect()}
    assert got[1] == ("OK", None) and got[3] == ("FINE", None)
    assert got[2][0] == K.ERROR_PREFIX + "bad row"


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "Merhaba dünya merhaba"), (2, "")], "id long, text string")
    v = {r["id"]: r["embedding"] for r in em.embed_hashed(df, "text", 16).collect()}
    assert abs(sum(x * x for x in v[1]) - 1.0) < 1e-6 and all(x == 0 for x in v[2])
    terms = {(r["bucket"], r["n"]) for r in em.hashed_terms(df, "id", "text", 16).collect()}
    assert sum(n for _, n in terms) == 3


def test_user_embedder_hook(spark):
    def make_model():
        def predict(texts):
            return np.stack([[float(len(t)), 1.0, 0.0] for t in texts]).astype(np.float32)
        return predict

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in em.embed_with(df, make_model, "text", 3).collect()}
    assert got == {1: [2.0, 1.0, 0.0], 2: [4.0, 1.0, 0.0]}


def test_wide_queries_take_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 96 * 40)           # 40 queries of 96 numbers a block
    monkeypatch.setattr(knn, "SLICE_BYTES", 8 * 96 * 50)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(300, 96)))] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.knn_topk(df.withColumnRenamed("vec_id", "query_id"), df, 2, exclude_self=True).collect()
    mat = np.array([v for _, v in rows[:-1]])
    dist = ((mat[:, None] - mat[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    want = {(i, r + 1): int(j) for i in range(300) for r, j in enumerate(np.argsort(dist[i])[:2])}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_of_a_hot_query_id_many_ties_and_string_ids(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "SLICE_BYTES", 8 * 4 * 30)            # many slices
    rnd = np.random.default_rng(8)
    c = [(f"c{i}", [float(x) for x in v]) for i, v in enumerate(rnd.integers(0, 3, size=(200, 4)))]      # ties abound
    c += [("short", [1.0, 2.0]), ("none", None), ("nothing", [])]
    q = [("hot" if i % 3 else f"q{i}", v) for i, (_, v) in enumerate(c[:60])] + [("two", [1.0, 2.5])]
    qdf = spark.createDataFrame(q, "query_id string, embedding array<double>")
    cdf = spark.createDataFrame(c, "vec_id string, embedding array<double>").repartition(7)
    got = [tuple(r) for r in knn.knn_topk(qdf, cdf, 5, metric=metric, max_block_rows=16).collect()]
    want = []
    for name in {n for n, _ in q}:
        ds = [(d, i) for n, v in q if n == name for _, _, i, d in brute([(n, v)], [x for x in c if x[1] and len(x[1]) == len(v)],
                                                                        999, False, metric)]
        want += [(name, r + 1, i, d) for r, (d, i) in enumerate(sorted(ds)[:5])]
    told = [(a, b, x if metric == "l2" else "", round(abs(d), 9)) for a, b, x, d in got]     # parallel vectors tie but for rounding
    assert sorted(told) == sorted((a, b, x if metric == "l2" else "", round(abs(d), 9)) for a, b, x, d in want)


def test_knn_wide_vectors_with_a_hot_query_id(spark):
    """12,000 x 768: block and slice bounds in bytes, a third of all queries under one id."""
    rnd = np.random.default_rng(3)
    mat = rnd.normal(size=(12_000, 768)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(12_000), "embedding": list(mat)})).repartition(4)
    ask = df.where("vec_id < 300").select(F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("vec_id")).alias("query_id"),
                                          "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["dist"]) for r in knn.knn_topk(ask, df, 2).collect()}
    assert {got[-1, 1], got[-1, 2]} == {(0, 0.0), (3, 0.0)}
    for i in (1, 2, 298):
        dist = ((mat.astype(float) - mat[i].astype(float)) ** 2).sum(1)
        order = np.argsort(dist)
        assert got[i, 1] == (i, 0.0) and got[i, 2][0] == order[1] and abs(got[i, 2][1] - dist[order[1]]) < 1e-9
