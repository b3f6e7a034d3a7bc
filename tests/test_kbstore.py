"""Knowledge-base lifecycle: create, append (no dedup), delete by basename or
path, re-add after delete, drop, list, retrieve."""

import pytest
from pyspark.sql import functions as F

from corpusworks.operators.kbstore import KnowledgeBaseStore
from corpusworks.operators import knn


def docs(spark, rows):
    return spark.createDataFrame(rows, "source string, text string")


def test_lifecycle(spark, tmp_dir):
    st = KnowledgeBaseStore(spark, tmp_dir)
    base = [("a/x.txt", "alpha beta " * 150), ("b/x.txt", "gamma delta " * 10), ("c/y.txt", "epsilon")]
    st.create("kb1", docs(spark, base))
    with pytest.raises(ValueError):
        st.create("kb1", docs(spark, base))
    with pytest.raises(ValueError):
        st.append("nope", docs(spark, base))
    listing = {r["filename"]: r["chunk_count"] for r in st.list_documents("kb1").collect()}
    assert set(listing) == {"x.txt", "y.txt"} and listing["y.txt"] == 1
    n_x = listing["x.txt"]
    st.append("kb1", docs(spark, [("c/y.txt", "epsilon")]))
    assert {r["filename"]: r["chunk_count"] for r in st.list_documents("kb1").collect()}["y.txt"] == 2
    ok, msg = st.delete_document("kb1", "a/x.txt")           # full path: one file only
    assert ok
    left = {r["filename"]: r["chunk_count"] for r in st.list_documents("kb1").collect()}
    assert 0 < left["x.txt"] < n_x
    ok, _ = st.delete_document("kb1", "x.txt")               # basename: the rest
    assert ok and "x.txt" not in {r["filename"] for r in st.list_documents("kb1").collect()}
    assert st.delete_document("kb1", "missing.txt")[0] is False
    st.append("kb1", docs(spark, [("a/x.txt", "back again")]))  # re-added after delete
    assert {r["filename"]: r["chunk_count"] for r in st.list_documents("kb1").collect()}["x.txt"] == 1
    st.create("kb2", docs(spark, base))
    assert [r["kb"] for r in st.list_bases().collect()] == ["kb1", "kb2"]
    assert st.drop("kb2") is True and st.drop("kb2") is False
    assert [r["kb"] for r in st.list_bases().collect()] == ["kb1"]
    st.create("kb2", docs(spark, [("z.txt", "fresh")]))      # re-create after drop sees only new rows
    assert [r["filename"] for r in st.list_documents("kb2").collect()] == ["z.txt"]
    info = st.info("kb1").first()
    assert info["files"] > 0 and info["size_bytes"] > 0
    # retrieval over the base's stored vectors
    q = st.chunks("kb1").select(F.col("chunk_id").alias("query_id"), "embedding").limit(1)
    q = q.select(F.lit(1).cast("long").alias("query_id"), "embedding")
    c = st.chunks("kb1").select(F.monotonically_increasing_id().alias("vec_id"), "embedding")
    assert knn.knn_topk(q, c, 3).count() == 3
    other = st.compact("kb1", tmp_dir + "/compacted")
    assert sorted(map(tuple, other.list_documents("kb1").collect())) == \
        sorted(map(tuple, st.list_documents("kb1").collect()))


def test_retrieve_searches_the_stored_vectors(spark, tmp_dir):
    st = KnowledgeBaseStore(spark, tmp_dir)
    pets = [("pets/cat.txt", "the cat sleeps on the mat"), ("pets/dog.txt", "a dog runs after the ball")]
    st.create("pets", docs(spark, pets))
    st.create("cars", docs(spark, [("cars/a.txt", "the cat sleeps on the mat of the car")]))
    ask = spark.createDataFrame([(1, "where does the cat sleep"), (2, "dog and ball"), (3, "")], "query_id long, question string")

    def found(**more):
        return {(r["query_id"], r["rank"]): (r["basename"], r["text"]) for r in st.retrieve(ask, "pets", 2, **more).collect()}

    got = found()
    assert got[1, 1] == ("cat.txt", pets[0][1]) and got[2, 1] == ("dog.txt", pets[1][1]) and len(got) == 6
    st.append("pets", docs(spark, [("pets/new.txt", "where does the cat sleep")]))
    assert found()[1, 1][0] == "new.txt"
    st.delete_document("pets", "new.txt")
    assert found() == got                                    # tombstones hold, other bases are not searched
    own = spark.createDataFrame([(7, st.chunks("cars").first()["embedding"])], "q long, e array<float>")
    r = st.retrieve(own, "pets", 1, query_id="q", vectors="e").first()
    assert r["q"] == 7 and r["basename"] == "cat.txt"
    plan = st.chunks("pets", columns=["chunk_id", "embedding"])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(kb" in plan and "text:string" not in plan
    with pytest.raises(ValueError):
        st.retrieve(ask, "nope")


def test_an_input_without_text_fails_and_leaves_nothing(spark, tmp_dir):
    st = KnowledgeBaseStore(spark, tmp_dir)
    blank = docs(spark, [("a.txt", " \n "), ("b.txt", None)])
    for bad in (blank, blank.where("false")):
        with pytest.raises(ValueError):
            st.create("kb", bad)
    assert not st.exists("kb") and st.log().count() == 0
    st.create("kb", docs(spark, [("a.txt", "text")]))
    with pytest.raises(ValueError):
        st.append("kb", blank)
    assert st.list_documents("kb").count() == 1 and st.log().count() == 1


def test_create_many_bases_in_one_job(spark, tmp_dir):
    st = KnowledgeBaseStore(spark, tmp_dir)
    df = spark.createDataFrame([("x", "a.txt", "one"), ("y", "b.txt", "two"), ("z", "c.txt", " "), (None, "d.txt", "four")],
                               "kb string, source string, text string")
    assert {r["kb"] for r in st.create_many(df, "kb").collect()} == {"x", "y"}
    assert [r["kb"] for r in st.list_bases().collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        st.create_many(df, "kb")
