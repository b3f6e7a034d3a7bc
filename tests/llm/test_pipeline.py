"""The pipeline's stages on a small fixture, against what each must decide."""


import corpus_pipeline as P
from corpusworks.llm import common, near_dup
from test_llm_operators import prose


def test_stages_keep_clean_documents(spark, tmp_path):
    common.prepare(spark)
    passage = "This passage stands in many documents and is long enough to be a key"
    item = prose(999, 30)
    texts = {d: prose(d, 120) for d in range(60)}
    for d in range(6):
        texts[d] += f"\n{passage}"
    texts[10] = texts[9]                                        # exact copy
    texts[12] = texts[11] + " more"                             # near copy
    texts[20] = prose(20, 60) + " " + item + " " + prose(21, 60)
    texts[30] = None
    texts[31] = ""
    texts[40] = " ".join(w.upper() + "!!" for w in prose(40, 80).split())
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "tokens"]
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids = {x["doc_id"] for x in now.select("doc_id").collect()}
        gone = {0: set(), 1: set(), 2: {10, 12}, 3: {10, 12, 20}, 4: {10, 12, 20}}[k] | {40}
        assert ids == set(texts) - gone, name
        if name == "lines":
            held = {x["doc_id"] for x in now.where(f"text LIKE '%{passage}%'").collect()}
            assert held == {5}
    assert now.where("NOT round_trip").count() == 0
    assert {x["doc_id"] for x in P.run(spark, str(tmp_path)).collect()} == ids


def test_near_duplicate_stage_takes_pairs_from_0_80(spark, tmp_path):
    common.prepare(spark)
    texts = {}
    for d in range(0, 40, 2):                                   # 200 words: 177 of 215 shingles shared, 0.823
        own = [f"w{d}x{i}" for i in range(200)]
        texts[d] = " ".join(own)
        texts[d + 1] = " ".join(own[:181] + [f"v{d}x{i}" for i in range(19)])
    for d in range(40, 60, 2):                                  # 174 of 218: 0.798
        own = [f"w{d}x{i}" for i in range(200)]
        texts[d] = " ".join(own)
        texts[d + 1] = " ".join(own[:178] + [f"v{d}x{i}" for i in range(22)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {x["doc_id"] for x in P.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(0, 40, 2)) | set(range(40, 60))
    assert all(x["kept"] for x in near_dup.near_duplicates(docs).collect())         # op4 keeps its 0.85


def test_near_duplicate_stage_decides_by_row(spark, tmp_path):
    common.prepare(spark)
    a, b, c, d, e = (prose(700 + i, 80) for i in range(5))
    rows = [(1, a), (2, b), (2, a + " more"), (2, c),           # one row of id 2 copies document 1, two are unique
            (3, d), (3, d), (4, e + " x"), (4, e),              # a repeated row; near copies under one id
            (5, ""), (5, None), (5, "  "), (5, ""), (None, a), (None, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.near_duplicate_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    got = sorted(map(tuple, got.collect()), key=repr)
    four = [r for r in got if r[0] == 4]
    assert len(four) == 1 and four[0][1] in (e, e + " x")
    want = [(1, a), (2, b), (2, c), (3, d), (5, ""), (5, None), (5, "  "), (None, a), (None, a), (None, b)]
    names = {a: "a", b: "b", c: "c", d: "d"}
    assert sorted(((i, names.get(x, x)) for i, x in got if i != 4), key=repr) == sorted(
        ((i, names.get(x, x)) for i, x in want), key=repr)
