"""Scalar functions: reference goldens and edge fixtures."""

from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.functions import text as tf


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def test_format_size_goldens(spark):
    # reference goldens
    df = spark.createDataFrame([(500,), (2048,), (5 * 1024 ** 2,), (2 * 1024 ** 3,)], "n long")
    got = [r[0] for r in df.select(tf.format_size("n")).collect()]
    assert got == ["500 B", "2.0 KB", "5.0 MB", "2.0 GB"]


def test_format_size_matches_python_rounding(spark):
    def py(n):
        if n < 1024:
            return f"{n} B"
        if n < 1024 ** 2:
            return f"{n / 1024:.1f} KB"
        if n < 1024 ** 3:
            return f"{n / 1024 ** 2:.1f} MB"
        return f"{n / 1024 ** 3:.1f} GB"
    ns = [0, 1, 1023, 1024, 1075, 1076, 1126, 2304, 2355, 2406, 1048575, 1048576, 1153433, 1205862,
          1073741823, 1073741824, 5 * 1024 ** 4, 3 * 1024 ** 3 + 5 * 1024 ** 2 * 10]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = dict(df.select("n", tf.format_size("n").alias("s")).collect())
    assert got == {n: py(n) for n in ns}


def test_strip_matches_python(spark):
    vals = ["\t a b \n", " x ", "　y ", "  ", "", "\x1cz\x1f", "n​o"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tf.strip("v")).collect()]
    assert got == [v.strip() for v in vals]


def test_basename_and_ext(spark):
    paths = ["a/b/c.TXT", "x.tar.gz", ".hidden", "dir/", "..x", "noext", "a.b/c", "y.", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select(tf.basename("p").alias("b"), tf.file_ext("p").alias("e")).collect()
    import os
    for p, r in zip(paths, rows):
        if p is None:
            assert r["b"] == "?"
            continue
        assert r["b"] == os.path.basename(p)
        assert r["e"] == os.path.splitext(p)[1].lower()


def test_reader_routing(spark):
    df = spark.createDataFrame([(e,) for e in [".txt", ".csv", ".xyz", ".doc", ".jsonl", ""]], "e string")
    got = [r[0] for r in df.select(tf.reader_for_ext("e")).collect()]
    assert got == ["text", "csv", "unsupported", "docx", "json", "unsupported"]


def test_preview_and_safe_name(spark):
    assert one(spark, tf.preview, "x" * 50) == "x" * 50
    assert one(spark, tf.preview, "x" * 51) == "x" * 50 + "..."
    name = "Aç-b c.Ⅳ_٣/ö"
    expected = "".join(c if c.isalnum() or c in "-_" else "_" for c in name)
    assert one(spark, tf.safe_name, name) == expected


def test_short_date(spark):
    assert one(spark, tf.short_date, "2024-03-05 07:08:09") == "05/03 07:08"
    assert one(spark, tf.short_date, "not a date at all here") == "not a date at all here"[:16]
    assert one(spark, tf.short_date, "") == ""


def test_caps_and_templates(spark):
    n = 10
    df = spark.createDataFrame([("a" * (n - 1),), ("a" * n,), ("a" * (n + 1),)], "v string")
    got = [r[0] for r in df.select(tf.cap_text("v", n, "!")).collect()]
    assert got == ["a" * (n - 1), "a" * n, "a" * n + "!"]
    t = spark.createDataFrame([("<{CONTENT}|{CONTENT}>", "X"), ("none", "X")], "t string, c string")
    got = [r[0] for r in t.select(tf.fill_template("t", "c")).collect()]
    assert got == ["<X|X>", "none"]


def test_progress_pct(spark):
    df = spark.createDataFrame([(5, 10), (3, 0), (30, 10), (-5, 10)], "s long, t long")
    got = [round(r[0], 6) for r in df.select(tf.progress_pct("s", "t", *K.PROGRESS_SCRATCH)).collect()]
    assert got == [0.675, 0.45, 1.0, 0.225]
    got = [round(r[0], 6) for r in df.select(tf.progress_pct("s", "t", *K.PROGRESS_FINETUNE)).collect()]
    assert got == [0.775, 0.6, 1.0, 0.425]


def test_display_role_and_stem(spark):
    df = spark.createDataFrame([("human",), ("ai",), ("x",)], "r string")
    assert [r[0] for r in df.select(tf.display_role("r")).collect()] == ["user", "ai", "ai"]
    assert one(spark, tf.file_stem, "a.json.json") == "a"
