"""File scans: JSON forms, mixed formats with quarantine, zip+XML formats, inventory."""

import io
import json
import os
import zipfile

from corpusworks.sources import files as fs


def put(d, name, data):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode("utf-8"))
    return p


def test_json_forms():
    j = lambda x: json.dumps(x).encode()
    assert fs.extract_json(j([{"a": "ç"}, {"b": 1}])) == ['{"a": "ç"}', '{"b": 1}']
    assert fs.extract_json(j([True, None, 1.0, "x"])) == ["True", "None", "1.0", "x"]
    assert fs.extract_json(j({"k": [1, 2]})) == ['{"k": [1, 2]}']
    assert fs.extract_json(b"3") == []
    assert fs.extract_json(b'{"a": 1}\n{"b": 2}\n') == ['{"a": 1}', '{"b": 2}']
    assert fs.extract_json(b'\n  {"a": 1  \n\nbroken{\n') == ['{"a": 1', "broken{"]
    assert fs.extract_json(b"") == []


def docx_bytes(paras):
    body = "".join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' for p in paras)
    xml = ('<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
           f"<w:body>{body}</w:body></w:document>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def xlsx_bytes():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f'<sst {ns}><si><t>name</t></si><si><t>ada</t></si></sst>'
    sheet = (f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>1</v></c></row>'
             f'<row><c t="s"><v>1</v></c><c><v>2.5</v></c></row></sheetData></worksheet>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()


def test_mixed_files_with_quarantine(spark, tmp_dir):
    put(tmp_dir, "a/Notes.TXT", "line1\r\nline2\rline3")
    put(tmp_dir, "b/x.txt", "same name, other folder")
    put(tmp_dir, "data.csv", 'name,bio\nada,"multi\nline"\nbob,plain\n')
    put(tmp_dir, "weird.xyz", "?")
    put(tmp_dir, "README", "no extension")
    put(tmp_dir, ".hidden", "dot files are never listed by Spark file sources")
    put(tmp_dir, "bad.txt", b"\xff\xfe\xfa not utf8")
    put(tmp_dir, "broken.docx", b"not a zip")
    put(tmp_dir, "ok.docx", docx_bytes(["Başlık", "İkinci paragraf"]))
    put(tmp_dir, "sheet.xlsx", xlsx_bytes())
    put(tmp_dir, "rows.jsonl", '{"a": 1}\n\n{"b": 2}\n')
    put(tmp_dir, "scan.pdf", b"%PDF-1.4")
    docs, quarantine = fs.scan_documents(spark, tmp_dir)
    d = {}
    for r in docs.collect():
        d.setdefault(os.path.basename(r["source"]), []).append((r["ordinal"], r["text"]))
    assert d["Notes.TXT"] == [(0, "line1\nline2\nline3")]
    assert sorted(d["data.csv"]) == [(0, "name: ada\nbio: multi\nline"), (1, "name: bob\nbio: plain")]
    assert d["ok.docx"] == [(0, "Başlık\nİkinci paragraf")]
    assert d["sheet.xlsx"] == [(0, "name\t1\nada\t2.5")]
    assert sorted(d["rows.jsonl"]) == [(0, '{"a": 1}'), (1, '{"b": 2}')]
    assert "x.txt" in d
    q = {os.path.basename(r["source"]): r["reason"] for r in quarantine.collect()}
    assert set(q) == {"weird.xyz", "README", "bad.txt", "broken.docx", "scan.pdf"}
    assert "unsupported" in q["weird.xyz"] and "utf-8" in q["bad.txt"].lower()
    rep = {os.path.basename(r["source"]): r for r in fs.ingest_report(docs, quarantine).collect()}
    assert rep["data.csv"]["documents"] == 2 and rep["bad.txt"]["reason"]


def test_inventory(spark, tmp_dir):
    put(tmp_dir, "k/a.bin", b"x" * 1000)
    put(tmp_dir, "k/sub/b.bin", b"y" * 2048)
    r = fs.file_inventory(spark, os.path.join(tmp_dir, "k")).first()
    assert (r["files"], r["size_bytes"], r["size"]) == (2, 3048, "3.0 KB")


def test_streaming_file_ingest(spark, tmp_dir):
    """T2 with real files: new files -> documents -> knowledge base, once-only."""
    from corpusworks.operators.kbstore import KnowledgeBaseStore
    from corpusworks.session import scratch_dir
    from corpusworks.streaming.ingest import ingest_stream
    inbox = os.path.join(tmp_dir, "inbox")
    put(inbox, "one.txt", "first document " * 100)
    put(inbox, "two.json", json.dumps([{"q": "a"}, {"q": "b"}]))
    put(inbox, "bad.txt", b"\xff\xfe")
    docs, quarantine = fs.split_documents(fs.stream_files(spark, inbox, max_files_per_trigger=1))
    store = KnowledgeBaseStore(spark, os.path.join(tmp_dir, "store"))
    ck = scratch_dir(spark, "t2-files")
    ingest_stream(docs, store, "inbox", ck, create_missing=True)
    got = {r["filename"]: r["chunk_count"] for r in store.list_documents("inbox").collect()}
    assert got["two.json"] == 2 and got["one.txt"] >= 2 and "bad.txt" not in got
    ingest_stream(docs, store, "inbox", ck)  # restart: nothing new, nothing doubled
    again = {r["filename"]: r["chunk_count"] for r in store.list_documents("inbox").collect()}
    assert again == got


def test_ingest_totals_and_gate(spark, tmp_dir):
    import pytest
    put(tmp_dir, "a.txt", "x" * 1001)
    put(tmp_dir, "b.json", json.dumps([1, 2]))
    put(tmp_dir, "c.xyz", "?")
    docs, quarantine = fs.scan_documents(spark, tmp_dir)
    row = fs.require_documents(fs.ingest_totals(docs, quarantine))
    assert (row["files"], row["documents"], row["characters"], row["chunks"], row["failed_files"]) == (2, 3, 1003, 4, 1)
    empty = os.path.join(tmp_dir, "only_bad")
    put(empty, "z.xyz", "?")
    d2, q2 = fs.scan_documents(spark, empty)
    with pytest.raises(ValueError):
        fs.require_documents(fs.ingest_totals(d2, q2))


def test_csv_missing_and_surplus_cells():
    got = fs.extract_csv(b"a, b\n1\n2,3,4,5\n\n x , y \n")
    assert got == ["a: 1\nb: ", "a: 2\nb: 3\n4,5", "a: x\nb: y"]
    assert fs.extract_csv(b"") == []


CSVS = {"plain.csv": "a, b\n1\n2,3,4,5\n\n x , y \n", "Quoted.CSV": 'name,bio\r\n"ada, ""the"" first",x\r\n"bob"by,"" \r\n',
        "lines.csv": 'name,bio\n"multi\nline",x\nlast,"two\n\nmore"\n', "open.csv": 'a,b\nx"y,"z\nw",q\n', "empty.csv": "",
        "head.csv": "only,header\n", "blank.csv": "\n\na\n \n1\n", "literal.csv": 'a"b,c\nd"e"f,"g""h"\n'}
JSONS = {"rows.jsonl": '{"a": 1}\n\n  {"b": 2} \n', "one.jsonl": '[{"a": "ç"}, 3]\n', "pretty.jsonl": '[\n {"a": 1},\n 2\n]\n',
         "broken.jsonl": '{"a": 1\nbroken{\n', "words.jsonl": "hello\n[1, 2\n", "list.jsonl": "[1]\n[2]\n", "none.jsonl": "\n \n",
         "scalar.jsonl": "3\n"}


def test_files_by_lines_equal_whole_files(spark, tmp_dir):
    """Whatever the split: small splits cut every file; results equal the whole-file extractors."""
    for name, text in {**CSVS, **JSONS, "more rows/big one.jsonl": "".join('{"n": %d}\n' % i for i in range(4000)),
                       "big.csv": "n,m\n" + "".join(f'{i},"x, {i}"\n' for i in range(4000))}.items():
        put(tmp_dir, name, text)
    put(tmp_dir, "bad.csv", b"a,b\n\xff\xfe,1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = fs.scan_lines(spark, tmp_dir, [".csv", ".jsonl"])
        assert lines.where("source LIKE '%big.csv'").select("block").distinct().count() > 3
        docs, quarantine = fs.scan_documents(spark, tmp_dir)
        got = {}
        for r in docs.collect():
            got.setdefault(r["source"], []).append((r["ordinal"], r["text"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    listed = {r["path"]: bytes(r["content"]) for r in fs.list_files(spark, tmp_dir).collect()}
    assert len(listed) == len(CSVS) + len(JSONS) + 2                       # files of no byte are not listed
    for path, content in listed.items():
        if not path.endswith("bad.csv"):
            extract = fs.extract_csv if path.lower().endswith(".csv") else fs.extract_json
            assert sorted(got.get(path, [])) == list(enumerate(extract(content))), path
    assert {r["source"].rsplit("/", 1)[1]: r["reason"] for r in quarantine.collect()} == {
        "bad.csv": "UnicodeDecodeError: invalid utf-8"}


def test_each_file_is_read_once_and_large_ones_are_quarantined(spark, tmp_dir):
    put(tmp_dir, "a.txt", "short")
    put(tmp_dir, "b.json", "[1, 2]")
    put(tmp_dir, "big.txt", "x" * 5000)
    put(tmp_dir, "big.json", '["' + "x" * 5000 + '"]')
    put(tmp_dir, "rows.csv", "n\n" + "1\n" * 4000)
    put(tmp_dir, "pretty.jsonl", "[\n" + "1,\n" * 4000 + "1]")
    docs, quarantine = fs.scan_documents(spark, tmp_dir, max_bytes=4000)
    count = {r["source"].rsplit("/", 1)[1]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert count == {"a.txt": 1, "b.json": 2, "rows.csv": 4000}
    reasons = {r["source"].rsplit("/", 1)[1]: r["reason"] for r in quarantine.collect()}
    assert set(reasons) == {"big.txt", "big.json", "pretty.jsonl"} and all("too large" in x for x in reasons.values())
    for result in (docs, quarantine):                      # both come from the written rows, no file is read again
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "FileScan text" not in plan and "FileScan parquet" in plan
