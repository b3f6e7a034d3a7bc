"""File scans: mixed document files -> documents + quarantine.

The lower-cased extension routes each file (S6). Plain text is decoded JVM-side
(strict UTF-8 check, no Python); JSON and the zip+XML office formats go through one
Arrow-batched extractor that returns ``STRUCT<docs ARRAY<STRING>, error STRING>`` per
file, so a bad file becomes a quarantine row instead of failing the job (S7).

CSV and JSON lines are scanned as lines, so a huge file is many tasks. Per file an
aggregate over its lines tells whether lines can be read one by one: a CSV file if
no quoted cell goes on in the next line, a JSON-lines file if its first line is a whole
value or can't begin one. Their rows come from native expressions alone; the few other
files are put together again and go through the extractor.

Every file is read once: the lines and the extracted rows are written to the shared
folder and split into documents and quarantine from there. Files that are read whole
must not be larger than ``spark.sql.sources.binaryFile.maxLength`` or ``max_bytes``;
larger ones are quarantined by their listed size, unread.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from itertools import zip_longest
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks.functions import text as tf
from corpusworks.session import bound_batches, broadcast_if_small, stored

DOC_COLUMNS = ["source", "ext", "ordinal", "text"]
QUARANTINE_COLUMNS = ["source", "ext", "reason"]

EXTRACT_TYPE = T.StructType([
    T.StructField("docs", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


# ------------------------------------------------------------ extractors

def _decode(content: bytes) -> str:
    """Strict UTF-8 with Python's universal newlines (text-mode read)."""
    return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


def extract_csv(content: bytes) -> list[str]:
    """One document per row: 'column: value' lines in header order; a missing
    cell is empty, cells beyond the header share one line without a name."""
    rows = filter(None, csv.reader(io.StringIO(_decode(content), newline="")))
    names = [n.strip() for n in next(rows, [])]

    def document(cells: list[str]) -> str:
        cells = [c.strip() for c in cells]
        own, beyond = cells[:len(names)], cells[len(names):]
        named = [f"{n}: {c}" for n, c in zip_longest(names, own, fillvalue="")]
        return "\n".join(named + [",".join(beyond)] * bool(beyond))

    return list(map(document, rows))


def extract_json(content: bytes) -> list[str]:
    """List -> one doc per item (dict/list dumped with non-ASCII kept,
    scalars via str()); dict -> one doc; scalar -> none. If the file is not
    valid JSON, every stripped non-empty line is a doc, verbatim."""
    text = _decode(content)
    try:
        data = json.loads(text)
    except ValueError:
        return [s for s in (line.strip() for line in text.split("\n")) if s]
    if isinstance(data, list):
        return [json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x) for x in data]
    if isinstance(data, dict):
        return [json.dumps(data, ensure_ascii=False)]
    return []


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def extract_docx(content: bytes) -> list[str]:
    """Paragraphs of word/document.xml joined by newlines (one document)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paras = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for el in p.iter():
            if el.tag == f"{_W}t" and el.text:
                parts.append(el.text)
            elif el.tag == f"{_W}tab":
                parts.append("\t")
            elif el.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        paras.append("".join(parts))
    text = "\n".join(paras).strip()
    return [text] if text else []


def extract_xlsx(content: bytes) -> list[str]:
    """Every sheet's rows as tab-joined cell values, one document per file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            sroot = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            for si in sroot.iter(f"{_S}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_S}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)),
                        key=lambda n: int(re.findall(r"\d+", n)[-1]))
        lines = []
        for n in sheets:
            root = ElementTree.fromstring(z.read(n))
            for row in root.iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    if c.get("t") == "s" and v is not None:
                        cells.append(shared[int(v.text)])
                    elif c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                    elif v is not None and v.text is not None:
                        cells.append(v.text)
                if cells:
                    lines.append("\t".join(cells))
    text = "\n".join(lines)
    return [text] if text else []


# Extension -> extractor. Formats without a decoder here (.pdf, legacy
# .doc/.xls) go to quarantine unless the caller registers one.
DEFAULT_EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {
    ".csv": extract_csv,
    ".json": extract_json,
    ".jsonl": extract_json,
    ".docx": extract_docx,
    ".xlsx": extract_xlsx,
}

WHOLE_BYTES = 8 << 20       # JSON files up to this size are read whole, larger ones by lines

ACCEPTED = (".txt", ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".json", ".jsonl")


def extractor_udf(extractors: dict[str, Callable[[bytes], list[str]]]):
    table = dict(extractors)

    @F.pandas_udf(EXTRACT_TYPE)
    def _extract(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        docs, errs = [], []
        for e, b in zip(ext, content):
            fn = table.get(e)
            if fn is None:
                docs.append(None)
                errs.append(f"no extractor for '{e}'")
                continue
            try:
                docs.append(list(fn(bytes(b))))
                errs.append(None)
            except Exception as x:  # noqa: BLE001  (per-file isolation)
                docs.append(None)
                errs.append(f"{type(x).__name__}: {x}")
        return pd.DataFrame({"docs": docs, "error": errs})

    return _extract


# ------------------------------------------------------------ scans

def list_files(spark: SparkSession, paths: str | list[str], recursive: bool = True,
               glob: str | None = None) -> DataFrame:
    """binaryFile listing: path, modificationTime, length, content (lazy)."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(paths if isinstance(paths, list) else [paths])


def scan_documents(spark: SparkSession, paths: str | list[str],
                   extractors: dict[str, Callable[[bytes], list[str]]] | None = None,
                   recursive: bool = True, max_bytes: int | None = None,
                   line_formats: tuple[str, ...] = (".csv", ".jsonl")) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, quarantine). Files of ``line_formats`` (".csv", others hold JSON)
    without an extractor of the caller's are scanned by lines, and so are ".json" files above WHOLE_BYTES.

    documents: source, ext, ordinal, text - one row per document.
    quarantine: source, ext, reason - unsupported formats, files that are too large to be
    read whole, and failed files.
    """
    bound_batches(spark)
    most = max_bytes or int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    by_line = [e for e in line_formats if e not in (extractors or {})]
    large = [e for e in (".json",) if e not in [*by_line, *(extractors or {})]]
    # conditions on _metadata choose files before any is opened; those on columns would read contents first
    ext, size = tf.file_ext(F.col("_metadata.file_name")), F.col("_metadata.file_size")
    files = list_files(spark, paths, recursive).where(~ext.isin(by_line) & (~ext.isin(large) | (size <= WHOLE_BYTES)))
    docs, bad = split_documents(files.where(size <= most), extractors)
    too_large = files.where(F.col("length") > most).select(
        F.col("path").alias("source"), tf.file_ext("path").alias("ext"),
        F.concat(F.lit("too large to be read whole: "), F.col("length").cast("string"), F.lit(" bytes")).alias("reason"))
    rows = _outcome(docs, bad.unionByName(too_large))
    if by_line or large:
        lines = stored(scan_lines(spark, paths, by_line + large, recursive, dict.fromkeys(large, WHOLE_BYTES)), "file-lines")
        rows = rows.unionByName(_outcome(*documents_of_lines(lines, extractors, most)))
    rows = stored(rows, "file-rows")
    return (rows.where("reason IS NULL").select(*DOC_COLUMNS),
            rows.where("reason IS NOT NULL").select(*QUARANTINE_COLUMNS))


def _outcome(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents and quarantine as one table."""
    text = docs.select("source", "ext", F.col("ordinal").cast("long").alias("ordinal"), "text",
                       F.lit(None).cast("string").alias("reason"))
    return text.unionByName(bad.select("source", "ext", F.lit(None).cast("long").alias("ordinal"),
                                       F.lit(None).cast("string").alias("text"), "reason"))


# ------------------------------------------------------------ files by lines

# a CSV cell: quoted (doubled quotes inside, anything up to the comma behind), or bare
_CELL = r'"[^"]*+(?:""[^"]*+)*+"(?!")[^,]*|[^",][^,]*|'


def _numbered(batches):
    """Adds ``place``: how many filled lines of the same stretch of a file come before."""
    last, carry = None, 0
    for b in batches:
        stretch, filled = b.column("stretch").to_numpy(), b.column("filled").to_numpy(zero_copy_only=False)
        upto = np.cumsum(filled)
        starts = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]]) if len(b) else np.zeros(0, np.int64)
        before = np.append(0, upto)[starts]
        if len(b):
            begun = carry if last == stretch[0] else 0
            before[0] -= begun
            place = upto - filled - np.repeat(before, np.diff(np.append(starts, len(b))))
            last, carry = stretch[-1], int(place[-1] + filled[-1])
            yield b.append_column("place", pa.array(place.astype(np.int64)))


def scan_lines(spark: SparkSession, paths: str | list[str], extensions: list[str], recursive: bool = True,
               larger_than: dict[str, int] | None = None) -> DataFrame:
    """Lines of the files with these extensions, of some only files above a size (``larger_than``): source, ext, block (where the file's stretch
    begins), id (order in the stretch), place (among its filled lines), filled, value."""
    globs = ["*." + "".join(f"[{c.lower()}{c.upper()}]" for c in e[1:]) for e in extensions]
    r = spark.read.option("pathGlobFilter", "{" + ",".join(globs) + "}")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))     # a URI there, a path in listings
    source = F.regexp_replace(path, "^file:/{2,3}", "file:/")
    rows = r.text(paths if isinstance(paths, list) else [paths])
    for ext, size in (larger_than or {}).items():
        rows = rows.where((F.col("_metadata.file_size") > size) | (tf.file_ext(F.col("_metadata.file_name")) != ext))
    rows = rows.select(
        source.alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    filled = F.when(tf.file_ext("source") == ".csv", F.length("value") > 0).otherwise(F.length(tf.strip("value")) > 0)
    rows = rows.select("source", tf.file_ext("source").alias("ext"), "block", "id", F.xxhash64("source", "block").alias("stretch"),
                       filled.alias("filled"), F.is_valid_utf8("value").alias("valid"), F.encode("value", "UTF-8").alias("raw"))
    types = "source string, ext string, block long, id long, stretch long, filled boolean, valid boolean, raw binary"
    return rows.mapInArrow(_numbered, types + ", place long").select(
        "source", "ext", "block", "id", "place", "filled", "valid", F.col("raw").cast("string").alias("value"))


@F.pandas_udf(T.BooleanType())
def _whole_value(line: pd.Series) -> pd.Series:
    def whole(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False
    return line.map(whole)


def documents_of_lines(lines: DataFrame, extractors: dict[str, Callable[[bytes], list[str]]] | None = None,
                       max_bytes: int = 1 << 31) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of scanned lines (a written table)."""
    closed = (F.col("ext") != ".csv") | F.col("value").rlike(f"^(?:{_CELL})(?:,(?:{_CELL}))*$")
    told = lines.select("source", "ext", "valid", "filled", F.when(F.col("filled"), F.struct("block", "id")).alias("at"),
                        closed.alias("closed"), (F.octet_length("value") + 1).alias("size"))
    per_file = stored(told.groupBy("source", "ext").agg(
        F.bool_and("valid").alias("valid"), F.count_if("filled").alias("n"), F.min("at").alias("head"),
        F.bool_and("closed").alias("closed"), F.sum("size").alias("size")), "file-facts")
    # first filled lines: names of CSV columns, or what tells how JSON goes on
    heads = broadcast_if_small(per_file.where("valid AND n > 0").select("source", "head.block", "head.id"))
    firsts = stored(lines.where("filled").select("source", "block", "id", F.col("value").alias("first"))
                    .join(heads, ["source", "block", "id"]).select("source", "first"), "file-heads")
    # rows of a file one by one: no cell goes on; the first JSON value ends where more follow, or none can begin
    head = tf.strip("first")
    apart = F.when(F.col("ext") == ".csv", F.col("closed")).otherwise(
        (F.col("n") >= 2) & (~head.rlike("^[\\[{]") | _whole_value(F.coalesce(head, F.lit("")))))
    facts = stored(per_file.where("valid").join(firsts, "source", "left").select(
        "source", "ext", "n", "head", "size", apart.alias("apart")), "file-kinds")
    counts = lines.groupBy("source", "block").agg(F.count_if("filled").alias("filled_here"))
    before = F.sum("filled_here").over(Window.partitionBy("source").orderBy("block")
                                       .rowsBetween(Window.unboundedPreceding, -1))       # a row per block of a file
    offsets = stored(counts.join(facts.where("apart").select("source", "head"), "source").select(
        "source", "block", "head", F.coalesce(before, F.lit(0)).alias("offset")), "file-offsets")
    # small tables of files and blocks travel to the lines, which stay where they were written
    rows = (lines.where("filled").join(broadcast_if_small(offsets), ["source", "block"])
            .withColumn("at", F.col("offset") + F.col("place")))
    json_rows = rows.where("ext <> '.csv'").select("source", "ext", F.col("at").alias("ordinal"), tf.strip("value").alias("text"))
    names = broadcast_if_small(firsts.join(facts.where("apart AND ext = '.csv'").select("source"), "source", "left_semi"))
    csv_rows = rows.where(F.col("ext") == ".csv").where(F.struct("block", "id") != F.col("head")).join(names, "source").select(
        "source", "ext", (F.col("at") - 1).alias("ordinal"), _csv_document(_cells("first"), _cells("value")).alias("text"))
    whole = facts.where("NOT apart AND n > 0")
    put_together = broadcast_if_small(whole.where(F.col("size") <= max_bytes).select("source"))
    texts = (lines.join(put_together, "source", "left_semi").groupBy("source", "ext")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "value"))),
                                           lambda x: x["value"]), "\n").alias("text")))   # max_bytes at most, like a file read whole
    table = dict(DEFAULT_EXTRACTORS)
    table.update(extractors or {})
    got = stored(texts.select("source", "ext", extractor_udf(table)("ext", F.encode("text", "UTF-8")).alias("_r")), "file-whole")
    docs = json_rows.unionByName(csv_rows).unionByName(
        got.where("_r.error IS NULL").select("source", "ext", F.posexplode("_r.docs").alias("ordinal", "text")))
    bad = per_file.where("NOT valid").select("source", "ext", F.lit("UnicodeDecodeError: invalid utf-8").alias("reason")).unionByName(
        whole.where(F.col("size") > max_bytes).select("source", "ext", F.lit("too large to be read whole").alias("reason"))).unionByName(
        got.where("_r.error IS NOT NULL").select("source", "ext", F.col("_r.error").alias("reason")))
    return docs, bad


def _cells(line: str) -> F.Column:
    """The stripped cells of a CSV line."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(f",({_CELL})"), 1)

    def plain(cell):
        inner = F.regexp_extract(cell, r'^"([^"]*+(?:""[^"]*+)*+)"', 1)
        quoted = F.concat(F.replace(inner, F.lit('""'), F.lit('"')), F.substr(cell, F.length(inner) + 3))
        return tf.strip(F.when(cell.startswith('"'), quoted).otherwise(cell))

    return F.transform(found, plain)


def _csv_document(names: F.Column, cells: F.Column) -> F.Column:
    own = F.transform(names, lambda n, i: F.concat(n, F.lit(": "), F.coalesce(F.get(cells, i), F.lit(""))))
    beyond = F.slice(cells, F.size(names) + 1, F.size(cells))
    return F.concat_ws("\n", own, F.when(F.size(cells) > F.size(names), F.concat_ws(",", beyond)))


def stream_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 glob: str | None = None) -> DataFrame:
    """T2 source: new files arriving under ``path`` as a streaming binaryFile
    DataFrame (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    r = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def split_documents(files: DataFrame, extractors: dict[str, Callable[[bytes], list[str]]] | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """S1-S7 over any (batch or streaming) binaryFile DataFrame."""
    table = dict(DEFAULT_EXTRACTORS)
    table.update(extractors or {})
    files = files.select(F.col("path").alias("source"), tf.file_ext("path").alias("ext"), "content")

    # Text decoded JVM-side; invalid UTF-8 goes to quarantine
    txt = files.filter(F.col("ext") == ".txt").select(
        "source", "ext", F.col("content").cast("string").alias("_s"))
    txt_ok = txt.filter(F.is_valid_utf8("_s")).select(
        "source", "ext", F.lit(0).alias("ordinal"),
        F.regexp_replace("_s", "\r\n?", "\n").alias("text"))
    txt_bad = txt.filter(~F.is_valid_utf8("_s")).select(
        "source", "ext", F.lit("UnicodeDecodeError: invalid utf-8").alias("reason"))

    # everything else accepted goes through the extractor (one pass, two filters)
    other = files.filter(F.col("ext").isin([e for e in ACCEPTED if e != ".txt"]) |
                         F.col("ext").isin([e for e in table if e != ".txt"]))
    ext_udf = extractor_udf(table)
    got = other.select("source", "ext", ext_udf("ext", "content").alias("_r"))
    ok = got.filter(F.col("_r.error").isNull()).select(
        "source", "ext", F.posexplode("_r.docs").alias("ordinal", "text"))
    bad = got.filter(F.col("_r.error").isNotNull()).select("source", "ext", F.col("_r.error").alias("reason"))

    unsupported = files.filter(~F.col("ext").isin(list(set(ACCEPTED) | set(table)))).select(
        "source", "ext", F.lit("unsupported format").alias("reason"))

    docs = txt_ok.unionByName(ok.select("source", "ext", F.col("ordinal").cast("int"), "text"))
    quarantine = txt_bad.unionByName(bad).unionByName(unsupported)
    return docs, quarantine


def rows_as_documents(df: DataFrame, columns: list[str], keep: list[str] | None = None,
                      text_col: str = "text") -> DataFrame:
    """S2 over a table: each row becomes 'column: value' lines in column order
    (NULL renders as empty)."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(*(keep or []), F.concat_ws("\n", *lines).alias(text_col))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Number of files, total size, newest modification time, F4 size.

    Only ``length`` and ``modificationTime`` are selected, so the binaryFile
    scan never reads file contents.
    """
    files = list_files(spark, path, recursive=True).select("length", "modificationTime")
    return files.agg(F.count(F.lit(1)).alias("files"),
                     F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("size_bytes"),
                     F.max("modificationTime").alias("modified")).withColumn(
        "size", tf.format_size("size_bytes"))


def ingest_report(docs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """S8 for a scan: per source documents and characters, plus failures."""
    d = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"),
                                   F.sum(F.length("text")).cast("long").alias("chars"))
    q = quarantine.groupBy("source").agg(F.first("reason").alias("reason"))
    return d.join(q, "source", "full")


def ingest_totals(docs: DataFrame, quarantine: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """S8 totals of a scan: files read, documents, characters, fixed-stride
    chunks (C2 count, no explode) and failed files - one row."""
    from corpusworks.operators.chunk import stride_chunk_count
    ok = docs.select("source", F.lit(1).alias("_doc"), F.length("text").cast("long").alias("_len"),
                     stride_chunk_count("text", size, overlap).alias("_ch"), F.lit(None).cast("string").alias("_bad"))
    bad = quarantine.select("source", F.lit(0).alias("_doc"), F.lit(0).cast("long").alias("_len"),
                            F.lit(0).cast("long").alias("_ch"), F.col("source").alias("_bad"))
    u = ok.unionByName(bad)   # one aggregate over both, no join
    return u.agg(F.countDistinct(F.when(F.col("_doc") == 1, F.col("source"))).alias("files"),
                 F.coalesce(F.sum("_doc"), F.lit(0)).cast("long").alias("documents"),
                 F.coalesce(F.sum("_len"), F.lit(0)).cast("long").alias("characters"),
                 F.coalesce(F.sum("_ch"), F.lit(0)).cast("long").alias("chunks"),
                 F.countDistinct("_bad").alias("failed_files"))


def require_documents(totals: DataFrame) -> dict:
    """S8 gate: reading no document at all is an error (one-row report)."""
    row = totals.first().asDict()
    if not row["documents"]:
        raise ValueError("no text could be read from the given files")
    return row
