"""Knowledge-base store (K1-K4, A8, S9, V2) on a shared Parquet folder.

Layout under ``root``:
  chunks/kb=<name>/ingest_seq=<n>/part-*.parquet   chunk rows (+ embedding)
  log/kb=<name>/part-*.parquet                     action, name, seq, ts

Every change is an append: create/append write a new ``ingest_seq``
partition, deletes and drops are log rows (tombstones). Reads filter on the
``kb`` partition column (partition pruning), hide chunks ingested before the
last drop, and apply document tombstones with anti joins. ``compact`` writes
the visible rows to a new folder; nothing is overwritten while being read.
An input without any text fails and leaves no base and no log row behind.
``retrieve`` searches a base's stored vectors: a scan of its partitions alone, of
ids and vectors, meets the questions; texts are read for the chunks found.
Single writer per store is assumed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from corpusworks import constants as K
from corpusworks.functions.text import basename
from corpusworks.operators import chunk as ch
from corpusworks.operators import embed as em
from corpusworks.operators import knowledge as kn
from corpusworks.operators.knn import knn_topk
from corpusworks.session import stored
from corpusworks.sources.files import file_inventory

LOG_SCHEMA = "kb string, action string, name string, seq long, ts timestamp"


class KnowledgeBaseStore:
    def __init__(self, spark: SparkSession, root: str, embed_dim: int = em.DEFAULT_DIM):
        self.spark = spark
        self.root = root.rstrip("/")
        self.embed_dim = embed_dim

    # ------------------------------------------------------------ log
    @property
    def chunk_path(self) -> str:
        return f"{self.root}/chunks"

    @property
    def log_path(self) -> str:
        return f"{self.root}/log"

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        except AnalysisException:
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def _append_log(self, kb: str, action: str, name: str | None, seq: int) -> None:
        row = [(kb, action, name, int(seq), datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))]
        self._write_log(self.spark.createDataFrame(row, LOG_SCHEMA).coalesce(1))

    def _write_log(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("kb").parquet(self.log_path)

    def _next_seq(self) -> int:
        m = self.log().agg(F.max("seq")).first()[0]
        return (m or 0) + 1

    def _state(self, kb: str):
        """(exists, last drop seq) from the log (a handful of rows per kb)."""
        rows = (self.log().filter((F.col("kb") == kb) & F.col("action").isin("create", "drop"))
                .orderBy(F.desc("seq")).select("action", "seq").collect())
        last_drop = max((r["seq"] for r in rows if r["action"] == "drop"), default=0)
        return bool(rows) and rows[0]["action"] == "create", last_drop

    def exists(self, kb: str) -> bool:
        return self._state(kb)[0]

    # ------------------------------------------------------------ writes
    def _prepare(self, docs: DataFrame, kb: str, seq: int, size: int, overlap: int, recursive: bool,
                 source_col: str, text_col: str, id_col: str | None) -> DataFrame:
        d = docs.select(F.col(source_col).alias("source"),
                        (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
        chunks = (ch.recursive_chunks(d, "text", size, overlap) if recursive
                  else ch.fixed_stride_chunks(d, "text", size, overlap))
        chunks = chunks.select(F.lit(kb).alias("kb"), F.lit(seq).cast("long").alias("ingest_seq"), "source",
                               basename("source", None).alias("basename"), "doc_id", "chunk_no", "text")
        chunks = chunks.withColumn("chunk_id", ch.chunk_id("kb", "source", "ingest_seq", "doc_id", "chunk_no", "text"))
        return em.embed_hashed(chunks, "text", self.embed_dim)

    def create_many(self, docs: DataFrame, kb_col: str, size: int = K.CHUNK_SIZE,
                    overlap: int = K.CHUNK_OVERLAP, recursive: bool = True, source_col: str = "source",
                    text_col: str = "text", id_col: str | None = None) -> DataFrame:
        """K1 for one base per value of ``kb_col``, written in a single job
        (partitioned by kb). Fails if any of them exists. Returns the names (kb)."""
        ch.check_chunk_args(size, overlap)
        names = docs.select(F.col(kb_col).cast("string").alias("kb")).where(F.col("kb").isNotNull()).distinct()
        clash = [r["kb"] for r in names.join(self.list_bases(), "kb", "left_semi").limit(10).collect()]
        if clash:
            raise ValueError(f"knowledge bases already exist: {clash}")
        seq = self._next_seq()
        d = docs.where(F.col(kb_col).isNotNull()).select(
            F.col(kb_col).cast("string").alias("_kb"), F.col(source_col).alias("source"),
            (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        chunks = (ch.recursive_chunks(d, "text", size, overlap) if recursive
                  else ch.fixed_stride_chunks(d, "text", size, overlap))
        chunks = chunks.select(F.col("_kb").alias("kb"), F.lit(seq).cast("long").alias("ingest_seq"), "source",
                               basename("source", None).alias("basename"), "doc_id", "chunk_no", "text")
        chunks = chunks.withColumn("chunk_id", ch.chunk_id("kb", "source", "ingest_seq", "doc_id", "chunk_no", "text"))
        self._write(em.embed_hashed(chunks, "text", self.embed_dim))
        written = self._all(["kb", "ingest_seq"])
        if written is None:
            raise ValueError("no text in any of the documents")
        made = written.where(F.col("ingest_seq") == seq).select("kb").distinct()      # bases without text don't come to be
        self._write_log(made.select("kb", F.lit("create").alias("action"), F.lit(None).cast("string").alias("name"),
                                    F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("ts")))
        return self.log().where((F.col("seq") == seq) & (F.col("action") == "create")).select("kb")

    def _write(self, chunks: DataFrame) -> None:
        chunks.write.mode("append").partitionBy("kb", "ingest_seq").parquet(self.chunk_path)

    def create(self, kb: str, docs: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
               recursive: bool = True, source_col: str = "source", text_col: str = "text",
               id_col: str | None = None) -> dict:
        """K1: fails if the base exists or no document holds text; chunk -> embed -> persist."""
        ch.check_chunk_args(size, overlap)
        if self.exists(kb):
            raise ValueError(f"knowledge base '{kb}' already exists")
        seq = self._next_seq()
        chunks = self._prepare(docs, kb, seq, size, overlap, recursive, source_col, text_col, id_col)
        self._write(chunks)
        report = self._required(self._batch_report(kb, seq))
        self._append_log(kb, "create", None, seq)
        return report

    def append(self, kb: str, docs: DataFrame, source_col: str = "source", text_col: str = "text",
               id_col: str | None = None, seq: int | None = None) -> dict:
        """K2: fails if the base is missing or no document holds text; always 1000/200
        recursive chunking; no de-duplication (re-adding a file doubles its chunks)."""
        if not self.exists(kb):
            raise ValueError(f"knowledge base '{kb}' not found")
        seq = seq if seq is not None else self._next_seq()
        chunks = self._prepare(docs, kb, seq, K.CHUNK_SIZE, K.CHUNK_OVERLAP, True, source_col, text_col, id_col)
        self._write(chunks)
        report = self._required(self._batch_report(kb, seq))
        self._append_log(kb, "append", None, seq)
        return report

    @staticmethod
    def _required(report: dict) -> dict:
        """The ingest gate: reading no text at all is an error."""
        if not report["chunks"]:
            raise ValueError("no text in any of the documents")
        return report

    def _batch_report(self, kb: str, seq: int) -> dict:
        r = (self._raw(kb).filter(F.col("ingest_seq") == seq)
             .agg(F.countDistinct("source").alias("documents"), F.count(F.lit(1)).alias("chunks")).first())
        return {"kb": kb, "ingest_seq": seq, "documents": r["documents"], "chunks": r["chunks"]}

    def delete_document(self, kb: str, name: str) -> tuple[bool, str]:
        """K3: hide chunks whose basename(source) or source equals ``name``."""
        exists, _ = self._state(kb)
        if not exists:
            return False, "knowledge base not found"
        vis = self.chunks(kb, columns=["source", "basename"])
        n = vis.filter((F.col("basename") == name) | (F.col("source") == name)).count()
        if n == 0:
            return False, "no matching document"
        self._append_log(kb, "delete", name, self._next_seq() - 1)
        return True, f"'{name}': {n} chunks removed"

    def drop(self, kb: str) -> bool:
        """K4: True if the base existed."""
        if not self.exists(kb):
            return False
        self._append_log(kb, "drop", None, self._next_seq())
        return True

    # ------------------------------------------------------------ reads
    def _all(self, columns: list[str] | None = None) -> DataFrame | None:
        """The chunk files of all bases; None before the first one is written."""
        try:
            found = self.spark.read.parquet(self.chunk_path).schema
        except AnalysisException:
            return None
        # base names are strings, whatever they look like ("007" is not "7")
        typed = StructType([StructField("kb", StringType()) if f.name == "kb" else f for f in found.fields])
        df = self.spark.read.schema(typed).parquet(self.chunk_path)
        return df.select(*columns) if columns else df

    def _raw(self, kb: str, columns: list[str] | None = None) -> DataFrame:
        df = self._all(columns and ["kb", "ingest_seq"] + [c for c in columns if c not in ("kb", "ingest_seq")])
        if df is None:
            return self.spark.createDataFrame([], "kb string, ingest_seq long, source string, basename string")
        return df.filter(F.col("kb") == kb)

    def chunks(self, kb: str, columns: list[str] | None = None) -> DataFrame:
        """Visible chunks of a base (V2 read); ``columns`` prunes the scan."""
        exists, last_drop = self._state(kb)
        need = list(dict.fromkeys((columns or []) + ["source"])) if columns else None
        df = self._raw(kb, need).filter(F.col("ingest_seq") > last_drop)
        if not exists:
            return df.limit(0)
        tomb = (self.log().filter((F.col("kb") == kb) & (F.col("action") == "delete"))
                .select("kb", "name", "seq"))
        return kn.apply_tombstones(df, tomb)

    def retrieve(self, questions: DataFrame, kb: str, k: int = K.TOP_K, query_id: str = "query_id",
                 question: str = "question", metric: str = "cosine", vectors: str | None = None) -> DataFrame:
        """The k visible chunks of a base nearest to each question: query_id, rank, dist, chunk_id,
        source, basename, doc_id, text. ``vectors`` names a column with the questions' own
        embeddings; without it the base's embedder makes them. Ties go to the smaller chunk id."""
        if not self.exists(kb):
            raise ValueError(f"knowledge base '{kb}' not found")
        asked = questions.select(F.col(query_id).alias("query_id"), F.col(vectors or question).alias("asked"))
        asked = asked.withColumnRenamed("asked", "embedding") if vectors else em.embed_hashed(asked, "asked", self.embed_dim)
        found = stored(knn_topk(asked.select("query_id", "embedding"), self.chunks(kb, columns=["chunk_id", "embedding"]), k,
                                corpus_id="chunk_id", metric=metric).withColumnRenamed("vec_id", "chunk_id"), "retrieved")
        texts = (self.chunks(kb, columns=["chunk_id", "basename", "doc_id", "text"])
                 .join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
                 .select("chunk_id", "source", "basename", "doc_id", "text").dropDuplicates(["chunk_id"]))
        return found.join(texts, "chunk_id").select(F.col("query_id").alias(query_id), "rank", "dist", "chunk_id", "source",
                                                    "basename", "doc_id", "text")

    def list_documents(self, kb: str) -> DataFrame:
        """A1 over the base: filename, chunk_count (vectors never read)."""
        return kn.list_documents(self.chunks(kb, columns=["source"]))

    def list_bases(self) -> DataFrame:
        """Bases whose latest create/drop event is a create."""
        ev = self.log().filter(F.col("action").isin("create", "drop"))
        last = ev.groupBy("kb").agg(F.max_by("action", "seq").alias("last"))
        return last.filter(F.col("last") == "create").select("kb").orderBy("kb")

    def info(self, kb: str) -> DataFrame:
        """Files, size and newest modification under the base's folder."""
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(kb)
        return file_inventory(self.spark, f"{self.chunk_path}/kb={escaped}").select(
            F.lit(kb).alias("name"), F.lit("RAG").alias("type"), "files", "size_bytes", "size", "modified")

    def compact(self, kb: str, new_root: str) -> "KnowledgeBaseStore":
        """Rewrite the visible rows of ``kb`` into a new store folder."""
        other = KnowledgeBaseStore(self.spark, new_root, self.embed_dim)
        vis = self.chunks(kb)
        other._write(vis.select(*[c for c in vis.columns]))
        other._append_log(kb, "create", None, self._next_seq())
        return other
