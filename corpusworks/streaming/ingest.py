"""Incremental ingest of new documents into a knowledge base.

Each micro-batch is chunked, embedded and appended with its own
``ingest_seq``; the batch's partition is written with dynamic partition
overwrite, so a micro-batch re-run after a failure replaces its own output
instead of duplicating it (with the checkpoint: effectively once-only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators.kbstore import KnowledgeBaseStore


def _batch_seq(store: KnowledgeBaseStore, kb: str, checkpoint: str, batch_id: int) -> int:
    """The sequence number of a micro-batch: drawn from the store's log when the
    batch is first seen, found there again when it is replayed. No other writer
    gets the same number, and it is above every earlier drop or delete."""
    name = f"{checkpoint}#{batch_id}"
    got = (store.log().filter((F.col("kb") == kb) & (F.col("action") == "stream") & (F.col("name") == name))
           .select("seq").first())
    if got:
        return int(got["seq"])
    seq = store._next_seq()
    store._append_log(kb, "stream", name, seq)
    return seq


def ingest_stream(docs: DataFrame, store: KnowledgeBaseStore, kb: str, checkpoint: str,
                  source_col: str = "source", text_col: str = "text", id_col: str | None = None,
                  recursive: bool = True, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                  available_now: bool = True, create_missing: bool = False):
    """Start (and with ``available_now`` finish) the ingest stream. Fails if the base is
    missing, unless ``create_missing``: then an empty one comes to be first."""
    if not store.exists(kb):
        if not create_missing:
            raise ValueError(f"knowledge base '{kb}' not found")
        store._append_log(kb, "create", None, store._next_seq())

    def sink(batch: DataFrame, batch_id: int) -> None:
        seq = _batch_seq(store, kb, checkpoint, batch_id)
        chunks = store._prepare(batch, kb, seq, size, overlap, recursive, source_col, text_col, id_col)
        (chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("kb", "ingest_seq").parquet(store.chunk_path))
        store._append_log(kb, "append", None, seq)

    w = docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
