"""Helpers to run streaming queries to completion and to keep update-mode
results as an append-only upsert log (latest row per key wins on read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusworks.session import scratch_dir


def run_available_now(stream: DataFrame, out_path: str, checkpoint: str, output_mode: str = "append",
                      fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Process everything available, write it to ``out_path`` and stop.
    The checkpoint makes a re-run continue where it stopped (once-only)."""
    w = (stream.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode(output_mode).trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()


def run_upserts(stream: DataFrame, log_path: str, checkpoint: str, output_mode: str = "update") -> None:
    """Update/complete-mode aggregation -> append-only log of changed rows,
    tagged with the micro-batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(log_path)

    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
     .outputMode(output_mode).trigger(availableNow=True).start().awaitTermination())


def latest_by_key(log: DataFrame, keys: list[str], version_col: str = "_batch") -> DataFrame:
    """Read side of the upsert log: the newest version of every key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version_col))
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", version_col)


def files_and_trigger(table: DataFrame, batches: int) -> tuple[int, int]:
    """How many files a stream's source made from ``table`` has, as many as the table has
    partitions, and how many of them a trigger reads so that there are about ``batches`` micro-batches."""
    n = max(batches, table.rdd.getNumPartitions())
    return n, -(-n // batches)


def stage_as_stream_source(spark: SparkSession, df: DataFrame, name: str, split_cols: list[str] | None = None,
                           n_files: int = 1) -> str:
    """Write a derived table as the file source of a stream. With
    ``split_cols``, rows are spread over ``n_files`` files by these
    columns so that a stream with maxFilesPerTrigger sees several batches."""
    path = scratch_dir(spark, name)
    if split_cols:
        df = df.repartition(n_files, *split_cols)
    df.write.mode("overwrite").parquet(path)
    return path
