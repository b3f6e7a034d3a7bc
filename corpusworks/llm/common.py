"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusworks.session import bound_batches, ensure_checkpoint_dir, scratch_dir, ship_package

ARROW_ROWS = 1000            # rows of one Arrow batch; its bytes are bounded for every query
ROWS_OF_A_TASK = 250_000     # narrow rows that one task writes


def prepare(spark: SparkSession) -> SparkSession:
    """Shared folder, package on the workers, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    bound_batches(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a derived table to the shared folder and read it back: lineage is
    cut, later reads survive lost executors, and joins plan their own exchange.
    ``rows``: about how many come out of the last shuffle at most; a table far smaller than
    the shuffle is wide is then written by as many tasks as it needs, one a core at least."""
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_A_TASK)))
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
