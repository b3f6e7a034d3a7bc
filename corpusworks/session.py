"""Session helpers: building a session for tests/bench, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings applied when this package builds a session itself (tests, bench).
# On a cluster the session is built by the platform and only the values that
# are unset there are filled in by ``ensure_conf``.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "corpusworks") -> SparkSession:
    """Build (or return) a session with this package's defaults.

    ``spark.checkpoint.dir`` is set only if the caller's environment did not
    set it, to a fresh local folder (tests / single node only).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CW_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusworks`` importable in every Python worker (the code the
    Arrow UDFs and grouped functions pickle by reference): zip the package
    once per application and hand it to ``addPyFile`` - the same path as
    ``--py-files``. The zip is a driver-side staging file of code only."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="cw-code-"), "corpusworks.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, dirs, files in os.walk(pkg):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session; only when it is unset (local tests)
    a fresh folder under the system temp dir is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cw-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


# Bytes of one Arrow batch (it ends with the row that reaches them), as texts and packed rows can be long.
ARROW_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold ARROW_BYTES bytes, about."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint dir for derived tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cw-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back: lineage is
    cut and later reads survive lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a check of rows and bytes: a bounded count (each
    task stops after ``max_rows + 1`` rows) with the size of all cells. Above either bound the
    join is left to the planner / AQE (shuffle join, skew split)."""
    from pyspark.sql import functions as F
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(8) for c in df.columns]
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(cells, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


# tables whose rows carry enough per-row work (text, vectors) to spread them
SPREAD_TABLES = {"documents", "conversations", "pages", "embeddings", "events", "benchmark"}


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan over the cluster's parallelism when it plans fewer
    partitions (e.g. one large row group of long texts). The partition count
    comes from the file listing, no job runs; on a large table the scan
    already has more splits and nothing is added."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in SPREAD_TABLES else df
