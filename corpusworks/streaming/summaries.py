"""T3 running session summaries and T4 training-progress streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.functions.text import progress_pct


def running_summary(events: DataFrame, key: str, ts_col: str = "ts", watermark: str | None = None) -> DataFrame:
    """Per key message count, first and last event time. Streaming-safe
    (update mode); with ``watermark`` also usable in append mode, where a key
    is final once the watermark passes."""
    ev = events.withWatermark(ts_col, watermark) if watermark else events
    return ev.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts_col).alias("first_ts"),
                               F.max(ts_col).alias("last_ts"))


def latest_progress(progress: DataFrame, job_col: str = "job", base_span: tuple[float, float] = K.PROGRESS_SCRATCH,
                    ts_col: str = "ts") -> DataFrame:
    """T4: newest report per job (highest step, then latest time) with its
    percentage (F15, clamped). Works on batch and streaming input."""
    latest = progress.groupBy(job_col).agg(
        F.max_by(F.struct("step", "total", "loss"), F.struct("step", ts_col)).alias("_r"))
    base, span = base_span
    return latest.select(job_col, F.col("_r.step").alias("step"), F.col("_r.total").alias("total"),
                         F.col("_r.loss").alias("loss"),
                         progress_pct(F.col("_r.step"), F.col("_r.total"), base, span).alias("pct"))


def log_interval(total_steps, divisor: int = 20):
    """Steps between progress reports: max(1, total // divisor)."""
    t = F.col(total_steps) if isinstance(total_steps, str) else total_steps
    return F.greatest(F.lit(1), F.floor(t / divisor)).cast("long")
