"""Running offsets (prefix sums) over an ordered table without a
single-partition window.

Plan:
1. keep only the narrow columns (group keys, order keys, length);
2. range-partition by (group, order) and sort inside partitions, then
   ``checkpoint()`` so partition boundaries are fixed for both passes below
   and the lineage is cut (survives executor loss, no recomputed sample);
3. per partition, an Arrow pass computes each row's local exclusive sum,
   carrying the running value across batches of the same partition;
4. a tiny table of per-(partition, group) totals - at most #partitions +
   #groups rows - gives each (partition, group) its starting offset with a
   window per group over partition ids;
5. offsets are joined back on (partition, group) (AQE broadcasts it when its
   runtime size is small) and added to the local sums.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NULL = "\u0000<null>"


def _local_sums(group_cols: list[str], length_col: str, sep: int):
    def run(it):
        pid = TaskContext.get().partitionId()
        carry_key, carry = None, 0
        for pdf in it:
            if pdf.empty:
                continue
            w = pdf[length_col].fillna(0).astype("int64") + sep
            if group_cols:
                keys = pdf[group_cols].astype(object).where(pdf[group_cols].notna(), _NULL)
                kt = list(keys.itertuples(index=False, name=None))
                codes = pd.Series(pd.factorize(pd.Series(kt, dtype=object))[0], index=pdf.index)
            else:
                kt = [()] * len(pdf)
                codes = pd.Series(0, index=pdf.index)
            incl = w.groupby(codes, sort=False).cumsum()
            if carry_key is not None and kt[0] == carry_key:
                first = codes == codes.iloc[0]
                incl = incl.where(~first, incl + carry)
            excl = incl - w
            carry_key, carry = kt[-1], int(incl.iloc[-1])
            out = pdf.copy()
            out["_local"] = excl.astype("int64")
            out["_pid"] = pid
            yield out
    return run


def running_offsets(df: DataFrame, group_cols: list[str], order_cols: list[str], length_col: str,
                    sep: int = 0, num_partitions: int | None = None) -> DataFrame:
    """For every row: ``start`` = sum of (length + sep) over the rows before it
    in its group (ordered by ``order_cols``) and ``group_total`` = sum of
    (length + sep) over the whole group. Returns group, order, length, start,
    group_total. ``order_cols`` must identify a row inside its group."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_cols) + list(order_cols)
    narrow = df.select(*keys, F.col(length_col).cast("long").alias(length_col))
    ranged = (narrow.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .checkpoint(eager=True))

    schema = T.StructType(ranged.schema.fields + [T.StructField("_local", T.LongType()),
                                                  T.StructField("_pid", T.IntegerType())])
    local = ranged.mapInPandas(_local_sums(list(group_cols), length_col, sep), schema)

    w = F.coalesce(F.col(length_col), F.lit(0)) + F.lit(sep)
    per_part = ranged.groupBy(F.spark_partition_id().alias("_pid"), *group_cols).agg(F.sum(w).alias("_ptot"))
    win = Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid")
    offsets = per_part.select(
        "_pid", *group_cols,
        F.coalesce(F.sum("_ptot").over(win.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_ptot").over(win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("group_total"))

    on = ["_pid"] + list(group_cols)       # a null group is a group like any other
    named = offsets.withColumnsRenamed({c: f"_o_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in on])
    joined = local.join(named, same, "inner")
    return joined.select(*keys, length_col, (F.col("_off") + F.col("_local")).alias("start"),
                         F.col("group_total").cast("long").alias("group_total"))


def global_row_index(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the global order of ``order_cols``
    (distributed; no single-partition window)."""
    one = df.select(*order_cols).withColumn("_one", F.lit(1))
    r = running_offsets(one, [], order_cols, "_one", 0, num_partitions)
    return r.select(*order_cols, F.col("start").alias("row_index"), F.col("group_total").alias("row_count"))
