"""Connected components by alternating stars: every round links each node's
larger neighbours to its smallest one (large star), then its smaller neighbours
(small star), until nothing changes. Each half round is one aggregate with a
partial minimum and one join on written tables, so a node with very many
neighbours is split by the skew join and nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import keep


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = keep(side.groupBy("a").agg(F.min("b").alias("m")), "least", 2 * rows).withColumn("m", F.least("a", "m"))
    joined = side.join(least, "a")
    moved = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionAll(least.select("a", F.col("m").alias("b")))
    return keep(moved.where("a <> b").distinct(), "star", 2 * rows)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges``: a, b (any orderable type; about ``rows`` of them). Returns node, root for
    every node with an edge; the root is the smallest node of the component."""
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .where("a <> b").distinct(), "edges", rows)
    state = _state(now)
    while state[0]:
        now = _star(_star(now, True, state[0]), False, state[0])
        after = _state(now)
        if after == state:
            break
        state = after
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
