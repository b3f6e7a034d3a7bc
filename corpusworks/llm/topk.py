"""Exact top-k inner-product search by a three-phase uniform threshold.

Components are cut into LISTS lists of dimensions; a vector's score is the sum
of its local scores in the lists.

1. Every task (one slice of vectors, one block of queries) gathers the k best
   entries of each local list. The k-th best full score among a query's gathered
   entries is a lower bound of its k-th best score.
2. That bound divided by the number of lists is the uniform cutoff, which travels
   with the query blocks: an entry below it in every list scores less than the
   bound in sum and can't be among the k best. Entries that reach it somewhere
   are collected; where the known local scores plus the cutoff for the unknown
   ones stay below the bound, the entry goes too.
3. The scores of the remaining entries are resolved exactly.

Equal vectors are searched once: the search runs over distinct vectors (classes)
with their k + 1 smallest ids, for distinct query vectors, and ids come in at the
end, so a vector that a third of all rows share costs no more than one. An id
with one vector has one row of its own among the k + 1 best at most. An id with
several vectors is searched apart from the others: its own members are left out
before the k best are taken, and with them the classes that it holds alone. Slices
and query blocks have bounded sizes. Slices are dealt to lanes and blocks to bands; a
slice goes to every band and a block to every lane, where they meet by an equi-join on
both numbers. A lane's share of a band is bounded, and nothing is broadcast: files of
vectors are far smaller than their rows, and Spark's estimate of a join's side knows
nothing of copies. Slices are put together after the shuffle, and never read from files,
as a reader takes thousands of rows at once.

Scores are integers; they are exact as long as they fit 64 bits (products of
doubles while they are below 2^53, 64-bit integers beyond).

Defined cases: vectors that are null or hold null or non-finite components take
no part; vectors meet only vectors of their own length; rows that repeat id and
vector count once; ids that repeat with other vectors are rows of their own, and
a query never finds its own id; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusworks.llm.common import keep

LISTS = 4
SLICE, BLOCK = 2048, 256        # vectors of a slice, queries of a block (on average)
LANE = 16                       # slices of a lane at most (on average)
BAND_BYTES = 16 << 20           # vectors of the query blocks that a lane's slices meet at once, about
LOWEST = -(1 << 62)


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(members) -> np.ndarray:
    """Vectors of a list column cell (struct with an array of integers)."""
    cell = members.values
    return cell.field("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cell[0]["q"]))


def _numbers(members, name: str) -> np.ndarray:
    """A field of a list column cell, 0 for nulls."""
    column = members.values.field(name)
    return column.fill_null(0 if pa.types.is_integer(column.type) else False).to_numpy(zero_copy_only=False)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def local_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """LISTS x queries x vectors."""
    cuts = np.array_split(np.arange(vectors.shape[1]), min(LISTS, vectors.shape[1]))
    return np.stack([_products(queries[:, c], vectors[:, c]) for c in cuts])


def gather(local: np.ndarray, k: int) -> np.ndarray:
    """Which entries (queries x vectors) are among the k best of some list."""
    chosen = np.zeros(local.shape[1:], dtype=bool)
    for scores in local:
        best = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
        np.put_along_axis(chosen, best, True, axis=1)
    return chosen


def collect(local: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which entries may reach each query's bound."""
    lists = len(local)
    cutoff = np.ceil(bound / lists)[None, :, None]
    known = local >= cutoff
    most = np.where(known, local, np.maximum(cutoff - 1, local.min())).sum(0)
    return known.any(0) & (most >= bound[:, None])


def _best(queries: int, tie, total, chosen, k: int):
    """Query numbers, entry numbers, ties and scores of the k best chosen entries of
    every query; ``tie`` gives the smallest id of (query, entry) pairs."""
    q, v = np.nonzero(chosen)
    s, t = total[q, v], tie(q, v)
    order = np.lexsort((t, -s, q))
    q, v, s, t = q[order], v[order], s[order], t[order]
    first = np.searchsorted(q, np.arange(queries))
    top = np.arange(len(q)) - first[q] < k
    return q[top], v[top], t[top], s[top]


def _phase(k: int, bounded: bool):
    def run(batches):
        for b in batches:
            for r in range(len(b)):
                entries, asking = b.column("slice")[r], b.column("block")[r]
                first, second, single = (_numbers(entries, c) for c in ("first", "second", "single"))
                own, apart = _numbers(asking, "own"), _numbers(asking, "apart")
                local = local_scores(_matrix(asking), _matrix(entries))
                total = local.sum(0)
                mine = apart[:, None] & (own[:, None] == first[None, :]) & single[None, :]
                if bounded:
                    bound = asking.values.field("bound").to_numpy(zero_copy_only=False).astype(float)
                    bound = np.where(np.isnan(bound), -np.inf, bound)
                    free = np.isinf(bound)
                    chosen = np.where(free[:, None], True, collect(local, np.where(free, 0, bound)))
                else:
                    chosen = gather(np.where(mine, LOWEST, local) if mine.any() else local, k)

                def tie(q, v):
                    return np.where(apart[q] & (own[q] == first[v]), second[v], first[v])

                q, v, t, score = _best(len(own), tie, total, chosen & ~mine, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (_numbers(asking, "rep")[q], apart[q], own[q], _numbers(entries, "rep")[v], t, score)],
                    names=["rep", "apart", "own", "id", "tie", "score"])
    return run


_OUT = "rep long, apart boolean, own long, id long, tie long, score long"
_QUERY = ["rep", "apart", "own"]


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sorts both sides, however small Spark takes them for."""
    return left.join(right.hint("merge"), on, how)


def lanes(slices: int, cores: int) -> int:
    """How many lanes the slices are dealt to: each of them gets a copy of every query block."""
    return min(slices, max(-(-slices // LANE), 4 * cores))


def meet(entries: DataFrame, blocks: DataFrame, lanes_of: int, blocks_of: int) -> DataFrame:
    """Every slice (its rows: dims, at, entry) beside every block (dims, block_at, block) of its dims."""
    grid, first = ["dims", "lane", "band"], F.lit(0).cast("long")
    bands = F.ceil(F.col("dims") * (8 * BLOCK * blocks_of / BAND_BYTES))
    slices = (entries.select("dims", F.pmod("at", F.lit(lanes_of)).alias("lane"),
                             F.explode(F.sequence(first, bands - 1)).alias("band"), "at", "entry")
              .repartition(*grid).groupBy(*grid, "at").agg(F.collect_list("entry").alias("slice")))
    dealt = blocks.select("dims", F.explode(F.sequence(first, F.lit(lanes_of - 1).cast("long"))).alias("lane"),
                          F.pmod("block_at", bands).alias("band"), "block")     # this side is held, a band at a time
    return joined(slices, dealt, grid).select("slice", "block")


def top_k(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """For every row with ``is_query``: its k best other rows by integer inner
    product of floor(scale * component): query_id, rank, vec_id, score."""
    rows = keep(df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
                .select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("q"),
                        F.coalesce(is_query, F.lit(False)).alias("asks"))
                .groupBy("id", "q").agg(F.max("asks").alias("asks")), "vectors")
    need = k + 1                                              # the query itself may be among the best
    order = Window.partitionBy("q").orderBy("id")
    heads = rows.select("id", "q").withColumn("place", F.row_number().over(order)).where(F.col("place") <= need)
    classes = keep(heads.groupBy("q").agg(F.sort_array(F.collect_list("id")).alias("ids"))       # need ids at most
                   .select(F.monotonically_increasing_id().alias("rep"), "q", F.size("q").alias("dims"), "ids"), "classes")
    several = keep(rows.groupBy("id").agg(F.count(F.lit(1)).alias("vectors"), F.max("asks").alias("asks"))
                   .where("vectors > 1 AND asks").select(F.col("id").alias("query_id"), F.lit(True).alias("apart")),
                   "several")
    asked = rows.where("asks").select(F.col("id").alias("query_id"), "q")
    asked = keep(joined(joined(asked, classes.select("q", "rep", "dims"), "q"), several, "query_id", "left")
                 .withColumn("apart", F.coalesce("apart", F.lit(False)))
                 .withColumn("own", F.when(F.col("apart"), F.col("query_id")).otherwise(F.lit(0))), "asked")

    slices_of = max(1, -(-classes.count() // SLICE))
    entry = F.struct("rep", "q", F.col("ids")[0].alias("first"), F.get("ids", F.lit(1)).alias("second"),
                     (F.size("ids") == 1).alias("single"))
    entries = classes.select("dims", F.pmod(F.xxhash64("rep"), F.lit(slices_of)).alias("at"), entry.alias("entry"))
    askers = keep(asked.groupBy(*_QUERY, "q", "dims").agg(F.count(F.lit(1)).alias("n")), "askers")
    blocks_of = max(1, -(-askers.count() // BLOCK))
    lanes_of = lanes(slices_of, df.sparkSession.sparkContext.defaultParallelism)

    def blocks(queries: DataFrame, *more) -> DataFrame:
        dealt = (queries.groupBy("dims", F.pmod(F.xxhash64(*_QUERY), F.lit(blocks_of)).alias("block_at"))
                 .agg(F.collect_list(F.struct(*_QUERY, "q", *more)).alias("block")))
        return meet(entries, dealt, lanes_of, blocks_of)

    by_score = Window.partitionBy(*_QUERY).orderBy(F.desc("score"), "tie")
    gathered = blocks(askers).mapInArrow(_phase(need, False), _OUT)
    bounds = keep(gathered.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == need)
                  .select(*_QUERY, F.col("score").alias("bound")), "bounds")
    resolved = blocks(joined(askers, bounds, _QUERY, "left"), "bound").mapInArrow(_phase(need, True), _OUT)
    best = keep(resolved.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= need)
                .select(*_QUERY, "id", "score"), "best")

    members = classes.select(F.col("rep").alias("id"), F.explode("ids").alias("member"))
    by_member = Window.partitionBy(*_QUERY).orderBy(F.desc("score"), "member")
    listed = keep(joined(best, members, "id").where(~F.col("apart") | (F.col("own") != F.col("member")))
                  .withColumn("place", F.row_number().over(by_member)).where(F.col("place") <= need)
                  .select(*_QUERY, "member", "score"), "listed")
    by_query = Window.partitionBy("query_id", "rep").orderBy(F.desc("score"), "member")
    return (joined(asked.select("query_id", *_QUERY), listed, _QUERY).where(F.col("query_id") != F.col("member"))
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("member").alias("vec_id"), "score"))
