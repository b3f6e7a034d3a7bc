"""Exact k-nearest-neighbour join, queries x corpus.

Both sides are packed, batch by batch and without a shuffle, into rows of bounded
bytes: slices of the corpus and blocks of queries. Every block meets every slice by an
equi-join on the slice's bucket; one task holds one block and one slice at a time
(an Arrow batch ends with the row that fills it), and the distances of MAX_CELLS pairs.
Distances come as one matrix product; everything within rounding of a query's k best
is computed again exactly, so results and ties (the smaller id) are exact. A pair of
block and slice returns at most k rows per query, and ``row_number() <= k`` per query
(Spark limits it in each partition first) merges them. No vector reaches the driver, and
a query id with many vectors is many rows like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks import constants as K
from corpusworks.session import bound_batches, stored

SLICE_BYTES = 8 * 1024 ** 2      # vectors of a corpus slice
BLOCK_BYTES = 2 * 1024 ** 2      # vectors of a query block
MAX_BLOCK_ROWS = 4096            # queries of a block
MAX_CELLS = 1 << 21              # distances that are held at once
_NEAR = 1e-9                     # relative error that the matrix product is allowed


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise exact distance between paired rows of q and x (float64)."""
    if metric == "cosine":
        qn = np.linalg.norm(q, axis=1)
        xn = np.linalg.norm(x, axis=1)
        den = qn * xn
        dot = np.einsum("ij,ij->i", q, x)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(den > 0, 1.0 - dot / den, 1.0)
    d = q - x
    return np.einsum("ij,ij->i", d, d)


def _pack(max_bytes: int, max_rows: int):
    """Rows (id, vec) of a task as packed rows: place (of the packed row), dims, ids, vecs."""
    def run(batches):
        pid, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def packed(dims):
            nonlocal made
            ids, parts = zip(*held.pop(dims))
            made += 1
            ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([pid << 33 | made]), pa.array([dims]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["place", "dims", "ids", "vecs"])

        for b in batches:
            column = b.column("vec")
            flat = column.flatten()
            if flat.null_count:
                flat = flat.cast(pa.float64()).fill_null(float("nan"))
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                step = max(1, min(max_rows, max_bytes // (8 * max(1, dims))))
                while len(rows):
                    room = step - sum(len(i) for i, _ in held.get(dims, []))
                    take, rows = rows[:room], rows[room:]
                    part = values[(starts[take, None] + np.arange(dims)).ravel()]
                    held.setdefault(dims, []).append((b.column("id").take(pa.array(take)), part))
                    if len(take) == room:
                        yield packed(dims)
        for dims in list(held):
            yield packed(dims)
    return run


def _ordinals(ids: list) -> np.ndarray:
    """Places of ids in their order (null first), for ties."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
    out = np.empty(len(ids), np.int64)
    last, rank = object(), -1
    for i in order:
        rank += ids[i] != last
        out[i], last = rank, ids[i]
    return out


def _search(k: int, metric: str, exclude_self: bool):
    def nearest(q, qids, x, xn, numbers, ordinals):
        """(query, row, distance) of the k best rows x of each query; ``numbers``: of the ids of x."""
        qn = np.einsum("ij,ij->i", q, q)
        if metric == "cosine":
            den = np.sqrt(qn)[:, None] * np.sqrt(xn)[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.where(den > 0, 1.0 - (q @ x.T) / den, 1.0)
            slack = np.full(len(q), _NEAR)
        else:
            d = qn[:, None] + xn[None, :] - 2.0 * (q @ x.T)
            slack = _NEAR * (qn + xn.max(initial=0))
        if exclude_self:
            number, of_x = numbers
            own = np.array([number.get(i, -1) for i in qids])
            d[own[:, None] == of_x[None, :]] = np.inf
        bound = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + slack
        at_q, at_x = np.nonzero((d <= bound[:, None]) & ~np.isinf(d) | np.isnan(d))
        exact = _exact(metric, q[at_q], x[at_x])
        order = np.lexsort((ordinals[at_x], exact, at_q))
        at_q, at_x, exact = at_q[order], at_x[order], exact[order]
        first = np.searchsorted(at_q, np.arange(len(q)))
        top = np.arange(len(at_q)) - first[at_q] < k
        return at_q[top], at_x[top], exact[top]

    def run(batches):
        for b in batches:
            for r in range(len(b)):
                qids, cids, dims = b.column("qids")[r].as_py(), b.column("cids")[r].as_py(), b.column("dims")[r].as_py()
                q = np.frombuffer(b.column("qvecs")[r].as_buffer(), np.float64).reshape(len(qids), dims)
                x = np.frombuffer(b.column("cvecs")[r].as_buffer(), np.float64).reshape(len(cids), dims)
                number = {c: i for i, c in enumerate(dict.fromkeys(cids))}
                numbers, xn, ordinals = (number, np.array([number[c] for c in cids])), np.einsum("ij,ij->i", x, x), _ordinals(cids)
                step = max(1, MAX_CELLS // len(cids))
                for at in range(0, len(qids), step):
                    at_q, at_x, dist = nearest(q[at:at + step], qids[at:at + step], x, xn, numbers, ordinals)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("qids")[r].values.take(pa.array(at + at_q)), b.column("cids")[r].values.take(pa.array(at_x)),
                         pa.array(dist)], names=["query_id", "vec_id", "dist"])
    return run


def _id(df: DataFrame, column: str) -> F.Column:
    """Integers of any width as long, other ids as strings."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    return F.col(column).cast("long" if whole else "string")


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int = K.TOP_K, query_id: str = "query_id",
             query_vec: str = "embedding", corpus_id: str = "vec_id", corpus_vec: str = "embedding",
             metric: str = "l2", exclude_self: bool = False, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Top-k corpus rows per query id: query_id, rank (1..k), vec_id, dist.

    metric 'l2' = squared Euclidean distance; 'cosine' = 1 - cosine
    similarity. Ties are broken by the smaller vec_id; NULL vectors take no part,
    vectors meet only vectors of their own length. Ids are integers or strings; a query
    id with several vectors gets the k best rows of all of them.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    bound_batches(queries.sparkSession)

    def packed(df: DataFrame, id_col: str, vec: str, name: str, max_bytes: int, rows: int) -> DataFrame:
        own = df.select(_id(df, id_col).alias("id"), F.col(vec).alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0))
        kind = own.schema["id"].dataType.simpleString()
        return stored(own.mapInArrow(_pack(max_bytes, rows), f"place long, dims long, ids array<{kind}>, vecs binary"), name)

    slices = packed(corpus, corpus_id, corpus_vec, "knn-slices", SLICE_BYTES, 1 << 30)
    blocks = packed(queries, query_id, query_vec, "knn-blocks", BLOCK_BYTES, max_block_rows)
    buckets = max(1, slices.count())
    placed = slices.select("dims", F.pmod(F.xxhash64("place"), F.lit(buckets)).alias("bucket"),
                           F.col("ids").alias("cids"), F.col("vecs").alias("cvecs"))
    asking = blocks.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
                           F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
    kinds = [d.schema["ids"].dataType.elementType for d in (blocks, slices)]
    schema = f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, dist double"
    found = (asking.join(placed, ["dims", "bucket"]).select("dims", "qids", "qvecs", "cids", "cvecs")
             .mapInArrow(_search(k, metric, exclude_self), schema))
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "dist"))
