"""Embedding whitening by spectral divide and conquer.

1. Every component c becomes the integer x = floor(scale * c) + shift. One pass
   sums x per dimension (exactly, in two halves), a second one sums the products
   of (n * x - S) / n. Tasks send one row per dimension, added up by salted
   groups first, so no task reads the sums of all others.
2. The d x d covariance (d: dimensions, a bounded matrix) is cut on the driver:
   the polar factor of V - sigma I, by the QDWH iteration, is +1 on the invariant
   subspace above sigma and -1 below, so (U + I) / 2 is its spectral projector.
   Bases of the two subspaces come from the projector; the compressed blocks are
   cut again until a block is one component. Only blocks that reach the leading
   components are cut further.
3. Means and the leading components travel by broadcast (d x k numbers); one pass
   projects every vector, and the whitened vectors' own covariance tells how far
   from the identity the result is.

Defined cases: vectors that are null or hold null or non-finite entries go;
empty vectors have no component and give no row; vectors of several lengths are
fitted each with their own length's list (identity_error is then the largest of
all); repeated rows and null ids count as rows; integers saturate at 2 ** 52;
with fewer dimensions than k all components come; a component without variance
(all vectors alike, or fewer vectors than components) has whitened null and takes
no part in identity_error; deviation is null beyond 38 digits; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import keep

SCALE, SHIFT = 1024, 100_000
TOP = 1 << 52                     # integers saturate here
HALF = 26                         # bits of the lower half of an exact sum
SALTS = 64                        # groups that partial sums go through first
ROUNDS = 40
TINY = np.finfo(float).eps


# ------------------------------------------------------- spectral divide and conquer
def qdwh(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley
    iteration: X <- X (a I + b X'X) (I + c X'X)^-1, by QR while the weights are large and
    by Cholesky afterwards."""
    n = len(a)
    norm = np.linalg.norm(a, 2)
    if norm == 0:
        return np.eye(n)
    x, eye = a / norm, np.eye(n)
    low = max(np.linalg.norm(np.linalg.inv(x), 2) ** -1 * 0.9 if np.linalg.cond(x) < 1 / TINY else TINY, TINY)
    for _ in range(ROUNDS):
        squared = low * low
        d = np.cbrt(4 * (1 - squared) / squared ** 2) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - squared) / (squared * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            z = eye + wc * x.T @ x
            half = np.linalg.solve(np.linalg.cholesky(z), x.T)
            whole = np.linalg.solve(np.linalg.cholesky(z).T, half)
            new = (wb / wc) * x + (wa - wb / wc) * whole.T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * squared) / (1 + wc * squared))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 4 * TINY ** (1 / 3) and abs(1 - low) < 10 * TINY or moved < 10 * TINY:
            break
    return x


def _split(a: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of ``a`` above and below a shift; None
    if no shift parts it (all its eigenvalues agree to working precision)."""
    n, diagonal = len(a), np.sort(np.diag(a))
    spread = max(diagonal[-1] - diagonal[0], np.linalg.norm(a - np.diag(np.diag(a)), 2))
    middle = np.trace(a) / n
    for shift in (np.median(diagonal), middle, middle + 0.21 * spread, middle - 0.21 * spread,
                  middle + 0.043 * spread, middle - 0.043 * spread):
        projector = (qdwh(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-8 * n:
            continue
        upper = np.linalg.qr(projector @ rng.standard_normal((n, rank)))[0]
        upper = np.linalg.qr(projector @ upper)[0]
        both = np.linalg.qr(upper, mode="complete")[0]
        lower = both[:, rank:]
        if np.linalg.norm(both[:, :rank].T @ a @ lower, 2) <= 1e3 * n * TINY * max(np.linalg.norm(a, 2), 1e-300):
            return both[:, :rank], lower
    return None


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns, by recursive spectral division."""
    rng = np.random.default_rng(5)
    top = max(np.linalg.norm(v, 2), 1e-300)

    def cut(basis: np.ndarray, wanted: int):
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        n = len(block)
        alike = np.linalg.norm(block - np.trace(block) / n * np.eye(n), 2) <= 8 * n * TINY * top
        parts = None if n == 1 or alike else _split(block, rng)
        if parts is None:
            return [(float(block[i, i]), basis[:, i]) for i in np.argsort(-np.diag(block), kind="stable")[:wanted]]
        upper = cut(basis @ parts[0], wanted)
        rest = wanted - len(upper)
        return upper + (cut(basis @ parts[1], rest) if rest > 0 else [])

    found = sorted(cut(np.eye(len(v)), min(k, len(v))), key=lambda f: -f[0])
    return np.array([e for e, _ in found]), np.stack([x for _, x in found], 1)


# ------------------------------------------------------------------ passes over the rows
def _whole(column, scale: int, shift: int) -> list[np.ndarray]:
    out = []
    for cell in column:
        with np.errstate(over="ignore"):
            c = np.floor(cell.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        out.append(np.clip(c, -TOP, TOP - shift).astype(np.int64) + shift)
    return out


def _blocks(batches, name: str, scale: int, shift: int):
    """(dimensions, positions in the batch, matrix of integers, batch)."""
    for b in batches:
        rows = _whole(b.column(name), scale, shift)
        sizes = np.array([len(r) for r in rows])
        for d in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == d)
            yield d, at, np.stack([rows[i] for i in at]), b


def _sums(scale: int, shift: int):
    def run(batches):
        n, high, low = {}, {}, {}
        for d, at, x, _ in _blocks(batches, "v", scale, shift):
            n[d] = n.get(d, 0) + len(at)
            high[d] = high.get(d, 0) + (x >> HALF).sum(0)
            low[d] = low.get(d, 0) + (x & ((1 << HALF) - 1)).sum(0)
        for d in n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n[d])), pa.array(high[d]),
                 pa.array(low[d])], names=["dims", "i", "n", "high", "low"])
    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they fit, Python integers beyond."""
    most = max(1, int(np.abs(x).max(initial=0))) * n + max(map(abs, sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _products(scale: int, shift: int, fitted):
    def run(batches):
        total = {}
        for d, _, x, _ in _blocks(batches, "v", scale, shift):
            n, sums = fitted.value[d]
            y = (_centred(x, n, sums) / n).astype(np.float64)
            total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(list(m), pa.list_(pa.float64()))],
                names=["dims", "i", "row"])
    return run


def _add_rows(t: pa.Table) -> pa.Table:
    row = np.sum([c.values.to_numpy() for c in t.column("row")], axis=0)
    return t.slice(0, 1).select(["dims", "i"]).append_column("row", pa.array([row], pa.list_(pa.float64())))


def _project(scale: int, shift: int, models, id_type):
    def run(batches):
        for d, at, x, b in _blocks(batches, "v", scale, shift):
            n, sums, parts = models.value[d]
            y = _centred(x, n, sums)
            size = d * int(np.abs(y).max(initial=0)) ** 2
            squares = (y * y).sum(1) if size < 1 << 62 else (y.astype(object) ** 2).sum(1)
            deviation = [Decimal(int(s)) if int(s) < 10 ** 38 else None for s in squares]
            white = (y / n).astype(np.float64) @ parts["axes"]
            white[:, ~parts["varies"]] = np.nan
            values = pa.array(white.ravel(), from_pandas=True)                  # NaN: null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * white.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(at)), pa.array(np.full(len(at), d)),
                 pa.array(deviation, pa.decimal128(38, 0)), lists], names=["id", "dims", "deviation", "white"])
    return run


def fit(rows: DataFrame, k: int, scale: int = SCALE, shift: int = SHIFT) -> dict[int, tuple]:
    """By dimensions of the vectors (column v): n, sums per dimension, and a dict with the
    eigenvalues, the share each explains, which vary, and the axes (eigenvectors over
    the root of the eigenvalue). Held by the driver: d x d numbers."""
    spark = rows.sparkSession
    first: dict[int, tuple[int, list]] = {}
    sums = (rows.select("v").mapInArrow(_sums(scale, shift), "dims long, i long, n long, high long, low long")
            .groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")))
    for r in sums.orderBy("dims", "i").collect():                                # d rows
        n, own = first.setdefault(r["dims"], (r["n"], []))
        own.append((r["high"] << HALF) + r["low"])
    fitted = spark.sparkContext.broadcast(first)
    schema = "dims long, i long, row array<double>"
    salted = (rows.select("v").mapInArrow(_products(scale, shift, fitted), schema)
              .groupBy("dims", "i", F.pmod(F.spark_partition_id(), F.lit(SALTS))).applyInArrow(_add_rows, schema))
    found: dict[int, dict] = {d: {} for d in first}
    for r in salted.groupBy("dims", "i").applyInArrow(_add_rows, schema).collect():      # d rows of d numbers
        found[r["dims"]][r["i"]] = r["row"]
    models = {}
    for d, (n, own) in first.items():
        v = np.array([found[d][i] for i in range(d)]) / n
        v = (v + v.T) / 2
        values, vectors = leading_components(v, k)
        varies = values > d * TINY * max(values[0], 0) * 16 + 1e-300
        axes = vectors / np.sqrt(np.where(varies, values, 1.0))
        total = float(np.trace(v))
        models[d] = (n, own, {"values": values, "varies": varies, "axes": axes,
                              "explained": values / total if total > 0 else np.zeros(len(values))})
    return models


def whiten(df: DataFrame, vec_id: str, vector: str, k: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per usable row of ``df`` and component: vec_id, component, n, deviation
    decimal(38,0), whitened, explained, identity_error, dimensions."""
    spark, v = df.sparkSession, F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).alias("id"), v.cast("array<double>").alias("v")) \
        .where(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    models = fit(rows, k, scale, shift)
    shared = spark.sparkContext.broadcast(models)
    id_type = df.schema[vec_id].dataType
    out = keep(rows.mapInArrow(_project(scale, shift, shared, id_type),
                               f"id {id_type.simpleString()}, dims long, deviation decimal(38,0), white array<double>"),
               "whitened")
    error = identity_error(out, max([len(m[2]["values"]) for m in models.values()], default=0))
    facts = spark.createDataFrame(
        [(int(d), c + 1, int(m[0]), float(e)) for d, m in models.items() for c, e in enumerate(m[2]["explained"])],
        "dims long, component int, n long, explained double")                     # k rows per length
    lines = out.select("id", "dims", "deviation", F.posexplode("white").alias("c", "whitened"))
    return (lines.withColumn("component", (F.col("c") + 1).cast("int"))
            .join(F.broadcast(facts), ["dims", "component"])
            .select(F.col("id").alias(vec_id), "component", "n", "deviation", "whitened", "explained",
                    F.lit(error).cast("double").alias("identity_error"), F.col("dims").alias("dimensions")))


def identity_error(white: DataFrame, k: int) -> float | None:
    """Largest absolute entry of covariance minus identity over the whitened vectors
    (dims, white), centred first; components without variance are left out."""
    if not k:
        return None
    at = [F.get("white", F.lit(i)) for i in range(k)]
    means = {r[0]: r[1:] for r in white.groupBy("dims").agg(*[F.avg(c) for c in at]).collect()}     # one row per length
    if not means:
        return None
    worst = 0.0
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = F.broadcast(white.sparkSession.createDataFrame(
        [(d, list(m)) for d, m in means.items()], "dims long, mean array<double>"))
    centred = white.join(rows, "dims").select("dims", F.zip_with("white", F.slice("mean", 1, F.size("white")),
                                                                 lambda a, b: a - b).alias("white"))
    for r in centred.groupBy("dims").agg(*[F.avg(at[i] * at[j]) for i, j in pairs]).collect():
        for (i, j), value in zip(pairs, r[1:]):
            if value is not None:
                worst = max(worst, abs(value - (i == j)))
    return worst
