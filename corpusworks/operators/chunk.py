"""Chunking operators.

C2 fixed-stride chunks are pure array expressions (no Python, no shuffle).
C1 recursive chunks need per-row string logic: an Arrow-batched pandas UDF
returns all chunks of a row as one array, exploded afterwards (no shuffle).
U7 exposes C1 as a SQL table function.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks import constants as K
from corpusworks.functions.text import _c, strip

RECURSIVE_SEPARATORS = ["\n\n", "\n", " ", ""]

CHUNK_STRUCT = T.StructType([
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("text", T.StringType()),
])


def check_chunk_args(size: int, overlap: int) -> None:
    if not (isinstance(size, int) and isinstance(overlap, int)):
        raise TypeError("chunk size and overlap must be integers")
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size}, overlap={overlap}")


# --------------------------------------------------------------------- C2

def stride_starts(text_col, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """0-based chunk starts 0, step, 2*step, ... up to the first chunk that
    reaches the end of the text; no chunk for an empty/NULL text."""
    check_chunk_args(size, overlap)
    n = F.length(_c(text_col))
    step = size - overlap
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))


def stride_chunk_count(text_col, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Number of C2 chunks of a text without building them."""
    check_chunk_args(size, overlap)
    n = F.length(_c(text_col))
    step = size - overlap
    return F.when(n > 0, F.floor(F.greatest(n - overlap - 1, F.lit(0)) / step) + 1).otherwise(0).cast("long")


def fixed_stride_chunks(df: DataFrame, text_col: str = "text", size: int = K.CHUNK_SIZE,
                        overlap: int = K.CHUNK_OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``keep`` columns + chunk_no, start, text.

    ``text = substring(text, start + 1, size)``. Narrow: runs inside the scan
    stage, the whole text is never copied per chunk.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    out = df.select(*keep, F.col(text_col).alias("_t"),
                    F.posexplode(stride_starts(text_col, size, overlap)).alias("chunk_no", "start"))
    return out.select(*keep, F.col("chunk_no").cast("int").alias("chunk_no"),
                      F.col("start").cast("int").alias("start"),
                      F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias(text_col))


# --------------------------------------------------------------------- C4

def chunk_id(*cols) -> Column:
    """C4: deterministic id = sha256 over the identifying columns joined by \\u0001."""
    return F.sha2(F.concat_ws("\u0001", *[_c(c).cast("string") for c in cols]), 256)


# --------------------------------------------------------------------- C1

def _packed(starts, ends, first: int, last: int, size: int, overlap: int):
    """Spans over the pieces first..last, each as many whole pieces as fit into
    ``size``. The next span starts with the earliest piece that leaves at most
    ``overlap`` shared characters and room for the piece after the span."""
    while first <= last:
        stop = max(first, bisect_right(ends, starts[first] + size, first, last + 1) - 1)
        yield starts[first], ends[stop]
        if stop == last:
            return
        least = max(ends[stop] - overlap, ends[stop + 1] - size)
        first = bisect_left(starts, least, first + 1, stop + 1)


def _spans(text: str, lo: int, hi: int, size: int, overlap: int, seps: list[str]):
    """Chunk spans of text[lo:hi]: pieces between the coarsest separator in it
    are packed; a piece above ``size`` is cut by the finer separators."""
    level = next((i for i, sep in enumerate(seps) if text.find(sep, lo, hi) >= 0), len(seps) - 1)
    sep, finer = seps[level], seps[level + 1:]
    if not sep:
        yield from _packed(range(lo, hi), range(lo + 1, hi + 1), 0, hi - lo - 1, size, overlap)
        return
    at = [m.start() for m in re.compile(re.escape(sep)).finditer(text, lo, hi)]
    starts, ends = [lo, *(i + len(sep) for i in at)], [*at, hi]
    for fits, run in groupby(range(len(starts)), lambda i: ends[i] - starts[i] <= size):
        own = list(run)
        if fits:
            yield from _packed(starts, ends, own[0], own[-1], size, overlap)
        else:
            for i in own:
                yield from _spans(text, starts[i], ends[i], size, overlap, finer) if finer else [(starts[i], ends[i])]


def recursive_split(text: str | None, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                    seps: list[str] | None = None) -> list[tuple[int, int, str]]:
    """C1 on one string: [(chunk_no, start, text)]; start is the 0-based
    offset of the (stripped) chunk in the input."""
    check_chunk_args(size, overlap)
    if not text:
        return []
    out = []
    for lo, hi in _spans(text, 0, len(text), size, overlap, list(seps or RECURSIVE_SEPARATORS)):
        core = text[lo:hi].lstrip()
        if core:
            out.append((len(out), hi - len(core), core.rstrip()))
    return out


def recursive_chunk_udf(size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP):
    check_chunk_args(size, overlap)

    @F.pandas_udf(T.ArrayType(CHUNK_STRUCT))
    def _chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [
            {"chunk_no": i, "start": s, "text": c} for i, s, c in recursive_split(t, size, overlap)])

    return _chunk


def recursive_chunks(df: DataFrame, text_col: str = "text", size: int = K.CHUNK_SIZE,
                     overlap: int = K.CHUNK_OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``keep`` columns + chunk_no, start, text.

    Arrow-batched; rows stay in their partition (no shuffle). Very large
    texts are better cut with C2 first and the pieces chunked per task.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    udf = recursive_chunk_udf(size, overlap)
    out = df.select(*keep, F.explode(udf(F.col(text_col))).alias("_c"))
    return out.select(*keep, "_c.chunk_no", "_c.start", F.col("_c.text").alias(text_col))


# --------------------------------------------------------------------- U7

def register_chunk_table_function(spark, name: str = "chunk_text"):
    """``SELECT * FROM docs, LATERAL chunk_text(text, 1000, 200)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_no: int, start: int, chunk: string", useArrow=True)
    class ChunkText:
        def eval(self, text, size=K.CHUNK_SIZE, overlap=K.CHUNK_OVERLAP):
            for i, s, c in recursive_split(text, int(size), int(overlap)):
                yield i, s, c

    spark.udtf.register(name, ChunkText)
    return ChunkText


def chunk_invariants_hold(text: str, chunks: list[tuple[int, int, str]], size: int, overlap: int) -> bool:
    """Test helper for C1's contract: every chunk <= size and equal to the
    text at its offset, offsets non-decreasing, and the chunks together cover
    every non-whitespace character of the text."""
    covered = set()
    last = -1
    for _, at, c in chunks:
        if len(c) > size or text[at:at + len(c)] != c or at < last:
            return False
        last = at
        covered.update(range(at, at + len(c)))
    return all(i in covered for i, ch_ in enumerate(text) if not ch_.isspace())


__all__ = ["fixed_stride_chunks", "stride_starts", "stride_chunk_count", "chunk_id",
           "recursive_chunks", "recursive_split", "register_chunk_table_function", "strip"]
