"""Embedding a text column.

Default embedder: hashed term frequencies. Terms = runs of letters/digits of
the lower-cased text; bucket = first 24 bits of md5(term) mod ``dim``;
vector = bucket counts, L2-normalised (all zero for a text without terms).
Bucket ids are computed JVM-side; only the per-row ``bincount`` runs in an
Arrow batch. A user model plugs in through ``embed_with`` (batched
``predict_batch_udf`` from pyspark.ml, one model per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM_PATTERN = r"[\p{L}\p{N}]+"
DEFAULT_DIM = 64


def term_buckets(text_col, dim: int = DEFAULT_DIM) -> Column:
    words = F.regexp_extract_all(F.lower(F.col(text_col) if isinstance(text_col, str) else text_col),
                                 F.lit(TERM_PATTERN), 0)
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"),
                                               F.lit(dim)).cast("int"))


def hashed_terms(df: DataFrame, id_col: str, text_col: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """Long form: id, bucket, n (term count in that bucket)."""
    return (df.select(id_col, F.explode(term_buckets(text_col, dim)).alias("bucket"))
            .groupBy(id_col, "bucket").agg(F.count(F.lit(1)).alias("n")))


def _dense_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dense(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            v = np.bincount(np.asarray(b, dtype=np.int64), minlength=dim).astype(np.float64) \
                if b is not None and len(b) else np.zeros(dim)
            n = np.sqrt((v * v).sum())
            out.append((v / n if n > 0 else v).astype(np.float32))
        return pd.Series(out)
    return dense


def embed_hashed(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM,
                 out_col: str = "embedding") -> DataFrame:
    """Dense hashed-TF embedding as ARRAY<FLOAT>; narrow (no shuffle)."""
    return df.withColumn(out_col, _dense_udf(dim)(term_buckets(text_col, dim)))


def embed_with(df: DataFrame, make_model: Callable, text_col: str = "text", dim: int = DEFAULT_DIM,
               out_col: str = "embedding", batch_size: int = 64) -> DataFrame:
    """User embedder. ``make_model()`` runs once per Python worker and
    returns ``fn(np.ndarray[str]) -> np.ndarray[float, (n, dim)]``."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return df.withColumn(out_col, udf(F.col(text_col)))
