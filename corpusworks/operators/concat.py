"""Corpus concatenation per group.

``concat_layout`` places every text inside its group's concatenation
(start offset, length) using distributed prefix sums - the corpus is never
gathered. ``capped_concat`` materialises only the first ``cap`` characters of
each group: it keeps the rows whose separator-start lies before the cap, cuts
each of them to what can still fit, and joins those (bounded) pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import constants as K
from corpusworks.operators.prefix import running_offsets


def concat_layout(df: DataFrame, group_cols: list[str], order_cols: list[str], text_col: str = "text",
                  sep: str = K.PARAGRAPH_SEP) -> DataFrame:
    """A4 layout: group, order, length, start (0-based offset of the text in
    the group's concatenation) and total (length of the concatenation)."""
    lens = df.select(*group_cols, *order_cols, F.length(text_col).alias("length"))
    off = running_offsets(lens, group_cols, order_cols, "length", len(sep))
    return off.select(*group_cols, *order_cols, F.col("length").cast("long").alias("length"),
                      F.col("start").cast("long").alias("start"),
                      (F.col("group_total") - len(sep)).cast("long").alias("total"))


def concat_texts(df: DataFrame, group_cols: list[str], order_cols: list[str], text_col: str = "text",
                 sep: str = K.PARAGRAPH_SEP) -> DataFrame:
    """A4 as one string per group. Only for groups known to be small: the
    whole group becomes one value. Use ``capped_concat`` for corpora."""
    parts = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col(text_col).alias("_t"))))
    return df.groupBy(*group_cols).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias(text_col))


def capped_concat(df: DataFrame, group_cols: list[str], order_cols: list[str], text_col: str = "text",
                  cap: int = K.CONTENT_CAP, notice: str | None = K.CAP_NOTICE,
                  sep: str = K.PARAGRAPH_SEP) -> DataFrame:
    """A5 + F11: per group ``full = sep.join(texts in order)`` (null keys are keys like
    any other, a null text is an empty one, rows with equal keys stand by a hash of the text); if
    ``len(full) > cap`` the result is ``full[:cap] + notice`` (notice may be
    None), else ``full``. Returns group, text, full_length."""
    s = len(sep)
    keys = list(group_cols) + list(order_cols)
    # rows are told apart by keys and text: rows alike in both are the same piece several
    # times, so repeated or null order keys multiply nothing (their texts go by hash)
    texts = df.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_m", F.xxhash64("_t"))
    lens = texts.select(*keys, "_m", F.length("_t").alias("length"))
    layout = running_offsets(lens, group_cols, [*order_cols, "_m"], "length", s)
    # a row matters if its separator starts before the cap (the separator itself may be cut by
    # the cap); empty texts without a separator add nothing
    head = layout.filter((F.col("start") < F.lit(cap + s)) & ((F.col("length") > 0) | F.lit(s > 0)))
    places = head.groupBy(*keys, "_m").agg(F.collect_list("start").alias("_at"),      # at most cap places in a group
                                           F.max("group_total").alias("_total"))
    named = texts.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_m")], F.substring("_t", 1, cap).alias("_t"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_m")])
    once = places.join(named, same, "inner").select(*keys, "_m", "_at", "_total", "_t").dropDuplicates([*keys, "_m"])
    pieces = once.select(*group_cols, "_t", "_total", F.explode("_at").alias("start")).select(
        *group_cols, "start", "_total", F.expr(f"substring(_t, 1, greatest({cap} - start, 0))").alias("_p"))
    if not s:                                                       # groups of empty texts only
        pieces = pieces.unionAll(df.select(*group_cols, F.lit(0).alias("start"), F.lit(0).alias("_total"),
                                           F.lit("").alias("_p")).distinct())
    parts = F.sort_array(F.collect_list(F.struct("start", "_p")))
    joined = pieces.groupBy(*group_cols).agg(F.array_join(F.transform(parts, lambda x: x["_p"]), sep).alias("_j"),
                                             (F.max("_total") - s).alias("full_length"))
    cut = F.substring("_j", 1, cap)
    if notice:
        cut = F.concat(cut, F.lit(notice))
    return joined.select(*group_cols, F.when(F.col("full_length") > cap, cut).otherwise(F.col("_j")).alias(text_col),
                         F.col("full_length").cast("long").alias("full_length"))
