"""Small relational operators: ranked preference match (J4), lookup with
default (J5), distinct union of name lists (A6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3        # characters of a gram; shorter preferences are a gram as they are


def preference_table(spark, preferences: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(preferences)], "pref_rank int, pref string")


def _grams(text: str, sizes: list[int]) -> F.Column:
    """The distinct stretches of the given lengths in a text."""
    def of(k):
        n = F.length(text) - k + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col(text), i, F.lit(k)))) \
            .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) if k else F.array(F.lit("")) for k in sizes]))


def containing(names: DataFrame, prefs: DataFrame, name_col: str = "name") -> DataFrame:
    """Distinct names and the best rank of a preference that is a substring of the lower-cased name:
    ``name_col``, pref_rank. Each preference is found by its rarest gram among the names, an equi-join, and
    verified; both lists may be of any length."""
    wanted = prefs.where(F.col("pref").isNotNull()).select("pref_rank", "pref")
    sizes = sorted(r[0] for r in wanted.select(F.least(F.length("pref"), F.lit(GRAM))).distinct().collect())      # 4 at most
    if not sizes:
        return names.select(name_col, F.lit(None).cast("int").alias("pref_rank")).limit(0)
    low = names.select(name_col).where(F.col(name_col).isNotNull()).distinct().withColumn("_low", F.lower(name_col))
    grams = low.select(name_col, "_low", F.explode(_grams("_low", sizes)).alias("_gram"))
    often = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    own = wanted.select("pref_rank", "pref", F.explode(_grams("pref", sizes)).alias("_gram")).where(
        F.length("_gram") == F.least(F.length("pref"), F.lit(GRAM)))
    keys = own.join(often, "_gram").groupBy("pref_rank", "pref").agg(F.min_by("_gram", F.struct("_often", "_gram")).alias("_gram"))
    return (grams.join(keys, "_gram").where(F.contains(F.col("_low"), F.col("pref")))
            .groupBy(name_col).agg(F.min("pref_rank").alias("pref_rank")))


def ranked_preference(names: DataFrame, prefs: DataFrame, group_cols: list[str], name_col: str = "name",
                      pos_col: str = "pos") -> DataFrame:
    """Per group pick the name matching the best-ranked preference
    (preference is a substring of the lower-cased name), earliest position
    first; if nothing matches, the group's first name."""
    m = names.join(containing(names, prefs, name_col), name_col)
    best = m.groupBy(*group_cols).agg(F.min_by(name_col, F.struct("pref_rank", pos_col)).alias("_best"))
    first = names.groupBy(*group_cols).agg(F.min_by(name_col, pos_col).alias("_first"))
    return first.join(best, group_cols, "left").select(
        *group_cols, F.coalesce("_best", "_first").alias("chosen"),
        F.col("_best").isNotNull().alias("matched"))


def lookup_with_default(df: DataFrame, mapping: dict[str, str], key_col: str, default: str,
                        out_col: str = "mapped") -> DataFrame:
    """Key -> value from a fixed mapping, ``default`` for missing keys: joined as a table
    (left join, AQE decides broadcast vs shuffle)."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"`{key_col}` string, _v string")
    return lookup_table_with_default(df, table, key_col, "_v", default, out_col)


def lookup_table_with_default(df: DataFrame, table: DataFrame, key_col: str, value_col: str,
                              default: str, out_col: str = "mapped") -> DataFrame:
    """J5 with a table: left join on the key (AQE broadcasts a small table)."""
    t = table.select(F.col(key_col).alias("_k"), F.col(value_col).alias("_v"))
    j = df.join(t, df[key_col] == t["_k"], "left")
    return j.withColumn(out_col, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def union_names(*frames: DataFrame, col: str = "name") -> DataFrame:
    """Distinct union of several one-column name lists, sorted."""
    out = frames[0].select(F.col(frames[0].columns[0]).alias(col))
    for f in frames[1:]:
        out = out.union(f.select(F.col(f.columns[0]).alias(col)))
    return out.distinct().orderBy(col)
