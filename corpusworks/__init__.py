"""corpusworks: PySpark toolkit for preparing and querying text corpora.

Every operator takes and returns DataFrames; work is expressed with
DataFrame/SQL expressions first and Arrow-batched functions second.
"""

from corpusworks.session import get_spark, scratch_dir, load_table

__all__ = ["get_spark", "scratch_dir", "load_table"]
