"""Query catalogue: every operator registered as ``name -> fn(spark, sf_dir)``
with a DuckDB oracle where SQL can express it."""

from corpusworks.plans.registry import ORACLE, QUERIES
from corpusworks.plans import (  # noqa: F401  (register the catalogue)
    bpe_queries, corpus_queries, docs_queries, file_queries, misc_queries, retrieval_queries, session_queries, stream_queries, text_queries)


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
