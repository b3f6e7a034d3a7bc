"""Training-data operators (top-k search, decontamination, sharding, near-duplicates,
byte-level BPE, personal data, chat formatting, line duplicates, secrets, quality,
conversation tries, language-model scores, embedding whitening).

Nothing else in the library imports this subpackage. ``all_queries()`` and
``all_oracles()`` list its catalogue queries and their DuckDB twins."""


def all_queries():
    from corpusworks.llm import queries
    return dict(queries.QUERIES)


def all_oracles():
    from corpusworks.llm import queries
    return dict(queries.ORACLE)
