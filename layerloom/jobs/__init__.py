"""Registered queries and their SQL."""


def all_queries() -> dict:
    from layerloom.jobs import details, episodes, library, queries, replies  # noqa: F401  (the others register theirs with ``queries``)

    return dict(queries.QUERIES)


def all_sql() -> dict[str, str]:
    from layerloom.jobs import details, episodes, library_oracles, oracles, replies

    return oracles.SQL | library_oracles.SQL | replies.SQL | episodes.SQL | details.SQL
