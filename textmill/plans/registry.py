"""All registered queries of the library's own operators, with their DuckDB SQL."""

from __future__ import annotations

from textmill.plans import base, data_queries, text_queries  # noqa: F401

flagship = text_queries.flagship


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
