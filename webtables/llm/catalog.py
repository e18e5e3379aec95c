"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from webtables.llm.queries import QUERIES
from webtables.llm.sql import ORACLE


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
