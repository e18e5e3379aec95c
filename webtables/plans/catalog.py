"""All registered queries and SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("url_jobs", "page_jobs", "table_jobs", "report_jobs", "wiki_jobs", "stream_jobs")


def _gather(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"webtables.plans.{name}"), attribute))
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
