"""Rows that travel as packed blobs: a few per task and bucket instead of one per item."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webtables.session import cut_lineage, importable

__all__ = ["arrow_schema", "bucket_count", "by_bucket", "importable", "stored"]

BLOBS = "bucket int, blob binary"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bucket_count(spark: SparkSession, factor: int = 8) -> int:
    """Buckets of an exchange: in proportion to the shuffle partitions the cluster is set to."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(blobs: DataFrame, task: Callable[[list], Iterator], schema: str) -> DataFrame:
    """Run ``task`` on the blobs of each bucket; it yields Arrow batches."""
    def grouped(batches: Iterator) -> Iterator:
        held: list = []
        for batch in batches:
            held.extend(batch.column("blob").to_pylist())
        yield from task(held)

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(grouped(iter(table.to_batches()))), target)

    target = arrow_schema(schema)
    return blobs.groupBy("bucket").applyInArrow(whole, schema)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _arrow_type(name: str) -> pa.DataType:
    return pa.list_(_arrow_type(name[6:-1])) if name.startswith("array<") else _TYPES[name]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of plain columns; works inside tasks as well."""
    return pa.schema([(name, _arrow_type(kind)) for name, kind in (c.split() for c in ddl.split(","))])


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def stored(df: DataFrame) -> DataFrame:
    """Write a step's result to the shared folder, drop its shuffle files, and read it back."""
    with _cleaned(df.sparkSession):
        return cut_lineage(df)
