"""Reading fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtables import schema as S
from webtables.session import prepare


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages table with its declared schema, so no file is opened just to infer one."""
    return prepare(spark).read.schema(S.PAGES).parquet(path)


def dealt(pages: DataFrame) -> DataFrame:
    """The rows of a plain scan dealt out to all cores, if the scan has fewer splits than there are cores.

    For jobs that spend long on every page: a table of one file with one row group would keep a single core busy.
    A table of many splits is returned as it is, so nothing is shuffled at size.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages if pages.rdd.getNumPartitions() >= cores else pages.repartition(cores)
