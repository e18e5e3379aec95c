"""Writing: table export, URL lists, page documents, table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions import urls as U

EXPORTED = ("discovered_urls", "downloaded_documents", "downloaded_resources", "url_mappings")


def export_json(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One directory of JSON lines per exported table; statistics and wiki tables stay out.

    NULL columns are written too, so a reader sees every column of every row.
    """
    written = []
    for name in EXPORTED:
        if name in tables:
            tables[name].write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")
            written.append(name)
    return written


def url_list(discovered: DataFrame, status: str = "completed") -> DataFrame:
    """(clean_url) of one status in order, duplicates kept."""
    return discovered.where(F.col("status") == status).select("clean_url").orderBy("clean_url")


def export_urls(discovered: DataFrame, path: str, status: str = "completed") -> bool:
    """Write the list as text, range-partitioned so that files follow each other in order.

    Nothing is written, and False returned, when no URL has the status.
    """
    urls = url_list(discovered, status)
    if urls.isEmpty():
        return False
    urls.write.mode("errorifexists").text(path)
    return True


def document_rows(docs: DataFrame, content: Column | str = "content") -> DataFrame:
    """Add what is stored about a rendered page: host and size in bytes."""
    c = F.col(content) if isinstance(content, str) else content
    return docs.withColumns(
        {"host": F.lower(U.netloc("clean_url")), "file_size": F.octet_length(c).cast("bigint")}
    )


def write_documents(docs: DataFrame, path: str, by: str = "host", per_file: int = 1_000_000) -> None:
    """Rendered pages as Parquet partitioned by host (or space_key).

    The rebalance hint lets AQE size the writing tasks: one huge host is split over many
    of them, many small hosts share one and get a single file each. With very many hosts
    pass a coarser column as ``by``, for every value becomes a directory.
    """
    (
        docs.hint("rebalance", by)
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", per_file)
        .partitionBy(by)
        .parquet(path)
    )
