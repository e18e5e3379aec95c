"""Look-ups between the tables: what is unseen, where things are stored, what is orphaned.

No side is broadcast by hint: seen sets and registries grow with the corpus, so the choice
is left to AQE, which knows their measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(links: DataFrame, documents: DataFrame, link_col: str = "clean_url") -> DataFrame:
    """Links whose clean URL is not among the stored documents."""
    return links.join(documents.select(F.col("clean_url").alias(link_col)), link_col, "left_anti")


def unfetched(refs: DataFrame, registry: DataFrame) -> DataFrame:
    return refs.join(registry.select("url"), "url", "left_anti")


def fetched(refs: DataFrame, registry: DataFrame) -> DataFrame:
    return refs.join(registry.select("url"), "url", "left_semi")


def lookup_paths(urls: DataFrame, mappings: DataFrame, default: str = "unknown") -> DataFrame:
    """Add ``local_path`` of every clean URL, ``default`` where none is known."""
    paths = mappings.select("clean_url", F.col("local_path").alias("__path"))
    return (
        urls.join(paths, "clean_url", "left")
        .withColumn("local_path", F.coalesce("__path", F.lit(default)))
        .drop("__path")
    )


def lookup_resources(refs: DataFrame, registry: DataFrame, transversal_only: bool = False) -> DataFrame:
    """Add ``local_path`` of every resource URL, NULL where it is not stored."""
    known = registry.where("is_transversal") if transversal_only else registry
    return refs.join(known.select("url", "local_path"), "url", "left")


def page_attachments(metadata: DataFrame, attachments: DataFrame) -> DataFrame:
    return metadata.join(attachments.withColumnRenamed("page_url", "url"), "url")


def pages_in_space(metadata: DataFrame, space_key: str) -> DataFrame:
    """A filter, so a table partitioned by space_key is pruned to one directory."""
    return metadata.where(F.col("space_key") == space_key)


def page_metadata(metadata: DataFrame, url: str) -> DataFrame:
    return metadata.where(F.col("url") == url)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose foreign key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")
