"""Import of legacy progress files (one JSON object per crawl)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables import schema as S
from webtables.functions import urls as U
from webtables.operators import tracker as T
from webtables.operators.quarantine import judge, sort_out
from webtables.operators.resources import resource_type


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(local_path, file_size) of the files under ``root``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E/", "").alias("local_path"), F.col("length").alias("file_size")
    )


def import_progress(spark: SparkSession, path: str, files: DataFrame | None = None, most_bad: float = 1.0) -> dict[str, DataFrame]:
    """Tracker tables out of progress files (a file, a directory or a glob).

    Files that hold no JSON object of the format are left out and listed in ``bad`` (file, json, problem); more than the share
    ``most_bad`` of them fails the import (see quarantine).

    Both generations of key names are read. ``files`` gives the size of stored files. The
    maps of a file are exploded and joined rather than looked up row by row, so that no
    row carries a whole map around. ``raw`` keeps what migration_summary counts.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    # Each file is parsed once; the outputs below read only their columns of the stored table.
    good, bad = sort_out(judge(whole, S.PROGRESS_FILE, "progress"), "progress", most_bad)
    raw = good.select(
        "file",
        F.coalesce("progress.downloaded_urls", "progress.completed_urls").alias("urls"),
        F.coalesce("progress.download_queue", "progress.url_queue").alias("queue"),
        "progress.url_to_filename", "progress.downloaded_resources", "progress.transversal_resources",
    )
    sizes = files if files is not None else spark.createDataFrame([], "local_path string, file_size bigint")

    def entries(column: str, key: str) -> DataFrame:
        return raw.select("file", F.explode(column).alias(key, "local_path"))

    def with_size(df: DataFrame) -> DataFrame:
        # A missing path stays NULL in the join, so paths that are missing do not meet in one key.
        return df.join(sizes, "local_path", "left").withColumn("local_path", F.coalesce("local_path", F.lit("")))

    done = raw.select("file", F.posexplode("urls").alias("pos", "url")).join(entries("url_to_filename", "url"), ["file", "url"], "left")
    done = with_size(done.select("file", "pos", U.clean_url("url").alias("clean_url"), "local_path"))
    documents = T.last_per_key(done, ["clean_url"], ["file", "pos"]).select(
        F.col("clean_url").alias("url"), "clean_url", "local_path", "file_size", F.lit(0).alias("depth"), F.lit(0).alias("links_extracted")
    )
    shared = entries("transversal_resources", "url").withColumn("is_transversal", F.lit(True))
    res = raw.select("file", F.posexplode("downloaded_resources").alias("pos", "url")).join(shared, ["file", "url"], "left")
    res = T.last_per_key(with_size(res), ["url"], ["file", "pos"]).select(
        "url", "local_path", resource_type("url").alias("resource_type"), "file_size",
        F.coalesce("is_transversal", F.lit(False)).alias("is_transversal"),
    )
    queue = raw.select("file", F.posexplode("queue").alias("pos", "item")).where(F.size("item") >= 2)
    queue = queue.select("file", "pos", F.col("item")[0].alias("url"), F.col("item")[1].cast("int").alias("depth"))
    queue = T.first_per_key(queue, ["url"], ["file", "pos"]).select(
        "url", U.clean_url("url").alias("clean_url"), "depth", F.lit("pending").alias("status"), F.lit(0).alias("retry_count")
    )
    return {
        "downloaded_documents": S.conform(documents, S.DOCUMENTS),
        "downloaded_resources": S.conform(res, S.RESOURCES),
        "url_mappings": S.conform(documents.select("clean_url", "local_path"), S.MAPPINGS),
        "discovered_urls": S.conform(queue, S.DISCOVERED),
        "raw": raw,
        "bad": bad,
    }


def migration_summary(imported: dict[str, DataFrame]) -> DataFrame:
    """(item, n): URLs, resources and mappings read, queue items added."""
    sizes = imported["raw"].select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("item"), F.coalesce(F.size(column), F.lit(0)).alias("n"))
                    for name, column in (("urls", "urls"), ("resources", "downloaded_resources"), ("mappings", "url_to_filename"))
                ]
            )
        ).alias("s")
    ).select("s.*")
    counted = sizes.groupBy("item").agg(F.sum(F.greatest("n", F.lit(0))).alias("n"))
    queued = imported["discovered_urls"].agg(F.count("*").alias("n")).select(F.lit("queue_items").alias("item"), "n")
    return counted.unionByName(queued)
