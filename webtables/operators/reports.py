"""Reports over the tracker tables. Each is one scan with a partial and a final aggregate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions.formats import human_size

BAR_WIDTH = 40


def status_counts(discovered: DataFrame) -> DataFrame:
    return discovered.groupBy("status").agg(F.count("*").alias("n"))


def status_share(discovered: DataFrame) -> DataFrame:
    """Counts and percentages by status, and a Total row. Nothing for an empty table.

    The window runs over the handful of status groups, never over URLs.
    """
    counts = discovered.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g"))
    total = F.max(F.when(F.col("g") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return (
        counts.withColumn("total", total)
        .where("total > 0")
        .select(
            F.when(F.col("g") == 1, "Total").otherwise(F.initcap("status")).alias("status"),
            "n",
            (F.col("n") / F.col("total") * 100).alias("percentage"),
        )
    )


def totals(documents: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: counts, byte sums (0 when nothing is known) and their readable forms."""
    sizes = documents.select(F.lit(True).alias("doc"), "file_size").unionByName(
        resources.select(F.lit(False).alias("doc"), "file_size")
    )
    size = F.col("file_size")
    sums = sizes.agg(
        F.count_if("doc").alias("total_documents"),
        F.count_if(~F.col("doc")).alias("total_resources"),
        F.coalesce(F.sum(F.when(F.col("doc"), size)), F.lit(0)).alias("total_documents_size"),
        F.coalesce(F.sum(F.when(~F.col("doc"), size)), F.lit(0)).alias("total_resources_size"),
    )
    sums = sums.withColumn("total_size", F.col("total_documents_size") + F.col("total_resources_size"))
    return sums.withColumns(
        {
            "documents_size_text": human_size(F.col("total_documents_size")),
            "resources_size_text": human_size(F.col("total_resources_size")),
            "total_size_text": human_size(F.col("total_size")),
        }
    )


def _by_status() -> dict[str, Column]:
    return {s: F.count_if(F.col("status") == s) for s in ("pending", "downloading", "completed", "failed")}


def url_totals(discovered: DataFrame) -> DataFrame:
    n = _by_status()
    return discovered.agg(
        F.count("*").alias("total_discovered"), n["completed"].alias("total_completed"), n["failed"].alias("total_failed")
    )


def resource_breakdown(resources: DataFrame) -> DataFrame:
    return (
        resources.groupBy("resource_type")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"))
        .withColumn("size_text", human_size(F.col("total_size")))
        .orderBy(F.desc("n"), "resource_type")
    )


def recent_activity(documents: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Documents per day of the last days, newest first."""
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        documents.where(F.col("downloaded_at") >= bound)
        .groupBy(F.to_date("downloaded_at").alias("day"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("day"))
    )


def top_failed(discovered: DataFrame, k: int = 10) -> DataFrame:
    """The k failed URLs retried most; a top-k, so no full sort takes place."""
    return (
        discovered.where("status = 'failed'")
        .orderBy(F.desc("retry_count"), F.desc("discovered_at"), "clean_url")
        .limit(k)
        .select("clean_url", "error_message", "retry_count")
    )


def progress(discovered: DataFrame, width: int = BAR_WIDTH) -> DataFrame:
    n = _by_status()
    row = discovered.agg(F.count("*").alias("total"), *[c.alias(s) for s, c in n.items()]).where("total > 0")
    return row.select(
        "total", "completed", "pending", F.col("downloading").alias("active"), "failed",
        (F.col("completed") / F.col("total") * 100).alias("percentage"),
        F.expr(f"({width} * completed) div total").alias("bar_fill"),
    )


def success_rate(discovered: DataFrame) -> DataFrame:
    n = _by_status()
    row = discovered.agg(n["completed"].alias("done"), n["failed"].alias("failed"))
    finished = F.col("done") + F.col("failed")
    rate = F.when(finished == 0, 100.0).otherwise(F.try_divide("done", finished) * 100)
    return row.select("done", "failed", rate.alias("success_rate"))


def throughput(log: DataFrame) -> DataFrame:
    """Pages per second over the span of the log and the seconds the queue still takes.

    ``log`` has ts, action and clean_url; the queue are URLs that were seen but neither
    claimed nor finished.
    """
    per_url = log.groupBy("clean_url").agg(
        F.count_if(F.col("action") == "complete").alias("done"),
        F.max(F.when(F.col("action").isin("claim", "complete", "fail"), 1).otherwise(0)).alias("touched"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
    )
    row = per_url.agg(
        F.sum("done").alias("done"), F.count_if(F.col("touched") == 0).alias("queued"),
        (F.unix_micros(F.max("t1").cast("timestamp")) - F.unix_micros(F.min("t0").cast("timestamp"))).alias("micros"),
    )
    speed = F.when(F.col("micros") > 0, F.col("done") / (F.col("micros") / 1000000.0))
    row = row.withColumn("pages_per_second", speed)
    eta = F.when(
        (F.col("pages_per_second") > 0) & (F.col("queued") > 0),
        F.floor(F.col("queued") / F.col("pages_per_second")).cast("bigint"),
    )
    return row.select("done", "queued", "pages_per_second", eta.alias("eta_seconds"))


def run_state(discovered: DataFrame) -> DataFrame:
    n = _by_status()
    row = discovered.agg(n["pending"].alias("queued"), n["completed"].alias("done"), n["failed"].alias("failed"))
    state = (
        F.when(F.col("queued") > 0, "in progress")
        .when(F.col("failed") > F.col("done"), "with errors")
        .otherwise("completed")
    )
    return row.select(state.alias("run_state"))


def space_summary(metadata: DataFrame) -> DataFrame:
    """One synthetic record per space: its pages and the links they stand for."""
    return metadata.groupBy("space_key").agg(F.count("*").alias("page_count")).select(
        F.concat(F.lit("space-"), "space_key").alias("id"),
        F.concat(F.lit("Space: "), "space_key").alias("title"),
        "space_key", "page_count",
    )
