"""Streams: arriving pages and the crawl log.

State is bounded everywhere: duplicates are remembered for the watermark delay, windows
close behind it, and the status table is kept as small mergeable folds per batch instead
of being rewritten. All sinks name their output after the batch id, so a replayed batch
overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webtables.operators import tracker as T
from webtables.operators.links import link_rows
from webtables.operators.scope import Rules
from webtables.streaming.folds import EVERY, read_folds, to_folds


def stream_links(pages: DataFrame, rules: Rules) -> DataFrame:
    """In-scope links of arriving pages: stateless, append, no shuffle."""
    return link_rows(pages, rules)


def stream_new_urls(links: DataFrame, delay: str = "1 hour", ts: str = "ts", key: str = "clean_url") -> DataFrame:
    """First sight of every URL within the delay."""
    return links.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_progress(log: DataFrame, every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Pages, bytes and errors per tumbling window of event time."""
    action = F.col("action")
    done = action == "complete"
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", every).alias("w"))
        .agg(
            F.count_if(done).alias("pages"),
            F.coalesce(F.sum(F.when(done, F.col("file_size"))), F.lit(0)).alias("bytes"),
            F.count_if(action == "fail").alias("errors"),
        )
        .select(F.col("w.start").alias("window_start"), "pages", "bytes", "errors")
    )


def stream_stalled(log: DataFrame, after: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Claims that saw no completion or failure of their URL in time.

    A row comes out once the watermark has passed the end of its time.
    """
    # Each side carries its own event time under its own name, as the join condition needs.
    claims = log.where("action = 'claim'").select(
        F.col("clean_url").alias("claim_url"), F.col("ts").alias("claimed_at"), F.col("event_id").alias("claim_id")
    )
    ends = log.where("action IN ('complete', 'fail')").select(
        F.col("clean_url").alias("end_url"), F.col("ts").alias("ended_at")
    )
    claims, ends = claims.withWatermark("claimed_at", delay), ends.withWatermark("ended_at", delay)
    in_time = F.expr(
        f"claim_url = end_url AND ended_at >= claimed_at AND ended_at <= claimed_at + INTERVAL {after}"
    )
    joined = claims.join(ends, in_time, "leftOuter")
    return joined.where("end_url IS NULL").select(F.col("claim_url").alias("clean_url"), "claimed_at", "claim_id")


# --- sinks -----------------------------------------------------------------------------


def to_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write every micro-batch to its own directory ``batch=<id>`` and stop when caught up."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def stream_status(log: DataFrame, path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Fold arriving status events; each batch stores the fold of its own events, and folds are compacted in levels."""
    return to_folds(log, path, checkpoint, lambda rows, _: T.partial_fold(rows), T.merge_folds, every=every)


def current_status(discovered: DataFrame, path: str, every: int = EVERY) -> DataFrame:
    """The status table as of the folds stored so far."""
    fold = read_folds(discovered.sparkSession, path, T.merge_folds, every)
    return discovered if fold is None else T.apply_fold(discovered, fold)


def _last_windows(rows: DataFrame, key: str = "window_start") -> DataFrame:
    return T.last_per_key(rows, [key], ["batch"])


def stream_windows(windows: DataFrame, path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Store the windows of an aggregate in update mode; of each window the last state counts."""
    return to_folds(windows, path, checkpoint, lambda rows, n: rows.withColumn("batch", F.lit(n).cast("bigint")), _last_windows, "update", every)


def latest_windows(spark: SparkSession, path: str, every: int = EVERY) -> DataFrame | None:
    """Last state of every window stored so far; None before the first batch."""
    rows = read_folds(spark, path, _last_windows, every)
    return rows.drop("batch") if rows is not None else None
