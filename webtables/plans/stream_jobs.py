"""Streaming queries run over the files that are there, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webtables.functions import urls as U
from webtables.plans import inputs as I
from webtables.plans import page_jobs as P
from webtables.session import checkpoint_dir, prepare
from webtables.streaming import jobs as J
from webtables.streaming import queue as Q


# Files that one micro-batch reads at most; the rest waits for the next one.
FILES_PER_TRIGGER = 64
# How far events may arrive out of order.
LATE = "1 day"


def _room(spark) -> str:
    """A fresh folder in the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """The table as a stream of its files, whether it is one file or a folder of them."""
    batch = I.table(spark, sf, name)
    # A plain path would have to be a folder; a pattern is looked up, and may find a file as well.
    stream = prepare(spark).readStream.schema(batch.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    return stream.parquet(f"{sf}/{name}.parque[t]")


def _run(stream, room, mode="append"):
    J.to_batches(stream, f"{room}/out", f"{room}/ckpt", mode).awaitTermination()
    return J.read_batches(stream.sparkSession, f"{room}/out").drop("batch")


def stream_links(spark, sf):
    return _run(J.stream_links(_stream(spark, sf, "pages"), P.LINKS), _room(spark)).distinct()


def stream_dedup(spark, sf):
    """First sight of every crawled URL; the whole log lies within one delay."""
    log = I.log_of(_stream(spark, sf, "events")).select("ts", U.clean_url("clean_url").alias("clean_url"))
    return _run(J.stream_new_urls(log, "60 days"), _room(spark)).select("clean_url")


def stream_status(spark, sf):
    room = _room(spark)
    J.stream_status(I.log_of(_stream(spark, sf, "events")), f"{room}/out", f"{room}/ckpt").awaitTermination()
    status = J.current_status(I.discovered_new(spark, sf), f"{room}/out")
    return status.select("url", "status", "retry_count", "error_message")


def stream_progress(spark, sf):
    room = _room(spark)
    windows = J.stream_progress(I.log_of(_stream(spark, sf, "events")), "1 hour")
    J.stream_windows(windows, f"{room}/out", f"{room}/ckpt").awaitTermination()
    rows = J.latest_windows(spark, f"{room}/out")
    return rows.withColumn("window_start", F.date_format("window_start", I.TS_FORMAT))


def stream_timeout(spark, sf):
    """Claims of the log that nothing ended within twelve hours, as far as the watermark has come."""
    stalled = J.stream_stalled(I.log_of(_stream(spark, sf, "events")), "12 hours", LATE)
    return _run(stalled, _room(spark)).withColumn("claimed_at", F.date_format("claimed_at", I.TS_FORMAT))


def stream_queue(spark, sf):
    """The queue after the whole log: claims time out after twelve hours, two retries, then a URL is given up."""
    room = _room(spark)
    Q.stream_queue(I.log_of(_stream(spark, sf, "events")), f"{room}/out", f"{room}/ckpt", 12 * 3600, 2, LATE).awaitTermination()
    return Q.current_queue(spark, f"{room}/out")


QUERIES = {f.__name__: f for f in (stream_links, stream_dedup, stream_status, stream_progress, stream_timeout, stream_queue)}

ORACLE = {
    "stream_links": P.ORACLE["html_links"],
    "stream_dedup": f"WITH {I.CRAWL_LOG} SELECT DISTINCT clean_url FROM log",
    "stream_status": f"WITH {I.DISCOVERED} SELECT url, status, retry_count, error_message FROM discovered",
    "stream_progress": f"""WITH {I.CRAWL_LOG} SELECT strftime(date_trunc('hour', ts), '{I.TS_FORMAT_SQL}') AS window_start, count(*) FILTER (action = 'complete') AS pages,
      coalesce(sum(file_size) FILTER (action = 'complete'), 0)::BIGINT AS bytes, count(*) FILTER (action = 'fail') AS errors FROM log GROUP BY 1""",
    "stream_timeout": f"""WITH {I.CRAWL_LOG}, ends AS (SELECT clean_url, ts FROM log WHERE action IN ('complete', 'fail')),
      claims AS (SELECT clean_url, ts, event_id FROM log WHERE action = 'claim'), seen AS (SELECT least((SELECT max(ts) FROM claims), (SELECT max(ts) FROM ends)) - INTERVAL '{LATE}' AS until)
      SELECT clean_url, strftime(ts, '{I.TS_FORMAT_SQL}') AS claimed_at, event_id AS claim_id FROM claims c, seen WHERE ts + INTERVAL 12 HOUR < until
      AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.clean_url = c.clean_url AND e.ts BETWEEN c.ts AND c.ts + INTERVAL 12 HOUR)""",
    "stream_queue": f"""WITH {I.CRAWL_LOG}, seen AS (SELECT clean_url, action, ts FROM log WHERE action IN ('claim', 'complete', 'fail')),
      until AS (SELECT max(ts) - INTERVAL '{LATE}' AS until FROM seen),
      o AS (SELECT *, action = 'claim' AND NOT EXISTS (SELECT 1 FROM seen e WHERE e.clean_url = c.clean_url AND e.action <> 'claim' AND e.ts BETWEEN c.ts AND c.ts + INTERVAL 12 HOUR) AS unended,
        c.ts + INTERVAL 12 HOUR < until AS over_ FROM seen c, until),
      s AS (SELECT clean_url, (count(*) FILTER (action = 'fail' OR (unended AND over_)))::INT AS retry_count, bool_or(action = 'complete') AS done, bool_or(unended AND NOT over_) AS waits FROM o GROUP BY 1)
      SELECT clean_url, CASE WHEN done THEN 'completed' WHEN retry_count > 2 THEN 'failed' WHEN waits THEN 'downloading' ELSE 'pending' END AS status, retry_count FROM s""",
}
