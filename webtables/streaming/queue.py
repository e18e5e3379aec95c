"""The crawl queue as a stream: claims, completions and failures in, the status of every URL out.

A claim that no completion or failure of its URL follows in time is a time-out, which counts as a failure. A URL with more failures
than ``max_retries`` is given up; until then it goes back to the queue. Status, by this order:

completed     it was completed at some time
failed        failures and time-outs are more than max_retries
downloading   a claim is open: nothing ended it and its time is not over
pending       else

``stream_queue`` joins claims with the ends of their URL in event time. A claim comes out of the join with every end in its time, or
alone once the watermark has passed its time, and by then everything that could belong to it has arrived, so
the result does not depend on the order of files or of rows. State of a claim or an end goes when its time is over. Each batch stores
one row of counters per URL and one per claim that is open; where folds are merged, claims and what closed them cancel out.
Of what arrives later than ``delay``, completions and failures are still counted but end no claim, and claims are left out.
``queue_status`` says the same about a whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webtables.streaming.folds import EVERY, Store, to_folds

TIMEOUT = 60
MAX_RETRIES = 3
# Watermarks are whole milliseconds, times are microseconds.
TICK = 1000


def _status(completed: Column, retries: Column, open_claims: Column, max_retries: int | Column) -> Column:
    return F.when(completed, "completed").when(retries > max_retries, "failed").when(open_claims, "downloading").otherwise("pending")


def _timed(seen: DataFrame, names: tuple[str, str], is_claim: bool, delay: str) -> DataFrame:
    """(URL, time) of the claims or of the ends; both carry the watermark of all of them."""
    url, ts = names
    rows = seen.select(F.col("clean_url").alias(url), "action", F.col("ts").alias(ts)).withWatermark(ts, delay)
    # The condition names the time, so that it is not moved below the watermark.
    wanted = F.when((F.col("action") == "claim") == F.lit(is_claim), F.col(ts)).isNotNull()
    return rows.where(wanted).select(url, ts)


def _closed(seen: DataFrame, timeout: int, delay: str) -> DataFrame:
    """(clean_url, at, late): every claim with each end in its time, or once with ``late`` when its time is over."""
    claims, ends = _timed(seen, ("claim_url", "claimed_at"), True, delay), _timed(seen, ("end_url", "ended_at"), False, delay)
    in_time = F.expr(f"claim_url <=> end_url AND ended_at >= claimed_at AND ended_at <= claimed_at + INTERVAL {timeout} MICROSECONDS")
    joined = claims.join(ends, in_time, "leftOuter")
    return joined.select(F.col("claim_url").alias("clean_url"), F.unix_micros("claimed_at").alias("at"), F.col("ended_at").isNull().alias("late"))


def _counts(rows: DataFrame, at: Column) -> DataFrame:
    return rows.groupBy("clean_url", at.alias("at")).agg(
        F.sum("claims").alias("claims"), F.max("closed").alias("closed"), F.sum("failures").alias("failures"), F.max("completed").alias("completed"),
        F.max("over_at").alias("over_at"), F.max("seen_at").alias("seen_at"), F.max("max_retries").alias("max_retries"),
    )


def _merge(rows: DataFrame) -> DataFrame:
    """One row per URL (``at`` is NULL) and one per claim that is open, or was closed by a later batch than its own."""
    done = (F.col("claims") > 0) & F.col("closed")
    merged = _counts(rows, F.col("at"))
    merged = merged.withColumn("at", F.when(~done, F.col("at")))
    # What went into the counters of the URL is no claim any more.
    merged = merged.withColumn("claims", F.when(F.col("at").isNull(), 0).otherwise(F.col("claims")).cast("bigint"))
    merged = merged.withColumn("closed", F.col("at").isNotNull() & F.col("closed"))
    return _counts(merged, F.col("at"))


def stream_queue(
    log: DataFrame, path: str, checkpoint: str, timeout: float = TIMEOUT, max_retries: int = MAX_RETRIES, delay: str = "10 minutes", every: int = EVERY
) -> StreamingQuery:
    """Follow a log (clean_url, action, ts) that may be out of order by ``delay``; changes are stored as folds below ``path``."""
    length = int(timeout * 1_000_000)
    seen = log.where("action IN ('claim', 'complete', 'fail')").select("clean_url", "action", "ts")
    is_claim, at = (F.col("action") == "claim") & F.col("ts").isNotNull(), F.unix_micros("ts")
    events = seen.select(
        "clean_url", F.when(is_claim, at).alias("at"), is_claim.cast("bigint").alias("claims"), F.lit(False).alias("closed"),
        (F.col("action") == "fail").cast("bigint").alias("failures"), (F.col("action") == "complete").alias("completed"),
        F.when(is_claim, F.unix_micros(F.expr(f"ts + INTERVAL {delay}")) + length + TICK).alias("over_at"), at.alias("seen_at"),
    )
    closed = _closed(seen, length, delay).select(
        "clean_url", "at", F.lit(0).cast("bigint").alias("claims"), F.lit(True).alias("closed"), F.col("late").cast("bigint").alias("failures"),
        F.lit(False).alias("completed"), F.lit(None).cast("bigint").alias("over_at"), F.lit(None).cast("bigint").alias("seen_at"),
    )
    rows = events.unionByName(closed).withColumn("max_retries", F.lit(max_retries))
    return to_folds(rows, path, checkpoint, lambda batch, _: _merge(batch), _merge, every=every)


def current_queue(spark: SparkSession, path: str, every: int = EVERY) -> DataFrame | None:
    """(clean_url, status, retry_count) as of the last batch; None before the first one."""
    store = Store(spark, path, every)
    folds = store.cover()
    if not folds:
        return None
    stored = store.read(folds)
    last = F.lit(stored.agg(F.max("seen_at")).first()[0])
    # A claim that is over and that nothing closed arrived too late.
    waits = (F.col("claims") > 0) & ~F.col("closed") & F.coalesce(F.col("over_at") >= last, F.lit(False))
    sums = _counts(stored, F.col("at")).withColumn("waits", waits).groupBy("clean_url").agg(
        F.sum("failures").cast("int").alias("retry_count"), F.max("completed").alias("completed"), F.max("waits").alias("waits"), F.max("max_retries").alias("most")
    )
    return sums.select("clean_url", _status(F.col("completed"), F.col("retry_count"), F.col("waits"), F.col("most")).alias("status"), "retry_count")


def queue_status(log: DataFrame, until: Column, timeout: float = TIMEOUT, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(clean_url, status, retry_count) of a whole log; claims whose time is over before ``until`` have timed out."""
    seen = log.where("action IN ('claim', 'complete', 'fail')").select("clean_url", "action", F.unix_micros("ts").alias("at"))
    is_end, length = F.col("action") != "claim", int(timeout * 1_000_000)
    onwards = Window.partitionBy("clean_url").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = seen.withColumn("next_end", F.min(F.when(is_end, F.col("at"))).over(onwards))
    unended = (F.col("action") == "claim") & ~F.coalesce(F.col("next_end") <= F.col("at") + length, F.lit(False))
    over = F.col("at") + length < F.unix_micros(until)
    sums = seen.groupBy("clean_url").agg(
        F.count_if((F.col("action") == "fail") | (unended & over)).cast("int").alias("retry_count"),
        F.max(F.col("action") == "complete").alias("completed"),
        F.max(unended & ~over).alias("waits"),
    )
    status = _status(F.col("completed"), F.col("retry_count"), F.col("waits"), max_retries)
    return sums.select("clean_url", status.alias("status"), "retry_count")
