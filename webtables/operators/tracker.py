"""Tracker tables: insert-ignore, upsert, status transitions, retention.

Tables are immutable versions: an operator takes the current version and a change set and
returns the next one. The change set is reduced to one row per key by an aggregate that
combines map-side, so a key with very many changes costs one partial row per task; the
current version then only meets the (small, distinct) keys of the change set in an anti
join, which AQE turns into a broadcast when the measured size allows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "downloading", "completed", "failed")


def _pick(df: DataFrame, key: list[str], order: list[str | Column], latest: bool) -> DataFrame:
    pick = F.max_by if latest else F.min_by
    row = F.struct(*df.columns)
    return df.groupBy(*key).agg(pick(row, F.struct(*order)).alias("__row")).select("__row.*")


def first_per_key(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    return _pick(df, key, order, latest=False)


def last_per_key(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    return _pick(df, key, order, latest=True)


def insert_ignore(table: DataFrame, new: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Add the first new row of every key the table does not have."""
    fresh = first_per_key(new, key, order).join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def discover(table: DataFrame, links: DataFrame, order: list[str | Column]) -> DataFrame:
    """insert_ignore of found links as pending rows; ``links`` has the other columns."""
    rows = links.withColumns({"status": F.lit("pending"), "retry_count": F.lit(0), "error_message": F.lit(None).cast("string")})
    return insert_ignore(table, rows, ["url"], order)


def upsert(
    table: DataFrame,
    new: DataFrame,
    key: list[str],
    order: list[str | Column],
    defaults: dict[str, object] | None = None,
) -> DataFrame:
    """Replace whole rows by the last new row of their key.

    Columns the new rows do not carry fall back to ``defaults`` or NULL, also where the
    old row had a value.
    """
    defaults = defaults or {}
    last = last_per_key(new, key, order)
    have = set(new.columns)
    rows = last.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
    untouched = table.join(last.select(*key), key, "left_anti")
    return untouched.select(*table.columns).unionByName(rows)


def partial_fold(log: DataFrame) -> DataFrame:
    """One row per clean_url with what its claims, completions and failures amount to.

    ``log`` has clean_url, action (claim, complete, fail or anything else), ts, event_id
    and error. The closed form needs no state machine: completion and failure always
    apply, a claim only matters while nothing else has happened. Partial folds of disjoint
    pieces of a log can be merged.
    """
    action = F.col("action")
    return log.groupBy("clean_url").agg(
        F.max(F.when(action.isin("complete", "fail"), F.struct("ts", "event_id", "action"))).alias("terminal"),
        F.count_if(action == "claim").alias("n_claims"),
        F.count_if(action == "fail").alias("n_fails"),
        F.max(F.when(action == "fail", F.struct("ts", "event_id", "error"))).alias("last_fail"),
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    return folds.groupBy("clean_url").agg(
        F.max("terminal").alias("terminal"), F.sum("n_claims").alias("n_claims"),
        F.sum("n_fails").alias("n_fails"), F.max("last_fail").alias("last_fail"),
    )


def apply_fold(discovered: DataFrame, fold: DataFrame) -> DataFrame:
    """Next version of ``discovered``; a change hits every URL that shares the clean URL."""
    joined = discovered.join(fold, "clean_url", "left")
    terminal = F.when(F.col("terminal.action") == "complete", "completed").when(F.col("terminal.action") == "fail", "failed")
    claimed = (F.col("n_claims") > 0) & (F.col("status") == "pending")
    failed = F.coalesce(F.col("n_fails") > 0, F.lit(False))
    return joined.withColumns(
        {
            "status": F.coalesce(terminal, F.when(claimed, "downloading"), "status"),
            "retry_count": (F.col("retry_count") + F.coalesce("n_fails", F.lit(0))).cast("int"),
            "error_message": F.when(failed, F.col("last_fail.error")).otherwise(F.col("error_message")),
        }
    ).select(*discovered.columns)


def apply_status(discovered: DataFrame, log: DataFrame) -> DataFrame:
    return apply_fold(discovered, partial_fold(log))


def completed_documents(log: DataFrame) -> DataFrame:
    """Document rows of the completions in a log, last one per clean URL.

    The document key is the clean URL itself.
    """
    done = log.where("action = 'complete'")
    last = last_per_key(done, ["clean_url"], ["ts", "event_id"])
    return last.withColumn("url", F.col("clean_url")).withColumn("downloaded_at", F.col("ts"))


def latest_version(versions: DataFrame, key: list[str], version: list[str | Column]) -> DataFrame:
    return last_per_key(versions, key, version)


def retain(stats: DataFrame, days: int, as_of: datetime, col: str = "start_time") -> DataFrame:
    """Drop rows older than ``days`` before ``as_of``; rows without a start stay."""
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return stats.where(F.col(col).isNull() | (F.col(col) >= bound))


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Empty the four progress tables, keep every other one."""
    progress = ("discovered_urls", "downloaded_documents", "downloaded_resources", "url_mappings")
    return {name: df.where(F.lit(False)) if name in progress else df for name, df in tables.items()}
