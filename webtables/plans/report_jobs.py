"""Report queries over the derived tracker tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.operators import reports as R
from webtables.plans import inputs as I


def agg_status(spark, sf):
    return R.status_counts(I.discovered(spark, sf))


def agg_status_pct(spark, sf):
    return R.status_share(I.discovered(spark, sf))


def agg_totals(spark, sf):
    return R.totals(I.documents(spark, sf), I.resources(spark, sf))


def agg_counts(spark, sf):
    return R.url_totals(I.discovered(spark, sf))


def agg_resource_type(spark, sf):
    return R.resource_breakdown(I.resources(spark, sf))


def agg_daily(spark, sf):
    daily = R.recent_activity(I.documents(spark, sf), 7, I.AS_OF)
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def top_failed(spark, sf):
    return R.top_failed(I.discovered(spark, sf), 10)


def agg_progress(spark, sf):
    return R.progress(I.discovered(spark, sf))


def agg_success_rate(spark, sf):
    return R.success_rate(I.discovered(spark, sf))


def agg_speed(spark, sf):
    return R.throughput(I.crawl_log(spark, sf))


def run_state(spark, sf):
    return R.run_state(I.discovered(spark, sf))


def fmt_bytes(spark, sf):
    from webtables.functions.formats import human_size

    sizes = I.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.array(*[(F.col("n_chars") * f).cast("bigint") for f in (0, 1, 1000, 1_000_000, 1_000_000_000, 10**12, 10**13)])).alias("size")
    )
    return sizes.select("doc_id", "size", human_size(F.col("size")).alias("size_text"))


def snk_url_list(spark, sf):
    from webtables.sources.export import url_list

    return url_list(I.discovered(spark, sf), "completed")


QUERIES = {
    f.__name__: f
    for f in (
        agg_status, agg_status_pct, agg_totals, agg_counts, agg_resource_type, agg_daily, top_failed, agg_progress,
        agg_success_rate, agg_speed, run_state, fmt_bytes, snk_url_list,
    )
}


def _size(v: str) -> str:
    """Readable size, one decimal, ties to even."""
    parts = ["CASE WHEN {v} = 0 THEN '0 B'"]
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        parts.append(f"WHEN {v} < {1024 ** (power + 1)} THEN format('{{:.1f}} {unit}', {v} / {float(1024 ** power)!r}::DOUBLE)")
    parts.append(f"ELSE format('{{:.1f}} PB', {v} / {float(1024 ** 5)!r}::DOUBLE) END")
    return " ".join(parts).replace("{v}", v)


_D = f"WITH {I.DISCOVERED} "
_N = "count(*) FILTER (status = '{s}')"
_DOCS = I.DOCUMENTS

ORACLE = {
    "agg_status": f"{_D} SELECT status, count(*) AS n FROM discovered GROUP BY status",
    "agg_status_pct": f"""{_D}, c AS (SELECT status, count(*) AS n FROM discovered GROUP BY status), t AS (SELECT sum(n)::BIGINT AS total FROM c)
      SELECT upper(status[1]) || status[2:] AS status, n, n / total * 100 AS percentage FROM c, t UNION ALL SELECT 'Total', total, total / total * 100 FROM t WHERE total > 0""",
    "agg_totals": f"""WITH {_DOCS}, {I.RESOURCES}, t AS (SELECT (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM resources) AS total_resources,
        (SELECT coalesce(sum(file_size), 0)::BIGINT FROM docs) AS total_documents_size, (SELECT coalesce(sum(file_size), 0)::BIGINT FROM resources) AS total_resources_size)
      SELECT *, total_documents_size + total_resources_size AS total_size, {_size('total_documents_size')} AS documents_size_text,
        {_size('total_resources_size')} AS resources_size_text, {_size('(total_documents_size + total_resources_size)')} AS total_size_text FROM t""",
    "agg_counts": f"{_D} SELECT count(*) AS total_discovered, {_N.format(s='completed')} AS total_completed, {_N.format(s='failed')} AS total_failed FROM discovered",
    "agg_resource_type": f"""WITH {I.RESOURCES}, g AS (SELECT resource_type, count(*) AS n, coalesce(sum(file_size), 0)::BIGINT AS total_size FROM resources GROUP BY 1)
      SELECT *, {_size('total_size')} AS size_text FROM g ORDER BY n DESC, resource_type""",
    "agg_daily": f"""WITH {_DOCS} SELECT strftime(downloaded_at, '%Y-%m-%d') AS day, count(*) AS n FROM docs
      WHERE downloaded_at >= {I.AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1 ORDER BY 1 DESC""",
    "top_failed": f"{_D} SELECT clean_url, error_message, retry_count FROM discovered WHERE status = 'failed' ORDER BY retry_count DESC, discovered_at DESC, clean_url LIMIT 10",
    "agg_progress": f"""{_D}, c AS (SELECT count(*) AS total, {_N.format(s='completed')} AS completed, {_N.format(s='pending')} AS pending,
        {_N.format(s='downloading')} AS active, {_N.format(s='failed')} AS failed FROM discovered)
      SELECT *, completed / total * 100 AS percentage, 40 * completed // total AS bar_fill FROM c WHERE total > 0""",
    "agg_success_rate": f"""{_D}, c AS (SELECT {_N.format(s='completed')} AS done, {_N.format(s='failed')} AS failed FROM discovered)
      SELECT done, failed, CASE WHEN done + failed = 0 THEN 100.0 ELSE done / (done + failed) * 100 END AS success_rate FROM c""",
    "agg_speed": f"""WITH {I.CRAWL_LOG}, u AS (SELECT clean_url, count(*) FILTER (action = 'complete') AS done, count(*) FILTER (action <> 'discover') AS touched FROM log GROUP BY 1),
      c AS (SELECT sum(done)::BIGINT AS done, count(*) FILTER (touched = 0) AS queued FROM u),
      s AS (SELECT *, done / ((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM log) / 1000000.0::DOUBLE) AS pages_per_second FROM c)
      SELECT *, CASE WHEN pages_per_second > 0 AND queued > 0 THEN floor(queued / pages_per_second)::BIGINT END AS eta_seconds FROM s""",
    "run_state": f"""{_D} SELECT CASE WHEN {_N.format(s='pending')} > 0 THEN 'in progress' WHEN {_N.format(s='failed')} > {_N.format(s='completed')} THEN 'with errors'
      ELSE 'completed' END AS run_state FROM discovered""",
    "fmt_bytes": f"""WITH s AS (SELECT doc_id, unnest([0, n_chars, n_chars * 1000, n_chars * 1000000, n_chars * 1000000000, n_chars * 1000000000000, n_chars * 10000000000000]) AS size FROM documents)
      SELECT doc_id, size, {_size('size')} AS size_text FROM s""",
    "snk_url_list": f"{_D} SELECT clean_url FROM discovered WHERE status = 'completed' ORDER BY clean_url",
}
