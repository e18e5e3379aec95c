"""Queries over tracker tables: look-ups, frontier, upserts and status transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.operators import frontier as FR
from webtables.operators import lookups as L
from webtables.operators import tracker as T
from webtables.plans import duck as D
from webtables.plans import inputs as I
from webtables.session import cut_lineage


def _ts(col: str):
    return F.date_format(col, I.TS_FORMAT).alias(col)


# --- look-ups ------------------------------------------------------------------------------


def _parent_links(spark, sf):
    return I.discovered_new(spark, sf).where("parent_url IS NOT NULL").select(
        "clean_url", F.col("parent_url").alias("parent")
    ).distinct()


def join_unseen(spark, sf):
    links = _parent_links(spark, sf).select(F.col("parent").alias("clean_url"), F.col("clean_url").alias("found_on"))
    return L.unseen(links, I.documents(spark, sf))


def join_unfetched_resources(spark, sf):
    return L.unfetched(I.resource_uses(spark, sf), I.stored_resources(spark, sf)).groupBy("url").agg(F.count("*").alias("n_uses"))


def join_path_lookup(spark, sf):
    docs = I.documents(spark, sf)
    return L.lookup_paths(I.discovered_new(spark, sf).select("url", "clean_url"), docs.select("clean_url", "local_path"))


def join_resource_path(spark, sf):
    refs, known = I.resource_uses(spark, sf), I.stored_resources(spark, sf)
    every = L.lookup_resources(refs, known).groupBy("url", "local_path").agg(F.count("*").alias("n_uses"))
    shared = L.lookup_resources(refs.distinct(), known, transversal_only=True).select("url", "local_path").distinct()
    return every.join(shared.withColumnRenamed("local_path", "transversal_path"), "url")


def fk_audit(spark, sf):
    """Wiki pages (as saved versions) whose document was never stored, and line items without a part."""
    meta = I.page_versions(spark, sf).select("url").distinct()
    docs = I.table(spark, sf, "documents").select(
        F.concat(F.lit("https://wiki.example.com/pages/"), F.col("doc_id").cast("string")).alias("url")
    )
    lost = L.orphans(meta, docs, "url", "url").select(F.lit("metadata").alias("child"), "url")
    uses = I.resource_uses(spark, sf).select("url").distinct()
    return lost.unionByName(L.orphans(uses, I.stored_resources(spark, sf), "url", "url").select(F.lit("use").alias("child"), "url"))


# --- frontier ------------------------------------------------------------------------------


def frontier_bfs(spark, sf):
    seeds = I.table(spark, sf, "supplier").where("s_suppkey = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("clean_url"))
    return FR.crawl_frontier(I.link_graph(spark, sf), seeds, 3)


def _space_listing(spark, sf):
    docs = I.table(spark, sf, "documents")
    key = F.upper("source")
    return docs.select(
        key.alias("space_key"),
        F.concat(F.lit("https://wiki.example.com/wiki/spaces/"), key, F.lit("/pages/"), F.col("doc_id").cast("string")).alias("url"),
    )


def frontier_space(spark, sf):
    """A frontier of every page and of the index of every space, one hop down."""
    docs = I.table(spark, sf, "documents")
    key = F.upper("source")
    base = F.lit("https://wiki.example.com/wiki/spaces/")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    index = sizes.select(F.concat(base, key, F.when(F.col("n") % 3 == 0, "").otherwise("/overview")).alias("url"), F.lit(2).alias("depth"))
    own = docs.select(
        F.concat(base, key, F.lit("/pages/"), F.col("doc_id").cast("string"), F.lit("#top")).alias("url"), F.lit(1).alias("depth")
    )
    return FR.expand_spaces(index.unionByName(own), _space_listing(spark, sf))


def frontier_update(spark, sf):
    """The frontier of a third of all links, brought up to date with the other two thirds one after the other."""
    seeds = I.table(spark, sf, "supplier").where("s_suppkey = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("clean_url"))
    graph = I.link_graph(spark, sf).withColumn("part", F.expr("cast(conv(substring(md5(src || '>' || dst), 1, 4), 16, 10) as int) % 3"))
    graph = cut_lineage(graph)
    known = FR.crawl_frontier(graph.where("part = 0"), seeds, 3)
    for part in range(1, 3):
        known = cut_lineage(FR.extend_frontier(known, graph.where(F.col("part") < part), graph.where(F.col("part") == part), 3))
    return known


def fetch_schedule(spark, sf):
    """Everything that waits in the queue, most of it on one host, and the pages of all other hosts, half a second apart."""
    queue = I.discovered(spark, sf).where("status = 'pending'").select("url", "depth", "discovered_at")
    pages = I.pages(spark, sf).select("url", F.lit(0).alias("depth"), F.lit(None).cast("timestamp").alias("discovered_at"))
    out = FR.fetch_schedule(queue.unionByName(pages), I.AS_OF, 0.5)
    return out.withColumn("fetch_at", F.date_format("fetch_at", I.TS_FORMAT))


def frontier_pending(spark, sf):
    return FR.pending(I.discovered(spark, sf), 500)


def frontier_resume(spark, sf):
    return FR.resume(I.discovered(spark, sf), "https://crawl.example.com/")


def frontier_new_links(spark, sf):
    return FR.new_links_per_page(I.discovered(spark, sf))


# --- upserts and status --------------------------------------------------------------------


def upsert_ignore(spark, sf):
    """Late discoveries on top of an early table; the first event of a URL wins."""
    log = I.crawl_log(spark, sf).where("action = 'discover'")
    rows = log.select(
        F.col("clean_url").alias("url"), "clean_url", (F.col("k") % 5).cast("int").alias("depth"), F.col("ts").alias("discovered_at"),
        "parent_url", "event_id",
    )
    cut = F.lit("2024-01-10").cast("timestamp")
    empty = I.discovered_new(spark, sf).where("false").withColumn("event_id", F.lit(0).cast("bigint"))
    early = T.discover(empty, rows.where(F.col("discovered_at") < cut), ["discovered_at", "event_id"])
    both = T.discover(early, rows.where(F.col("discovered_at") >= cut), ["discovered_at", "event_id"])
    return both.select("url", "depth", _ts("discovered_at"), "status", "retry_count", "parent_url", "event_id")


def upsert_replace(spark, sf):
    """Completions of the second half of the log replace documents of the first half.

    The second half brings no depth, so replaced rows lose theirs.
    """
    log = I.crawl_log(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp")
    old = T.completed_documents(log.where(F.col("ts") < half)).select(
        "url", "file_size", (F.col("k") % 5).cast("int").alias("depth"), F.lit(3).alias("links_extracted"), "downloaded_at", "event_id"
    )
    new = log.where((F.col("ts") >= half) & (F.col("action") == "complete")).select(
        F.col("clean_url").alias("url"), "file_size", F.col("ts").alias("downloaded_at"), "event_id"
    )
    table = T.upsert(old, new, ["url"], ["downloaded_at", "event_id"], {"links_extracted": 0})
    return table.select("url", "file_size", "depth", "links_extracted", _ts("downloaded_at"), "event_id")


def upsert_attachments(spark, sf):
    """Line items as attachment saves: page = supplier, attachment = part, last save wins."""
    saves = I.table(spark, sf, "lineitem").select(
        F.concat(F.lit("https://wiki.example.com/pages/"), F.col("l_suppkey").cast("string")).alias("page_url"),
        F.col("l_partkey").cast("string").alias("attachment_id"),
        F.col("l_quantity").cast("bigint").alias("file_size_api"),
        F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )
    order = ["batch", "line", "part", "file_size_api"]
    first = T.last_per_key(saves.where("batch % 2 = 0"), ["page_url", "attachment_id"], order)
    table = T.upsert(first, saves.where("batch % 2 = 1"), ["page_url", "attachment_id"], order)
    return table.select("page_url", "attachment_id", "file_size_api", "batch", "line")


def status_claim(spark, sf):
    claims = I.crawl_log(spark, sf).where("action = 'claim'")
    return T.apply_status(I.discovered_new(spark, sf), claims).select("url", "clean_url", "status")


def status_complete(spark, sf):
    done = I.crawl_log(spark, sf).where("action IN ('claim', 'complete')")
    status = T.apply_status(I.discovered_new(spark, sf), done)
    docs = I.documents(spark, sf).select("clean_url", "local_path", "file_size")
    return status.join(docs, "clean_url", "left").select("url", "clean_url", "status", "local_path", "file_size")


def status_fail(spark, sf):
    """The whole log in two instalments; errors survive a later completion."""
    log = I.crawl_log(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp")
    first = T.apply_status(I.discovered_new(spark, sf), log.where(F.col("ts") < half))
    return T.apply_status(first, log.where(F.col("ts") >= half)).select("url", "status", "retry_count", "error_message")


def latest_version(spark, sf):
    return T.latest_version(I.page_versions(spark, sf), ["url"], ["version_number"])


def retention(spark, sf):
    from datetime import datetime

    return T.retain(I.sessions(spark, sf), 30, datetime(2000, 6, 1)).select("session_id", _ts("start_time"), "total_urls_discovered")


def reset_progress(spark, sf):
    tables = {"discovered_urls": I.discovered(spark, sf), "downloaded_documents": I.documents(spark, sf),
              "downloaded_resources": I.resources(spark, sf), "crawler_stats": I.sessions(spark, sf)}
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in T.reset(tables).items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        join_unseen, join_unfetched_resources, join_path_lookup, join_resource_path, fk_audit, frontier_bfs, fetch_schedule, frontier_update, frontier_space,
        frontier_pending, frontier_resume, frontier_new_links, upsert_ignore, upsert_replace, upsert_attachments,
        status_claim, status_complete, status_fail, latest_version, retention, reset_progress,
    )
}

_TS = f"strftime({{c}}, '{I.TS_FORMAT_SQL}')"
_WIKI = "'https://wiki.example.com/wiki/spaces/'"

_BFS = f"""WITH RECURSIVE {I.LINK_GRAPH}, walk AS (SELECT 's0' AS url, 0 AS depth FROM supplier WHERE s_suppkey = 0
        UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = url WHERE depth < 3),
      best AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
      SELECT b.url AS clean_url, b.depth, min(p.url) AS parent_url FROM best b LEFT JOIN edges e ON e.dst = b.url AND b.depth > 0
      LEFT JOIN best p ON p.url = e.src AND p.depth = b.depth - 1 GROUP BY ALL"""

ORACLE = {
    "join_unseen": f"""WITH {I.DISCOVERED_NEW}, {I.DOCUMENTS.replace(I.CRAWL_LOG + ', ', '')}
      SELECT DISTINCT parent_url AS clean_url, clean_url AS found_on FROM discovered_new
      WHERE parent_url IS NOT NULL AND parent_url NOT IN (SELECT clean_url FROM docs)""",
    "join_unfetched_resources": f"WITH {I.RESOURCE_USES}, {I.STORED_RESOURCES} SELECT url, count(*) AS n_uses FROM uses WHERE url NOT IN (SELECT url FROM stored) GROUP BY url",
    "join_path_lookup": f"""WITH {I.DISCOVERED_NEW}, {I.DOCUMENTS.replace(I.CRAWL_LOG + ', ', '')}
      SELECT d.url, d.clean_url, coalesce(local_path, 'unknown') AS local_path FROM discovered_new d LEFT JOIN docs ON d.clean_url = docs.clean_url""",
    "join_resource_path": f"""WITH {I.RESOURCE_USES}, {I.STORED_RESOURCES} SELECT u.url, local_path, CASE WHEN is_transversal THEN local_path END AS transversal_path, count(*) AS n_uses
      FROM uses u LEFT JOIN stored r ON u.url = r.url GROUP BY ALL""",
    "fk_audit": f"""WITH {I.PAGE_VERSIONS}, {I.RESOURCE_USES}, {I.STORED_RESOURCES}
      SELECT DISTINCT 'metadata' AS child, url FROM versions WHERE url NOT IN (SELECT 'https://wiki.example.com/pages/' || doc_id FROM documents)
      UNION ALL SELECT DISTINCT 'use', url FROM uses WHERE url NOT IN (SELECT url FROM stored)""",
    "frontier_bfs": _BFS,
    "frontier_update": _BFS,
    "fetch_schedule": f"""WITH {I.DISCOVERED}, w AS (SELECT url, depth, discovered_at FROM discovered WHERE status = 'pending' UNION ALL SELECT url, 0, NULL FROM pages),
      r AS (SELECT url, lower({D.netloc('url')}) AS host, row_number() OVER (PARTITION BY lower({D.netloc('url')}) ORDER BY depth NULLS FIRST, discovered_at NULLS FIRST, url NULLS FIRST) - 1 AS place FROM w)
      SELECT url, host, place, strftime({I.AS_OF_SQL} + to_microseconds(place * 500000), '{I.TS_FORMAT_SQL}') AS fetch_at FROM r""",
    "frontier_space": f"""WITH f AS (SELECT 'https://wiki.example.com/wiki/spaces/' || upper(source) || '/pages/' || doc_id AS url, 1 AS depth FROM documents
        UNION ALL SELECT {_WIKI} || upper(source) || '/pages/' || doc_id, 0 FROM documents)
      SELECT url, min(depth) AS depth FROM f GROUP BY url""",
    "frontier_pending": f"WITH {I.DISCOVERED} SELECT url, depth FROM discovered WHERE status = 'pending' ORDER BY depth, discovered_at, url LIMIT 500",
    "frontier_resume": f"WITH {I.DISCOVERED} SELECT url, depth FROM discovered WHERE status = 'pending'",
    "frontier_new_links": f"WITH {I.DISCOVERED_NEW} SELECT parent_url, count(*) AS links_extracted FROM discovered_new WHERE parent_url IS NOT NULL GROUP BY parent_url",
    "upsert_ignore": f"""WITH {I.CRAWL_LOG} SELECT clean_url AS url, CAST(k % 5 AS INTEGER) AS depth, {_TS.format(c='ts')} AS discovered_at, 'pending' AS status,
      0 AS retry_count, parent_url, event_id FROM log WHERE action = 'discover' QUALIFY row_number() OVER (PARTITION BY clean_url ORDER BY ts, event_id) = 1""",
    "upsert_replace": f"""WITH {I.CRAWL_LOG}, r AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS late FROM log WHERE action = 'complete'
      QUALIFY row_number() OVER (PARTITION BY clean_url ORDER BY ts DESC, event_id DESC) = 1)
      SELECT clean_url AS url, file_size, CASE WHEN NOT late THEN CAST(k % 5 AS INTEGER) END AS depth, CASE WHEN late THEN 0 ELSE 3 END AS links_extracted,
        {_TS.format(c='ts')} AS downloaded_at, event_id FROM r""",
    "upsert_attachments": """WITH s AS (SELECT 'https://wiki.example.com/pages/' || l_suppkey AS page_url, CAST(l_partkey AS VARCHAR) AS attachment_id,
        CAST(l_quantity AS BIGINT) AS file_size_api, l_orderkey AS batch, l_linenumber AS line, l_partkey AS part FROM lineitem)
      SELECT page_url, attachment_id, file_size_api, batch, line FROM s
      QUALIFY row_number() OVER (PARTITION BY page_url, attachment_id ORDER BY batch % 2 DESC, batch DESC, line DESC, part DESC, file_size_api DESC) = 1""",
    "status_claim": f"""WITH {I.DISCOVERED_NEW}, {I.FOLD} SELECT url, d.clean_url, CASE WHEN n_claims > 0 THEN 'downloading' ELSE 'pending' END AS status
      FROM discovered_new d JOIN fold f ON d.clean_url = f.clean_url""",
    "status_complete": f"""WITH {I.DISCOVERED_NEW}, {I.FOLD}, {I.DOCUMENTS.replace(I.CRAWL_LOG + ', ', '')}
      SELECT d.url, d.clean_url, CASE WHEN docs.url IS NOT NULL THEN 'completed' WHEN n_claims > 0 THEN 'downloading' ELSE 'pending' END AS status, local_path, file_size
      FROM discovered_new d JOIN fold f ON d.clean_url = f.clean_url LEFT JOIN docs ON docs.clean_url = d.clean_url""",
    "status_fail": f"WITH {I.DISCOVERED} SELECT url, status, retry_count, error_message FROM discovered",
    "latest_version": f"WITH {I.PAGE_VERSIONS} SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY url ORDER BY version_number DESC) = 1",
    "retention": f"""WITH {I.SESSIONS} SELECT session_id, {_TS.format(c='start_time')} AS start_time, total_urls_discovered FROM sessions
      WHERE start_time IS NULL OR start_time >= TIMESTAMP '2000-06-01' - INTERVAL 30 DAY""",
    "reset_progress": """SELECT 'crawler_stats' AS table_name, count(*) AS n_rows FROM orders UNION ALL
      SELECT * FROM (VALUES ('discovered_urls', CAST(0 AS BIGINT)), ('downloaded_documents', 0), ('downloaded_resources', 0))""",
}
