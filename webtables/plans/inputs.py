"""Stand-in tables derived from the shared test tables, and the same derivations as SQL.

The shared tables hold no crawl log, tracker tables or wiki JSON. Each function below
derives one of those from a whole shared table; the constant next to it says the same for
the SQL twins (as CTEs to be joined with commas).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.operators import tracker as T
from webtables.operators.resources import RESOURCE_TYPES, with_resource_type
from webtables.session import prepare
from webtables.sources.pages import dealt, read_pages

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FORMAT_SQL = "%Y-%m-%d %H:%M:%S.%f"
WIKI_BASE = "https://wiki.example.com"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


# --- pages with the mark-up the shared pages lack --------------------------------------

SNIPPET = (
    """'<table><tr><th>k</th><th>v</th></tr><tr><td>' || page_id || '</td><td>x</td></tr></table>"""
    """<img src="/static/i' || (page_id % 7) || '.png" alt="i" onclick="go(1)">"""
    """<img src=' || chr(39) || '//secure.gravatar.com/avatar/' || (page_id % 5) || chr(39) || '>"""
    """<link rel="stylesheet" href="https://cdn' || (page_id % 2) || '.example.net/s' || (page_id % 3) || '.css?v=2">"""
    """<div class="x breadcrumbs">crumb<div>deep</div></div><meta http-equiv="refresh" content="5">"""
    """<noscript><img src="/no.png"></noscript><nav>menu</nav>"""
    """<a href="../up/' || page_id || '?q=1#f" title="a > b">up</a><a href="https://other.example.org/x">o</a>"""
    """<script-loader data-x="1"></script-loader><p>caf&eacute; &copy; &hellip; &#150; &#00000000065;</p>"""
    """<!-- <title>old</title> --><noscript-x>kept</noscript-x>"""
    """<h3>Part *one*</h3><ol><li>first<ul><li>deep_er</li></ul></li><li>second</li></ol><pre><code>a  b

 c</code></pre>"""
    """<blockquote><p>said <code>so_much</code></p></blockquote><a href="/t" title="tip">t</a> <strong>s</strong><em>e</em>"""
    """<a href="http://auto.example/">http://auto.example/</a><img src="/p.png" alt="p" title="pic">"""
    """<ul><li>one</li><li>two &amp; three</li></ul></article>'"""
)


# A title in a comment and one in a script come before the real one; every page ends in a tag that is cut off.
RICH_HTML = (
    """replace(replace(html, '<title>', '<!-- <title>old</title> --><script>x = "<title>no</title>";</script><title>'), """
    f"""'</article>', {SNIPPET}) || '<a href="/cut'"""
)


def rich_pages(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(pages(spark, sf)).withColumn("html", F.expr(RICH_HTML))


RICH_PAGES = f"rich AS (SELECT page_id, url, {RICH_HTML} AS html FROM pages)"


# --- URLs of many shapes ------------------------------------------------------------------

_URL_SHAPES = (
    "url",
    "upper(substring(url, 1, 4)) || substring(url, 5)",
    "origin || '/wiki/spaces/S' || (page_id % 5) || '/pages/' || (1000 + page_id) || '/Title+Page%20' || page_id || '?x=1'",
    "origin || '/docs/a:b*' || page_id || '/'",
    "origin || '/help/d;v=1/x;p=' || page_id || '?y#z'",
    "origin || '/pages/viewpage.action?pageId=' || page_id",
    "origin || '/wiki/spaces/S1/overview'",
    "origin || '/wiki/spaces/S' || (page_id % 3)",
    "origin || '/display/S/My%20Page%C3%A9+' || page_id || '%zz'",
    "origin || '/a/' || (100000 + page_id) || '.html'",
    "origin || '/wiki/n' || length(url) || left(md5(origin), 2)",
    "origin || '/docs/n' || length(url) || left(md5(origin), 2)",
    "origin",
    "origin || '//x/../y/./' || page_id || '#frag'",
    "'mailto:u' || page_id || '@h.example.com'",
)


def url_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url): every page with URLs of all shapes on its own host."""
    origin = F.regexp_extract("url", r"^[^/]*//[^/?#]*", 0)
    shapes = F.expr(f"array({', '.join(_URL_SHAPES)})")
    return pages(spark, sf).select("page_id", "url", origin.alias("origin")).select("page_id", F.explode(shapes).alias("url"))


URL_SAMPLES = (
    "samples AS (SELECT page_id, unnest([" + ", ".join(_URL_SHAPES) + "]) AS url FROM "
    "(SELECT page_id, url, regexp_extract(url, '^[^/]*//[^/?#]*', 0) AS origin FROM pages))"
)

_HREF_SHAPES = (
    "c.html", "/wiki/p", "../up", "../../../../z", "./s/", "a/./b/../c", "?q=2", "#top", "", "//cdn.example.com/x",
    "/a;p=1?q", "/x?y=/../z", "a b", "/für", "..", ".", "x//y", "/a//b/../c", "?", "#", "//h2",
    "http://o.example/a/../b", "mailto:a@b", "javascript:void(0)", "g:h", "https://o.example/login?next=1",
    "/spaces/AR/pages/12/T", "/display/AR/T",
)


def href_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, src, href): every page with hrefs of all shapes."""
    hrefs = F.array(*[F.lit(h) for h in _HREF_SHAPES])
    return pages(spark, sf).select("page_id", F.col("url").alias("src"), F.explode(hrefs).alias("href"))


HREF_SAMPLES = (
    "hrefs AS (SELECT page_id, url AS src, unnest(["
    + ", ".join("'" + h.replace("'", "''") + "'" for h in _HREF_SHAPES)
    + "]) AS href FROM pages)"
)


# --- crawl log and tracker tables ---------------------------------------------------------


def crawl_log(spark: SparkSession, sf: str) -> DataFrame:
    """Status events: one row per event, keyed by user and property."""
    return log_of(table(spark, sf, "events"))


def log_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.concat(F.lit("https://crawl.example.com/u"), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        k.alias("k"),
        F.concat(user, F.lit("/p"), k.cast("string")).alias("clean_url"),
        F.when(k > 0, F.concat(user, F.lit("/p"), F.floor(k / 2).cast("string"))).alias("parent_url"),
        F.when(kind == "click", "claim").when(kind == "purchase", "complete").when(kind == "error", "fail")
        .otherwise("discover").alias("action"),
        F.when(kind == "error", F.concat(F.lit("HTTP "), (F.col("event_id") % 100 + 400).cast("string"))).alias("error"),
        F.floor(F.col("value") * 1024).cast("bigint").alias("file_size"),
        F.col("value").alias("value"),
    )


CRAWL_LOG = """log AS (
  SELECT event_id, ts, k, u || '/p' || k AS clean_url,
         CASE WHEN k > 0 THEN u || '/p' || (k // 2) END AS parent_url,
         CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'discover' END AS action,
         CASE WHEN event_type = 'error' THEN 'HTTP ' || (event_id % 100 + 400) END AS error,
         CAST(floor(value * 1024) AS BIGINT) AS file_size, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               'https://crawl.example.com/u' || user_id AS u FROM events))"""


def discovered_new(spark: SparkSession, sf: str) -> DataFrame:
    """discovered_urls before any status change; every tenth URL has a variant with a query."""
    log = crawl_log(spark, sf)
    first = log.groupBy("clean_url", "k", "parent_url").agg(F.min("ts").alias("discovered_at"))
    urls = F.when(F.col("k") % 10 == 0, F.array("clean_url", F.concat("clean_url", F.lit("?v=1")))).otherwise(F.array("clean_url"))
    return first.select(
        F.explode(urls).alias("url"), "clean_url", (F.col("k") % 5).cast("int").alias("depth"), "discovered_at",
        F.lit("pending").alias("status"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"), "parent_url",
    )


DISCOVERED_NEW = CRAWL_LOG + """, discovered_new AS (
  SELECT unnest(CASE WHEN k % 10 = 0 THEN [clean_url, clean_url || '?v=1'] ELSE [clean_url] END) AS url, clean_url,
         CAST(k % 5 AS INTEGER) AS depth, discovered_at, 'pending' AS status, 0 AS retry_count, parent_url
  FROM (SELECT clean_url, k, parent_url, min(ts) AS discovered_at FROM log GROUP BY ALL))"""


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    return T.apply_status(discovered_new(spark, sf), crawl_log(spark, sf))


FOLD = """fold AS (
  SELECT clean_url, arg_max(action, (ts, event_id)) FILTER (action IN ('complete', 'fail')) AS terminal,
         count(*) FILTER (action = 'claim') AS n_claims, count(*) FILTER (action = 'fail') AS n_fails,
         arg_max(error, (ts, event_id)) FILTER (action = 'fail') AS last_error
  FROM log GROUP BY clean_url)"""

DISCOVERED = DISCOVERED_NEW + ", " + FOLD + """, discovered AS (
  SELECT url, d.clean_url, depth, discovered_at,
         CASE WHEN terminal = 'complete' THEN 'completed' WHEN terminal = 'fail' THEN 'failed'
              WHEN n_claims > 0 THEN 'downloading' ELSE 'pending' END AS status,
         CAST(n_fails AS INTEGER) AS retry_count, last_error AS error_message, parent_url
  FROM discovered_new d JOIN fold f ON d.clean_url = f.clean_url)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """downloaded_documents: the last completion of every clean URL."""
    done = T.completed_documents(crawl_log(spark, sf))
    return done.select(
        "url", "clean_url", F.concat(F.lit("out/"), F.regexp_replace("clean_url", "^https://[^/]*/", ""), F.lit(".md")).alias("local_path"),
        "file_size", "value", "downloaded_at", (F.col("k") % 5).cast("int").alias("depth"),
    )


DOCUMENTS = CRAWL_LOG + """, docs AS (
  SELECT clean_url AS url, clean_url, 'out/' || regexp_replace(clean_url, '^https://[^/]*/', '') || '.md' AS local_path,
         file_size, value, ts AS downloaded_at, CAST(k % 5 AS INTEGER) AS depth
  FROM log WHERE action = 'complete' QUALIFY row_number() OVER (PARTITION BY clean_url ORDER BY ts DESC, event_id DESC) = 1)"""

_RESOURCE_URL = (
    "'https://cdn' || ({pk} % 4) || '.example.net/static/r' || {pk} || "
    "CASE {pk} % 6 WHEN 0 THEN '.css' WHEN 1 THEN '.js' WHEN 2 THEN '.PNG' WHEN 3 THEN '.woff2' WHEN 4 THEN '.json' ELSE '' END"
)


def resources(spark: SparkSession, sf: str) -> DataFrame:
    """downloaded_resources out of parts."""
    url = F.expr(_RESOURCE_URL.format(pk="p_partkey"))
    rows = table(spark, sf, "part").select(
        url.alias("url"), F.concat(F.lit("out/shared_resources/r"), F.col("p_partkey").cast("string")).alias("local_path"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("bigint") * 1000).alias("file_size"),
        (F.col("p_partkey") % 3 != 0).alias("is_transversal"),
    )
    return with_resource_type(rows)


_TYPE_SQL = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(url), '{part}')" for part in parts) + f" THEN '{name}'" for name, parts in RESOURCE_TYPES
    )
    + " ELSE 'other' END"
)

RESOURCES = (
    "res0 AS (SELECT " + _RESOURCE_URL.format(pk="p_partkey") + " AS url, 'out/shared_resources/r' || p_partkey AS local_path, "
    "CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS BIGINT) * 1000 END AS file_size, p_partkey % 3 <> 0 AS is_transversal "
    f"FROM part), resources AS (SELECT *, {_TYPE_SQL} AS resource_type FROM res0)"
)


def resource_uses(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url): which supplier page shows which part."""
    url = F.expr(_RESOURCE_URL.format(pk="l_partkey"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page_id"), url.alias("url"))


def stored_resources(spark: SparkSession, sf: str) -> DataFrame:
    """The registry of the look-up queries. What is not stored is their subject, so it lacks the small parts."""
    small = table(spark, sf, "part").where("p_size <= 10")
    lost = small.select(F.concat(F.lit("out/shared_resources/r"), F.col("p_partkey").cast("string")).alias("local_path"))
    return resources(spark, sf).join(lost, "local_path", "left_anti")


STORED_RESOURCES = RESOURCES + """, stored AS (SELECT r.* FROM resources r
  ANTI JOIN (SELECT 'out/shared_resources/r' || p_partkey AS local_path FROM part WHERE p_size <= 10) USING (local_path))"""


RESOURCE_USES = "uses AS (SELECT l_suppkey AS page_id, " + _RESOURCE_URL.format(pk="l_partkey") + " AS url FROM lineitem)"


def link_graph(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): suppliers and parts that meet in a line item, both ways."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    ends = F.array(F.struct(s.alias("src"), p.alias("dst")), F.struct(p.alias("src"), s.alias("dst")))
    return li.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


LINK_GRAPH = """pairs AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem),
edges AS (SELECT s AS src, p AS dst FROM pairs UNION ALL SELECT p, s FROM pairs)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """crawler_stats: one session per order, some without a start."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("session-"), F.col("o_orderkey").cast("string")).alias("session_id"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("timestamp")).alias("start_time"),
        F.col("o_custkey").alias("total_urls_discovered"),
    )


SESSIONS = """sessions AS (SELECT 'session-' || o_orderkey AS session_id,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS start_time, o_custkey AS total_urls_discovered FROM orders)"""


def page_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Saved versions of wiki pages: one per conversation turn."""
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("https://wiki.example.com/pages/"), F.col("conv_id").cast("string")).alias("url"),
        F.col("turn").alias("version_number"), F.col("role").alias("version_by"), F.col("text").alias("version_message"),
    )


PAGE_VERSIONS = """versions AS (SELECT 'https://wiki.example.com/pages/' || conv_id AS url, turn AS version_number,
  role AS version_by, text AS version_message FROM conversations)"""
