"""Queries over URLs: clean, resolve, scope, identify, local paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.functions import urls as U
from webtables.functions.stages import pin
from webtables.operators import links as L
from webtables.operators import wiki as W
from webtables.operators.scope import Rules, filter_scope, filter_wiki_links
from webtables.plans import duck as D
from webtables.plans import inputs as I

EXACT = Rules(exclude=("action=", "?y", "/display/"), valid=("/wiki/", "/docs/", "/en/", "/a/"))
REGEX = Rules(
    base_domain="example.com", exclude=(r"pageId=\d*7$", r"/S[12]/"), valid=(r"/pages/", r"/\d+(\.html)?$", r"/n\d"),
    mode="regex", max_depth=3,
)
WIKI = Rules(base_domain="example.net", exclude=(r"/S[34]/", r"overview$"))


def src_pages(spark, sf):
    return I.pages(spark, sf).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


def url_clean(spark, sf):
    return U.with_clean_url(I.url_samples(spark, sf))


def url_normalize(spark, sf):
    return U.with_normalized_url(I.url_samples(spark, sf))


def url_resolve(spark, sf):
    return L.resolve_links(I.href_samples(spark, sf))


def url_resolve_wiki(spark, sf):
    return L.resolve_wiki_links(I.href_samples(spark, sf), I.WIKI_BASE + "/").select("page_id", "href", "abs_url")


def scope_exact(spark, sf):
    return filter_scope(I.url_samples(spark, sf), EXACT)


def scope_regex(spark, sf):
    samples = I.url_samples(spark, sf).withColumn("depth", (F.col("page_id") % 6).cast("int"))
    seen = I.pages(spark, sf).where("url LIKE 'https://%'").select(F.concat("url", F.lit("")).alias("url"))
    return filter_scope(samples, REGEX, depth="depth", seen=seen).select("page_id", "url", "depth")


def scope_wiki_link(spark, sf):
    is_body_link = F.col("page_id") % 2 == 0
    return filter_wiki_links(I.url_samples(spark, sf), WIKI, pages_only=is_body_link)


def url_page_id(spark, sf):
    return I.url_samples(spark, sf).select(
        "page_id", "url", U.page_id("url").alias("wiki_id"),
        F.coalesce(U.page_id("url", U.PAGE_ID_PATTERNS_PLAIN), F.lit("")).alias("plain_id"),
    )


def url_title_lookup(spark, sf):
    urls = I.table(spark, sf, "part").select(
        F.concat(
            F.lit("https://wiki.example.com/display/P"), F.col("p_partkey").cast("string"), F.lit("/"),
            F.replace("p_name", F.lit(" "), F.lit("%20")),
        ).alias("url")
    )
    titles = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("A "), F.initcap("p_name"), F.lit(" ("), "p_brand", F.lit(")")).alias("title")
    )
    return W.resolve_by_title(urls, titles)


def url_space_key(spark, sf):
    return I.url_samples(spark, sf).select(
        "page_id", "url", U.space_key("url").alias("space_key"), U.is_space_index("url").alias("is_index")
    )


def url_site_type(spark, sf):
    samples = I.url_samples(spark, sf)
    override = F.when(F.col("page_id") % 10 == 0, "true").when(F.col("page_id") % 10 == 1, "FALSE").otherwise("auto")
    return samples.select(
        "page_id", "url", U.site_type("url").alias("detected"), U.site_type("url", override).alias("site_type")
    )


def url_local_path(spark, sf):
    samples = U.with_local_path(I.url_samples(spark, sf), "url", "markdown", "out", "md_path")
    return U.with_local_path(samples, "url", "html", "site", "html_path")


def url_page_dir(spark, sf):
    space = F.coalesce(U.space_key("url"), F.lit("NONE"))
    return I.url_samples(spark, sf).select("page_id", "url", U.page_dir("url", space).alias("page_dir"))


def url_relpath(spark, sf):
    paths = U.with_local_path(I.url_samples(spark, sf), "url")
    here = I.pages(spark, sf).select("page_id", F.col("url").alias("page_url"))
    here = U.with_local_path(here, "page_url", "markdown", "out", "page_path")
    here = here.select("page_id", U.dirname(F.col("page_path")).alias("page_dir"))
    return U.with_rel_path(paths.join(here, "page_id"), "local_path", "page_dir")


def url_variants(spark, sf):
    return L.canonical_groups(I.url_samples(spark, sf))


def path_collisions(spark, sf):
    urls = U.with_clean_url(I.url_samples(spark, sf))
    hostless = pin(urls, {"clean_url": F.regexp_replace("clean_url", r"//[^/]*\.example\.", "//x.example.")})
    return L.path_collisions(hostless)


QUERIES = {
    f.__name__: f
    for f in (
        src_pages, url_clean, url_normalize, url_resolve, url_resolve_wiki, scope_exact, scope_regex, scope_wiki_link,
        url_page_id, url_title_lookup, url_space_key, url_site_type, url_local_path, url_page_dir, url_relpath,
        url_variants, path_collisions,
    )
}

_S = f"WITH {I.URL_SAMPLES} "
_ID_WIKI = "coalesce(nullif(regexp_extract(url, '/pages/(\\d+)', 1), ''), nullif(regexp_extract(url, 'pageId=(\\d+)', 1), ''), nullif(regexp_extract(url, '/content/(\\d+)', 1), ''), nullif(regexp_extract(url, '/(\\d{6,})', 1), ''))"
_ID_PLAIN = "coalesce(nullif(regexp_extract(url, '/pages/(\\d+)', 1), ''), nullif(regexp_extract(url, 'pageId=(\\d+)', 1), ''), nullif(regexp_extract(url, '/(\\d{6,})', 1), ''))"
_SPACE = "nullif(regexp_extract(url, '/spaces/([^/]+)', 1), '')"
_SITE = "CASE WHEN regexp_matches(url, '(?i)\\.atlassian\\.net|/wiki/|/confluence/|/display/|/pages/|/rest/api/content/') THEN 'confluence' ELSE 'html' END"
_TITLE = "trim(regexp_replace(lower('A ' || p_name || ' (' || p_brand || ')'), '[^\\pL\\pN]+', ' ', 'g'))"
_PHRASE = "trim(regexp_replace(lower(p_name), '[^\\pL\\pN]+', ' ', 'g'))"

ORACLE = {
    "src_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "url_clean": f"{_S} SELECT page_id, url, {D.clean_url('url')} AS clean_url FROM samples",
    "url_normalize": f"{_S} SELECT page_id, url, {D.clean_url('url')} || CASE WHEN {D.query('url')} <> '' THEN '?' || {D.query('url')} ELSE '' END AS normalized_url FROM samples",
    "url_resolve": f"WITH {I.HREF_SAMPLES}, {D.resolved('hrefs', 'src', 'href')} SELECT page_id, src, href, abs_url FROM resolved",
    "url_resolve_wiki": f"WITH {I.HREF_SAMPLES} SELECT page_id, href, CASE WHEN href LIKE '/%' THEN '{I.WIKI_BASE}' || href ELSE href END AS abs_url FROM hrefs WHERE href LIKE '/%' OR href LIKE 'http%'",
    "scope_exact": f"""{_S} SELECT page_id, url FROM samples WHERE (url LIKE 'http://%' OR url LIKE 'https://%')
      AND NOT (contains(url, 'action=') OR contains(url, '?y') OR contains(url, '/display/'))
      AND (contains(url, '/wiki/') OR contains(url, '/docs/') OR contains(url, '/en/') OR contains(url, '/a/'))""",
    "scope_regex": f"""{_S} SELECT page_id, url, CAST(page_id % 6 AS INTEGER) AS depth FROM samples s WHERE contains({D.netloc('url')}, 'example.com')
      AND NOT regexp_matches(url, 'pageId=\\d*7$|/S[12]/') AND regexp_matches(url, '/pages/|/\\d+(\\.html)?$|/n\\d') AND page_id % 6 <= 3
      AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.url LIKE 'https://%' AND p.url = s.url)""",
    "scope_wiki_link": f"""{_S} SELECT page_id, url FROM samples WHERE contains(url, 'example.net') AND NOT regexp_matches(url, '/S[34]/|overview$')
      AND (page_id % 2 <> 0 OR regexp_matches(url, '/pages/|/display/|/viewpage\\.action|/content/'))""",
    "url_page_id": f"{_S} SELECT page_id, url, {_ID_WIKI} AS wiki_id, coalesce({_ID_PLAIN}, '') AS plain_id FROM samples",
    "url_title_lookup": f"""WITH asked AS (SELECT DISTINCT p_partkey AS k, {_PHRASE} AS phrase,
        'https://wiki.example.com/display/P' || p_partkey || '/' || replace(p_name, ' ', '%20') AS url FROM part),
      phrases AS (SELECT DISTINCT phrase FROM asked), titles AS (SELECT p_partkey, ' ' || {_TITLE} || ' ' AS t FROM part),
      best AS (SELECT phrase, min(p_partkey) AS page_id FROM phrases JOIN titles ON contains(t, ' ' || phrase || ' ') GROUP BY phrase)
      SELECT url, page_id FROM asked JOIN best USING (phrase)""",
    "url_space_key": f"""{_S} SELECT page_id, url, {_SPACE} AS space_key, contains(url, '/spaces/') AND (contains(url, '/overview')
      OR coalesce(ends_with(url, {_SPACE}), false)) AS is_index FROM samples""",
    "url_site_type": f"""{_S} SELECT page_id, url, {_SITE} AS detected, CASE page_id % 10 WHEN 0 THEN 'confluence' WHEN 1 THEN 'html' ELSE {_SITE} END AS site_type FROM samples""",
    "url_local_path": f"{_S} SELECT page_id, url, {D.local_path('url')} AS md_path, {D.local_path('url', 'site', '.html')} AS html_path FROM samples",
    "url_page_dir": f"""{_S} SELECT page_id, url, 'out/spaces/' || coalesce({_SPACE}, 'NONE') || '/pages/' || coalesce({_ID_PLAIN},
      nullif(regexp_extract({D.path('url')}, '([^/]+)/*$', 1), ''), 'page_' || substring(md5(url), 1, 10)) || '/index.md' AS page_dir FROM samples""",
    "url_relpath": f"""{_S}, t AS (SELECT s.page_id, s.url, {D.local_path('s.url')} AS local_path, regexp_replace({D.local_path('p.url')}, '/?[^/]*$', '') AS page_dir
      FROM samples s JOIN pages p ON s.page_id = p.page_id)
      SELECT page_id, url, local_path, page_dir, {D.rel_path('local_path', 'page_dir')} AS rel_path FROM t""",
    "url_variants": f"{_S} SELECT {D.clean_url('url')} AS clean_url, count(DISTINCT url) AS n_variants FROM samples GROUP BY 1",
    "path_collisions": f"""{_S}, c AS (SELECT DISTINCT regexp_replace({D.clean_url('url')}, '//[^/]*\\.example\\.', '//x.example.') AS u FROM samples)
      SELECT {D.local_path('u')} AS local_path, count(*) AS n_urls FROM c GROUP BY 1 HAVING count(*) > 1""",
}
