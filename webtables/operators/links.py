"""Link extraction: pages to edges, wiki JSON to edges, and edge-level audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import markup as M
from webtables.functions import urls as U
from webtables.functions.stages import pin
from webtables.operators.scope import Rules, filter_scope, filter_wiki_links


def anchor_hrefs(html: Column) -> Column:
    """Distinct raw hrefs of the <a> tags of one page, in page order.

    Anchors in comments, scripts and style sheets are not tags and do not count. The
    duplicates of a page go here, inside its row, before anything is exploded.
    """
    toks = M.tokens(M.visible(html, ("script", "style")))
    anchors = F.filter(toks, lambda t: t.rlike(r"(?i)^<a[\s/]") & t.endswith(">") & M.has_attr(t, "href"))
    return F.array_distinct(F.transform(anchors, lambda t: M.raw_attr(t, "href")))


def page_hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, src, href): decoded hrefs, with the cleaned page URL as source."""
    exploded = pages.select("page_id", "url", F.explode(anchor_hrefs(F.col("html"))).alias("href"))
    return exploded.select("page_id", U.clean_url("url").alias("src"), M.unescape(F.col("href"), in_attribute=True).alias("href"))


def resolve_links(edges: DataFrame, base: str = "src", href: str = "href") -> DataFrame:
    return U.with_resolved(edges, base, href, "abs_url")


def link_rows(pages: DataFrame, rules: Rules) -> DataFrame:
    """(page_id, src, dst) of every in-scope link, without a shuffle.

    Hrefs are distinct per page, but two of them may clean to one URL.
    """
    edges = filter_scope(resolve_links(page_hrefs(pages)), rules, "abs_url")
    return edges.select("page_id", "src", U.clean_url("abs_url").alias("dst"))


def extract_links(pages: DataFrame, rules: Rules) -> DataFrame:
    """(page_id, src, dst): the set of cleaned in-scope links of every page.

    The scope looks at the full URL, before cleaning. All links of a page leave the same
    task, so the partial aggregate of the final distinct already removes what duplicates
    cleaning creates and the exchange carries each edge once.
    """
    return link_rows(pages, rules).distinct()


def resolve_wiki_links(edges: DataFrame, base_url: str) -> DataFrame:
    return U.with_wiki_resolved(edges, base_url)


def union_links(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def extract_wiki_links(raw: DataFrame, rules: Rules) -> DataFrame:
    """(url, link) of wiki pages: anchors of the body that look like pages, plus children.

    ``raw`` has ``url`` and the parsed page struct ``page``. Children skip the page-URL
    test and are never given a /wiki prefix.
    """
    base = (rules.base_url or "").rstrip("/")
    body = raw.select("url", F.explode(anchor_hrefs(F.col("page.body.view.value"))).alias("href"))
    body = U.with_wiki_resolved(pin(body, {"href": M.unescape(F.col("href"), in_attribute=True)}), base)
    body = body.select("url", F.col("abs_url").alias("link"), F.lit(True).alias("must_be_page"))
    kids = raw.select("url", F.explode("page.children.page.results").alias("kid"))
    kids = kids.select("url", F.col("kid._links.webui").alias("w")).where("w <> ''")
    kids = kids.select(
        "url",
        F.when(F.col("w").startswith("http"), F.col("w")).otherwise(F.concat(F.lit(base), F.col("w"))).alias("link"),
        F.lit(False).alias("must_be_page"),
    )
    body = filter_wiki_links(body, rules, "link", pages_only=F.col("must_be_page"))
    kids = filter_wiki_links(kids, rules, "link")
    return union_links(body.select("url", "link"), kids.select("url", "link"))


def broken_links(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges whose target (``dst``) is no stored page (``clean_url``)."""
    return edges.join(stored.select(F.col("clean_url").alias("dst")).distinct(), "dst", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(url, out_links, in_links) in one aggregation: each edge counts once at both ends.

    Exploding the two ends and counting keeps everything map-side combinable, so a hub
    that holds a third of all edges costs one partial row per task.
    """
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("url").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


def canonical_groups(urls: DataFrame, col: str = "url") -> DataFrame:
    """(clean_url, n_variants): URLs that are one page."""
    return (
        urls.select(F.col(col).alias("url"))
        .distinct()
        .groupBy(U.clean_url("url").alias("clean_url"))
        .agg(F.count("*").alias("n_variants"))
    )


def path_collisions(urls: DataFrame, fmt: str = "markdown", out_dir: str = "out") -> DataFrame:
    """(local_path, n_urls): files that several clean URLs would overwrite."""
    paths = U.with_local_path(urls.select("clean_url").distinct(), "clean_url", fmt, out_dir)
    return paths.groupBy("local_path").agg(F.count("*").alias("n_urls")).where("n_urls > 1")
