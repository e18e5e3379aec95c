"""Style sheets and images: references, registry, types, collisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import markup as M
from webtables.functions import urls as U
from webtables.functions.stages import pin

# Hosts whose files go to the cdn_images folder.
CDN_HOSTS = (
    "media-cdn.atlassian.com",
    "avatar-management--avatars.us-west-2.prod.public.atl-paas.net",
    "secure.gravatar.com",
)

# Resource types by the first substring found in the lower-cased URL.
RESOURCE_TYPES = (
    ("css", (".css",)),
    ("js", (".js", ".javascript")),
    ("image", (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico")),
    ("font", (".woff", ".woff2", ".ttf", ".eot")),
)


def _any_in(u: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [u.contains(p) for p in parts])


def resource_type(url: Column | str) -> Column:
    u = F.lower(F.col(url) if isinstance(url, str) else url)
    chain = F
    for name, parts in RESOURCE_TYPES:
        chain = chain.when(_any_in(u, parts), name)
    return chain.otherwise("other")


def with_resource_type(df: DataFrame, col: str = "url") -> DataFrame:
    return df.withColumn("resource_type", resource_type(col))


def reference_attr(tok: Column) -> tuple[Column, Column]:
    """(kind, raw URL) of a token that refers to a resource, NULLs otherwise."""
    rels = F.concat(F.lit(" "), F.regexp_replace(M.raw_attr(tok, "rel"), r"\s+", " "), F.lit(" "))
    css = tok.rlike(r"(?i)^<link[\s/]") & rels.contains(" stylesheet ")
    img = tok.rlike(r"(?i)^<img[\s/]")
    kind = F.when(css, "css").when(img, "img")
    value = F.when(css, M.attr(tok, "href")).when(img, M.attr(tok, "src"))
    return kind, value


def resource_refs(pages: DataFrame, hosts: tuple[str, ...] = (), types: tuple[str, ...] = ("css", "img")) -> DataFrame:
    """(page_id, kind, url): resolved resource references, one row per occurrence.

    ``hosts`` keeps URLs that hold one of the given strings; empty keeps all. Filtering
    happens inside the page row, so only references are ever exploded.
    """
    toks = F.filter(M.tokens(M.visible(F.col("html"))), lambda t: t.rlike(r"(?i)^<(?:link|img)[\s/]") & t.endswith(">"))
    rows = pages.select("page_id", U.clean_url("url").alias("src"), F.explode(toks).alias("tok"))
    kind, value = reference_attr(F.col("tok"))
    rows = pin(rows, {"kind": kind, "ref": value}, drop=("tok",))
    rows = rows.where((F.col("ref") != "") & F.col("kind").isin(*types))
    rows = U.with_resolved(rows, "src", "ref", "url")
    if hosts:
        rows = rows.where(_any_in(F.col("url"), hosts))
    return rows.select("page_id", "kind", "url")


def stored_name(url: Column, kind: Column) -> Column:
    """Last path part, or a name made from the URL's md5 when that has no extension."""
    name = U.last_segment(url)
    number = F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("bigint") % 10000
    made = F.concat(F.lit("resource_"), number.cast("string"), F.when(kind == "css", ".css").otherwise(".png"))
    return F.when(name.contains("."), name).otherwise(made)


def stored_path(url: Column, kind: Column, root: str, cdn_hosts: tuple[str, ...] = CDN_HOSTS) -> Column:
    folder = F.when(_any_in(url, cdn_hosts), f"{root}/cdn_images/") if cdn_hosts else F.when(F.lit(False), "")
    return F.concat(folder.otherwise(f"{root}/"), stored_name(url, kind))


def resource_registry(
    refs: DataFrame, root: str = "out/shared_resources", cdn_hosts: tuple[str, ...] = CDN_HOSTS
) -> DataFrame:
    """One row per resource URL with its stored path and the number of pages using it.

    A logo on every page is the normal case: the pages are first made distinct per
    (url, page) with map-side combining, so a hot URL never gathers in one task.
    """
    # A flag instead of the kind itself: flags aggregate by hash, strings only by sort.
    css = F.col("kind") == "css"
    per_page = refs.groupBy("url", "page_id").agg(F.max(css).alias("css"))
    per_url = per_page.groupBy("url").agg(F.max("css").alias("css"), F.count("*").alias("n_pages"))
    per_url = per_url.withColumn("resource_type", F.when(F.col("css"), "css").otherwise("img"))
    return per_url.select(
        "url",
        stored_path(F.col("url"), F.col("resource_type"), root, cdn_hosts).alias("local_path"),
        "resource_type",
        F.lit(True).alias("is_transversal"),
        F.lit(None).cast("string").alias("referenced_by"),
        "n_pages",
    )


def resource_collisions(registry: DataFrame) -> DataFrame:
    """(local_path, n_urls): stored files that several URLs share."""
    return registry.groupBy("local_path").agg(F.count("*").alias("n_urls")).where("n_urls > 1")
