"""Depth-bounded crawl frontier over a link graph.

The loop runs on the driver but holds no data there: each hop is one join and one
aggregate. Edges and every hop are written to the shared checkpoint folder, so neither the
plan nor the recomputation grows with the depth, and a lost executor costs one stage.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtables.functions import urls as U
from webtables.session import cut_lineage


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(clean_url, depth, parent_url): breadth-first from the seeds, each URL once.

    ``edges`` has src and dst, ``seeds`` has clean_url. Links are followed while the depth
    is below ``max_depth``. Where several pages of one hop lead to a URL the smallest
    parent is recorded, which makes the result independent of arrival order.

    The edges are stored as they come and not partitioned by source, on purpose: a source
    holding a large part of them would fill one partition, which no join could split any
    more. As it is, a small hop is broadcast (by measured size), a large one joins by
    shuffle with AQE splitting the hot source, and a popular target is combined map-side
    before it is shuffled.
    """
    graph = cut_lineage(edges.select("src", "dst").where("src <> dst"))
    start = seeds.select(
        "clean_url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url")
    ).dropDuplicates(["clean_url"])
    hop = cut_lineage(start)
    visited = hop
    for depth in range(1, max_depth + 1):
        reached = (
            hop.select(F.col("clean_url").alias("src"))
            .join(graph, "src")
            .groupBy(F.col("dst").alias("clean_url"))
            .agg(F.min("src").alias("parent_url"))
        )
        fresh = reached.join(visited.select("clean_url"), "clean_url", "left_anti")
        hop = cut_lineage(fresh.select("clean_url", F.lit(depth).alias("depth"), "parent_url"))
        if hop.isEmpty():
            break
        visited = visited.unionByName(hop)
    return visited


def extend_frontier(visited: DataFrame, edges: DataFrame, new_links: DataFrame, max_depth: int) -> DataFrame:
    """``visited`` (as from crawl_frontier over ``edges``) after ``new_links`` have been found; nothing starts from the seeds again.

    Semi-naive: at each depth only two kinds of links are followed, new ones from pages of the depth before, and all links of pages
    that have just come to the depth before. What they reach gets a lower depth and spreads onwards, or, where the depth
    is the same, a smaller parent. A page that keeps its depth cannot lose its parent, as a parent that moves up takes its
    targets along. The result equals a full run over all links, which the caller keeps as the next ``edges``.
    """
    links = cut_lineage(new_links.select("src", "dst").where("src <> dst").distinct())
    graph = edges.select("src", "dst").where("src <> dst").unionByName(links)
    seen = visited.select("clean_url", "depth", "parent_url")
    # New links with the depth their source had; the few sources go to the large table, not the other way round.
    starts = cut_lineage(links.join(seen.select(F.col("clean_url").alias("src"), F.col("depth").alias("was")), "src", "left"))
    deepest = starts.agg(F.max("was")).first()[0]
    changed = seen.where(F.lit(False))
    moved = None
    for depth in range(1, max_depth + 1):
        if moved is None and (deepest is None or depth - 1 > deepest):
            break
        now = changed.select(F.col("clean_url").alias("src"), F.col("depth").alias("now"))
        reached = starts.join(now, "src", "left").where(F.coalesce("now", "was") == depth - 1).select("src", "dst")
        if moved is not None:
            reached = reached.unionByName(moved.select(F.col("clean_url").alias("src")).join(graph, "src").select("src", "dst"))
        best = cut_lineage(reached.groupBy(F.col("dst").alias("clean_url")).agg(F.min("src").alias("new_parent")))
        if best.isEmpty():
            moved = None
            continue
        old = seen.join(best.select("clean_url"), "clean_url", "left_semi").select("clean_url", F.col("depth").alias("was"), "parent_url")
        over = changed.select("clean_url", F.col("depth").alias("now"), F.col("parent_url").alias("now_parent"))
        here = best.join(old, "clean_url", "left").join(over, "clean_url", "left")
        here = here.select(
            "clean_url", "new_parent", F.coalesce("now", "was").alias("had"),
            F.when(F.col("now").isNotNull(), F.col("now_parent")).otherwise(F.col("parent_url")).alias("had_parent"),
        )
        lower = F.col("had").isNull() | (F.col("had") > depth)
        renamed = (F.col("had") == depth) & (F.col("new_parent") < F.col("had_parent"))
        step = cut_lineage(
            here.where(lower | renamed).select("clean_url", F.lit(depth).alias("depth"), F.col("new_parent").alias("parent_url"), lower.alias("lower"))
        )
        # No page changes twice: it is looked at at its own, final depth only, or came to a lower one before.
        changed = changed.unionByName(step.drop("lower"))
        moved = step.where("lower").select("clean_url")
        moved = None if moved.isEmpty() else moved
    return seen.join(changed.select("clean_url"), "clean_url", "left_anti").unionByName(changed)


def expand_spaces(frontier: DataFrame, listing: DataFrame) -> DataFrame:
    """Replace space index pages by all pages of their space, at depth 0.

    ``frontier`` has url and depth, ``listing`` space_key and url. The index itself is no
    document and goes. URLs that come from both sides keep the smaller depth.
    """
    is_index = U.is_space_index("url")
    spaces = frontier.where(is_index).select(U.space_key("url").alias("space_key")).distinct()
    pages = listing.join(spaces, "space_key", "left_semi").select("url", F.lit(0).alias("depth"))
    both = frontier.where(~is_index).select("url", "depth").unionByName(pages)
    return both.groupBy(U.normalize_url("url").alias("url")).agg(F.min("depth").alias("depth"))


def pending(discovered: DataFrame, limit: int | None = None) -> DataFrame:
    """(url, depth) still to fetch, shallow and old first; the URL breaks ties."""
    rows = discovered.where("status = 'pending'").orderBy("depth", "discovered_at", "url")
    return (rows.limit(limit) if limit else rows).select("url", "depth")


def resume(discovered: DataFrame, seed: str) -> DataFrame:
    """Pending URLs if there are any, else the seed."""
    waiting = discovered.where("status = 'pending'").select("url", "depth")
    # One row, and only when nothing waits: part of the same plan, so no job runs before it.
    start = waiting.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(seed).alias("url"), F.lit(0).alias("depth"))
    return waiting.unionByName(start)


def fetch_schedule(waiting: DataFrame, start: datetime, delay: float, order: tuple[str, ...] = ("depth", "discovered_at", "url")) -> DataFrame:
    """(url, host, place, fetch_at): when each waiting URL may be fetched at the earliest, ``delay`` seconds apart on each host.

    ``waiting`` has url and the columns of ``order``; the host is the URL's, in lower case ('' if it has none). The places on a host are a running count, made
    in two levels: URLs are dealt out by ranges of (host, order), each range counts its own URLs per host, and the
    counts of the ranges before are added. So a host with most of all URLs is spread over many ranges, and no
    task holds more than one of them. Repeated rows take a place each; NULLs of ``order`` come first.
    """
    parts = int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = waiting.select(F.coalesce(F.lower(U.netloc("url")), F.lit("")).alias("host"), "url", *[c for c in order if c != "url"])
    # Stored, so that every reader sees the same ranges.
    dealt = cut_lineage(rows.repartitionByRange(parts, "host", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("host", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("host", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part", "host").orderBy(*order)))
    placed = own.join(offsets, ["host", "part"]).withColumn("place", F.col("before") + F.col("own") - 1)
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("place") * F.lit(delay * 1_000_000)).cast("bigint")
    return placed.select("url", "host", "place", F.timestamp_micros(micros).alias("fetch_at"))


def new_links_per_page(discovered: DataFrame) -> DataFrame:
    """(parent_url, links_extracted): URLs each page was the first to bring in."""
    found = discovered.where("parent_url IS NOT NULL")
    return found.groupBy("parent_url").agg(F.count("*").alias("links_extracted"))
