"""Pages as an ordered table of tokens, and the extent of every element in it.

A page is one row, so its tokens always fit one task. The page table is hash-partitioned
by page_id once, as whole compressed rows and before it is exploded; explode keeps that
partitioning, so none of the windows below (all of which cluster on page_id) shuffles
again. A table already bucketed by page_id skips even that one exchange
(``clustered=True``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from webtables.functions import markup as M
from webtables.functions.stages import pin

def in_page() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("pos")


def tokenize(
    pages: DataFrame,
    drop: tuple[str, ...] = ("script", "style", "noscript"),
    keep: tuple[str, ...] = (),
    clustered: bool = False,
) -> DataFrame:
    """(page_id, *keep, pos, tok, kind, tag, is_close) for every token of every page."""
    src = pages.select("page_id", *keep, "html")
    if not clustered:
        src = src.repartition("page_id")
    body = M.visible(F.col("html"), drop)
    toks = src.select("page_id", *keep, F.posexplode(M.tokens(body)).alias("pos", "tok"))
    toks = pin(toks, {"tag": M.tag_name(F.col("tok"))})
    kind = F.when(F.col("tag") != "", "tag").when(F.col("tok").rlike("^</?[A-Za-z!]"), "decl").otherwise("text")
    return toks.select(
        "page_id", *keep, "pos", "tok", kind.alias("kind"), "tag", F.col("tok").startswith("</").alias("is_close")
    )


def opens(tag_col: str = "tag") -> Column:
    """Tokens that open an element with content."""
    t = F.col(tag_col)
    return (t != "") & ~F.col("is_close") & ~t.isin(*M.VOID_TAGS) & ~F.col("tok").endswith("/>")


def with_element_end(tokens: DataFrame) -> DataFrame:
    """Add ``end_pos``: where the element a token opens is closed (NULL when it never is).

    Only same-tag depth counts, so an unclosed <p> or <b> disturbs nothing but itself. On
    one depth level of one tag, opening and closing tokens alternate; the partner of an
    opening token is therefore simply the next token of its level.
    """
    by_tag = Window.partitionBy("page_id", "tag").orderBy("pos")
    by_level = Window.partitionBy("page_id", "tag", "__level").orderBy("pos")
    closes = (F.col("tag") != "") & F.col("is_close")
    delta = F.when(opens(), 1).when(closes, -1).otherwise(0)
    depth = F.sum(delta).over(by_tag.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.when(opens(), F.col("__depth")).when(closes, F.col("__depth") + 1)
    return (
        tokens.withColumn("__depth", depth)
        .withColumn("__level", level)
        .withColumn("end_pos", F.when(opens(), F.lead("pos").over(by_level)))
        .drop("__depth", "__level")
    )
