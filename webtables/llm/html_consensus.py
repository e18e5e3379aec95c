"""HTML extraction: containers score, hosts vote on their paths, pages are read again by the winner.

Every page is read once into blocks of text (paragraphs, headings, list items) with the chain of
containers around them. A block gives its length without links to its nearest container and
half of it to the next one; text in an article or main element counts for the outermost of these.
A page's vote for a container is that container's share of the
page's score. Containers are named by their generalised path: tags and classes from the root,
without digits. Spark adds up the votes by host and path, and the strongest path of a host
is where its pages are read from the second time. A page without that path, or without text
there, is read from its own strongest container. Where the container is not marked as the article and
much text lies beside it (title, lead, sibling sections), the lowest container with nearly all text is read.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments never count, in or outside the container. Null and empty pages give an empty text;
malformed mark-up is read as far as it goes, in time linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.exchange import arrow_schema, stored
from webtables.llm.url_templates import host_and_path

#: Elements inside a line of text; all others end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article main section div td body html".split())
#: Elements whose content is never text of the page, and those that are read as raw text.
SKIPPED = set("nav footer aside form script style noscript template iframe object svg math head button select textarea dialog menu audio video canvas".split())
RAW = set("script style noscript template iframe textarea title svg math object".split())
#: Words in class, id or role that mark what is around the article.
AROUND = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus foot footer login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words in class or id that mark the article itself where no article element does.
INSIDE = set("article content entry post story".split())
#: Parts into which the pages of a very frequent host are dealt.
SALTS = 64
#: Share of a page's text outside links that counts as nearly all.
NEARLY = 0.9
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(raw)} if raw else {}


def read_blocks(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int]]]:
    """(blocks, containers): blocks are (text, characters in links, container), containers (path, parent).

    Blocks of skipped or surrounding elements are left out.
    """
    blocks: list[tuple[str, int, int]] = []
    containers: list[tuple[str, int]] = [("", -1)]
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, container, skipped, inside an article
    text: list[str] = []
    link, in_link, at, pattern = 0, False, 0, _TAG

    def end_block() -> None:
        nonlocal link
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line and not stack[-1][2]:
                blocks.append((line, min(link, len(line)), stack[-1][1]))
            text.clear()
        link = 0

    while at < len(page):
        sign = page.find("<", at)
        if sign < 0:
            sign = len(page)
        if sign > at:
            text.append(page[at:sign])
            if in_link:
                link += sign - at
            if sign == len(page):
                break
        if page.startswith("<!--", sign):
            stop = page.find("-->", sign + 4)
            at = len(page) if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), sign):
            stop = page.find(">", sign)
            at = len(page) if stop < 0 else stop + 1
            continue
        m = pattern.match(page, sign)
        if not m and pattern is _TAG and page[sign + 1 : sign + 2].isalpha():
            pattern = _PLAIN  # a quote that never closes: from here on quotes do not count
            m = pattern.match(page, sign)
        if not m:
            if page[sign + 1 : sign + 2].isalpha() or page[sign + 1 : sign + 2] == "/":
                if page.find(">", sign) < 0:
                    break  # a tag cut off at the end of the page
            text.append("<")
            at = sign + 1
            continue
        at = m.end()
        tag, closing = m[1].lower(), page[sign + 1] == "/"
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                text.append(" ")
            if closing or not m[2] or tag in VOID:
                continue
            near = _attributes(m[2])
            if not near or not _around(near, tag, stack[-1][3]):
                continue
        elif closing:
            end_block()
            in_link = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        else:
            end_block()
            in_link = False
            near = _attributes(m[2])
            if stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "option")):
                stack.pop()
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if not stop else stop.start()
            if not stop:
                break
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        if tag in INLINE:  # a marked span: what it holds is left out
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = at if not stop else stop.end()
            continue
        _, container, skipped, inside = stack[-1]
        skipped = skipped or tag in SKIPPED or _around(near, tag, inside)
        inside = inside or tag in ("article", "main") or _says(near, INSIDE, ("class", "id"))
        if tag in CONTAINERS:
            name = ".".join([tag, *sorted({re.sub(r"\d+", "", c.lower()) for c in near.get("class", "").split()} - {""})])
            containers.append((f"{containers[container][0]}>{name}", container))
            container = len(containers) - 1
        stack.append((tag, container, skipped, inside))
    end_block()
    return blocks, containers


def _around(near: dict[str, str], tag: str, inside: bool) -> bool:
    if tag == "header" and not inside:
        return True
    if not near or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in near or near.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(near.get("style", "")):
        return True
    return _says(near, AROUND, ("class", "id", "role")) or (not inside and _says(near, {"header"}, ("class", "id", "role")))


def _says(near: dict[str, str], words: set[str], names: tuple[str, ...]) -> bool:
    return any(name in near and words & {w.lower() for w in _WORD.findall(near[name])} for name in names)


def _last(path: str) -> list[str]:
    """Tag and classes of a path's container."""
    return path.rsplit(">", 1)[-1].split(".")


def enclosing(containers: list) -> list[int]:
    """For each container the outermost article or main element around it; itself where there is none."""
    out: list[int] = []
    for k, (path, parent) in enumerate(containers):
        above = out[parent] if parent >= 0 else k
        out.append(above if parent >= 0 and _last(containers[above][0])[0] in ("article", "main") else k)
    return out


def _marked(path: str) -> bool:
    """Whether a container says itself that it is the article."""
    tag, *classes = _last(path)
    return tag in ("article", "main") or any(INSIDE & set(_WORD.findall(c)) for c in classes)


def scores(blocks: list, containers: list) -> list[float]:
    """Score of each container of a page. All text of an article or main element counts for that element."""
    out, whole = [0.0] * len(containers), enclosing(containers)
    for text, link, container in blocks:
        worth = float(len(text) - link)
        container = whole[container]
        for share in (1.0, 0.5):
            if container >= 0:
                out[container] += share * worth
                container = containers[container][1]
    return out


def text_at(blocks: list, containers: list, path: str | None) -> str:
    """The blocks inside the containers of that path, or inside the page's own strongest container.

    Containers that do not say that they are the article, and hold less than ``NEARLY`` all of the page's text,
    give way to the lowest one around them that does.
    """

    def held(chosen: set[int]) -> list[bool]:
        out = [k in chosen for k in range(len(containers))]
        for k in range(1, len(containers)):
            out[k] = out[k] or out[containers[k][1]]
        return out

    def inside(chosen: set[int]) -> str:
        if not chosen:
            return ""
        within = held(chosen)
        if not all(_marked(containers[k][0]) for k in chosen):
            total = sum(b[1] for b in worth)
            if sum(w for k, w in worth if within[k]) < NEARLY * total:
                below = [0.0] * len(containers)
                for k, w in worth:
                    below[k] += w
                for k in range(len(containers) - 1, 0, -1):
                    below[containers[k][1]] += below[k]
                top = min(chosen)
                while top and below[top] < NEARLY * total:
                    top = containers[top][1]
                within = held(chosen | {top})
        return "\n".join(b[0] for b in blocks if within[b[2]])

    worth = [(container, float(len(text) - link)) for text, link, container in blocks]
    if path:
        text = inside({k for k, c in enumerate(containers) if c[0] == path})
        if text:
            return text
    own = scores(blocks, containers)
    best = max(own)
    return inside({own.index(best)}) if best > 0 else ""


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, vote): added up by Spark, a row per generalised path of a host."""
    ddl = "host string, path string, vote double"
    schema = arrow_schema(ddl)

    def task(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "html"):
            total: dict[tuple[str, str], float] = {}
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                blocks, containers = read_blocks(page or "")
                own = scores(blocks, containers)
                whole = sum(own)
                for (path, _), value in zip(containers, own):
                    if value > 0 and path:
                        total[host, path] = total.get((host, path), 0.0) + value / whole
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.float64())], schema=schema)

    return pages.select("host", "html").mapInArrow(task, ddl).groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))


def _with_winner(pages: DataFrame, best: DataFrame) -> DataFrame:
    """Pages with their host's path. Hosts above 1/SALTS of all votes (fewer than SALTS, so they fit a list) are dealt out."""
    whole = best.agg(F.sum("weight").alias("w")).first()["w"] or 0.0
    hot = [r["host"] for r in best.where(F.col("weight") * SALTS > whole).select("host").collect()]
    often = F.col("host").isin(hot) if hot else F.lit(False)
    salted = pages.withColumn("salt", F.when(often, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(best.select("host", "path", F.explode(every).alias("salt")), ["host", "salt"], "left")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, path (the container it was read from is the host's winner)."""
    host, _ = host_and_path(F.col(f"`{url_col}`").cast("string"))
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    best = votes(own).groupBy("host").agg(F.max(F.struct("vote", "path")).alias("best"), F.sum("vote").alias("weight"))
    best = stored(best.select("host", F.col("best.path").alias("path"), "weight"))
    both = _with_winner(own, best)
    shape = both.select("page_id", "url", "path", F.col("html").alias("text"))

    def task(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text"):
            texts = []
            for page, path in zip(part.column("text").to_pylist(), part.column("path").to_pylist()):
                blocks, containers = read_blocks(page or "")
                texts.append(text_at(blocks, containers, path))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string())], names=part.schema.names)

    return shape.mapInArrow(task, shape.schema)
