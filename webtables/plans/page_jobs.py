"""Queries over page content: links, tokens, main content, rewriting, resources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from webtables.functions import urls as U
from webtables.operators import content as C
from webtables.operators import links as L
from webtables.operators import markdown as M
from webtables.operators import resources as R
from webtables.operators import rewrite as W
from webtables.operators import selectors as E
from webtables.operators.scope import Rules
from webtables.operators.tokens import tokenize
from webtables.plans import duck as D
from webtables.plans import inputs as I
from webtables.session import cut_lineage
from webtables.sources.pages import dealt

LINKS = Rules(exclude=("/login", "?delete", "action=", "/th"), valid=("/",))
OUT_OF_REWRITE = ("/login", "/th", "other.example.org")
REWRITE = Rules(exclude=OUT_OF_REWRITE)
HOSTS = ("secure.gravatar.com", "cdn0.example.net", "example.com")


def html_tokens(spark, sf):
    return tokenize(I.pages(spark, sf)).select("page_id", "pos", "tok", "kind", "tag", "is_close")


def html_links(spark, sf):
    return L.extract_links(I.pages(spark, sf), LINKS)


def html_strip_active(spark, sf):
    return C.strip_active(I.rich_pages(spark, sf))


def _main(spark, sf):
    return C.main_content(I.rich_pages(spark, sf).select("page_id", "html"))


def html_main(spark, sf):
    return C.assemble(_main(spark, sf))


def html_boilerplate(spark, sf):
    return C.assemble(C.drop_boilerplate(_main(spark, sf)))


# Elements that a clean page loses: a usual list, and a chain.
REMOVED = ("script", "noscript", "iframe[src*='ads']", ".advertisement", "#sidebar", "div.advert > table td.k")
_CLUTTER = (
    "'<div id=\"sidebar\">side<div>in</div></div><iframe src=\"/ads/' || page_id || '\"></iframe><iframe src=\"/video\"></iframe><p class=\"x advertisement\">ad<b>s</b></p>"
    "<noscript>n<b>s</b></noscript><div class=\"advert\"><p class=\"k\">kept</p><table><tr><td class=\"k\">gone' || page_id || '</td><td>kept</td></tr></table>"
    "<div><table><tr><td class=\"k\">no child</td></tr></table></div></div></article>'"
)
_CLUTTERED = f"replace(html, '</article>', {_CLUTTER})"


def _cluttered(spark, sf):
    return I.rich_pages(spark, sf).withColumn("html", F.expr(_CLUTTERED))


def html_remove_elements(spark, sf):
    return E.remove_elements(_cluttered(spark, sf), REMOVED)


def html_select_elements(spark, sf):
    """Links and images inside articles, with their place among the tokens of the page."""
    return E.select_elements(_cluttered(spark, sf), "article a[href^='/'], article img[alt]").select("page_id", "pos", "tok", "html")


def html_title(spark, sf):
    return C.page_titles(I.rich_pages(spark, sf))


def html_text(spark, sf):
    return C.main_text(C.drop_boilerplate(_main(spark, sf)))


def html_markdown(spark, sf):
    return M.to_markdown(C.drop_boilerplate(_main(spark, sf)))


def _documents(spark, sf):
    """Plain documents (title, url, text) as the body under the headers."""
    docs = I.table(spark, sf, "documents")
    ident = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", F.concat(F.lit("https://wiki.example.com/pages/"), ident).alias("url"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Doc "), ident)).alias("title"),
        F.upper("source").alias("space_key"), F.concat(F.lit("Space "), "source").alias("space_name"),
        ident.alias("page_id"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
        .alias("updated_when"),
        F.col("text").alias("markdown"),
    )


def md_header(spark, sf):
    docs = _documents(spark, sf)
    html = M.with_md_header(docs, "html").select("doc_id", F.lit("html").alias("mode"), "content")
    return html.unionByName(M.with_md_header(docs, "api").select("doc_id", F.lit("api").alias("mode"), "content"))


def html_rewrite_links(spark, sf):
    return W.rewrite_links(I.rich_pages(spark, sf), REWRITE)


def html_resources(spark, sf):
    return R.resource_refs(I.rich_pages(spark, sf), HOSTS)


def resource_registry(spark, sf):
    return R.resource_registry(R.resource_refs(I.rich_pages(spark, sf)))


def resource_type(spark, sf):
    shown = I.resource_uses(spark, sf).select("url").distinct()
    return R.with_resource_type(shown)


def resource_rewrite(spark, sf):
    pages = I.rich_pages(spark, sf)
    # Read twice below: written out once instead of cutting every page into tokens again.
    refs = cut_lineage(R.resource_refs(pages))
    stored = R.resource_registry(refs).where("url NOT LIKE '%/static/i3.png'")
    return W.rewrite_resources(W.with_stored_resources(pages, refs, stored))


def resource_collisions(spark, sf):
    return R.resource_collisions(R.resource_registry(R.resource_refs(I.rich_pages(spark, sf))))


def content_stats(spark, sf):
    pages = I.rich_pages(spark, sf)
    return C.content_stats(pages.withColumn("html", F.expr("if(page_id % 2 = 0, html, replace(html, 'table', 'TaBle'))"))).unionByName(
        C.content_stats(I.pages(spark, sf))
    )


def auth_wall(spark, sf):
    """Pages, pages with a phrase in them, and documents cut to short ones by their own text."""
    pages = I.pages(spark, sf).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.expr("if(page_id % 9 = 0, replace(html, '</article>', 'you MUST log In</article>'), html)").alias("html"),
    )
    docs = I.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit(" \n\t"), "text", F.lit("\n ")).alias("html"),
    )
    return C.flag_auth_walls(pages.unionByName(docs)).select("id", "is_auth_wall")


def attachment_rewrite(spark, sf):
    pages = attachment_pages(spark, sf)
    atts = page_attachment_list(spark, sf)
    return W.rewrite_attachments(W.with_shown_attachments(pages, atts))


_SHOWN_FORMS = (
    "'https://wiki.example.com/wiki/download/attachments/' || page_id || '/f0.png?v=1'",
    "'/wiki/download/attachments/' || page_id || '/f1.png'",
    "'/download/attachments/' || page_id || '/f0.png?x=1'",
    "'download/attachments/' || page_id || '/f1.png'",
    "'https://cdn.example.org/wiki/download/thumbnails/' || page_id || '/f0.png?w=9'",
    "'/wiki/download/thumbnails/' || page_id || '/f1.png'",
    "'/wiki/download/attachments/' || page_id || '/missing.png'",
    "'https://else.example.org/wiki/download/attachments/' || page_id || '/f0.png'",
)
_SHOWN_HTML = " || ".join(f"'<img src=\"' || {form} || '\">'" for form in _SHOWN_FORMS)


def attachment_pages(spark, sf):
    return dealt(I.pages(spark, sf)).withColumn("html", F.expr(f"replace(html, '</article>', {_SHOWN_HTML} || '</article>')"))


def page_attachment_list(spark, sf):
    """Two attachments of every page."""
    pages = I.pages(spark, sf)
    ident = F.col("page_id").cast("string")
    return pages.select("page_id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("n")).select(
        "page_id",
        F.concat(F.lit("https://wiki.example.com/wiki/download/attachments/"), ident, F.lit("/f"), "n", F.lit(".png?v=2")).alias("download_url"),
        F.concat(F.lit("spaces/S/pages/"), ident, F.lit("/attachments/a"), "n", F.lit("_f"), "n", F.lit(".png")).alias("local_path"),
    )


def broken_links(spark, sf):
    """Links to pages that are not stored; the home page of every host is."""
    pages = I.pages(spark, sf)
    stored = pages.select(
        F.explode(F.array(U.clean_url("url"), F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/to")))).alias("clean_url")
    )
    return L.broken_links(L.extract_links(pages, Rules()), stored).select("page_id", "src", "dst")


def set_link_union(spark, sf):
    edges = L.extract_links(I.pages(spark, sf), LINKS).select("src", "dst")
    rich = L.extract_links(I.rich_pages(spark, sf), LINKS).select("src", "dst")
    return L.union_links(edges, rich)


def link_degree(spark, sf):
    return L.degrees(L.extract_links(I.rich_pages(spark, sf), LINKS))


QUERIES = {
    f.__name__: f
    for f in (
        html_tokens, html_links, html_strip_active, html_main, html_boilerplate, html_title, html_text, html_markdown,
        md_header, html_rewrite_links, html_resources, resource_registry, resource_type, resource_rewrite,
        resource_collisions, content_stats, auth_wall, attachment_rewrite, broken_links, set_link_union, link_degree,
        html_remove_elements, html_select_elements,
    )
}


# --- twins ---------------------------------------------------------------------------------

_ANCHOR = "tok LIKE '%>' AND regexp_matches(tok, '(?i)^<a[\\s/]') AND regexp_matches(tok, '(?i)[\\s/]href[\\s=/>]')"


def _links(source: str, name: str = "found", valid: str = "true") -> str:
    """CTEs ending in ``name``: (page_id, src, dst)."""
    n = name
    return f"""{D.tokens(source, ('script', 'style'), name=n + '_t')},
{n}_a AS (SELECT page_id, {D.clean_url('url')} AS src, {D.attr('tok', 'href')} AS href FROM {n}_t WHERE {_ANCHOR}),
{D.resolved(n + '_a', 'src', 'href', name=n + '_x')},
{n} AS (SELECT DISTINCT page_id, src, {D.clean_url('abs_url')} AS dst FROM {n}_x
  WHERE (abs_url LIKE 'http://%' OR abs_url LIKE 'https://%') AND {valid})"""


_IN_LINKS = "NOT (contains(abs_url, '/login') OR contains(abs_url, '?delete') OR contains(abs_url, 'action=') OR contains(abs_url, '/th'))"
_MAIN = f"WITH {I.RICH_PAGES}, {D.tokens('rich')}, {D.main()}"
_CHAIN = "string_agg({piece}, '' ORDER BY pos)"
_VALUE = """(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>"'']+))?"""
_HANDLERS = f"""(?i)[\\s/]+on[^\\s=/>"'']*{_VALUE}|([\\s/]+[^\\s=/>"'']+{_VALUE})"""


def _set_attr(name: str, value: str) -> str:
    v = """(?:"[^"]*"|''[^'']*''|[^\\s>"'']+)"""
    other = f"""(?:[\\s/]+[^\\s=/>"'']+(?:\\s*=\\s*{v})?)*?"""
    head = f"""regexp_extract(tok, '(?is)^(<[A-Za-z][^\\s/>]*{other}[\\s/]+{name}\\s*=\\s*){v}', 1)"""
    whole = f"""regexp_extract(tok, '(?is)^<[A-Za-z][^\\s/>]*{other}[\\s/]+{name}\\s*=\\s*{v}', 0)"""
    return f"""({head} || '"' || {value} || '"' || substring(tok, length({whole}) + 1))"""


_REF = f"""CASE WHEN regexp_matches(tok, '(?i)^<link[\\s/]') AND ' ' || {D.attr('tok', 'rel')} || ' ' LIKE '% stylesheet %' THEN {D.attr('tok', 'href')}
  WHEN regexp_matches(tok, '(?i)^<img[\\s/]') THEN {D.attr('tok', 'src')} END"""
_REFS = f"""{I.RICH_PAGES}, {D.tokens('rich')},
ref0 AS (SELECT *, {D.clean_url('url')} AS src, {_REF} AS ref, CASE WHEN tag = 'link' THEN 'css' ELSE 'img' END AS rkind FROM tok),
ref1 AS (SELECT page_id, pos, src, rkind, ref FROM ref0 WHERE ref <> ''), {D.resolved('ref1', 'src', 'ref', 'rurl', 'refs')}"""
_NAME = "regexp_extract({p}, '([^/]+)/*$', 1)".format(p=D.path("rurl"))
_CDN = " OR ".join(f"contains(rurl, '{host}')" for host in R.CDN_HOSTS)
_REGISTRY = f"""{_REFS}, reg0 AS (SELECT rurl, min(rkind) AS rkind, count(DISTINCT page_id) AS n_pages FROM refs GROUP BY rurl),
registry AS (SELECT rurl AS url, 'out/shared_resources/' || CASE WHEN {_CDN} THEN 'cdn_images/' ELSE '' END
   || CASE WHEN contains({_NAME}, '.') THEN {_NAME} ELSE 'resource_' || (CAST('0x' || substring(md5(rurl), 1, 8) AS BIGINT) % 10000)
   || CASE WHEN rkind = 'css' THEN '.css' ELSE '.png' END END AS local_path,
   rkind AS resource_type, true AS is_transversal, CAST(NULL AS VARCHAR) AS referenced_by, n_pages FROM reg0)"""
_SHOWN_SQL = f"shown AS (SELECT page_id, url, replace(html, '</article>', {_SHOWN_HTML} || '</article>') AS html FROM pages)"
_PHRASES = "|".join(re.escape(phrase.lower()) for phrase in C.AUTH_WALL_PHRASES)
_DOC_SQL = """SELECT doc_id, 'https://wiki.example.com/pages/' || doc_id AS url, CASE WHEN doc_id % 7 <> 0 THEN 'Doc ' || doc_id ELSE 'Confluence Page' END AS title,
  upper(source) AS space_key, 'Space ' || source AS space_name,
  CASE WHEN doc_id % 5 <> 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') ELSE 'N/A' END AS updated_when, text FROM documents"""

# All tokens of a page with comments and raw elements whole, where elements end, and what the selectors look at.
_WHOLE = (
    "((?s:<!--.*?(?:-->|\\z))|" + "|".join(f"(?is:<{t}(?:[\\s/][^>]*)?>.*?(?:</{t}(?:[\\s/][^>]*)?>|\\z))" for t in ("script", "style")) + "|" + D.TOKEN[1:]
)
_ELEMENTS = f"""clut AS (SELECT page_id, {_CLUTTERED} AS html FROM rich),
wl AS (SELECT page_id, regexp_extract_all(html, '{_WHOLE}', 1) AS l FROM clut),
wr AS (SELECT page_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS tok FROM wl),
wt AS (SELECT *, lower(regexp_extract(tok, '(?s)^</?([A-Za-z][^\\s/>]*).*>$', 1)) AS tag, tok LIKE '</%' AS is_close FROM wr),
wo AS (SELECT *, tag <> '' AND NOT is_close AND tag NOT IN ({D.VOID}, 'script', 'style') AND tok NOT LIKE '%/>' AS opens FROM wt),
wd AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN tag <> '' AND is_close THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM wo),
we AS (SELECT *, CASE WHEN opens THEN lead(pos) OVER (PARTITION BY page_id, tag, CASE WHEN opens THEN depth WHEN tag <> '' AND is_close THEN depth + 1 END ORDER BY pos) END AS e FROM wd),
el AS (SELECT page_id, pos, tok, tag, CASE WHEN opens THEN coalesce(e, 2147483647) ELSE pos END AS e, ' ' || regexp_replace({D.attr('tok', 'class')}, '\\s+', ' ', 'g') || ' ' AS cls,
  {D.attr('tok', 'id')} AS ident, {D.attr('tok', 'src')} AS src, {D.attr('tok', 'href')} AS href FROM we WHERE tag <> '' AND NOT is_close)"""

_NL = "chr(10)"
_BLOCK_TAGS = "'p', 'div', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'ul', 'ol', 'li', 'pre', 'blockquote', 'table', 'tr', 'td', 'th'"
_HEADS = "'h1', 'h2', 'h3', 'h4', 'h5', 'h6'"


def _depth(tags: str) -> str:
    return f"greatest(sum(CASE WHEN tag IN ({tags}) THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER o, 0)"


def _last(value: str, tags: str, over: str = "o") -> str:
    return f"last_value(CASE WHEN tag IN ({tags}) AND NOT is_close THEN {value} END IGNORE NULLS) OVER {over}"


def _opened(tags: str, over: str = "o") -> str:
    return f"sum(CASE WHEN tag IN ({tags}) AND NOT is_close THEN 1 ELSE 0 END) OVER {over}"


def _hint(title: str) -> str:
    return f"""CASE WHEN coalesce({title}, '') <> '' THEN ' "' || {title} || '"' ELSE '' END"""


# Every token's context by running sums, one CASE per tag, the fragments joined and tidied.
_O = "o AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_D = "d AS (PARTITION BY page_id, list_ ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_ALT, _SRC, _IMG_TITLE = D.attr("tok", "alt"), D.attr("tok", "src"), D.attr("tok", "title")
_HREF = D.attr("tok", "href")
# Ends in markdown_of (page_id, markdown), from main_kept.
MARKDOWN = rf"""c1 AS (SELECT page_id, pos, tok, kind, tag, is_close, {_depth("'ul', 'ol'")} AS list_, {_depth("'blockquote'")} AS quote_, {_depth("'pre'")} AS pre_,
    {_depth("'code'")} AS code_, {_depth(_HEADS)} AS head_, {_depth("'td', 'th'")} AS cell_, {_opened("'tr'")} AS rows_, {_opened("'td', 'th'")} AS cells_,
    {_last(_HREF, "'a'")} AS href, {_last(_IMG_TITLE, "'a'")} AS title, lag(tag, 1, 'p') OVER b AS prev_, lead(tag, 1, 'p') OVER b AS next_,
    lead(tok, 1) OVER b AS next_tok, lead(tag, 2) OVER b || CAST(lead(is_close, 2) OVER b AS VARCHAR) AS after_
  FROM main_kept WINDOW {_O}, b AS (PARTITION BY page_id ORDER BY pos)),
c2 AS (SELECT *, rows_ - coalesce({_last("rows_", "'table'")}, 0) AS row_no, cells_ - coalesce({_last("cells_", "'tr'")}, 0) AS row_cells,
    {_last(f"({_HREF} <> '' AND next_tok = {_HREF} AND after_ = 'atrue')", "'a'")} AS auto_, {_opened("'li'", "d")} AS items_,
    {D.unescape("tok")} AS plain FROM c1 WINDOW {_O}, {_D}),
c3 AS (SELECT *, {_last("tag", "'ul', 'ol'", "d")} AS list_kind, {_last("items_", "'ul', 'ol'", "d")} AS list_n,
    regexp_replace(plain, '\s+', ' ', 'g') AS flat0 FROM c2 WINDOW {_D}),
c4 AS (SELECT *, CASE WHEN prev_ IN ({_BLOCK_TAGS}) THEN ltrim(flat0) ELSE flat0 END AS flat1 FROM c3),
c5 AS (SELECT *, CASE WHEN next_ IN ({_BLOCK_TAGS}) THEN rtrim(flat1) ELSE flat1 END AS flat FROM c4),
c6 AS (SELECT page_id, pos, quote_, CASE
    WHEN kind = 'text' THEN CASE WHEN pre_ > 0 THEN regexp_replace(plain, '\r?\n', chr(57344), 'g') WHEN code_ > 0 THEN flat ELSE regexp_replace(flat, '([*_])', '\\\1', 'g') END
    WHEN kind = 'decl' THEN ''
    WHEN tag IN ('p', 'div') THEN CASE WHEN cell_ > 0 OR head_ > 0 THEN ' ' WHEN list_ > 0 AND (is_close OR prev_ = 'li') THEN ''
      WHEN list_ > 0 THEN {_NL} || {_NL} || repeat('    ', list_::BIGINT) ELSE {_NL} || {_NL} END
    WHEN tag IN ({_HEADS}) THEN CASE WHEN is_close THEN {_NL} || {_NL} ELSE {_NL} || {_NL} || repeat('#', CAST(substring(tag, 2, 1) AS BIGINT)) || ' ' END
    WHEN tag = 'li' THEN CASE WHEN is_close THEN '' ELSE {_NL} || repeat('    ', greatest(list_ - 1, 0)::BIGINT) ||
      CASE WHEN list_kind = 'ol' THEN CAST((items_ - list_n)::BIGINT AS VARCHAR) || '. ' ELSE '- ' END END
    WHEN tag IN ('ul', 'ol') THEN CASE WHEN list_ - CASE WHEN is_close THEN 0 ELSE 1 END > 0 THEN '' ELSE {_NL} || {_NL} END
    WHEN tag = 'a' THEN CASE WHEN coalesce(href, '') = '' THEN '' WHEN auto_ THEN CASE WHEN is_close THEN '>' ELSE '<' END
      WHEN is_close THEN '](' || href || {_hint("title")} || ')' ELSE '[' END
    WHEN tag = 'strong' THEN '**' WHEN tag = 'em' THEN '*' WHEN tag = 'code' AND pre_ = 0 THEN '`'
    WHEN tag = 'pre' THEN CASE WHEN is_close THEN {_NL} || '```' || {_NL} || {_NL} ELSE {_NL} || {_NL} || '```' || {_NL} END
    WHEN tag = 'blockquote' THEN {_NL} || {_NL}
    WHEN tag = 'img' THEN CASE WHEN cell_ > 0 OR head_ > 0 THEN {_ALT} ELSE '![' || {_ALT} || '](' || {_SRC} || {_hint(_IMG_TITLE)} || ')' END
    WHEN tag = 'table' THEN {_NL} || {_NL}
    WHEN tag = 'tr' THEN CASE WHEN NOT is_close THEN {_NL} WHEN row_no = 1 THEN '|' || {_NL} || '|' || repeat(' --- |', row_cells::BIGINT) ELSE '|' END
    WHEN tag IN ('td', 'th') THEN CASE WHEN is_close THEN ' ' ELSE '| ' END ELSE '' END AS frag0 FROM c5),
c7 AS (SELECT page_id, pos, CASE WHEN quote_ > 0 THEN replace(frag0, {_NL}, {_NL} || repeat('> ', quote_::BIGINT)) ELSE frag0 END AS frag FROM c6),
c8 AS (SELECT page_id, coalesce(string_agg(frag, '' ORDER BY pos), '') AS md FROM c7 GROUP BY page_id),
markdown_of AS (SELECT page_id, replace(regexp_replace(regexp_replace(md, '(?:\n((?:> )*)){{2,}}', {_NL} || {_NL} || '\1', 'g'), '^\s+|\s+$', '', 'g'), chr(57344), {_NL}) AS markdown FROM c8)"""


TITLE = f"""coalesce(nullif({D.unescape("regexp_extract(regexp_replace(html, '" + D.hidden(("script", "style", "noscript")) + "', '', 'g'), '(?is)<title(?:[\\s/][^>]*)?>(.*?)</title[\\s/>]', 1)")}, ''), 'Confluence Page')"""

ORACLE = {
    "html_tokens": f"WITH {D.tokens('pages')} SELECT page_id, pos, tok, kind, tag, is_close FROM tok",
    "html_links": f"WITH {_links('pages', valid=_IN_LINKS)} SELECT page_id, src, dst FROM found",
    "html_strip_active": f"""WITH {I.RICH_PAGES}, {D.tokens('rich')} SELECT page_id, string_agg(CASE WHEN tag <> '' AND NOT is_close AND regexp_matches(tok, '(?i)[\\s/]on')
      THEN regexp_replace(tok, '{_HANDLERS}', '\\1', 'g') ELSE tok END, '' ORDER BY pos) AS html FROM tok
      WHERE NOT (tag = 'meta' AND lower({D.attr('tok', 'http-equiv')}) = 'refresh') GROUP BY page_id""",
    "html_main": f"{_MAIN} SELECT page_id, string_agg(tok, '' ORDER BY pos) AS html FROM main_all GROUP BY page_id",
    "html_boilerplate": f"{_MAIN} SELECT page_id, string_agg(tok, '' ORDER BY pos) AS html FROM main_kept GROUP BY page_id",
    "html_remove_elements": f"""WITH {I.RICH_PAGES}, {_ELEMENTS},
      child AS (SELECT d.page_id, t.pos, t.e FROM el d JOIN el t ON d.page_id = t.page_id AND t.pos > d.pos AND t.pos <= d.e WHERE d.tag = 'div' AND d.cls LIKE '% advert %' AND t.tag = 'table'
        AND NOT EXISTS (SELECT 1 FROM el m WHERE m.page_id = d.page_id AND m.pos > d.pos AND m.pos < t.pos AND m.e > t.pos)),
      hit AS (SELECT page_id, pos, e FROM el WHERE tag IN ('script', 'noscript') OR (tag = 'iframe' AND contains(src, 'ads')) OR cls LIKE '% advertisement %' OR ident = 'sidebar'
        UNION SELECT c.page_id, c.pos, c.e FROM child t JOIN el c ON c.page_id = t.page_id AND c.pos > t.pos AND c.pos <= t.e WHERE c.tag = 'td' AND c.cls LIKE '% k %')
      SELECT page_id, string_agg(tok, '' ORDER BY pos) AS html FROM we WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.page_id = we.page_id AND we.pos BETWEEN hit.pos AND hit.e) GROUP BY page_id""",
    "html_select_elements": f"""WITH {I.RICH_PAGES}, {_ELEMENTS},
      s AS (SELECT * FROM el c WHERE ((tag = 'a' AND href LIKE '/%') OR (tag = 'img' AND regexp_matches(tok, '(?i)[\\s/]alt[\\s=/>]')))
        AND EXISTS (SELECT 1 FROM el p WHERE p.page_id = c.page_id AND p.tag = 'article' AND p.pos < c.pos AND p.e >= c.pos))
      SELECT s.page_id, s.pos, s.tok, string_agg(we.tok, '' ORDER BY we.pos) AS html FROM s JOIN we ON we.page_id = s.page_id AND we.pos BETWEEN s.pos AND s.e GROUP BY s.page_id, s.pos, s.tok""",
    "html_title": f"WITH {I.RICH_PAGES} SELECT page_id, {TITLE} AS title FROM rich",
    "html_text": f"{_MAIN} SELECT page_id, coalesce(string_agg(CASE WHEN kind = 'text' THEN {D.unescape('tok')} END, '' ORDER BY pos), '') AS text FROM main_kept GROUP BY page_id",
    "html_markdown": f"{_MAIN}, {MARKDOWN} SELECT * FROM markdown_of",
    "md_header": f"""WITH d AS ({_DOC_SQL}) SELECT doc_id, 'html' AS mode, '# ' || title || chr(10) || chr(10) || '**Original URL:** ' || url || chr(10) || chr(10)
      || '---' || chr(10) || chr(10) || text AS content FROM d UNION ALL SELECT doc_id, 'api', '# ' || title || chr(10) || chr(10) || '**Space:** ' || space_key || ' - ' || space_name
      || chr(10) || chr(10) || '**Page ID:** ' || doc_id || chr(10) || chr(10) || '**Last Updated:** ' || updated_when || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text FROM d""",
    "html_rewrite_links": f"""WITH {I.RICH_PAGES}, {D.tokens('rich')},
      anch AS (SELECT page_id, pos, {D.clean_url('url')} AS src, {D.attr('tok', 'href')} AS href FROM tok WHERE {_ANCHOR}), {D.resolved('anch', 'src', 'href')},
      dst0 AS (SELECT *, {D.clean_url('abs_url')} AS dst FROM resolved),
      dst1 AS (SELECT page_id, pos, {D.local_path('dst')} AS target, regexp_replace({D.local_path('src')}, '/?[^/]*$', '') AS here FROM dst0
        WHERE (dst LIKE 'http://%' OR dst LIKE 'https://%') AND NOT (contains(dst, '/login') OR contains(dst, '/th') OR contains(dst, 'other.example.org'))),
      rel AS (SELECT page_id, pos, replace(replace(replace({D.rel_path('target', 'here')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS rel FROM dst1)
      SELECT page_id, string_agg(CASE WHEN rel IS NULL THEN tok ELSE {_set_attr('href', 'rel')} END, '' ORDER BY pos) AS html
      FROM tok LEFT JOIN rel USING (page_id, pos) GROUP BY page_id""",
    "html_resources": f"""WITH {_REFS} SELECT page_id, rkind AS kind, rurl AS url FROM refs
      WHERE contains(rurl, 'secure.gravatar.com') OR contains(rurl, 'cdn0.example.net') OR contains(rurl, 'example.com')""",
    "resource_registry": f"WITH {_REGISTRY} SELECT * FROM registry",
    "resource_type": f"WITH {I.RESOURCE_USES}, u AS (SELECT DISTINCT url FROM uses) SELECT url, {I._TYPE_SQL} AS resource_type FROM u",
    "resource_rewrite": f"""WITH {_REGISTRY}, hit AS (SELECT r.page_id, r.pos, g.local_path, regexp_replace({D.local_path('r.src')}, '/?[^/]*$', '') AS here
        FROM refs r JOIN registry g ON r.rurl = g.url WHERE g.url NOT LIKE '%/static/i3.png'),
      rel AS (SELECT page_id, pos, {D.rel_path('local_path', 'here')} AS rel FROM hit)
      SELECT page_id, string_agg(CASE WHEN rel IS NULL THEN tok WHEN tag = 'link' THEN {_set_attr('href', 'rel')} ELSE {_set_attr('src', 'rel')} END, '' ORDER BY pos) AS html
      FROM tok LEFT JOIN rel USING (page_id, pos) GROUP BY page_id""",
    "resource_collisions": f"WITH {_REGISTRY} SELECT local_path, count(*) AS n_urls FROM registry GROUP BY 1 HAVING count(*) > 1",
    "content_stats": f"""WITH {I.RICH_PAGES} SELECT page_id, length(html) AS content_char_count, contains(lower(html), '<table') AS has_tables FROM rich
      UNION ALL SELECT page_id, length(html), contains(lower(html), '<table') FROM pages""",
    "auth_wall": f"""WITH a AS (SELECT 'page-' || page_id AS id, CASE WHEN page_id % 9 = 0 THEN replace(html, '</article>', 'you MUST log In</article>') ELSE html END AS html FROM pages
      UNION ALL SELECT 'doc-' || doc_id, ' ' || chr(10) || chr(9) || text || chr(10) || ' ' FROM documents)
      SELECT id, regexp_matches(lower(html), '{_PHRASES}') OR length(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) < 500 AS is_auth_wall FROM a""",
    "attachment_rewrite": f"""WITH {_SHOWN_SQL}, {D.tokens('shown', keep='page_id')},
      ref AS (SELECT page_id, pos, regexp_extract({D.attr('tok', 'src')},
        '^(?:(?:https://wiki\\.example\\.com)?/?(?:wiki/)?download/attachments/' || '\\d+/f([01])\\.png|(?:https?://[^/]+)?/wiki/download/thumbnails/\\d+/f([01])\\.png)', 1)
        || regexp_extract({D.attr('tok', 'src')}, '^(?:https?://[^/]+)?/wiki/download/thumbnails/\\d+/f([01])\\.png', 1) AS n FROM tok WHERE tag = 'img')
      SELECT page_id, string_agg(CASE WHEN coalesce(n, '') = '' THEN tok ELSE '<img src="attachments/a' || n || '_f' || n || '.png">' END, '' ORDER BY pos) AS html
      FROM tok LEFT JOIN ref USING (page_id, pos) GROUP BY page_id""",
    "broken_links": f"""WITH {_links('pages')}, stored AS (SELECT {D.clean_url('url')} AS u FROM pages UNION SELECT regexp_extract(url, '^[^/]*//[^/?#]*', 0) || '/to' FROM pages)
      SELECT page_id, src, dst FROM found WHERE dst NOT IN (SELECT u FROM stored)""",
    "set_link_union": f"""WITH {_links('pages', 'f1', _IN_LINKS)}, {I.RICH_PAGES}, {_links('rich', 'f2', _IN_LINKS)}
      SELECT src, dst FROM f1 UNION SELECT src, dst FROM f2""",
    "link_degree": f"""WITH {I.RICH_PAGES}, {_links('rich', valid=_IN_LINKS)}, e AS (SELECT src AS url, 1 AS o, 0 AS i FROM found UNION ALL SELECT dst, 0, 1 FROM found)
      SELECT url, CAST(sum(o) AS BIGINT) AS out_links, CAST(sum(i) AS BIGINT) AS in_links FROM e GROUP BY url""",
}
