"""Hand-written pages for what the shared test pages lack."""

import html
import re
import time
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webtables.functions import markup as M
from webtables.operators import content as C
from webtables.operators import markdown as MD
from webtables.operators import rewrite as RW
from webtables.operators import resources as RS
from webtables.operators.links import extract_links
from webtables.operators.scope import Rules
from webtables.operators.tokens import tokenize, with_element_end

URL = "https://h.example.com/docs/a/b.html?x=1"
SCHEMA = "page_id bigint, url string, html string"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, URL, h) for i, h in enumerate(htmls)], SCHEMA)


def one(df, col):
    return df.first()[col]


MAIN = [
    ("<body>x<article>A<div id='main-content'>B</div></article>", "<div id='main-content'>B</div>"),
    ("<body><main>a<nav>n<ul><li>q</ul></nav>b</main>c", "<main>ab</main>"),
    ('<div class="x content y">k<div>i</div>j</div>z', '<div class="x content y">k<div>i</div>j</div>'),
    ("<body><nav>n</nav>t</body>", "<body><nav>n</nav>t</body>"),
    ("just <b>text</b>", "just <b>text</b>"),
    ("<article>a<div class='q breadcrumbs'>x<div>y</div></div>b<p>c</article>d", "<article>ab<p>c</article>"),
    ("<article>a<footer>never closed", "<article>a"),
    ('<div class="wiki-content">w</div><main>m</main>', '<div class="wiki-content">w</div>'),
    ('<div title="a > b" class=content>w</div>v', '<div title="a > b" class=content>w</div>'),
    ('<article><header>h</header><p>1<p>2</article>', "<article><p>1<p>2</article>"),
]


def test_main_content(spark):
    toks = C.drop_boilerplate(C.main_content(pages(spark, *[h for h, _ in MAIN])))
    got = {r.page_id: r.html for r in C.assemble(toks).collect()}
    assert [got[i] for i in range(len(MAIN))] == [want for _, want in MAIN]


def test_links(spark):
    html = (
        "<!-- <a href='/no1'> --><script>'<a href=\"/no2\">'</script><a href='/s'>s</a><a href=/u>u</a>"
        '<a title=" href=/no3 " href="/q?x=1#f">q</a><A HREF="/Up">U</A><a>none</a><a href>self</a>'
        "<abbr href='/no4'>x</abbr><a href='/amp?a=1&amp;b=2'>a</a><a href='mailto:x@y'>m</a>"
        "<noscript><a href='/ns'>n</a></noscript><a data-href='/no5'>d</a><a href=' /sp '>sp</a>"
    )
    got = {r.dst for r in extract_links(pages(spark, html), Rules()).collect()}
    h = "https://h.example.com"
    assert got == {f"{h}/s", f"{h}/u", f"{h}/q", f"{h}/Up", f"{h}/docs/a/b.html", f"{h}/amp", f"{h}/ns", f"{h}/sp "}


def test_hostile_pages(spark):
    big_tag = "<a " + " ".join(f"a{i}='v{i}'" for i in range(3000)) + " href='/x'>t</a>"
    cases = [big_tag, "<" * 50000, "x" * 2_000_000, '<a href="unclosed ' + "y" * 100000, "<img src='data:" + "A" * 500000 + "'>"]
    got = {r.page_id: r.n for r in tokenize(pages(spark, *cases)).groupBy("page_id").agg(F.sum(F.length("tok")).alias("n")).collect()}
    assert got == {i: len(c) for i, c in enumerate(cases)}
    assert [r.dst for r in extract_links(pages(spark, *cases), Rules()).collect()] == ["https://h.example.com/x"]


def test_element_end(spark):
    toks = with_element_end(tokenize(pages(spark, "<div>a<div>b</div></div></div><div>c</div><br><div>d")))
    assert {r.pos: r.end_pos for r in toks.where("end_pos is not null").collect()} == {0: 5, 2: 4, 7: 9}


def test_strip_active(spark):
    html = (
        '<meta HTTP-EQUIV="Refresh" content="1"><meta name=x><noscript>n</noscript>'
        '<p onclick="a()" class="k" ONLOAD=b title=" onfake=1 ">onclick=kept</p><img src=x/ onerror=y/><a one=1>'
    )
    got = one(C.strip_active(pages(spark, html)), "html")
    assert got == '<meta name=x><p class="k" title=" onfake=1 ">onclick=kept</p><img src=x/><a>'


def test_titles_and_walls(spark):
    df = pages(spark, "<title>A &amp; B</title>", "<title></title>", "<p>")
    assert [r.title for r in C.page_titles(df).collect()] == ["A & B", C.DEFAULT_TITLE, C.DEFAULT_TITLE]
    walls = pages(spark, "y" * 499, "y" * 500, " \n" + "y" * 499 + "\t", "z" * 600 + "ACCESS DENIED")
    assert [r.is_auth_wall for r in C.flag_auth_walls(walls).orderBy("page_id").collect()] == [True, False, True, True]


def test_unescape_agrees_with_the_standard_library(spark):
    texts = [f"a&{name} b&{name}" for name in html5] + [f"&#{n};x" for n in (*range(300), 0x20AC, 0xD800, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000)]
    texts += ["&lt;&amp;lt;&#65;&#x20AC;x&#x1F;&nbsp;&bogus;&#55296;", "&#00000000065;&#x0000000041;&#65z&#x41z", "&notit; &ampamp; &", "&;&#;&#x;", "plain", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", M.unescape(F.col("t")).alias("u")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_references_in_attributes_leave_url_parameters_alone(spark):
    df = spark.createDataFrame([('<a href="?a=1&copy=2&amp;b=&eacute;&lt">',)], "t string")
    assert df.select(M.attr(F.col("t"), "href")).first()[0] == "?a=1&copy=2&b=é<"


class _Reader(HTMLParser):
    """Text, links and first title by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.inside = [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])
        if tag in ("script", "style", "noscript", "title"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if self.inside == ["title"] and self.title is None:
            self.title = data
        if not self.inside:
            self.text.append(data)


AGREED = [
    "<article>before<script-loader></script-loader><p>after <a href='/x'>x</a></p><style-guide>s</style-guide></article>",
    "<head><!-- <title>old</title> --><script>t='<title>no</title>'</script><title>new</title></head><p>t</p>",
    "<p>a<script>x</script >b<SCRIPT type='a>b'>y</SCRIPT>c<style>p{}</style>d</p>",
    "<p don't>x</p><p title=\"a > b\">y</p><a href = '/q?a=1&amp;b=2'>z</a>",
    "<noscript-x>kept</noscript-x><p>1 < 2 &amp; 3 &eacute; &#150;</p>",
]


@pytest.mark.parametrize("page", AGREED)
def test_text_links_and_title_agree_with_the_standard_parser(spark, page):
    reader = _Reader()
    reader.feed(page)
    reader.close()
    df = pages(spark, page)
    toks = tokenize(df)
    text = "".join(r.t for r in toks.where("kind = 'text'").orderBy("pos").select(M.unescape(F.col("tok")).alias("t")).collect())
    body = re.sub("new$", "", "".join(reader.text)) if reader.title is None else "".join(reader.text)
    assert text.replace(reader.title or "\0", "", 1) == body
    links = toks.where("tag = 'a' AND NOT is_close").orderBy("pos").select(M.attr(F.col("tok"), "href").alias("h")).collect()
    assert [r.h for r in links] == reader.links
    assert C.page_titles(df).first().title == (reader.title or C.DEFAULT_TITLE)


@pytest.mark.parametrize("opener", ["<!--", "<script ", "<script>", "<a ", "<a href=\"", "<!x", "<", "&", "&#", "<title>"])
def test_openers_that_never_close_are_read_once(spark, opener):
    page = "<p>x</p>" + opener * (1_000_000 // len(opener))
    start = time.time()
    assert tokenize(pages(spark, page)).count() >= 1
    assert time.time() - start < 5


MARKDOWN = [
    ("<h2>T</h2><p>a <b>b</b>\n c</p><p>d</p>", "## T\n\na b c\n\nd"),
    ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><p>e</p>", "- a\n- b\n    - c\n\ne"),
    ("<ol><li>a<li>b</ol><ol><li>c</ol>", "1. a\n2. b\n\n1. c"),
    ("<ol><li>a<ul><li>x<li>y</ul><li>b</ol>", "1. a\n    - x\n    - y\n2. b"),
    ("x <a href='/p' title='t'>l</a> <em>e</em><strong>s</strong> <code>a_b</code> a_b", 'x [l](/p "t") *e***s** `a_b` a\\_b'),
    ("<a href='http://e/'>http://e/</a>", "<http://e/>"),
    ("<pre><code>a\n\n\n  b</code></pre>z", "```\na\n\n\n  b\n```\n\nz"),
    ("a<blockquote><p>q</p></blockquote>b", "a\n\n> q\n\nb"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><p>2</p></td></tr></table>",
     "| A | B |\n| --- | --- |\n| 1 |  2  |"),
    ("<p>i <img src='/i.png' alt='al'></p>", "i ![al](/i.png)"),
    ("<p>caf&#233; &amp; 2*3</p>", "café & 2\\*3"),
]


def test_markdown(spark):
    toks = C.drop_boilerplate(C.main_content(pages(spark, *[h for h, _ in MARKDOWN])))
    got = {r.page_id: r.markdown for r in MD.to_markdown(toks).collect()}
    assert [got[i] for i in range(len(MARKDOWN))] == [want for _, want in MARKDOWN]


def test_rewrite_links(spark):
    html = "<a class=k href='/docs/x?y'>x</a><a href='https://o.example/z'>o</a><a href>s</a><a href=\"../q/\">q</a>"
    df = pages(spark, html)
    rules = Rules(base_domain="h.example.com")
    got = one(RW.rewrite_links(df, rules), "html")
    assert got == (
        '<a class=k href="../x.md">x</a><a href=\'https://o.example/z\'>o</a><a href="b.html">s</a>'
        '<a href="../q/index.md">q</a>'
    )


def test_resources(spark):
    html = (
        "<link rel='stylesheet' href='/s/m.css?v=1'><link rel=icon href=/f.ico><img src='//secure.gravatar.com/avatar/9'>"
        "<img alt=x><img src='i.png'><noscript><img src='/no.png'></noscript>"
    )
    df = pages(spark, html)
    refs = RS.resource_refs(df)
    assert {(r.kind, r.url) for r in refs.collect()} == {
        ("css", "https://h.example.com/s/m.css?v=1"), ("img", "https://secure.gravatar.com/avatar/9"),
        ("img", "https://h.example.com/docs/a/i.png"),
    }
    reg = RS.resource_registry(refs)
    paths = {r.url: r.local_path for r in reg.collect()}
    assert paths["https://h.example.com/s/m.css?v=1"] == "out/shared_resources/m.css"
    assert paths["https://secure.gravatar.com/avatar/9"].startswith("out/shared_resources/cdn_images/resource_")
    keep = reg.where("url like '%h.example.com%'")
    got = one(RW.rewrite_resources(RW.with_stored_resources(df, refs, keep)), "html")
    assert got == (
        '<link rel=\'stylesheet\' href="../shared_resources/m.css"><link rel=icon href=/f.ico>'
        "<img src='//secure.gravatar.com/avatar/9'><img alt=x><img src=\"../shared_resources/i.png\">"
    )


def test_attachments(spark):
    base = "https://w.example.com"
    forms = [
        f"{base}/wiki/download/attachments/1/a%20b.png?v=2", "/wiki/download/attachments/1/a%20b.png",
        "/download/attachments/1/a%20b.png?x=1&amp;y=2", "download/attachments/1/a%20b.png",
        f"{base}/wiki/download/thumbnails/1/a%20b.png?w=9", "/wiki/download/thumbnails/1/a%20b.png",
    ]
    html = "".join(f'<img src="{f}">' for f in forms) + '<img src="https://other/wiki/download/attachments/1/a%20b.png">'
    atts = spark.createDataFrame(
        [(0, f"{base}/wiki/download/attachments/1/a%20b.png?v=2", "spaces/S/pages/1/attachments/9_a_b.png"),
         (0, "", "x")], "page_id bigint, download_url string, local_path string")
    df = RW.with_shown_attachments(pages(spark, html), atts)
    got = one(RW.rewrite_attachments(df), "html")
    assert got == '<img src="attachments/9_a_b.png">' * 6 + '<img src="https://other/wiki/download/attachments/1/a%20b.png">'


def test_headers(spark):
    df = spark.createDataFrame([("", "u", "m", "S", None, "1", None)],
                               "title string, url string, markdown string, space_key string, space_name string, page_id string, updated_when string")
    assert MD.with_md_header(df).first().content == f"# {C.DEFAULT_TITLE}\n\n**Original URL:** u\n\n---\n\nm"
    assert "**Space:** S - N/A\n\n**Page ID:** 1\n\n**Last Updated:** N/A\n\n---\n\nm" in MD.with_md_header(df, "api").first().content
