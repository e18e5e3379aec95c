"""The in-row element tree and selectors against a plain stack of open elements."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webtables.functions import markup as M
from webtables.operators import content as C
from webtables.operators import selectors as S
from webtables.operators import tree as T
from webtables.operators.markdown import to_markdown
from webtables.operators.rewrite import rewrite_links
from webtables.operators.scope import Rules


class Tree(HTMLParser):
    """Elements in page order: (tag, attributes, ancestors from the root on, end offset found later)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.page, self.open, self.elements = page, [], []
        self.lines = [0]
        for line in page.split("\n")[:-1]:
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()
        for e in self.open:
            e["end"] = len(page)

    def here(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs, alone=False):
        start = self.here()
        e = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "round": list(self.open), "start": start}
        e["end"] = start + len(self.get_starttag_text())
        self.elements.append(e)
        if not alone and tag not in M.VOID_TAGS:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, alone=True)

    def handle_endtag(self, tag):
        stop = self.page.find(">", self.here()) + 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                for e in self.open[k:]:
                    e["end"] = stop if e is self.open[k] else self.here()
                del self.open[k:]
                return


def random_page(rng, n):
    parts = []
    for _ in range(n):
        tag = rng.choice(["div", "p", "b", "ul", "li", "a", "td"])
        kind = rng.random()
        if kind < 0.45:
            attrs = rng.choice(["", ' class="x"', " class='x  y'", ' id="i"', ' href="/a/b.png"', " href=http://h/x", ' lang="en-GB"', ' class="xy" id=i'])
            parts.append(f"<{tag}{attrs}>")
        elif kind < 0.8:
            parts.append(f"</{tag}>")
        elif kind < 0.9:
            parts.append(rng.choice(["<br>", '<img class="x" src="/i.png">', "<hr/>", "<p class=x />"]))
        else:
            parts.append(rng.choice(["text ", "&amp; ", "\n", "<!-- <p class=x> -->", "<script>var a = '<p class=\"x\">'</script>"]))
    return "".join(parts)


@pytest.fixture(scope="module")
def some_pages():
    rng = random.Random(6)
    return [random_page(rng, rng.randint(0, 60)) for _ in range(150)]


@pytest.fixture(scope="module")
def table(spark, some_pages):
    return spark.createDataFrame([(k, p) for k, p in enumerate(some_pages)], "page_id bigint, html string").repartition(3)


def test_elements_against_a_stack(table, some_pages):
    pages = T.with_elements(T.with_tokens(table, drop=("script",))).collect()
    assert len(pages) == len(some_pages)
    for r in pages:
        stack, want = [], {}
        for k, t in enumerate(r.toks):
            if t.is_close and t.tag in [r.toks[o].tag for o in stack]:
                while True:
                    o = stack.pop()
                    want[o][3] = k if r.toks[o].tag == t.tag else k - 1
                    if r.toks[o].tag == t.tag:
                        break
            if t.tag and not t.is_close:
                want[k] = [t.opens, len(stack), stack[-1] if stack else -1, None if t.opens else k]
            if t.opens:
                stack.append(k)
        assert [[e.at, e.opens, e.depth, e.parent, e.end] for e in r.elements] == [[k, *v] for k, v in sorted(want.items())]


def words(e, name):
    return e["attrs"].get(name, "").split()


PLAIN = [
    ("p", lambda e: e["tag"] == "p"),
    (".x", lambda e: "x" in words(e, "class")),
    ("#i.xy, br", lambda e: (e["attrs"].get("id") == "i" and "xy" in words(e, "class")) or e["tag"] == "br"),
    ("[href]", lambda e: "href" in e["attrs"]),
    ("a[href^='/a']", lambda e: e["tag"] == "a" and e["attrs"].get("href", "").startswith("/a")),
    ('[href$=".PNG" i]', lambda e: e["attrs"].get("href", "").lower().endswith(".png")),
    ("[class*=x][lang|=en], [lang|=en]", lambda e: e["attrs"].get("lang", "").split("-")[0] == "en"),
    ("div p", lambda e: e["tag"] == "p" and any(a["tag"] == "div" for a in e["round"])),
    ("div > p", lambda e: e["tag"] == "p" and bool(e["round"]) and e["round"][-1]["tag"] == "div"),
    ("ul li > *", lambda e: bool(e["round"]) and e["round"][-1]["tag"] == "li" and any(a["tag"] == "ul" for a in e["round"][:-1])),
    ("div b > .x", lambda e: "x" in words(e, "class") and bool(e["round"]) and e["round"][-1]["tag"] == "b" and any(a["tag"] == "div" for a in e["round"][:-1])),
]


@pytest.mark.parametrize("text,holds", PLAIN)
def test_selectors_against_a_stack(table, some_pages, text, holds):
    found = {}
    for r in S.select_elements(table, text).orderBy("pos").collect():
        found.setdefault(r.page_id, []).append(r.html)
    cleaned = {r.page_id: r.html for r in S.remove_elements(table, text).collect()}
    for k, page in enumerate(some_pages):
        hits = [e for e in Tree(page).elements if holds(e)]
        assert found.get(k, []) == [page[e["start"] : e["end"]] for e in hits], page
        gone = [False] * len(page)
        for e in hits:
            gone[e["start"] : e["end"]] = [True] * (e["end"] - e["start"])
        assert cleaned[k] == "".join(c for c, g in zip(page, gone) if not g)


@pytest.mark.parametrize("text", ["", "a:hover", "a + b", "a ~ b", "a >", "a,,b", "[x", "a[x=]", "> a", "\\31"])
def test_what_is_no_selector_is_refused(text):
    with pytest.raises(ValueError):
        S.compile_selectors(text)


def test_many_selectors_and_raw_elements(spark):
    page = "<div id=k70>a</div><script>never closed <p class=x>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id bigint, html string")
    got = {r.page_id: r.html for r in S.remove_elements(df, tuple(f"#k{n} b, #k{n}" for n in range(60, 82))).collect()}
    assert got == {1: "<script>never closed <p class=x>", 2: "", 3: ""}
    assert {r.page_id: r.html for r in S.remove_elements(df, "script").collect()}[1] == "<div id=k70>a</div>"


@pytest.mark.parametrize("unit", ["<div>", "<nav></nav>", "<p>x", "<a><b><i>x</b>"])
def test_many_tags(spark, unit):
    page = unit * (400_000 // len(unit))
    df = spark.createDataFrame([(1, f"<article>{page}")], "page_id bigint, html string")
    start = time.time()
    out = C.drop_boilerplate(C.main_content(df)).select(F.size("toks").alias("n")).first()
    assert out.n >= 1 and time.time() - start < 30


def test_nothing_is_shuffled(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id bigint, url string, html string")
    for out in (C.assemble(C.drop_boilerplate(C.main_content(pages))), to_markdown(C.drop_boilerplate(C.main_content(pages))), rewrite_links(pages, Rules()), S.remove_elements(pages, "div > p")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
