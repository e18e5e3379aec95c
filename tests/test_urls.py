from urllib.parse import unquote, urljoin, urlparse

import os

import pytest
from pyspark.sql import functions as F

from webtables.functions import urls as U
from webtables.operators.scope import Rules, default_rules, filter_scope, in_scope

BASE = "https://h.example.com/docs/a/b.html?x=1#f"

HREFS = [
    "c.html", "/wiki/p", "../up", "../../../../z", "./s/", "a/./b/../c", "?q=2", "#top", "", "//cdn.example.com/x",
    "/a;p=1?q", "/x?y=/../z", "a b", "/für", "..", ".", "x//y", "/a//b/../c", "?", "#", "//h2",
    "http://o.example/a/../b", "https:foo", "HTTP://H.example.com/X", "mailto:a@b", "javascript:void(0)", "g:h",
    "http:foo", "/a;x/b;y", "d;p/..;q", "/..//x", " /lead", "/a\tb\nc", "../", "/./", "/a/..", "https://h2.example/p?",
    "HTTPS://h.example.com/Q#", "a:b/c", "1a:b", ";p", "?a?b#c#d", "/x/%2e%2e/y",
]


def test_resolve_equals_stdlib(spark):
    bases = [BASE, "https://h.example.com", "https://h.example.com/d/?k", "http://h.example.com/x;y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in HREFS], "base string, href string")
    got = U.with_resolved(df, "base", "href").withColumn("clean", U.clean_url("abs_url")).collect()
    for r in got:
        want = urljoin(r.base, r.href)
        assert r.abs_url == want, (r.base, r.href)
        p = urlparse(want)
        assert r.clean == f"{p.scheme}://{p.netloc}{p.path}", (r.base, r.href)


def test_clean_is_idempotent_and_normalize_keeps_query(spark):
    df = spark.createDataFrame([(h,) for h in ["HTTP://A.b/c;d?e#f", "http://x/y/;p/z?q=1", "http://x"]], "url string")
    once = df.select(U.clean_url("url").alias("u"), U.normalize_url("url").alias("n"))
    rows = once.select("u", "n", U.clean_url("u").alias("v")).collect()
    assert [r.u for r in rows] == [r.v for r in rows]
    assert [r.n for r in rows] == ["http://A.b/c?e", "http://x/y/;p/z?q=1", "http://x"]


@pytest.mark.parametrize(
    "path,want",
    [
        ("", "out/index.md"), ("/", "out/index.md"), ("/docs/v1/", "out/v1/index.md"),
        ("/wiki/spaces/X/pages/12/T", "out/spaces/X/pages/12/T.md"), ("/wiki", "out/wiki.md"),
        ("/a/b.html", "out/a/b.html"), ("/a/b.htm", "out/a/b.htm.md"), ("/a:b*c", "out/a_b_c.md"),
        ("/a%3Ab", "out/a:b.md"), ("/docs/", "out/index.md"),
    ],
)
def test_local_path(spark, path, want):
    df = spark.createDataFrame([("https://h.example.com" + path,)], "clean_url string")
    assert U.with_local_path(df).first().local_path == want


def test_percent_decode(spark):
    texts = ["a+b%20c%ZZ%C3%A9", "%", "100%", "%e2%82%ac", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(U.percent_decode(F.col("t"))).collect()] == [unquote(t) for t in texts]


def test_rel_path_equals_stdlib(spark):
    pairs = [("out/a/b.md", "out/a"), ("out/x.md", "out/a/b"), ("out/a/b/c.md", "out"), ("out/a/b.md", "out/c/d/e"),
             ("out/a//b.md", "out/a"), ("out/a", "out/a"), ("x/y.md", "z")]
    df = spark.createDataFrame(pairs, "t string, s string")
    got = U.with_rel_path(df, "t", "s", "r").collect()
    assert [r.r for r in got] == [os.path.relpath(t, s) for t, s in pairs]


def test_safe_file_name(spark):
    names = ["my file?.png", "", "<>", "a" * 250 + ".png", "." + "a" * 250, "x" * 199 + ".tar.gz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(U.safe_file_name(F.col("n"))).collect()]
    for n, g in zip(names, got):
        clean = "".join(ch for ch in n.replace(" ", "_") if ch not in '<>:"/\\|?*')
        if len(clean) > 200:
            stem, ext = os.path.splitext(clean)
            clean = stem[:190] + ext
        assert g == (clean or "attachment")


def test_page_ids_and_spaces(spark):
    rows = [
        ("https://w/wiki/spaces/AR/pages/123/T", "123", "AR"), ("https://w/x?pageId=9", "9", None),
        ("https://w/content/77", "77", None), ("https://w/a/1234567", "1234567", None), ("https://w/a/12345", None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    got = df.select("url", U.page_id("url").alias("p"), U.space_key("url").alias("s")).collect()
    assert [(r.url, r.p, r.s) for r in got] == rows
    idx = spark.createDataFrame([("https://w/wiki/spaces/AR/overview",), ("https://w/spaces/AR",), ("https://w/spaces/AR/x",)], "url string")
    assert [r[0] for r in idx.select(U.is_space_index("url")).collect()] == [True, True, False]


def test_scope_modes(spark):
    df = spark.createDataFrame(
        [("https://h.example.com/docs/a",), ("https://x.h.example.com/docs/a",), ("HTTP://h.example.com/docs/b",),
         ("https://h.example.com/docs/a?delete",), ("https://h.example.com/zzz",)], "url string")
    exact = Rules(base_domain="h.example.com", exclude=("?delete",), valid=("/docs",))
    assert [r.url for r in filter_scope(df, exact).collect()] == ["https://h.example.com/docs/a"]
    rx = Rules(base_domain="h.example.com", exclude=(r"\?delete",), valid=(r"/docs/[ab]$",), mode="regex")
    assert len(filter_scope(df, rx).collect()) == 3
    for bad in ("?delete", "(?P<x>abc)", "[a"):
        with pytest.raises(ValueError, match="Java"):
            filter_scope(df, Rules(exclude=(bad,), mode="regex"))
    assert len(filter_scope(df, Rules(valid=(r"(s)\1*/a", "(z)z"), mode="regex")).collect()) == 4
    for size in (5, 64, 65, 5000):
        texts = tuple(f"/p{i}" for i in range(size - 1)) + ("/zzz",)
        for mode in ("exact", "regex"):
            kept = [r.url for r in df.where(in_scope("url", Rules(exclude=texts, mode=mode))).collect()]
            assert "https://h.example.com/zzz" not in kept and "https://h.example.com/docs/a" in kept
    assert default_rules("https://a.b/c/").valid == ("/c/",)
