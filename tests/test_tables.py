"""Tracker, frontier, wiki, import and report behaviour on hand-made rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webtables import schema as S
from webtables.functions.formats import human_size
from webtables.operators import frontier as FR
from webtables.operators import reports as R
from webtables.operators import tracker as T
from webtables.operators import wiki as W
from webtables.sources import export as X
from webtables.sources import progress as P

LOG = "clean_url string, action string, ts timestamp, event_id bigint, error string"


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def discovered(spark, *rows):
    full = [(u, c, d, at(0), st, 0, None, None) for u, c, d, st in rows]
    return spark.createDataFrame(full, S.DISCOVERED)


def test_status_fold(spark):
    table = discovered(spark, ("a", "a", 0, "pending"), ("a?x", "a", 0, "pending"), ("b", "b", 0, "pending"),
                       ("c", "c", 0, "pending"), ("d", "d", 0, "failed"), ("e", "e", 0, "pending"))
    log = spark.createDataFrame(
        [("a", "fail", at(1), 1, "E1"), ("a", "claim", at(2), 2, None), ("a", "complete", at(3), 3, None),
         ("b", "complete", at(1), 4, None), ("b", "fail", at(1), 5, "E2"), ("b", "fail", at(0), 6, "E0"),
         ("c", "claim", at(1), 7, None), ("d", "claim", at(1), 8, None)], LOG)
    got = {r.url: (r.status, r.retry_count, r.error_message) for r in T.apply_status(table, log).collect()}
    assert got == {
        "a": ("completed", 1, "E1"), "a?x": ("completed", 1, "E1"), "b": ("failed", 2, "E2"),
        "c": ("downloading", 0, None), "d": ("failed", 0, None), "e": ("pending", 0, None),
    }
    halves = T.partial_fold(log.where("event_id <= 4")).unionByName(T.partial_fold(log.where("event_id > 4")))
    merged = {r.url: (r.status, r.retry_count, r.error_message) for r in T.apply_fold(table, T.merge_folds(halves)).collect()}
    assert merged == got


def test_upserts(spark):
    table = spark.createDataFrame([("k1", 1, "x"), ("k2", 2, "y")], "key string, v int, note string")
    new = spark.createDataFrame([("k2", 5, 1), ("k2", 6, 2), ("k3", 7, 1)], "key string, v int, seq int")
    up = T.upsert(table, new, ["key"], ["seq"], {"note": "none"})
    assert sorted(map(tuple, up.collect())) == [("k1", 1, "x"), ("k2", 6, "none"), ("k3", 7, "none")]
    again = T.upsert(up, new, ["key"], ["seq"], {"note": "none"})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, up.collect()))
    ign = T.insert_ignore(table, new.select("key", "v", F.lit("n").alias("note")), ["key"], ["v"])
    assert sorted(map(tuple, ign.collect())) == [("k1", 1, "x"), ("k2", 2, "y"), ("k3", 7, "n")]


def test_frontier_is_shortest_path(spark):
    edges = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "s"), ("c", "d"), ("d", "e"), ("x", "y"), ("s", "s"), ("a", "b")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("s",)], "clean_url string")
    got = {r.clean_url: (r.depth, r.parent_url) for r in FR.crawl_frontier(df, seeds, 3).collect()}
    assert got == {"s": (0, None), "a": (1, "s"), "b": (1, "s"), "c": (2, "a"), "d": (3, "c")}
    assert FR.crawl_frontier(df, seeds, 0).count() == 1
    assert FR.crawl_frontier(df, seeds, 50).count() == 6


@pytest.mark.parametrize("seed,depth", [(1, 4), (2, 2)])
def test_frontier_grows_as_if_run_anew(spark, seed, depth):
    """After each of several sets of new links: shortcuts, new pages, smaller parents, links that change nothing."""
    rng = random.Random(seed)
    pages = [f"p{k:02}" for k in range(40)]
    links = list({(rng.choice(pages), rng.choice(pages)) for _ in range(110)} | {(pages[k], pages[k + 1]) for k in range(0, 39, 2)})
    rng.shuffle(links)
    seeds = spark.createDataFrame([("p00",), ("p07",)], "clean_url string")
    table = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    known, upto = FR.crawl_frontier(table(links[:30]), seeds, depth), 30
    for step in (3, 40, len(links)):
        new = links[upto : upto + step] + links[:2] + [("p00", "p00"), ("zz", "p01")]
        known = FR.extend_frontier(known, table(links[:upto]), table(new), depth)
        upto = min(upto + step, len(links))
        want = FR.crawl_frontier(table(links[:upto] + [("zz", "p01")]), seeds, depth)
        assert sorted(map(tuple, known.collect())) == sorted(map(tuple, want.collect()))


def test_fetch_schedule_splits_a_hot_host(spark):
    hot = [(f"https://HOT.example.com/{k:04}", k % 3, datetime(2024, 1, 1)) for k in range(600)]
    cold = [(f"http://c{k % 200}/{k}", None, None) for k in range(600)]
    rows = hot + cold + [(None, 1, None)]
    table = spark.createDataFrame(rows, "url string, depth int, discovered_at timestamp").repartition(5)
    got = FR.fetch_schedule(table, datetime(2024, 1, 31), 0.25)
    by_host = {}
    for r in got.collect():
        by_host.setdefault(r.host, []).append((r.place, r.url, r.fetch_at))
    assert sum(map(len, by_host.values())) == len(rows)
    for places in by_host.values():
        assert [p for p, _, _ in sorted(places)] == list(range(len(places)))
        assert all(t == datetime(2024, 1, 31) + timedelta(seconds=p * 0.25) for p, _, t in places)
    want = [u for u, *_ in sorted(hot, key=lambda r: (r[1], r[2], r[0]))]
    assert [u for _, u, _ in sorted(by_host["hot.example.com"])] == want
    # The URLs themselves are ranked within a range only.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.split("\n") if "row_number" in line and "Window" in line and "[part#" in line]


def test_frontier_space_and_resume(spark):
    front = spark.createDataFrame(
        [("https://w/spaces/A/overview", 3), ("https://w/spaces/A/pages/1#x", 2), ("https://w/spaces/B/pages/9", 1)], "url string, depth int")
    listing = spark.createDataFrame([("A", "https://w/spaces/A/pages/1"), ("A", "https://w/spaces/A/pages/2"), ("B", "https://w/b")],
                                    "space_key string, url string")
    got = {r.url: r.depth for r in FR.expand_spaces(front, listing).collect()}
    assert got == {"https://w/spaces/A/pages/1": 0, "https://w/spaces/A/pages/2": 0, "https://w/spaces/B/pages/9": 1}
    none = discovered(spark, ("a", "a", 0, "completed"))
    assert [tuple(r) for r in FR.resume(none, "seed").collect()] == [("seed", 0)]


def test_reports_on_empty_and_full(spark):
    empty = discovered(spark).where("false") if False else spark.createDataFrame([], S.DISCOVERED)
    assert R.status_share(empty).count() == 0 and R.progress(empty).count() == 0
    assert R.success_rate(empty).first().success_rate == 100.0
    assert R.run_state(empty).first().run_state == "completed"
    table = discovered(spark, *[(f"u{i}", f"u{i}", 0, s) for i, s in enumerate(["completed"] * 2 + ["failed"] * 3)])
    assert R.run_state(table).first().run_state == "with errors"
    assert R.progress(table).first().bar_fill == 16
    shares = {r.status: (r.n, r.percentage) for r in R.status_share(table).collect()}
    assert shares == {"Completed": (2, 40.0), "Failed": (3, 60.0), "Total": (5, 100.0)}


def test_human_size(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1024**2, 1024**5 * 3, 1024**6]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    want = []
    for s in sizes:
        v, text = float(s), "0 B"
        if s:
            units = iter(["B", "KB", "MB", "GB", "TB"])
            text = next((f"{v / 1024**i:.1f} {u}" for i, u in enumerate(units) if v / 1024**i < 1024), f"{v / 1024**5:.1f} PB")
        want.append(text)
    assert [r[0] for r in df.select(human_size(F.col("s"))).collect()] == want


def test_retention_and_reset(spark):
    stats = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2023, 12, 1)), ("c", None)], "session_id string, start_time timestamp")
    kept = T.retain(stats, 30, datetime(2024, 1, 31))
    assert sorted(r.session_id for r in kept.collect()) == ["a", "c"]
    after = T.reset({"discovered_urls": stats, "crawler_stats": stats})
    assert (after["discovered_urls"].count(), after["crawler_stats"].count()) == (0, 3)


SAMPLE_PAGE = {
    "id": "556040223", "type": "page", "status": "current", "title": "T", "space": {"key": "AR", "name": "Architecture"},
    "version": {"number": 5, "when": "2025-10-20T10:30:00.000Z"}, "_expandable": {"ari": ""}, "ari": "ari:1",
    "history": {"createdDate": "2025-01-15T08:00:00.000Z", "lastUpdated": {"when": "2025-10-20T10:30:00.000Z"}},
}


def test_wiki_defaults_and_days(spark):
    raw = spark.createDataFrame([("u", json.dumps(SAMPLE_PAGE)), ("v", "{}")], "url string, json string")
    meta = W.metadata_table(W.wiki_metadata(raw))
    rows = {r.url: r for r in meta.collect()}
    assert (rows["u"].ari, rows["u"].version_number, rows["u"].version_minor_edit) == ("ari:1", 5, False)
    assert (rows["v"].page_id, rows["v"].title, rows["v"].version_number) == ("", "", None)
    atts = spark.createDataFrame([], S.ATTACHMENTS)
    stats = spark.createDataFrame([], "url string, content_char_count bigint, has_tables boolean")
    days = {}
    for as_of in (datetime(2025, 10, 22, 10, 29), datetime(2025, 10, 22, 10, 30), datetime(2025, 10, 20, 10, 0)):
        row = W.derived_stats(meta, atts, stats, as_of).where("url = 'u'").first()
        days[as_of] = row.days_since_update
    assert list(days.values()) == [1, 2, -1]


def test_title_lookup(spark):
    urls = spark.createDataFrame([("https://w/display/S/My+Page%20T",), ("https://w/x/zzz",), ("https://w/pages/12/My",), ("https://w/",)], "url string")
    titles = spark.createDataFrame([("5", "hello my page (t)"), ("4", "My Page T2"), ("3", "a My-Page t b"), ("9", "")], "page_id string, title string")
    assert [tuple(r) for r in W.resolve_by_title(urls, titles).collect()] == [("https://w/display/S/My+Page%20T", "3")]


def test_import_and_export(spark, tmp_path):
    old = {
        "completed_urls": ["https://h/a?x", "https://h/a", "https://h/b"], "url_to_filename": {"https://h/a": "out/a.md"},
        "downloaded_resources": ["https://h/s.json", "https://h/f.woff"], "transversal_resources": {"https://h/f.woff": "res/f.woff"},
        "url_queue": [["https://h/q#f", 2], ["https://h/q#f", 1], ["short"]],
    }
    src = tmp_path / "progress.json"
    src.write_text(json.dumps(old, indent=2))
    stored = tmp_path / "site"
    (stored / "out").mkdir(parents=True)
    (stored / "out" / "a.md").write_text("12345")
    t = P.import_progress(spark, str(src), P.stored_files(spark, str(stored)))
    docs = {r.url: (r.local_path, r.file_size, r.depth) for r in t["downloaded_documents"].collect()}
    assert docs == {"https://h/a": ("out/a.md", 5, 0), "https://h/b": ("", None, 0)}
    res = {r.url: (r.resource_type, r.is_transversal, r.local_path) for r in t["downloaded_resources"].collect()}
    assert res == {"https://h/s.json": ("js", False, ""), "https://h/f.woff": ("font", True, "res/f.woff")}
    assert [(r.url, r.clean_url, r.depth, r.status) for r in t["discovered_urls"].collect()] == [("https://h/q#f", "https://h/q", 2, "pending")]
    summary = {r.item: r.n for r in P.migration_summary(t).collect()}
    assert summary == {"urls": 3, "resources": 2, "mappings": 1, "queue_items": 1}
    names = X.export_json({**t, "crawler_stats": t["url_mappings"]}, str(tmp_path / "dump"))
    assert names == ["discovered_urls", "downloaded_documents", "downloaded_resources", "url_mappings"]
    assert X.export_urls(t["discovered_urls"], str(tmp_path / "none"), "failed") is False
    assert X.export_urls(t["discovered_urls"], str(tmp_path / "urls"), "pending") is True
    assert [r.value for r in spark.read.text(str(tmp_path / "urls")).collect()] == ["https://h/q"]
