"""Malformed JSON beside good rows."""

import json

import pytest
from pyspark.sql import functions as F

from webtables import schema as S
from webtables.operators import quarantine as Q
from webtables.operators import wiki as W
from webtables.sources import progress as P

ROWS = {
    1: ('{"id":"1","title":"x","version":{"number":3}}', None),
    2: ('{"id":"1","title":"x","vers', "unreadable"),
    3: ("", "missing"),
    4: (" \n\t ", "missing"),
    5: (None, "missing"),
    6: ("null", "unreadable"),
    7: ("[1,2]", "unreadable"),
    8: ('"s"', "unreadable"),
    9: ('{"title":"x"}', "incomplete"),
    10: ('{"id":""}', "incomplete"),
    11: ('{"id":"1","version":{"number":"z"}}', "wrong type"),
    12: ('{"id":5,"more":1}', None),
    13: ("not json", "unreadable"),
}


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(k, j) for k, (j, _) in ROWS.items()], "k int, json string").repartition(3)


def test_every_row_gets_its_problem(raw):
    judged = Q.judge(raw, S.WIKI_PAGE, "page", "id")
    assert {r.k: r.problem for r in judged.collect()} == {k: p for k, (_, p) in ROWS.items()}
    assert set(Q.PROBLEMS) == {p for _, p in ROWS.values() if p}


def test_two_outputs_hold_every_row_once(raw):
    good, bad = Q.sort_out(Q.judge(raw, S.WIKI_PAGE, "page", "id"), "page")
    assert {r.k: r.page.id for r in good.collect()} == {1: "1", 12: "5"}
    assert {r.k: (r.json, r.problem) for r in bad.collect()} == {k: v for k, v in ROWS.items() if v[1]}
    assert good.columns == ["k", "json", "page"] and bad.columns == ["k", "json", "problem"]


def test_a_job_fails_above_its_share(spark, raw):
    judged = Q.judge(raw, S.WIKI_PAGE, "page", "id")
    with pytest.raises(Q.TooManyBadRows, match="11 of 13"):
        Q.sort_out(judged, "page", 0.8)
    Q.sort_out(judged, "page", 0.9)
    good, bad = Q.sort_out(Q.judge(raw.limit(0), S.WIKI_PAGE, "page", "id"), "page", 0.0)
    assert good.count() == bad.count() == 0


def test_good_answers_are_not_parsed_again(spark):
    raw = spark.createDataFrame([("u", '{"id":"1","title":"T"}'), ("v", "{")], "url string, json string")
    good, _ = W.sort_out_answers(raw, "page")
    meta = W.wiki_metadata(good)
    assert "from_json" not in meta._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.url, r.metadata.title) for r in meta.collect()] == [("u", "T")]


def test_bad_progress_files_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"downloaded_urls":\n ["https://h/a"]}')
    (tmp_path / "b.json").write_text('{"downloaded_urls": [')
    (tmp_path / "c.json").write_text('{"downloaded_urls": 7}')
    got = P.import_progress(spark, str(tmp_path))
    assert [r.url for r in got["downloaded_documents"].collect()] == ["https://h/a"]
    named = got["bad"].select(F.regexp_extract("file", "([a-z]).json", 1).alias("f"), "problem").collect()
    assert {tuple(r) for r in named} == {("b", "unreadable"), ("c", "unreadable")}
    with pytest.raises(Q.TooManyBadRows):
        P.import_progress(spark, str(tmp_path), most_bad=0.5)


def test_listing_audit(spark):
    page = lambda n, total=None: json.dumps({"results": [{"id": str(k)} for k in range(n)]} | ({"totalSize": total} if total is not None else {}))
    rows = [
        ("whole", 0, page(3, 5)), ("whole", 3, page(2, 5)),
        ("holes", 2, page(2, 9)), ("holes", 6, page(2, 9)), ("holes", 20, page(0, 9)),
        ("twice", 0, page(5)), ("twice", 0, page(5)), ("twice", 3, page(4)), ("twice", 4, page(1)),
        ("none", None, None), (None, 1, page(1, 0)),
    ]
    got = W.listing_audit(spark.createDataFrame(rows, "space_key string, start int, json string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("holes", "gap", 0, 1), ("holes", "gap", 4, 5), ("holes", "early end", 8, 8), ("twice", "overlap", 0, 4), ("twice", "overlap", 3, 4), ("twice", "overlap", 4, 4), (None, "gap", 0, 0),
    ], key=repr)
    short = spark.createDataFrame([("s", 0, page(3, 9)), ("s", 3, page(1, 8))], "space_key string, start int, json string")
    assert [tuple(r) for r in W.listing_audit(short).collect()] == [("s", "early end", 4, 8)]
