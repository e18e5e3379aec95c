"""The registered queries against their SQL, and the pipeline against brute force."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import compare, duck
from webtables.llm import catalog
from webtables.llm.decontamination import find_leaks
from webtables.llm.exchange import importable
from webtables.llm.line_dedup import repeated_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(catalog.queries()))
def test_query(spark, con, key):
    ok, message, _ = compare(spark, con, SF, catalog.queries()[key], catalog.oracle_sql().get(key))
    assert ok, message


def test_every_operator_has_one_query():
    names = list(entry.queries())
    assert sorted(n.split("_")[0] for n in catalog.queries()) == sorted(f"op{k}" for k in range(1, 14))
    assert "pipeline" in names and len(names) == len(set(names))
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_pipeline_stages(spark):
    docs = importable(spark).read.parquet(f"{SF}/documents.parquet")
    names, seen = [], docs
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before = {r.doc_id: r for r in seen.collect()}
        out = spark.createDataFrame((stage(spark, seen, SF)).collect(), None if name == "packing" else docs.schema)
        after = out.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            break
        assert out.columns == docs.columns and {r.doc_id for r in after} <= set(before)
        gone = set(before) - {r.doc_id for r in after}
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            assert len(gone - toxic) <= 0.05 * len(before)
        elif name == "line dedup":
            lines = {}
            for r in repeated_lines(seen).collect():
                lines.setdefault(r.doc_id, set()).add(r.line)
            for r in after:
                assert r.text == "\n".join(x for k, x in enumerate(before[r.doc_id].text.split("\n")) if k not in lines.get(r.doc_id, ()))
                assert r.n_chars == len(r.text)
            assert all(len(lines[d]) == len(before[d].text.split("\n")) for d in gone)
        elif name == "near duplicates":
            sets = {d: _shingles(r.text) for d, r in before.items()}
            ids = sorted(sets)
            linked = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
            assert {b for _, b in linked} == gone
        else:
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert gone == {r.doc_id for r in find_leaks(seen, items).collect()}
        seen = out
    assert names == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]


def _shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
