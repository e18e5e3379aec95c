"""Speculative BPE, alignment of two tokenizers, and clustering with loosened bounds, against the plain way."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webtables.llm import alignment, bpe, centroids
from webtables.llm.arrays import text_bytes
from webtables.llm.exchange import importable
from webtables.llm.queries import tokenizer_path

WORD, BYTE, PIECE = (tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    hard = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 '<|>/.,!\n\té́ 　\U0001f600中İΣ ẞ-_sSreRE\x00\x85"
    out = [None, "", " \n", "<|endoftext|>x<|startoftext|><|endoftext|>", "a<|endoftext|>", "</w>", "x</w> </w", "aaaaa" * 400, "a▁b", "<s> <0x41>", "漢字" * 60, "ﬁ ① ﷽"]
    out += ["".join(rng.choices(hard, k=rng.randint(0, 80))) for _ in range(400)]
    out += ["".join(rng.choices("abe th", k=rng.randint(0, 60))) for _ in range(400)]
    words = ["".join(rng.choices("etaoinshrd", k=rng.randint(1, 12))) for _ in range(300)]
    out += [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    return out + [" ".join(rng.choices(words, k=60_000)), "".join(rng.choices("etaoin", k=50_000)), out[-1], out[-1]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k != 5 else None, t, 1, "x", [2]) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, n_a int, slice string, ids array<int>"
    return importable(spark).createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_library(texts, path):
    from tokenizers import Tokenizer

    codec, library = bpe.Codec(path), Tokenizer.from_file(path)
    ids, first = codec.ids(*text_bytes(pa.array(texts, pa.string())))
    got = [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want
    assert 0 < codec.merges.exact
    assert bpe.Names(path).texts(pa.array(want, pa.list_(pa.int32()))).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in want]


def test_only_failing_words_are_merged():
    codec = bpe.Codec(WORD)
    codec.merges.encode([b"hello", b"the", b"international"])
    assert codec.merges.exact == 0


def test_pairs_are_compatible_exactly_if_merging_keeps_them():
    merges, rng = bpe.Codec(BYTE).merges, random.Random(2)
    spell = {int(z): None for z in np.flatnonzero(merges.left >= 0)}

    def symbols(z):
        return symbols(int(merges.left[z])) + symbols(int(merges.right[z])) if merges.left[z] >= 0 else [int(merges.single.tolist().index(z))]

    some = rng.sample(sorted(spell), 60)
    x, y = (np.array(v) for v in zip(*[(a, b) for a in some for b in some]))
    for a, b, good in zip(x.tolist(), y.tolist(), merges.compatible(x, y).tolist()):
        assert (merges.merge(np.array(symbols(a) + symbols(b))) == [a, b]) == good


def test_encode_and_decode_keep_rows_and_columns(docs, texts):
    out = bpe.encode(docs, WORD)
    assert out.columns == ["doc_id", "text", "n_a", "slice", "ids"]
    back = bpe.decode(out.drop("text"), WORD)
    rows = back.collect()
    assert len(rows) == len(texts) and {r.slice for r in rows} == {"x"}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].ids == [] and by_id[0].text == "" and by_id[1].ids == []
    assert by_id[3].ids == [49407, 343, 49406, 49407] or by_id[3].text.startswith("<|endoftext|> x</w>")
    nulls = bpe.decode(back.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), WORD).agg(F.max("text")).first()
    assert nulls[0] == ""


def test_foreign_vocabularies_are_refused(tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="before its parts"):
        bpe.Codec(str(tmp_path / "v.json"))


def test_merge_pieces_give_the_groups_of_a_plain_merge():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array(sorted({100, *rng.sample(range(1, 100), rng.randint(0, 60))})) for _ in "ab")
        common = np.intersect1d(a, b)
        for piece in (1, 2, 3, 7, 1000):
            of_a, of_b, n = alignment.groups(a, b, piece)
            assert n == len(common) and (of_a == np.searchsorted(common, a)).all() and (of_b == np.searchsorted(common, b)).all()


def aligned(rows):
    """{doc_id: the eight columns}, document by document and pair by pair."""
    pair, plain, held = alignment.Pair(BYTE, PIECE), {}, Counter()
    for doc, text in rows:
        plain[doc] = None
        if not text:
            continue
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        raw_a, raw_b = [pair.bytes_a[i].as_py() for i in a], [pair.bytes_b[i].as_py() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        groups, i, j = [], 0, 0
        for stop in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(stop, i) + 1, ends[1].index(stop, j) + 1
            groups.append([a[i:i2], b[j:j2]])
            i, j = i2, j2
        plain[doc] = (len(a), len(b), groups)
        held.update({(u, v) for x, y in groups for u in x for v in y})
    top = defaultdict(int)
    for (u, _), n in held.items():
        top[u] = max(top[u], n)
    out = {}
    for doc, found in plain.items():
        if not found:
            out[doc] = (0, 0, 0, 0, 0, 0, "")
            continue
        links = [held[u, v] == top[u] for x, y in found[2] for u in x for v in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found[2])
        out[doc] = (*found[:2], len(found[2]), len(links), sum(links), sum(held[u, v] for x, y in found[2] for u in x for v in y), text)
    return out


def test_alignment_against_brute_force(docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r[0]: tuple(r[1:]) for r in alignment.align(docs, BYTE, PIECE).collect()}
    assert got == aligned(rows)
    assert got[0][0] == 0 and got[8] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_in_small_slices_and_blocks(spark, docs, monkeypatch):
    few = docs.where("doc_id < 60")
    want = {r[0]: tuple(r[1:]) for r in alignment.align(few, BYTE, PIECE).collect()}
    links = alignment._links
    ids_a, ids_b = np.arange(300) % 70, np.arange(400) % 90
    whole = [np.concatenate(c) for c in zip(*links(ids_a, np.zeros(300, int), ids_b, np.zeros(400, int), 1))]
    monkeypatch.setattr(alignment, "BLOCK", 100)
    parts = [np.concatenate(c) for c in zip(*links(ids_a, np.zeros(300, int), ids_b, np.zeros(400, int), 1))]
    assert all((x == y).all() for x, y in zip(whole, parts)) and whole[3].sum() == 300 * 400 and len(whole[0]) == 70 * 90
    again = {r[0]: tuple(r[1:]) for r in alignment.align(few.repartition(7), BYTE, PIECE).collect()}
    assert again == want


def test_empty_tables(spark):
    none = importable(spark).createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, WORD), WORD).count() == 0
    assert alignment.align(none, BYTE, PIECE).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.summary(*centroids.cluster(centroids.whole_vectors(vectors, 4, 256), 3, 2, "2", 4)).count() == 0


def lloyd(rows, k, rounds, size):
    rows = [(i, [math.floor(256 * v) for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [r[1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for c in range(len(middle)):
            part = [v for (_, v), o in zip(rows, own) if o == c]
            if part:
                middle[c] = [sum(x) // len(part) for x in zip(*part)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in rows), key=repr), middle


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(8)
    spots = [[rng.uniform(-2, 2) for _ in range(6)] for _ in range(9)]
    rows = [(k, [v + rng.gauss(0, 0.1) for v in rng.choice(spots)]) for k in range(700)]
    rows += [(3, [0.0] * 6), (3, [0.0] * 6), (None, [0.5] * 6), (900, None), (901, [1.0]), (902, [None] * 6), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [-1e5] * 6)]
    rows = [(i, [float(np.float32(v)) if v is not None else None for v in e] if e is not None else None) for i, e in rows]
    schema = "vec_id long, embedding array<float>, cluster string, distance int"
    return rows, importable(spark).createDataFrame([(i, e, "x", 1) for i, e in rows], schema).repartition(3)


@pytest.mark.parametrize("k,rounds", [(12, 5), (1, 2), (2000, 1)])
def test_clusters_against_plain_rounds(vectors, k, rounds):
    rows, table = vectors
    state, middle = centroids.cluster(centroids.whole_vectors(table, 6, 256), k, rounds, "2", 6)
    want, want_middle = lloyd(rows, k, rounds, 6)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in state.collect()), key=repr) == want
    assert [[int(v) for v in m] for m in middle] == want_middle
    out = centroids.summary(state, middle).collect()
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)} and len(out) == len(want)
    if k == 12:
        assert state.agg(centroids.skipped(state)).first()[0] > 0.2


def test_too_large_components_are_named(spark):
    table = importable(spark).createDataFrame([(1, [3e30] * 2), (2, [0.0] * 2)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(centroids.whole_vectors(table, 2, 256), 2, 1, "2", 2)


def test_loosening_is_safe_and_below_the_drift():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(200):
        k, size = 6, int(rng.integers(2, 5))
        old = rng.normal(0, 10, (k, size))
        new = old + rng.normal(0, 2, (k, size)) * (rng.random((k, 1)) < 0.8)
        radius = rng.uniform(0, 8, k)
        loose = centroids.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            rest = np.delete(np.arange(k), i)
            assert loose[i] <= drift[rest].max() + 1e-9
            tighter += loose[i] < 0.9 * drift[rest].max()
            away = rng.normal(0, 1, (300, size))
            away *= (radius[i] * rng.random((300, 1)) ** (1 / size)) / np.linalg.norm(away, axis=1, keepdims=True)
            x = old[i] + away
            gain = np.linalg.norm(x[:, None] - old[rest], axis=2) - np.linalg.norm(x[:, None] - new[rest], axis=2)
            assert gain.max() <= loose[i] + 1e-9
    assert tighter > 100
