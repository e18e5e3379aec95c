"""Each operator on hostile little tables and against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from webtables.llm import decontamination, fingerprints, html_consensus, line_dedup, packing, partenum, suffix_dedup, super_kmers, toxicity, url_templates
from webtables.llm.exchange import importable
from webtables.llm.queries import tokenizer_path

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


@pytest.fixture(scope="module")
def corpus(rng):
    """(doc_id, text): copies, near copies, shared passages, repeated lines, nulls, empties, ties and a very long text."""
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared, line = text(70), text(12)
    rows = [text(rng.randint(0, 120)) for _ in range(40)]
    rows += [f"{text(20)} {shared} {text(15)}\n{line}" for _ in range(8)] + [f"{line}\n{text(30)}\n{line}" for _ in range(4)]
    for base in rows[:6]:
        words = base.split()
        for k in range(3):
            if words:
                words = list(words)
                words[rng.randrange(len(words))] = f"x{k}"
            rows.append(" ".join(words))
    rows += [None, "", " \n\t ", "one", "one", "ONE", "é" * 60, "aa " * 200, rows[0], rows[41], text(6000) + "\n" + shared]
    rows += ["\n".join([text(40)] * 3), "a\n\nb\r\nc", "quarter " * 13]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    importable(spark)
    rows = [(i, t, 7, "y", 1, b"z") for i, t in corpus]
    schema = "doc_id bigint, text string, n bigint, key string, piece int, blob binary"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return importable(spark).createDataFrame([], "doc_id bigint, text string")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def repeated(sequences, size):
    """{id: flags} of units covered by a window that a smaller id has, by brute force."""
    least = {}
    for i, seq in sequences.items():
        for k in range(len(seq) - size + 1):
            w = seq[k : k + size]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, seq in sequences.items():
        gone = [False] * len(seq)
        for k in range(len(seq) - size + 1):
            if least[seq[k : k + size]] < i:
                gone[k : k + size] = [True] * size
        out[i] = gone
    return out


def test_suffix_dedup_equals_brute_force(docs, corpus):
    texts = {i: (t or "").encode() for i, t in corpus}
    gone = repeated(texts, 50)
    for r in suffix_dedup.dedup_bytes(docs).collect():
        own = texts[r.doc_id]
        kept = bytes(b for b, g in zip(own, gone[r.doc_id]) if not g)
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(own), sum(gone[r.doc_id]), kept)
        assert r.n_spans == sum(g and not (k and gone[r.doc_id][k - 1]) for k, g in enumerate(gone[r.doc_id])) == len(r.spans)


def test_suffix_dedup_finds_passages_that_begin_between_equal_minimisers(spark):
    import numpy as np

    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    # The 12 bytes of the least hash among many: a minimiser wherever it lies.
    pool = text(200_000)
    hashes = suffix_dedup._gram_hashes(np.frombuffer(pool.encode(), np.uint8))[: len(pool) - 11]
    gram = pool[int(hashes.argmin()) :][:12]
    rows = []
    for k in range(12):
        between, tail = text(12 - k), text(38 + k % 3)
        rows += [text(70) + gram + text(2 + k) + between + gram + tail + text(70), text(70) + between + gram + tail + text(70)]
        # The same with the passage's end between the two.
        rows += [text(70) + tail + gram + between + text(2 + k) + gram + text(70), text(70) + tail + gram + between + text(70)]
    # Both lie in the passage, and the places start anew between them.
    passage = text(8) + gram + text(4) + gram + text(14)
    rows = [text(4096 - 22) + passage + text(30), text(70) + passage + text(70)] + rows
    rows += [("-" * 90 + text(20)) * 2, text(30) + "-" * 70, text(60) + "ab" * 40, "ab" * 35 + text(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").coalesce(1)
    want = repeated({i: t.encode() for i, t in enumerate(rows)}, 50)
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert sum(sum(flags) for flags in want.values()) > 1000
    for i, t in enumerate(rows):
        flags = [False] * len(t)
        for s, e in got[i]["spans"]:
            flags[s:e] = [True] * (e - s)
        assert flags == want[i], i


def test_super_kmers_equal_brute_force(docs, corpus):
    texts = {i: tuple(words(t)) for i, t in corpus}
    gone = repeated(texts, 13)
    rows = super_kmers.dedup_windows(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        own = texts[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(own), sum(gone[r.doc_id]))
        assert r.kept_text == " ".join(w for w, g in zip(own, gone[r.doc_id]) if not g)


def test_hot_minimisers_change_the_way_not_the_result(docs, corpus, monkeypatch):
    import numpy as np

    from webtables.llm import windows

    def every(docs, units, size, gram, limit):
        out = []
        for part in docs.select("doc_id", "text").toArrow().to_batches():
            out.append(windows._runs(units(part), size, gram)[3])
        return np.unique(np.concatenate(out))[::2]

    monkeypatch.setattr(windows, "hot_minimisers", every)
    test_super_kmers_equal_brute_force(docs, corpus)
    test_suffix_dedup_equals_brute_force(docs, corpus)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def links(sets):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_partenum_equals_brute_force(docs, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    want = classes(sets, links(sets))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_partenum_loses_no_link_near_the_threshold(spark, rng):
    """Sets of every small size whose likeness lies just at or below 0.8, and groups that only chains hold together."""
    rows, n = [], 0
    for size in [*range(1, 40), 60, 100, 250]:
        base = [f"w{size}x{k}" for k in range(size + 4)]
        rows.append((n, " ".join(base)))
        n += 1
        for cut in range(1, 4):
            for drop in {max(0, (size * 2) // (9 * cut)), size // 5, 1}:
                rows.append((n, " ".join(base[: len(base) - drop] + [f"t{n}"] * (cut - 1))))
                n += 1
    docs = importable(spark).createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: shingles(t) for i, t in rows}
    want = classes(sets, links(sets))
    assert {r.doc_id: r.component_id for r in partenum.jaccard_components(docs).collect()} == want


def test_line_dedup_equals_brute_force(docs, corpus):
    lines = {(i, k): (x, set(words(x, lower=True))) for i, t in corpus for k, x in enumerate((t or "").split("\n"))}
    order = sorted(lines)
    gone = set()
    for p, b in enumerate(order):
        for a in order[:p]:
            x, y = lines[a][1], lines[b][1]
            if y and 100 * len(x & y) >= 80 * len(x | y):
                gone.add(b)
                break
    out = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert set(out) == {i for i, _ in corpus}
    for i, t in corpus:
        kept = "\n".join(lines[i, k][0] for k in range(len((t or "").split("\n"))) if (i, k) not in gone)
        assert (out[i].text or "", out[i].n_lines_removed) == (kept, sum(g[0] == i for g in gone))
        assert (out[i].key, out[i].piece, bytes(out[i].blob)) == ("y", 1, b"z")


def test_line_dedup_of_a_text_of_more_lines_than_20_bits(spark):
    far = 1 << 20
    # Line k and line k + 2^20 share a word; their sets are far apart.
    first = [f"shared{k % 7} " + " ".join(f"a{k}w{j}" for j in range(6)) for k in range(40)]
    later = [f"shared{k % 7} " + " ".join(f"b{k}w{j}" for j in range(6)) for k in range(40)]
    text = "\n".join(first + [""] * (far - len(first)) + later + [first[3] + " more", later[5]])
    docs = importable(spark).createDataFrame([(1, text), (2, later[7] + " too\nquite another line")], "doc_id bigint, text string").coalesce(1)
    got = {tuple(r) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {(1, far + 40), (1, far + 41), (2, 0)}


def test_line_dedup_sends_no_text_and_short_entries(spark, docs, rng, monkeypatch):
    from webtables.llm import exchange

    plans, blobs = [], []
    monkeypatch.setattr(line_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or exchange.stored(df))
    monkeypatch.setattr(line_dedup, "by_bucket", lambda b, *a: blobs.append(sum(len(r.blob) for r in b.collect())) or exchange.by_bucket(b, *a))
    # A filter that lets through nearly everything changes nothing.
    want = {tuple(r) for r in line_dedup.repeated_lines(docs).collect()}
    assert want and not any("Join" in p and "text#" in p for p in plans)
    monkeypatch.setattr(line_dedup, "MARKS", 1 << 7)
    assert {tuple(r) for r in line_dedup.repeated_lines(docs).collect()} == want
    # Three words of each line of twelve are listed: six bytes of the word, eight of the line's set, the sketch, and places.
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(4000)]
    df = importable(spark).createDataFrame([(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(400)], "doc_id bigint, text string").coalesce(1)
    line_dedup.repeated_lines(df).collect()
    assert blobs[-1] < 45 * 3 * len(lines)


def test_fingerprints(docs, corpus):
    ordered = sorted(corpus)
    out = {r.doc_id: r for r in fingerprints.fingerprints(docs).withColumn("near", fingerprints.likeness(F.col("sketch"), F.col("edited_sketch"))).collect()}

    def sketch(text):
        w = words(text)
        all_ = [hashlib.md5(" ".join(w[k : k + 5]).encode()).hexdigest() for k in range(max(len(w) - 4, 1))] if w else []
        return sorted({h[:16] for h in ([h for h in all_ if h < "2"] or all_ and [min(all_)])})

    for k, (i, t) in enumerate(ordered):
        t, follower = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        r = out[i]
        assert (r.n_chars, r.edited, r.sketch, r.edited_sketch, r.next_sketch) == (len(t), edited, sketch(t), sketch(edited), sketch(follower))
        assert 0 <= r.near <= 1
    assert len(out) == len(corpus)


def test_sketches_merge(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(400)) for c in "ab")
    df = spark.createDataFrame([(a, b, a + " . . . . " + b)], "a string, b string, c string")
    s = [fingerprints.sketch(F.col(c)) for c in "abc"]
    whole, part = df.select(fingerprints.containment(fingerprints.merged(s[0], s[1]), s[2]), fingerprints.containment(s[0], s[2])).first()
    assert whole == part == 1.0


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Which tall grey animal has a very long trunk and big ears. The elephant of the savanna."), (2, None), (3, ""), (4, "What is it."), (4, "Repeated item id text here now. Answer of seven plain words in total.")]
    return importable(spark).createDataFrame(rows, "item_id bigint, text string")


def test_decontamination(spark, items):
    whole = "Which tall grey animal has a very long trunk and big ears. The elephant of the savanna."
    rows = [
        (0, "before " * 90 + whole.upper().replace(".", " ,") + " after" * 500),
        (1, "Which tall grey animal has a very long trunk and big ears."),
        (2, "The elephant of the savanna. " * 3),
        (3, None), (4, ""), (5, "What   is\nit"), (6, whole), (6, whole), (None, whole), (7, "clean " * 1000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("mine")).withColumn("score", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, items).collect()}
    assert got == {(0, 1), (5, 4), (6, 1), (None, 1)}
    kept = decontamination.without_leaks(df, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7] and kept.columns == df.columns


def test_wand_misses_nothing(rng):
    import numpy as np

    vocabulary = [f"v{k}" for k in range(60)] + ["the"] * 20
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for k in range(90)]
    index = decontamination.Index.of(items)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))) for _ in range(60)] + [t for _, t in items[:20]]
    import pyarrow as pa

    from webtables.llm import arrays as A

    h, first = decontamination._tokens(*A.text_bytes(pa.array(texts)))
    row, start, item, score = index.retrieve(h, first)
    got = {(r, s, i): round(x, 9) for r, s, i, x in zip(row.tolist(), start.tolist(), item.tolist(), score.tolist())}
    want = {}
    terms = {t: k for k, t in enumerate(index.terms.tolist())}
    for r in range(len(texts)):
        own = h[first[r] : first[r + 1]].tolist()
        n = max(-(-(len(own) - 2 * index.stride) // index.stride), 0) + 1 if own else 0
        for p in range(n):
            sums = np.zeros(len(items))
            for t in {terms[x] for x in own[p * index.stride : (p + 2) * index.stride] if x in terms}:
                at = slice(index.first[t], index.first[t + 1])
                np.add.at(sums, index.item[at], index.impact[at])
            want |= {(r, p * index.stride, i): round(float(sums[i]), 9) for i in np.flatnonzero(sums >= decontamination.THRESHOLD - 1e-9).tolist()}
    assert got == want and want


def test_texts_full_of_benchmark_words_need_bounded_memory(rng, monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from webtables.llm import arrays as A

    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(400)]
    index = decontamination.Index.of(items)
    texts = [" ".join(rng.choices(vocabulary, k=60_000)) + " " + t for _, t in items[:3]]
    h, first = decontamination._tokens(*A.text_bytes(pa.array(texts)))
    tracemalloc.start()
    found = index.retrieve(h, first)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20 and set(found[2].tolist()) >= {0, 1, 2}
    # The length of a step changes nothing.
    few = np.array([0, 150, 700, 700, 1500])
    want = index.retrieve(h[-1500:], few)
    monkeypatch.setattr(decontamination, "STEP", 64)
    assert len(want[0]) and all(np.array_equal(x, y) for x, y in zip(index.retrieve(h[-1500:], few), want))


def test_packing_round_trip(spark, docs, corpus, rng):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for capacity in (64, 4096):
        rows = packing.pack(docs, tokenizer_path(), capacity=capacity, with_ids=True).collect()
        ids, sequences = {}, {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
            assert r.start == len(ids.setdefault(r.doc_id, [])) == r.piece * capacity and r.length == len(r.ids) <= capacity
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
            ids[r.doc_id] += r.ids
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert ids == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in corpus}
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) <= 1 + 1.1 * sum(map(len, ids.values())) / capacity


def test_units_give_the_tokens_of_whole_texts(rng):
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from webtables.llm import arrays as A

    signs = ["a", "B", "é", "É", "ß", "×", "÷", "1", "٣", "½", "'", "’", "'s", "'LL", ".", ",", "<|endoftext|>", "<|", " ", "\n", "\u00a0", "\u0301", "日本", "\x1f", "\x85", "👍", "ﬁ", "ı", "“", "re", "e"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)] + ["It's 12,5% «ÉTÉ» l'été don't'll naïve", ""]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids, first = packing.Encoder(tokenizer_path()).ids(*A.text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert ids.dtype == np.uint32


def test_new_units_are_tokenised_together_and_forgotten_ones_again(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from webtables.llm import arrays as A

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    monkeypatch.setattr(packing, "_KNOWN", {})
    monkeypatch.setattr(packing, "MEMORY", 500)
    encoder, library = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    encoder.tokenizer = Counted(encoder.tokenizer)
    plain_ = [" ".join(f"w\u00f6rt{chr(97 + k % 26)}{k} x{k * k}!? \u00dcb" for k in range(at, at + 100)) for at in (0, 50, 500, 0)]
    odd = ["it's re\u0301sum\u00e9 \u6f22\u5b57 <|endoftext|> </w> w", "", None, " \n"]
    for texts in ([x] for x in plain_):
        ids, first = encoder.ids(*A.text_bytes(pa.array(texts)))
        assert ids.tolist() == library.encode(texts[0], add_special_tokens=False).ids and first.tolist() == [0, len(ids)]
    assert encoder.tokenizer.texts <= len(plain_)
    ids, first = encoder.ids(*A.text_bytes(pa.array([*odd, *plain_])))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in [*odd, *plain_]]
    assert [ids[s:e].tolist() for s, e in zip(first[:-1], first[1:])] == want


def test_stages_hand_rows_to_python_by_a_few_megabytes(spark, monkeypatch):
    import pyarrow as pa

    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, path: docs)
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        rows = [r["n"] for r in corpus_pipeline.pack_sequences(spark, docs, "").mapInArrow(size, "n long").collect()]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert sum(rows) == 300 and max(rows) <= 50


def test_joining_words_costs_little_more_than_finding_them(rng):
    """It was most of what packing did beside the tokenizer."""
    import time

    import numpy as np

    from webtables.llm import arrays as A

    text = " ".join(rng.choices(["a", "of", "word", "longer", "x7"], k=400_000)).encode() + b"\n\tend"
    data, off = np.frombuffer(text, np.uint8), np.array([0, 5, len(text)])

    def least(of):
        took = []
        for _ in range(5):
            began = time.process_time()
            of()
            took.append(time.process_time() - began)
        return min(took)

    s, e, _ = A.words(data, off)
    assert least(lambda: A.joined(data, s, e)) < 10 * least(lambda: A.words(data, off))
    out, begin, end = A.joined(data, s, e)
    assert [out[x:y].tobytes() for x, y in zip(begin[:9].tolist(), end.tolist())] == [data[x:y].tobytes() for x, y in zip(s[:9].tolist(), e.tolist())]
    assert out.tobytes() == b"".join(text[x:y] + b" " for x, y in zip(s.tolist(), e.tolist()))


def test_plan_places_every_piece_once(rng):
    for _ in range(30):
        counts = {rng.randint(1, 200): rng.randint(1, 50) for _ in range(rng.randint(0, 60))}
        rows = packing.plan(counts, 200, rng.choice([1, 3, 16]))
        have, filled = dict.fromkeys(counts, 0), {}
        for length, first, number, sequence, offset in sorted(rows):
            assert first == have[length]
            have[length] += number
            for k in range(number):
                filled.setdefault(sequence + k, []).append((offset, length))
        assert have == counts
        for places in filled.values():
            assert [o for o, _ in sorted(places)] == [sum(x for _, x in sorted(places)[:k]) for k in range(len(places))] and sum(x for _, x in places) <= 200


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "HTTP://A.EXAMPLE.ORG/es/1", "https://example.org/en/1x?q", "https://notexample.org/es/1", "x://h.com/de/", "x://h.com", "x://com/fr/a#b", "://h.net?x/", "a://b://c/d"]
    urls += [f"https://s.com/{lang}/p{k}.html" for lang in ("de", "fr") for k in range(40)] + [f"https://s.com/dex/p{k}.html" for k in range(40)]
    df = importable(spark).createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(0))
    out = {r.page_id: r for r in url_templates.judge_urls(df, RULES).collect()}
    assert len(out) == len(urls)
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut], rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
            host = host.lower()
        fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fit, key=len, default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == RULES[rule] if rule else out[i].verdict in ("allow", "block")
    assert out[12].template == "/de/*.html" and out[55].template == "/fr/*.html" and out[12].blocked_share > 0.9 > 0.1 > out[55].blocked_share


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>x = "<p>no</p>";</script></head><body class="b1"><header><h2>Site</h2></header>
<nav><a href=/>menu</a></nav><div class="cookie-notice">We use cookies</div><div id="wrap2"><aside>side</aside><div class="post post-17"><header><h1>Head &amp; line</h1></header>
<p>First <b>bold</b>
 text &lt;x&gt;<p>Second &eacute;&nbsp;paragraph of some length<ul><li>one<li>two</ul><form><input><label>name</label></form><section class="comments"><p>A reader says much more than the article has to say here</p></section></div></div>
<footer>&copy; site</footer></body></html>"""
TEXT = "Head & line\nFirst bold text <x>\nSecond é paragraph of some length\none\ntwo"


def test_html_consensus(spark):
    short = PAGE.replace("of some length", "").replace("post-17", "post-18")
    sly = short.replace("<aside>side</aside>", "<div class='x'><p>" + "words outside the place where this host keeps its articles " * 3 + "</p></div>")
    pages = [(1, "http://h/a", PAGE), (2, "http://h/b", PAGE.replace("17", "99")), (3, "http://h/c", sly), (4, None, PAGE), (5, "http://h/d", None), (6, "http://h/e", ""), (7, "http://h/f", "<p>a<p>b &#65"), (7, "http://h/f", "<div><p>cut <a href='"), (None, "http://h/g", "x" * 300000 + "<" * 1000)]
    df = importable(spark).createDataFrame(pages, "page_id bigint, url string, html string").withColumn("path", F.lit(1)).withColumn("text", F.lit(2))
    out = html_consensus.extract_text(df).collect()
    got = {(r.page_id, r.url): r.text for r in out if r.page_id != 7}
    assert len(out) == len(pages)
    assert got[1, "http://h/a"] == got[2, "http://h/b"] == got[4, None] == TEXT
    assert got[3, "http://h/c"] == TEXT.replace(" of some length", "")  # read where the host keeps its articles
    assert got[5, "http://h/d"] == got[6, "http://h/e"] == ""
    assert got[None, "http://h/g"].startswith("xxx")


def test_html_consensus_keeps_title_lead_and_sibling_sections(spark):
    long, other = "body text that goes on for quite a while " * 6, "the second section says rather less " * 3
    lead = "<h1>Title</h1><p>A lead of some words</p>"
    texts = {
        "div in article": f"<body><div><article>{lead}<div class=body><p>{long}</p></div></article></div></body>",
        "sections in article": f"<body><article>{lead}<section class=a><p>{long}</p></section><section class=b><p>{other}</p></section></article></body>",
        "cells in article": f"<body><main>{lead}<table><tr><td><p>{long}</p></td><td><p>{other}</p></td></tr></table></main></body>",
        "sections alone": f"<body><nav>menu</nav><div>{lead}<section class=a><p>{long}</p></section><section class=b><p>{other}</p></section></div></body>",
    }
    rows = [(k, f"http://h{n}/{k}", page) for n, page in enumerate(texts.values()) for k in range(3 * n, 3 * n + 3)]
    df = importable(spark).createDataFrame(rows, "page_id bigint, url string, html string")
    for r in html_consensus.extract_text(df).collect():
        want = ["Title", "A lead of some words", long.strip()] + ([other.strip()] if r.page_id >= 3 else [])
        assert r.text.split("\n") == want, r.url


def test_toxicity_on_held_out_texts(spark, rng):
    common = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "ki", "po", "de", "ver", "en")]
    rows = []
    for k in range(900):
        w = rng.choices(common, k=rng.randint(5, 60))
        toxic = k % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumfel", "grumpot", "snarvik"]) + rng.choice(["", "s", "er"]))
        rows.append((k, " ".join(w), int(toxic)))
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 600"))
    right = toxicity.score(df.where("doc_id >= 600"), model).where("(toxicity >= 0.5) = (toxic = 1)").count()
    assert right >= 0.97 * 300
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "\n"), (2, "snarvik " * 50000)], "doc_id bigint, text string").withColumn("toxicity", F.lit("old"))
    scores = [r.toxicity for r in toxicity.score(odd, model).orderBy(F.length("text")).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and max(scores) > 0.5
    none = toxicity.fit(df, df.where("false"))
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(df.limit(5), none).collect())


def test_fitting_takes_one_python_worker_a_task(spark, monkeypatch):
    """Each Python step of its own in a plan is one more worker per core, and idle workers keep their memory."""
    from webtables.llm import exchange

    plans = []
    monkeypatch.setattr(toxicity, "stored", lambda df: plans.append(df) or exchange.stored(df))
    monkeypatch.setattr(toxicity, "by_bucket", lambda blobs, *a: plans.append(blobs) or exchange.by_bucket(blobs, *a))
    df = importable(spark).createDataFrame([(k, "bad words" if k % 2 else "good words", k % 2) for k in range(40)], "doc_id bigint, text string, toxic int")
    toxicity.fit(df, df)
    assert [p._jdf.queryExecution().analyzed().toString().count("MapInArrow") for p in plans] == [1, 1]


def test_toxicity_fitted_on_fewer_rows_keeps_the_base_rate(spark, rng):
    common = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "ki", "po", "de", "ver", "en")]
    rows = []
    for k in range(6000):
        toxic = k % 4 == 0
        # Words of both classes, so that the prior matters.
        w = rng.choices(common, k=rng.randint(5, 30)) + ["grumfel"] * (rng.random() < (0.4 if toxic else 0.2))
        rows.append((k, " ".join(w), int(toxic)))
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string, toxic int")
    odd = df.union(spark.createDataFrame([(-1, "", 0), (-2, None, 0)], df.schema))

    def found(model):
        got = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
        return sum(v for k, v in got.items() if k >= 0) / len(rows), sum(v >= 0.5 for v in got.values())

    # One class at the limit and the other below it; and both above it.
    (whole, flagged), some, few = (found(toxicity.fit(df, df, most=m)) for m in (None, 3000, 1400))
    assert abs(whole - 1 / 4) < 0.04
    assert abs(some[0] - whole) < 0.05 and abs(few[0] - whole) < 0.05
    assert abs(some[1] - flagged) < 0.05 * len(rows) and abs(few[1] - flagged) < 0.05 * len(rows)


def test_empty_tables(spark, nothing, items):
    assert suffix_dedup.dedup_bytes(nothing).count() == 0
    assert super_kmers.dedup_windows(nothing).count() == 0
    assert partenum.jaccard_components(nothing).count() == 0
    assert line_dedup.without_repeated_lines(nothing).count() == 0
    assert fingerprints.fingerprints(nothing).count() == 0
    assert decontamination.find_leaks(nothing, items).count() == 0
    assert decontamination.find_leaks(nothing, items.where("false")).count() == 0
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_templates.judge_urls(pages, RULES).count() == 0
    assert html_consensus.extract_text(pages).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, long), (None, None), (3, long), (3, long), (1, "short"), (3, "other " + long)]
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string")
    for out in (suffix_dedup.dedup_bytes(df), super_kmers.dedup_windows(df)):
        assert sorted((r.doc_id or -1, r.n_removed) for r in out.collect()) == [(-1, 0), (-1, 0), (1, 0), (3, 0), (3, 0), (3, 0)]
    got = sorted((r.doc_id or -1, r.component_id) for r in partenum.jaccard_components(df).collect() if r.doc_id)
    assert got == [(1, 1), (3, 3), (3, 3), (3, 3)]
    assert partenum.jaccard_components(df).where("doc_id IS NULL AND component_id IS NULL").count() == 2
    assert line_dedup.without_repeated_lines(df).count() == len(rows)
    assert fingerprints.fingerprints(df).count() == len(rows)
    assert packing.pack(df, tokenizer_path()).count() == len(rows)


def test_scored_text_goes_to_the_task_once(spark):
    """Twice the text in every Arrow batch was what scoring held most of; a text that is no string is still read as one."""
    import numpy as np

    from webtables.llm.toxicity import fit, score

    docs = spark.createDataFrame([(i, f"bad worse w{i}" if i % 2 else f"good nice w{i}", i) for i in range(60)], "doc_id long, text string, n int")
    model = fit(docs, docs.selectExpr("doc_id", "doc_id % 2 AS toxic"))
    out = score(docs, model, name="s")
    assert "_scored" not in out._jdf.queryExecution().analyzed().toString() and out.columns == ["doc_id", "text", "n", "s"]
    got = {r.doc_id: r.s for r in out.collect()}
    as_bytes = score(docs.withColumn("text", docs.text.cast("binary")), model, name="s")
    assert as_bytes.dtypes == [("doc_id", "bigint"), ("text", "binary"), ("n", "int"), ("s", "double")]
    assert {r.doc_id: r.s for r in as_bytes.collect()} == got
    over = score(docs.withColumn("n", docs.text), model, text_col="n", name="n")
    assert over.dtypes == [("doc_id", "bigint"), ("text", "string"), ("n", "double")] and {r.doc_id: r.n for r in over.collect()} == got
    assert np.mean([got[i] for i in range(1, 60, 2)]) > np.mean([got[i] for i in range(0, 60, 2)])
