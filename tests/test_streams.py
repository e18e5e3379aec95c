"""Streams over several arriving files agree with the batch jobs over all of them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webtables.operators import tracker as T
from webtables.plans import page_jobs, stream_jobs
from webtables.streaming import jobs as J
from webtables.streaming import queue as Q
from webtables.streaming.folds import Store, read_folds, to_folds

LOG = "clean_url string, action string, ts timestamp, event_id bigint, error string, file_size bigint"
T0 = datetime(2024, 1, 1)


def rows(lo, hi):
    kinds = ["claim", "complete", "fail", "discover"]
    return [(f"u{i % 7}", kinds[(i * 5 + i // 3) % 4], T0 + timedelta(seconds=40 * i), i, f"E{i}", i * 10) for i in range(lo, hi)]


def source(spark, tmp_path):
    spark.createDataFrame(rows(0, 60), LOG).coalesce(1).write.parquet(f"{tmp_path}/in/part0")
    spark.createDataFrame(rows(60, 120), LOG).coalesce(1).write.parquet(f"{tmp_path}/in/part1")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return stream, spark.createDataFrame(rows(0, 120), LOG)


def test_status_folds_merge(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    J.stream_status(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert Store(spark, f"{tmp_path}/out").marked() == {(0, 0), (0, 1)}
    base = batch.select("clean_url").distinct().selectExpr(
        "clean_url AS url", "clean_url", "'pending' AS status", "0 AS retry_count", "CAST(NULL AS STRING) AS error_message")
    got = J.current_status(base, f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.apply_status(base, batch).collect()))


def test_progress_windows(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    J.stream_windows(J.stream_progress(stream, "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/ck", every=2).awaitTermination()
    assert (1, 1) in Store(spark, f"{tmp_path}/out").marked()
    got = {r.window_start: (r.pages, r.bytes, r.errors) for r in J.latest_windows(spark, f"{tmp_path}/out", every=2).collect()}
    want = {r.window_start: (r.pages, r.bytes, r.errors) for r in J.stream_progress(batch, "10 minutes").collect()}
    assert got == want


def test_dedup_and_stalled(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    J.to_batches(J.stream_new_urls(stream.select("clean_url", "ts"), "10 days"), f"{tmp_path}/d", f"{tmp_path}/dk").awaitTermination()
    assert sorted(r.clean_url for r in J.read_batches(spark, f"{tmp_path}/d").collect()) == [f"u{i}" for i in range(7)]
    J.to_batches(J.stream_stalled(stream, "60 seconds", "0 seconds"), f"{tmp_path}/s", f"{tmp_path}/sk").awaitTermination()
    got = {r.claim_id for r in J.read_batches(spark, f"{tmp_path}/s").collect()}
    events = rows(0, 120)
    ends = [(u, t) for u, a, t, *_ in events if a in ("complete", "fail")]
    want, open_yet = set(), set()
    last = min(max(t for u, a, t, *_ in events if a == "claim"), max(t for _, t in ends))
    for u, a, t, i, *_ in events:
        if a == "claim" and not any(v == u and t <= e <= t + timedelta(seconds=60) for v, e in ends):
            (want if t + timedelta(seconds=60) < last else open_yet).add(i)
    assert want <= got <= want | open_yet


def test_stalled_claims_do_not_depend_on_files_or_their_order(spark, tmp_path):
    """Several unsorted files, one per micro-batch, against all events at once."""
    late = [("last", "claim", T0 + timedelta(days=2), 1000, None, 0), ("last", "complete", T0 + timedelta(days=2), 1001, None, 0)]
    events = rows(0, 120)
    found = []
    for name, parts in (("one", [events + late]), ("many", [events[k::4][::-1] for k in range(4)] + [late])):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{tmp_path}/{name}/part{k}")
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
        J.to_batches(J.stream_stalled(stream, "60 seconds", "2 hours"), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-ck").awaitTermination()
        found.append(sorted(r.claim_id for r in J.read_batches(spark, f"{tmp_path}/{name}-out").collect()))
    assert found[0] == found[1] and len(found[0]) > 5


# --- compaction ---------------------------------------------------------------------------


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum("batches").alias("batches"))


def batch_rows(spark, b):
    return spark.createDataFrame([(b % 3, b, 1), (7, 1, 1)], "k int, n bigint, batches bigint").coalesce(1)


def state(spark, path, every):
    found = read_folds(spark, path, summed, every)
    return {r.k: (r.n, r.batches) for r in found.collect()} if found is not None else {}


def expected(n):
    out = {k: (sum(range(k, n, 3)), len(range(k, n, 3))) for k in range(3) if k < n}
    return out | ({7: (n, n)} if n else {})


def test_a_reader_opens_few_folds_and_sees_all_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "f"), 3)
    assert read_folds(spark, store.path, summed, 3) is None
    for b in range(30):
        store.add(batch_rows(spark, b), b, summed)
        if b in (0, 1, 2, 5, 8, 9, 26, 29):
            assert state(spark, store.path, 3) == expected(b + 1)
        assert len(store.cover()) <= 2 * 4
    assert store.cover() == [(3, 26), (1, 29)]
    # Folders stay bounded too: of each level the inputs of at most the last two merges.
    assert len(store.marked()) <= 4 * 2 * 3


def test_a_thousand_batches(spark, tmp_path, monkeypatch):
    """The bookkeeping alone: which folds are marked, read and kept after 1,000 batches of 16."""
    marked, reads = set(), []
    monkeypatch.setattr(Store, "write", lambda self, rows, level, last: marked.add((level, last)))
    monkeypatch.setattr(Store, "read", lambda self, folds: reads.append(folds) or folds)
    monkeypatch.setattr(Store, "marked", lambda self: set(marked))
    monkeypatch.setattr(Store, "is_marked", lambda self, level, last: (level, last) in marked)
    monkeypatch.setattr(Store, "drop", lambda self, level, first, last: [marked.discard(x) for x in list(marked) if x[0] == level and first <= x[1] <= last])
    store = Store(spark, str(tmp_path / "f"), 16)
    for b in range(1000):
        store.add(None, b, lambda rows: rows)
    cover = store.cover()
    assert len(cover) <= 45 and cover[-1][1] == 999 and sum(16**level for level, _ in cover) == 1000
    assert len(marked) <= 3 * 2 * 16 and all(len(r) == 16 for r in reads)


def test_replays_and_crashes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    store = Store(spark, path, 2)
    for b in range(3):
        store.add(batch_rows(spark, b), b, summed)
    # A crash after the rows of the merge are written, before its marker: the reader still takes the folds below.
    real = store._fs.create
    calls = []

    def lost(rows, level, last):
        rows.write.mode("overwrite").parquet(f"{path}/level={level}/last={last}")
        if level > 0:
            calls.append((level, last))
            raise RuntimeError("lost")
        real(store._at(f"level={level}/last={last}/_MARKED"), True).close()

    monkeypatch.setattr(store, "write", lost)
    try:
        store.add(batch_rows(spark, 3), 3, summed)
    except RuntimeError:
        pass
    assert calls == [(1, 3)] and (1, 3) not in store.marked() and state(spark, path, 2) == expected(4)
    monkeypatch.undo()
    # The batch is replayed: nothing counts twice, and the merges are made up for.
    for _ in range(2):
        Store(spark, path, 2).add(batch_rows(spark, 3), 3, summed)
        assert state(spark, path, 2) == expected(4)
    assert Store(spark, path, 2).cover() == [(2, 3)]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    schema = "k int, n bigint"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        to_folds(stream, f"{tmp_path}/f", f"{tmp_path}/ck", lambda r, _: summed(r.withColumn("batches", F.lit(1))), summed, every=2).awaitTermination()

    for part in range(3):
        for k in range(2):
            spark.createDataFrame([(1, part * 2 + k)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}-{k}")
        run()
        assert state(spark, f"{tmp_path}/f", 2)[1][0] == sum(range(2 * part + 2))


# --- queue --------------------------------------------------------------------------------


def queue_events():
    rng = random.Random(3)
    out = []
    for u in range(6):
        t = T0 + timedelta(seconds=rng.randint(0, 300))
        for _ in range(rng.randint(1, 6)):
            out.append((f"u{u}", "claim", t))
            end = rng.choice([None, 10, 59, 60, 61, 200])
            if end is not None:
                out.append((f"u{u}", rng.choice(["complete", "fail", "fail", "discover"]), t + timedelta(seconds=end)))
            t += timedelta(seconds=rng.choice([30, 90, 400]))
    last = max(t for _, _, t in out)
    # Open claims beyond the watermark, and an event that moves it.
    return out + [("open", "claim", last + timedelta(hours=3)), ("clock", "complete", last + timedelta(hours=3))]


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled"])
def test_queue_does_not_depend_on_order(spark, tmp_path, order):
    events = queue_events()
    late = events[-2:]
    rest = {"sorted": events[:-2], "reversed": events[:-2][::-1], "shuffled": random.Random(9).sample(events[:-2], len(events) - 2)}[order]
    schema = "clean_url string, action string, ts timestamp"
    parts = [rest[k::3] for k in range(3)] + [late]
    path, checkpoint = f"{tmp_path}/f", f"{tmp_path}/ck"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        Q.stream_queue(stream, path, checkpoint, 60, 1, "2 hours", every=2).awaitTermination()

    assert Q.current_queue(spark, path, 2) is None
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        if k in (1, 3):  # stopped and started again from its checkpoint
            run()
    got = sorted(map(tuple, Q.current_queue(spark, path, 2).collect()))
    until = max(t for _, _, t in events) - timedelta(hours=2)
    want = Q.queue_status(spark.createDataFrame(events, schema), F.lit(until), 60, 1)
    assert got == sorted(map(tuple, want.collect()))
    assert {s for _, s, _ in got} >= {"completed", "failed", "downloading"}
    assert dict((u, s) for u, s, _ in got)["open"] == "downloading"


def test_queue_state_is_kept_by_a_join(spark, tmp_path):
    """Many URLs: no Python call per URL. Repeated claims, ends in later files, URLs that are NULL, and a claim that comes too late."""
    schema = "clean_url string, action string, ts timestamp"
    at = lambda *seconds: T0 + timedelta(seconds=sum(seconds))
    first = [(f"u{u}", "claim", at(u % 50)) for u in range(400)] + [("u1", "claim", at(1)), (None, "claim", at(0)), (None, "claim", at(500))]
    second = [(f"u{u}", "fail" if u % 3 else "complete", at(u % 50, 60 + (u % 2))) for u in range(0, 400, 4)] + [(None, "fail", at(60)), ("u4", "fail", at(20))]
    third = [("clock", "complete", at(7200)), ("u399", "claim", at(7190)), ("u399", "claim", at(7190))]
    for k, part in enumerate((first, second, third)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = f"{tmp_path}/f"
    query = Q.stream_queue(stream, path, f"{tmp_path}/ck", 60, 1, "1 hour", every=2)
    query.awaitTermination()
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"symmetricHashJoin"}
    want = Q.queue_status(spark.createDataFrame(first + second + third, schema), F.lit(at(7200) - timedelta(hours=1)), 60, 1)
    want = {r.clean_url: (r.status, r.retry_count) for r in want.collect()}
    assert {r.clean_url: (r.status, r.retry_count) for r in Q.current_queue(spark, path, 2).collect()} == want
    assert want["u1"] == ("failed", 2) and want["u399"] == ("downloading", 1) and want[None] == ("failed", 2)
    spark.createDataFrame([("late", "claim", at(0)), ("late", "fail", at(5))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part3")
    Q.stream_queue(stream, path, f"{tmp_path}/ck", 60, 1, "1 hour", every=2).awaitTermination()
    assert {r.clean_url: (r.status, r.retry_count) for r in Q.current_queue(spark, path, 2).collect()} == want | {"late": ("pending", 1)}


# --- tables of several files ----------------------------------------------------------------


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    sf = f"{tmp_path}/sf"
    schema = "page_id bigint, url string, html string"
    page = [(i, f"https://example.com/d/{i}", f'<a href="/x/{i}">a</a><a href="/x/{i + 1}#t">b</a><a href="/login">c</a>') for i in range(20)]
    spark.createDataFrame(page, schema).repartition(3).write.parquet(f"{sf}/pages.parquet")
    got, want = stream_jobs.stream_links(spark, sf), page_jobs.html_links(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 40
