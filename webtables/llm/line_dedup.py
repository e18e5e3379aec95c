"""Line dedup by an exact set-similarity join of lines.

A line is its set of distinct words (A-Z lower-cased). All lines with a word take part. Words are ordered
by rarity, counted over all documents in a fixed number of hashed cells; any order is exact,
a rare-first one is fast. A line of n words is listed under the n - ceil(0.8 n) + 1 first words of
its set; two lines of Jaccard 0.8 or more share one of them. Within a word's list, pairs pass the
length, position and parity-sketch bounds, none of which excludes a true pair, and are then
verified on their whole sets. A line goes if an earlier one (smaller document id, or above it in the
same document) is similar; lines are judged on the input.

Lines with the same set collapse to the earliest before anything is paired, in each task and again
in each bucket; only the earliest can decide for others. A later line is first verified against its
nearest earlier candidate per word; only lines that this does not decide meet all other
candidates of their lists.

Lines end at \\n. Null and empty texts have no lines; lines without words stay. Rows without
id stay whole; rows that share an id are one document, and a line then goes from each of them
that has that line at that place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.exchange import BLOBS, arrow_schema, bucket_count, by_bucket, stored
from webtables.llm.windows import _grouped, plain

CELLS = 1 << 18
CHUNKS = 16
PAIRS = 1 << 19
#: Words of 64 bits in a line's parity sketch.
WIDTH = 2
#: Bits of the filter of lines whose sets are wanted; it lets a few others through.
MARKS = 1 << 26
FOUND = "kind int, doc long, line long, other_doc long, other_line long, far long, blob binary"
_BREAK = np.arange(256) == 0x0A


def _lines(data: np.ndarray, off: np.ndarray):
    """(word hashes, line of each word, row of each line, number of each line in its row)."""
    data = A.LOWER[data]
    s, e, _ = A.words(data, off)
    h = A.hash_spans(data, s, e)
    # A line starts at each row's start and after each break, which may be the row's last byte.
    breaks = np.flatnonzero(_BREAK[data])
    starts = np.concatenate([off[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off[1:], breaks, "right")])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    at = np.searchsorted(starts, s, "right") - 1
    number = np.arange(len(starts)) - np.searchsorted(row, row)
    return h, at, row, number


def rarity(docs: DataFrame) -> np.ndarray:
    """Level of rarity by hashed cell, 0 to 255: a logarithm of how many words of all documents fall there."""
    ddl = "chunk int, cells binary"
    schema = arrow_schema(ddl)
    size = CELLS // CHUNKS

    def task(batches: Iterator) -> Iterator:
        total = np.zeros(CELLS, np.int64)
        for part in A.slices(batches, "text"):
            data, off = A.text_bytes(part.column("text"))
            data = A.LOWER[data]
            s, e, _ = A.words(data, off)
            total += np.bincount((A.hash_spans(data, s, e) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        if total.any():
            parts = [A.pack(total[k * size : (k + 1) * size]) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for blob in table.column("cells").to_pylist():
            total += A.unpack(blob)[0]
        return pa.table([table.column("chunk")[:1], pa.array([A.pack(total)], pa.binary())], schema=schema)

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(task, ddl).groupBy("chunk").applyInArrow(add, ddl).collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = A.unpack(r["cells"])[0]
    return np.minimum(8 * np.log2(out + 1), 255).astype(np.uint64)


def _sets(h: np.ndarray, line: np.ndarray, level: np.ndarray):
    """Distinct words of each line, rare ones first: (hashes, line of each)."""
    level = level[(h % np.uint64(CELLS)).astype(np.int64)]
    if len(line) and line.max() >= 1 << 20:  # more lines than the packed key holds
        order = np.lexsort((h, level, line))
    else:
        order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (level << np.uint64(36)) | (h >> np.uint64(28)))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[new], line[new]


def _first_pass(docs: DataFrame, percent: int) -> DataFrame:
    """kind 0: lines that go; 1: candidate pairs (later, earlier); 2: lists for the second look."""
    buckets = bucket_count(docs.sparkSession)
    level_sent = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def ship(batches: Iterator) -> Iterator:
        level = level_sent.value
        for part in A.slices(batches, "text"):
            part = A.sorted_by_id(part, "doc_id")
            if not part.num_rows:
                continue
            ids = part.column("doc_id").to_numpy()
            h, at, row, number = _lines(*A.text_bytes(part.column("text")))
            if not len(h):
                continue
            h, at = _sets(h, at, level)
            start = np.flatnonzero(np.diff(at, prepend=-1))
            line = at[start]
            n = np.diff(np.append(start, len(at)))
            digest = np.add.reduceat(A.mix(h + np.uint64(1)), start)
            spread = A.mix(h)
            bit, part_of = np.uint64(1) << (spread & np.uint64(63)), (spread >> np.uint64(6)) % np.uint64(WIDTH)
            sketch = np.stack([np.bitwise_xor.reduceat(np.where(part_of == np.uint64(k), bit, np.uint64(0)), start) for k in range(WIDTH)], 1)
            doc, number = ids[row[line]], number[line]
            _, lead = np.unique(digest, return_index=True)  # lines are in the order of (doc, line)
            chosen = np.zeros(len(line), bool)
            chosen[lead] = True
            bucket, blob = [], []
            told = np.flatnonzero(~chosen)
            for b, k in _grouped(doc[told] % buckets, told):
                bucket.append(b)
                blob.append(A.pack(doc[k], number[k]))
            prefix = np.where(chosen, n - (percent * n + 99) // 100 + 1, 0)
            owner = np.repeat(np.arange(len(line)), prefix)
            place = A.ranges(prefix)
            token = h[start[owner] + place]
            home = (token >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
            order = np.argsort(home, kind="stable")
            for b, k in _grouped(home[order].astype(np.int64), order):
                o = owner[k]
                bucket.append(b)
                blob.append(A.pack(token[k] & np.uint64((1 << 48) - 1), np.diff(doc[o], prepend=0), number[o].astype(np.uint32), n[o].astype(np.uint32), place[k].astype(np.uint16 if n.max() < 65536 else np.uint32), digest[o], *sketch[o].T))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], schema=blobs)

    def pairs(held: list[bytes]) -> Iterator:
        listed, told = [], []
        for raw in held:
            x = A.unpack(raw)
            if len(x) == 2:
                told.append(x)
            else:
                x[1] = np.cumsum(x[1])
                listed.append(x)
        if told:
            yield _found(0, np.concatenate([x[0] for x in told]), np.concatenate([x[1] for x in told]))
        if not listed:
            return
        token, doc, line, n, place, digest = (np.concatenate([x[k] for x in listed]) for k in range(6))
        sketch = np.stack([np.concatenate([x[6 + k] for x in listed]) for k in range(WIDTH)], 1)
        doc, line, n, place = (x.astype(np.int64) for x in (doc, line, n, place))
        order = np.argsort(token, kind="stable")
        cut = np.ones(len(order), bool)
        cut[1:] = token[order][1:] != token[order][:-1]
        group = np.cumsum(cut) - 1
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        if not len(order):
            return
        again = np.lexsort((line[order], doc[order], digest[order], group))
        order, group = order[again], group[again]
        same = np.zeros(len(order), bool)
        same[1:] = (group[1:] == group[:-1]) & (digest[order][1:] == digest[order][:-1])
        gone = order[same & (place[order] == 0)]
        if len(gone):
            yield _found(0, doc[gone], line[gone])
        order, group = order[~same], group[~same]
        doc, line, n, place, sketch = (x[order] for x in (doc, line, n, place, sketch))
        yield from _candidates(group, doc, line, n, place, sketch, percent, None)

    blobs = arrow_schema(BLOBS)
    return stored(by_bucket(docs.mapInArrow(ship, BLOBS), pairs, FOUND))


def _found(kind: int, doc, line, other_doc=None, other_line=None, far=None, blobs=None) -> pa.RecordBatch:
    count = len(doc)
    none = pa.nulls(count, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(count, kind, np.int32)),
            pa.array(doc),
            pa.array(line),
            none if other_doc is None else pa.array(other_doc),
            none if other_line is None else pa.array(other_line),
            none if far is None else pa.array(far),
            pa.nulls(count, pa.binary()) if blobs is None else pa.array(blobs, pa.binary()),
        ],
        schema=arrow_schema(FOUND),
    )


def _candidates(group, doc, line, n, place, sketch, percent: int, asked) -> Iterator[pa.RecordBatch]:
    """Pairs within groups that pass all bounds.

    Without ``asked``: per group and later line the nearest earlier one (kind 1), and the groups in
    which a line had further ones (kind 2). With ``asked`` (flags): all pairs whose later line is asked for.
    """
    order = np.lexsort((line, doc, n, group))
    group, doc, line, n, place, sketch = (x[order] for x in (group, doc, line, n, place, sketch))
    asked = None if asked is None else asked[order]
    width = int(n.max(initial=1)) + 1
    key = group.astype(np.int64) * width + n
    low = np.searchsorted(key, group.astype(np.int64) * width + (percent * n + 99) // 100)
    count = np.arange(len(key)) - low
    stop = np.cumsum(count)
    more, had = np.zeros(len(key), bool), np.zeros(len(key), bool)
    at = 0
    while at < len(key):
        end = max(int(np.searchsorted(stop, (stop[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        i = np.repeat(np.arange(at, end), count[at:end])
        k = np.repeat(low[at:end], count[at:end]) + A.ranges(count[at:end])
        at = end
        both = n[i] + n[k]
        far = np.bitwise_count(sketch[i] ^ sketch[k]).sum(1, dtype=np.int64)
        ok = far * (100 + percent) <= both * (100 - percent)
        i, k, both, far = i[ok], k[ok], both[ok], far[ok]
        need = -(-percent * both // (100 + percent))
        reach = np.minimum(place[i], place[k]) + 1 + np.minimum(n[i] - place[i], n[k] - place[k]) - 1
        ok = reach >= need
        i, k, far = i[ok], k[ok], far[ok]
        later = (doc[i] > doc[k]) | ((doc[i] == doc[k]) & (line[i] > line[k]))
        i, k = np.where(later, i, k), np.where(later, k, i)
        if asked is not None:
            far, i, k = far[asked[i]], i[asked[i]], k[asked[i]]
        elif len(i):
            had[i] = True
            best = np.lexsort((k, far, i))
            i, k = i[best], k[best]
            first = np.ones(len(i), bool)
            first[1:] = i[1:] != i[:-1]
            more[i[~first]] = True
            i, k, far = i[first], k[first], far[best][first]
        if len(i):
            yield _found(1, doc[i], line[i], doc[k], line[k], far)
    if asked is None and len(key):
        # A line may have had candidates in two blocks of pairs; such groups are kept as well.
        open_ = np.unique(group[more | (count > PAIRS)])
        if len(open_):
            rows = [slice(x, y) for x, y in zip(np.searchsorted(group, open_), np.searchsorted(group, open_, "right"))]
            blob = [A.pack(doc[r], line[r], had[r].astype(np.uint8), n[r], place[r], *sketch[r].T) for r in rows]
            yield _found(2, np.zeros(len(blob), np.int64), np.zeros(len(blob), np.int64), blobs=blob)


def _mark(bits: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, value) of each line's bit in the filter; line -1 stands for the document."""
    at = A.mix(A.mix(doc.astype(np.uint64)) + line.astype(np.uint64)) % np.uint64(8 * len(bits))
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def _marked(bits: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    at, value = _mark(bits, doc, line)
    return bits[at] & value > 0


def _marks(lines: DataFrame) -> np.ndarray:
    """The filter of the lines (doc, line) and their documents, eight bits a byte: its size does not depend on their number."""
    ddl = "chunk int, bits binary"
    schema = arrow_schema(ddl)
    whole = MARKS // 8
    size = whole // CHUNKS

    def task(batches: Iterator) -> Iterator:
        total = np.zeros(whole, np.uint8)
        for batch in batches:
            doc, line = batch.column("doc").to_numpy(), batch.column("line").to_numpy()
            for number in (line, np.full(len(doc), -1)):
                np.bitwise_or.at(total, *_mark(total, doc, number))
        if total.any():
            parts = [A.pack(total[k * size : (k + 1) * size]) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def both(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint8)
        for blob in table.column("bits").to_pylist():
            total |= A.unpack(blob)[0]
        return pa.table([table.column("chunk")[:1], pa.array([A.pack(total)], pa.binary())], schema=schema)

    out = np.zeros(whole, np.uint8)
    for r in lines.mapInArrow(task, ddl).groupBy("chunk").applyInArrow(both, ddl).collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = A.unpack(r["bits"])[0]
    return out


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of the pairs' later lines that are similar to the earlier one.

    Texts stay where they are: a filter of fixed size goes to them, and the sets of the lines that pass it
    come back; those that passed by chance find no pair.
    """

    def sets(batches: Iterator) -> Iterator:
        bits = sent.value
        for part in A.slices(batches, "text"):
            part = part.filter(pc.is_valid(part.column("doc_id")))
            part = part.filter(pa.array(_marked(bits, part.column("doc_id").to_numpy(), np.full(part.num_rows, -1))))
            h, at, row, number = _lines(*A.text_bytes(part.column("text")))
            doc = part.column("doc_id").to_numpy()[row]
            hit = np.flatnonzero(_marked(bits, doc, number))
            items = [np.unique(h[s:e]).tobytes() for s, e in zip(np.searchsorted(at, hit).tolist(), np.searchsorted(at, hit, "right").tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(number[hit]), pa.array(items, pa.binary())], names=["doc", "line", "items"])

    def check(batches: Iterator) -> Iterator:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = np.frombuffer(x + y, np.uint64).copy()
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("line")], names=["doc", "line"]).filter(pa.array(ok, pa.bool_()))

    pairs = pairs.select("doc", "line", "other_doc", "other_line").distinct()
    needed = pairs.select("doc", "line").unionByName(pairs.select(F.col("other_doc").alias("doc"), F.col("other_line").alias("line")))
    sent = docs.sparkSession.sparkContext.broadcast(_marks(needed))
    items = stored(docs.mapInArrow(sets, "doc long, line long, items binary"))
    x = items.withColumnRenamed("items", "x")
    y = items.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("items").alias("y"))
    both = pairs.join(x, ["doc", "line"]).join(y, ["other_doc", "other_line"])
    return both.select("doc", "line", "x", "y").mapInArrow(check, "doc long, line long").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, line) of the lines that an earlier line makes superfluous; lines count from 0."""
    docs = plain(docs, id_col, text_col)
    first = _first_pass(docs, percent)
    # Every word's list has named its nearest candidate; the nearest of these is tried first.
    near = first.where("kind = 1").select("doc", "line", "far", "other_doc", "other_line")
    best = near.groupBy("doc", "line").agg(F.min(F.struct("far", "other_doc", "other_line")).alias("b"))
    best = stored(best.select("doc", "line", "b.other_doc", "b.other_line"))
    gone = stored(first.where("kind = 0").select("doc", "line").unionByName(_verified(best, docs, percent)).distinct())
    # Lines that had a candidate and are still there meet all other candidates.
    waiting = stored(best.select("doc", "line").join(gone, ["doc", "line"], "left_anti"))
    lists = first.where("kind = 2").select(F.xxhash64("blob").alias("grp"), "blob")

    def members(batches: Iterator) -> Iterator:
        for batch in batches:
            # Only lines that had a candidate in the list can be waiting for another one.
            lists_ = [[v[x[2] == 1] for v in x[:2]] for x in (A.unpack(b) for b in batch.column("blob").to_pylist())]
            grp = np.repeat(batch.column("grp").to_numpy(), [len(x[0]) for x in lists_])
            yield pa.RecordBatch.from_arrays([pa.array(grp), *(pa.array(np.concatenate([x[k] for x in lists_])) for k in (0, 1))], names=["grp", "doc", "line"])

    def rest(batches: Iterator) -> Iterator:
        for batch in batches:
            for blob, docs_, lines in zip(*(batch.column(c).to_pylist() for c in ("blob", "docs", "lines"))):
                doc, line, _, n, place, *sketch = A.unpack(blob)
                sketch = np.stack(sketch, 1)
                wanted = set(zip(docs_, lines))
                asked = np.array([x in wanted for x in zip(doc.tolist(), line.tolist())])
                yield from _candidates(np.zeros(len(doc), np.int64), doc, line, n, place, sketch, percent, asked)

    if not waiting.isEmpty():
        asked = lists.mapInArrow(members, "grp long, doc long, line long").join(waiting, ["doc", "line"], "left_semi")
        asked = asked.groupBy("grp").agg(F.collect_list("doc").alias("docs"), F.collect_list("line").alias("lines"))
        rest_ = lists.join(asked, "grp").select("blob", "docs", "lines").mapInArrow(rest, FOUND)
        pair = ["doc", "line", "other_doc", "other_line"]
        late = near.join(waiting, ["doc", "line"], "left_semi").select(*pair).unionByName(rest_.select(*pair)).distinct()
        late = stored(late.join(best, pair, "left_anti"))
        if not late.isEmpty():
            gone = stored(gone.unionByName(_verified(late, docs, percent)).distinct())
    return gone.select(F.col("doc").alias("doc_id"), "line")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with repeated lines cut from their text, and a column n_lines_removed.

    All other columns stay as they are; an ``n_lines_removed`` of the input is replaced.
    """
    gone = repeated_lines(docs, id_col, text_col, percent).groupBy("doc_id").agg(F.collect_list("line").alias("_gone"))
    kept = [c for c in docs.columns if c != "n_lines_removed"]
    own = docs.select(*[F.col(f"`{c}`") for c in kept])
    id_ = F.col(f"`{id_col}`")
    both = own.join(gone.withColumnRenamed("doc_id", "_id"), id_.cast("long") == F.col("_id"), "left").drop("_id")
    shape = own.withColumn("n_lines_removed", F.lit(0).cast("long"))

    def task(batches: Iterator) -> Iterator:
        for part in A.slices(batches, text_col):
            texts, counts = [], []
            for text, lines in zip(part.column(text_col).to_pylist(), part.column("_gone").to_pylist()):
                if lines and text:
                    drop, whole = set(lines), text.split("\n")
                    left = [x for k, x in enumerate(whole) if k not in drop]
                    texts.append("\n".join(left))
                    counts.append(len(whole) - len(left))
                else:
                    texts.append(text)
                    counts.append(0)
            columns = [pa.array(texts, part.schema.field(c).type) if c == text_col else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*kept, "n_lines_removed"])

    return both.mapInArrow(task, shape.schema)
