"""Repeated windows of a fixed length: how their texts travel and how decisions come home.

A window is ``size`` consecutive units (bytes or words) of one document. Consecutive windows
that share their minimiser, the least hash among the grams inside, travel as one string to
the bucket of that minimiser, so equal windows always meet in one bucket. Inside a task equal
strings travel once, for the smallest document; the others are answered on the spot.
A minimiser that is too frequent for one bucket (it may lie in a passage of a third of all
documents, each with other surroundings) is routed window by window, by the hash of the whole
window. Routing never changes a result.

Documents are told apart by their integer id. A row without id is kept whole and removes
nothing; rows that share an id never remove each other's windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.exchange import BLOBS, arrow_schema, bucket_count, by_bucket, stored

#: Removed stretches: units [start, start + n) of a document; ``seen`` is the CRC of the stretch,
#: by which a decision finds the right text where rows share an id.
CUTS = "doc_id long, start long, n long, seen long"
HOT_KEYS = 1000


@dataclass
class Units:
    """The units of the rows of one slice: ``text[begin(i):end(j)]`` holds units i..j."""

    text: bytes
    begin: Callable
    end: Callable
    first: np.ndarray
    grams: np.ndarray


#: Low bits of a packed minimum that hold its place.
_PLACE = np.uint64((1 << 12) - 1)
#: Stands for the place of a run in which the minimiser moves.
MANY = (1 << 16) - 1


def _runs(u: Units, size: int, gram: int):
    """(first window, last window, row, key, place) of each run of windows with one minimiser.

    The place is where the minimiser lies, counted from the first window; ``MANY`` if it lies elsewhere
    in a later window. Of equal grams inside a window the leftmost counts, so the place
    depends on the window alone.
    """
    rows = np.repeat(np.arange(len(u.first) - 1, dtype=np.int32), np.diff(u.first))
    n = len(rows) - size + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    packed = (u.grams & ~_PLACE) | (np.arange(len(u.grams), dtype=np.uint64) & _PLACE)
    width = size - gram + 1
    least = A.sliding_min(packed, width)[:n]
    # Where the packed places start anew inside a window, the leftmost is looked up.
    wraps = np.arange(0, len(u.grams), int(_PLACE) + 1)[1:]
    across = (wraps[:, None] - np.arange(1, width)).ravel()
    across = across[(across >= 0) & (across < n)]
    if len(across):
        first = across + np.argmin((u.grams >> np.uint64(12))[across[:, None] + np.arange(width)], 1)
        least[across] = packed[first]
    key = least >> np.uint64(12)
    row = rows[:n]
    valid = row == rows[size - 1 :]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    last = np.ones(n, bool)
    last[:-1] = new[1:] | ~valid[1:]
    a, b = np.flatnonzero(valid & new), np.flatnonzero(valid & last)
    place = ((least[a] & _PLACE).astype(np.int64) - a) & int(_PLACE)
    moves = np.cumsum(np.append(False, least[1:] != least[:-1]))
    place[moves[b] != moves[a]] = MANY
    return a, b, row[a].astype(np.int64), key[a], place


def _single(u: Units, size: int, gram: int, a, b, row, hot):
    """The same windows, one by one, with the hash of the whole window as key."""
    count = (b - a + 1)[hot]
    at = np.repeat(a[hot], count) + A.ranges(count)
    key = np.zeros(len(at), np.uint64)
    for k, step in enumerate(dict.fromkeys([*range(0, size - gram, gram), size - gram])):
        key = A.mix(key + u.grams[at + step] * A.PLACES[k])
    return at, at, np.repeat(row[hot], count), key, np.zeros(len(at), np.int64)


def hot_minimisers(docs: DataFrame, units: Callable, size: int, gram: int, limit: int) -> np.ndarray:
    """Minimisers with more than 1/(16 x buckets) of all runs, the most frequent first.

    A count over all documents; it only decides which way a string travels.
    """

    def count(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text", limit):
            a, b, row, key, _ = _runs(units(part), size, gram)
            if not len(a):
                continue
            values, n = np.unique(key, return_counts=True)
            often = n >= 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(values[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(a)))],
                schema=schema,
            )

    ddl = "key long, n long, total long"
    schema = arrow_schema(ddl)
    counted = docs.select("doc_id", "text").mapInArrow(count, ddl)
    top = counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy(F.desc("total"), F.desc("n"), "key").limit(HOT_KEYS + 1).collect()
    whole = sum(r["total"] for r in top)
    share = 16 * bucket_count(docs.sparkSession)
    return np.sort(np.array([r["key"] for r in top if r["n"] * share > whole and r["n"] >= 1000], np.int64).view(np.uint64))


def ship(docs: DataFrame, units: Callable, size: int, gram: int, limit: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """The runs of all documents as blobs by bucket."""

    def blobs(ids, u: Units) -> tuple[list[int], list[bytes]]:
        a, b, row, key, place = _runs(u, size, gram)
        if len(hot) and len(a):
            often = np.isin(key, hot)
            if often.any():
                one = _single(u, size, gram, a, b, row, often)
                a, b, row, key, place = (np.concatenate([x[~often], y]) for x, y in zip((a, b, row, key, place), one))
        # Rows are in the order of their ids, so the first of equal strings is the smallest document's.
        order = np.argsort(a, kind="stable")
        a, b, row, key, place = (x[order] for x in (a, b, row, key, place))
        doc, pos = ids[row], a - u.first[row]
        left, right = u.begin(a), u.end(b + size - 1)
        repeats = _later(u.text, left, right, doc, A.mix(u.grams[a] + u.grams[b + size - gram] * A.PLACES[1] + (b - a).astype(np.uint64)))
        out: tuple[list, list] = ([], [])
        ship = np.flatnonzero(~repeats)
        home = (key[ship] % np.uint64(buckets)).astype(np.int64)
        text = u.text
        for b0, at in _grouped(home, ship):
            body = b"".join([text[s:e] for s, e in zip(left[at].tolist(), right[at].tolist())])
            out[0].append(b0)
            out[1].append(A.pack(np.diff(doc[at], prepend=0), pos[at], (right - left)[at].astype(np.uint32), key[at].astype(np.uint32), place[at].astype(np.uint16), body))
        # What is answered here: neighbouring runs of a row become one stretch.
        joins = repeats[1:] & repeats[:-1] & (row[1:] == row[:-1]) & (a[1:] == b[:-1] + 1)
        begins = np.flatnonzero(repeats & ~np.append(False, joins))
        ends = np.flatnonzero(repeats & ~np.append(joins, False))
        for b0, k in _grouped(doc[begins] % buckets, np.arange(len(begins))):
            seen = np.array([zlib.crc32(text[s:e]) for s, e in zip(left[begins[k]].tolist(), right[ends[k]].tolist())], np.int64)
            out[0].append(b0)
            out[1].append(A.pack(doc[begins[k]], pos[begins[k]], b[ends[k]] - a[begins[k]] + size, seen))
        return out

    def task(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text", limit):
            part = A.sorted_by_id(part, "doc_id")
            if part.num_rows:
                bucket, blob = blobs(part.column("doc_id").to_numpy(), units(part))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], schema=schema)

    schema = arrow_schema(BLOBS)
    return docs.select("doc_id", "text").mapInArrow(task, BLOBS)


def _later(text: bytes, left: np.ndarray, right: np.ndarray, doc: np.ndarray, quick: np.ndarray) -> np.ndarray:
    """Flags of strings that a smaller document has as well. ``quick`` is equal for equal strings; documents ascend."""
    out = np.zeros(len(quick), bool)
    order = np.argsort(quick, kind="stable")
    same = quick[order][1:] == quick[order][:-1]
    maybe = np.sort(order[np.append(same, False) | np.append(False, same)])
    known: dict[bytes, int] = {}
    for i, s, e, d in zip(maybe.tolist(), left[maybe].tolist(), right[maybe].tolist(), doc[maybe].tolist()):
        out[i] = known.setdefault(text[s:e], d) < d
    return out


def _grouped(home: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
    for s, e in zip(cuts, [*cuts[1:], len(order)]):
        yield int(home[order[s]]), items[order[s:e]]


def _shared(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of the values that more than one document has."""
    order = np.argsort(value, kind="stable")
    start = np.flatnonzero(np.diff(value[order].view(np.int64), prepend=~value[order][:1].view(np.int64)))
    low, high = np.minimum.reduceat(doc[order], start), np.maximum.reduceat(doc[order], start)
    out = np.zeros(len(value), bool)
    out[order] = np.repeat(low != high, np.diff(np.append(start, len(order))))
    return out


def judge(blobs: list[bytes], covered: Callable, count: Callable, size: int, contexts: Callable | None = None):
    """The cuts of one bucket. ``covered(data, off, docs)`` flags windows that a smaller document has.

    It gets the strings and their documents, and returns (windows flagged by unit, begin and end
    of a unit range in bytes, first unit of each string). ``contexts(data, off, key, place)`` gives (hashes, string of each);
    a string that shares none of them with another document holds no repeated window. ``count(data, off)``
    is the number of units of each string.
    """
    told, parts = [], []
    for blob in blobs:
        x = A.unpack(blob)
        (parts if len(x) == 6 else told).append(x)
    cuts = [[np.concatenate([x[k] for x in told])] for k in range(4)] if told else [[], [], [], []]
    if parts:
        docs = np.concatenate([np.cumsum(x[0]) for x in parts])
        pos, length, key, place = (np.concatenate([x[k] for x in parts]).astype(np.int64) for k in (1, 2, 3, 4))
        text = b"".join([x[5] for x in parts])
        data, off = np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(length)])
        # A minimiser, or its surroundings, that only one document has cannot repeat across documents.
        keep = _shared(key.view(np.uint64), docs)
        if contexts and keep.any():
            near = np.zeros(len(keep), bool)
            for value, owner in contexts(data, off, key, place):
                value, owner = value[keep[owner]], owner[keep[owner]]
                if len(owner):
                    near[owner[_shared(value, docs[owner])]] = True
            keep = near
        keep = np.flatnonzero(keep)
        keep = keep[np.argsort(docs[keep], kind="stable")]
        # Strings that a smaller document has as a whole need no sorting.
        known: dict[bytes, int] = {}
        whole = np.array([known.setdefault(text[s:e], d) < d for s, e, d in zip(off[keep].tolist(), off[keep + 1].tolist(), docs[keep].tolist())], bool)
        equal, keep = keep[whole], keep[~whole]
        if len(equal):
            cuts[0].append(docs[equal])
            cuts[1].append(pos[equal])
            cuts[2].append(count(data, off)[equal])
            cuts[3].append(np.array([zlib.crc32(text[s:e]) for s, e in zip(off[equal].tolist(), off[equal + 1].tolist())], np.int64))
        if len(keep):
            data = data[np.repeat(off[keep], length[keep]) + A.ranges(length[keep])]
            docs, pos = docs[keep], pos[keep]
            off = np.concatenate([[0], np.cumsum(length[keep])])
            flags, begin, end, first = covered(data, off, docs)
            s, e = A.runs(flags)
            owner = np.searchsorted(first, s, "right") - 1
            raw = data.tobytes()
            cuts[0].append(docs[owner])
            cuts[1].append(pos[owner] + s - first[owner])
            cuts[2].append(e - s + size - 1)
            cuts[3].append(np.array([zlib.crc32(raw[x:y]) for x, y in zip(begin(s).tolist(), end(e + size - 2).tolist())], np.int64))
    schema = arrow_schema(CUTS)
    if any(len(x) for x in cuts[0]):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in cuts], schema=schema)


def least_documents(group: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For sorted groups: the least document of each item's group."""
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.empty(0, np.int64)
    if not len(start):
        return docs
    return np.repeat(np.minimum.reduceat(docs, start), np.diff(np.append(start, len(group))))


def cuts_of(docs: DataFrame, units: Callable, covered: Callable, count: Callable, size: int, gram: int, limit: int, contexts: Callable | None = None) -> DataFrame:
    """All removed stretches of all documents, as a table in the shared folder."""
    buckets = bucket_count(docs.sparkSession)
    hot = hot_minimisers(docs, units, size, gram, limit)
    return stored(by_bucket(ship(docs, units, size, gram, limit, hot, buckets), lambda blobs: judge(blobs, covered, count, size, contexts), CUTS))


def with_cuts(docs: DataFrame, cuts: DataFrame, apply: Callable, added: str) -> DataFrame:
    """Each row with the columns that ``apply(text bytes, cuts)`` gives; cuts as (start, n, seen) rows."""
    gathered = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "seen")).alias("_cuts"))
    both = docs.select("doc_id", "text").join(gathered, "doc_id", "left")
    schema = arrow_schema(f"doc_id long, {added}")

    def task(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text"):
            texts = part.column("text").to_pylist()
            listed = part.column("_cuts").to_pylist()
            rows = [apply((t or "").encode(), [(c["start"], c["n"], c["seen"]) for c in cs or ()]) for t, cs in zip(texts, listed)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(v, f.type) for v, f in zip(zip(*rows), list(schema)[1:]))], schema=schema
            )

    return both.mapInArrow(task, schema_ddl(added))


def schema_ddl(added: str) -> str:
    return f"doc_id long, {added}"


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under fixed names: other columns, whatever they are called, stay out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
