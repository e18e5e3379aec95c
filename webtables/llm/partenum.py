"""N-gram Jaccard join by PartEnum signatures.

A document is its set of distinct 5-word shingles, as hashes. Sizes fall into bands
[l, l/0.8]; sets that may link lie in one band or in neighbouring ones, so a set signs for
its own band and the next. Within a band two linked sets differ in at most k elements. The
domain is cut into more than k parts, so some part holds the same elements of both: each
part's elements, hashed together, are one signature. Empty parts give none. A set with so
many empty parts that the argument fails signs, in addition, with the elements of its prefix
(n - ceil(0.8 n) + 1 smallest), which any two linked sets of that kind share; no link is lost.

Signatures travel packed by bucket. Per signature, members are compared with the smallest one
only; what then lies in different components is compared within its group, after size and
parity-sketch bounds that never exclude a link. Links are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.components import components
from webtables.llm.exchange import BLOBS, arrow_schema, bucket_count, by_bucket, stored
from webtables.llm.windows import _grouped, plain

SHINGLE = 5
LEAST_BITS = 512
FIRST = "kind int, doc_id long, n long, d1 long, d2 long, sketch binary, blob binary"


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each row in ascending order."""
    data = A.LOWER[data]
    s, e, first = A.words(data, off)
    h = A.hash_spans(data, s, e)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    left = np.repeat(count, count) - place
    value = np.zeros(len(h), np.uint64)
    for k in range(size):
        fits = left > k
        value[fits] += A.mix(h[np.flatnonzero(fits) + k] + np.uint64(k)) * A.PLACES[k]
    whole = (left >= size) | (place == 0)
    row, value = row[whole], A.mix(value[whole])
    bits = max(1, int(len(count) - 1).bit_length())
    key = np.unique((row.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(10)) & np.uint64((1 << (64 - bits)) - 1))
    return key & np.uint64((1 << 54) - 1), np.searchsorted(key >> np.uint64(64 - bits), np.arange(len(off)))


class Bands:
    """Size bands for a similarity of ``percent``/100, with their number of parts."""

    def __init__(self, percent: int, largest: int):
        low, top = [1], []
        while low[-1] <= max(largest, 1) or len(top) < 2:
            top.append(low[-1] * 100 // percent)
            low.append(top[-1] + 1)
        top.append(low[-1] * 100 // percent)
        self.low, self.top = np.array(low), np.array(top)
        self.k = 2 * self.top * (100 - percent) // (100 + percent)
        self.parts = np.where(self.k == 0, 1, self.k + 3 + self.k // 10)


def signatures(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets."""
    n = np.diff(first)
    bands = Bands(percent, int(n.max(initial=1)))
    own = np.searchsorted(bands.low, n, "right") - 1
    row = np.repeat(np.arange(len(n)), n)
    spread = A.mix(h)
    out: list = [[], []]
    for step in (0, 1):
        band = own + step
        parts = np.where(n > 0, bands.parts[band], 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        mixed = A.mix(spread + A.PLACES[band % 64][row])
        slot = base[row] + ((mixed >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(base[-1]), np.uint64)
        np.add.at(total, slot, A.mix(mixed))
        filled = np.bincount(slot, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(n)), parts)
        label = (band[owner].astype(np.uint64) << np.uint64(32)) + (np.arange(len(total)) - base[owner]).astype(np.uint64)
        out[0].append(A.mix(total ^ A.mix(label))[filled])
        out[1].append(owner[filled])
        empty = parts - np.bincount(owner[filled], minlength=len(n))
        unsure = (n > 0) & (parts - empty <= bands.k[band])
        prefix = n - (percent * n + 99) // 100 + 1
        at = unsure[row] & (np.arange(len(h)) - first[row] < prefix[row])
        out[0].append(A.mix(spread[at] ^ A.mix((band[row[at]].astype(np.uint64) << np.uint64(32)) + np.uint64(0xFFFFFFFF))))
        out[1].append(row[at])
    return np.concatenate(out[0]), np.concatenate(out[1])


def _sketches(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: bit i is set if an odd number of its hashes fall on i.

    A sketch has at least two bits per shingle (a power of two, LEAST_BITS or more), so sets that
    differ much have sketches that differ much, however large they are.
    """
    n = np.diff(first)
    bits = np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + (A.mix(h + np.uint64(1)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[s // 8 : e // 8] for s, e in zip(base[:-1].tolist(), base[1:].tolist())]


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _folded(m: np.ndarray, width: int) -> np.ndarray:
    """The same sketches with fewer bits."""
    while m.shape[1] > width:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def _first_pass(docs: DataFrame, percent: int) -> DataFrame:
    """One row per document (kind 0) and the groups of documents that share a signature (pairs 1, larger 2)."""
    buckets = bucket_count(docs.sparkSession)

    def ship(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text"):
            part = A.sorted_by_id(part, "doc_id")
            if not part.num_rows:
                continue
            ids = part.column("doc_id").to_numpy()
            h, first = shingle_sets(*A.text_bytes(part.column("text")))
            n = np.diff(first)
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            np.add.at(d1, row, A.mix(h ^ np.uint64(0x5DEECE66D)))
            np.add.at(d2, row, A.mix(h * A.PLACES[7] + np.uint64(3)))
            sketch = _sketches(h, first)
            bucket, blob = [], []
            for b, at in _grouped(ids % buckets, np.arange(len(ids))):
                bucket.append(b)
                blob.append(A.pack(ids[at], n[at], d1[at], d2[at], np.array([len(sketch[i]) for i in at]), b"".join([sketch[i] for i in at])))
            _, lead = np.unique(np.stack([d1, d2], 1), axis=0, return_index=True)
            chosen = np.zeros(len(n), bool)
            chosen[lead] = True
            sig, owner = signatures(h, first, percent)
            use = chosen[owner]
            sig, owner = sig[use], owner[use]
            home = (sig >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)
            order = np.argsort(sig)
            for b, at in _grouped(home[order].astype(np.int64), order):
                low = sig[at] & np.uint64((1 << 48) - 1)
                bucket.append(b)
                blob.append(A.pack((low >> np.uint64(32)).astype(np.uint16), low.astype(np.uint32), owner[at].astype(np.uint16), np.diff(ids, prepend=0)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], schema=blobs)

    def groups(held: list[bytes]) -> Iterator:
        sig, doc = [], []
        for raw in held:
            x = A.unpack(raw)
            if len(x) == 6:
                n = len(x[0])
                cut = np.cumsum(x[4])
                sketch = [x[5][e - size : e] for e, size in zip(cut.tolist(), x[4].tolist())]
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(x[0]), pa.array(x[1]), pa.array(x[2].view(np.int64)), pa.array(x[3].view(np.int64)), pa.array(sketch, pa.binary()), none],
                    schema=out,
                )
            else:
                sig.append((x[0].astype(np.uint64) << np.uint64(32)) | x[1])
                doc.append(np.cumsum(x[3])[x[2]])
        if not sig:
            return
        sig, doc = np.concatenate(sig), np.concatenate(doc)
        order = np.argsort(sig)
        sig, doc = sig[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        two, more = start[several & (size == 2)], np.flatnonzero(several & (size > 2))
        blob, kind = [], []
        if len(two):
            kind.append(1)
            blob.append(A.pack(np.minimum(doc[two], doc[two + 1]), np.maximum(doc[two], doc[two + 1])))
        for g in more:
            kind.append(2)
            blob.append(np.unique(doc[start[g] : start[g] + size[g]]).tobytes())
        if kind:
            none = pa.nulls(len(kind), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), none, none, none, none, pa.nulls(len(kind), pa.binary()), pa.array(blob, pa.binary())], schema=out)

    blobs, out = arrow_schema(BLOBS), arrow_schema(FIRST)
    return stored(by_bucket(docs.mapInArrow(ship, BLOBS), groups, FIRST))


def _pairs(batches: Iterator) -> Iterator:
    """Members of pair blobs (two arrays) and the star of larger groups around the smallest member."""
    for batch in batches:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            if kind == 1:
                x, y = A.unpack(blob)
            else:
                y = np.frombuffer(blob, np.int64)[1:]
                x = np.full(len(y), np.frombuffer(blob, np.int64, 1)[0])
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _within_bounds(percent: int):
    """Arrow filter on (n_a, n_b, s_a, s_b): keeps every pair that may link."""
    slack = 100 - percent, 100 + percent

    def task(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            sa, sb = (batch.column(c).to_pylist() for c in ("s_a", "s_b"))
            sizes = np.array([(len(x), len(y)) for x, y in zip(sa, sb)])
            far = np.zeros(len(na), np.int64)
            for kind in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == kind).all(1))
                width = int(kind.min()) // 8
                x, y = (_folded(_matrix([s[i] for i in at]), width) for s in (sa, sb))
                far[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            ok = (far * slack[1] <= (na + nb) * slack[0]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return task


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity."""

    def sets(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text"):
            h, first = shingle_sets(*A.text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([A.pack(np.diff(h[s:e], prepend=np.uint64(0))) for s, e in zip(first[:-1], first[1:])], pa.binary())], names=["doc_id", "items"])

    def check(batches: Iterator) -> Iterator:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = np.concatenate([np.cumsum(A.unpack(x)[0]), np.cumsum(A.unpack(y)[0])])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    items = stored(docs.join(needed, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, items binary"))
    left = items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _in_group(percent: int):
    """All pairs of an open group that lie in different components and within the bounds."""

    def task(table: pa.Table) -> pa.Table:
        n, rep, comp = (table.column(c).to_numpy() for c in ("n", "rep", "component"))
        _, lead = np.unique(rep, return_index=True)
        order = lead[np.argsort(n[lead], kind="stable")]
        n, rep, comp = n[order], rep[order], comp[order]
        sketches = table.column("sketch").take(pa.array(order)).to_pylist()
        size = np.array([len(x) for x in sketches])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        # Larger sets never have smaller sketches; each block of one sketch size meets itself and the later ones.
        for kind in np.unique(size):
            own = np.flatnonzero(size == kind)
            reach = int(np.searchsorted(n, n[own[-1]] * 100 // percent, "right"))
            near = _folded_rows(sketches[own[0] : reach], int(kind) // 8)
            for k, i in enumerate(own.tolist()):
                stop = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
                rest = np.flatnonzero(comp[i + 1 : stop] != comp[i]) + i + 1
                far = np.bitwise_count(near[rest - own[0]] ^ near[k]).sum(1, dtype=np.int64)
                hit = rest[far * (100 + percent) <= (n[rest] + n[i]) * (100 - percent)]
                a.append(np.minimum(rep[hit], rep[i]))
                b.append(np.maximum(rep[hit], rep[i]))
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return task


def _folded_rows(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches in ascending size, all folded to one width."""
    size = np.array([len(x) for x in sketches])
    return np.concatenate([_folded(_matrix([sketches[i] for i in np.flatnonzero(size == kind)]), width) for kind in np.unique(size)])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its smallest reachable document).

    Null and empty texts have no shingles and link with nothing. Rows that share an id are one
    node of the graph. A row without id links with nothing and has a null component.
    """
    docs = plain(docs, id_col, text_col)
    first = _first_pass(docs, percent)
    rows = first.where("kind = 0").select("doc_id", "n", "d1", "d2", "sketch")
    # Stored on its own: the join with the many rows of one set can then be split by AQE.
    same = stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    nodes = stored(rows.join(same, ["n", "d1", "d2"], "left").select("doc_id", "n", "sketch", F.coalesce("rep", "doc_id").alias("rep")))
    large = stored(first.where("kind = 2").select("kind", "blob").dropDuplicates(["blob"]))
    pairs = first.where("kind = 1").select("kind", "blob").unionByName(large).mapInArrow(_pairs, "a long, b long")
    of = nodes.select("doc_id", "rep").distinct()

    def by_rep(pairs: DataFrame) -> DataFrame:
        a = of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"))
        b = of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
        both = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).join(a, "a").join(b, "b")
        return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()

    leads = nodes.where("doc_id = rep").select("rep", "n", "sketch").dropDuplicates(["rep", "n", "sketch"])

    def bounded(pairs: DataFrame) -> DataFrame:
        a = leads.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        b = leads.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        return stored(pairs.join(a, "a").join(b, "b").mapInArrow(_within_bounds(percent), "a long, b long"))

    repeated = of.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = stored(_verified(bounded(by_rep(pairs)), docs, percent).unionByName(repeated))
    label = stored(components(links))

    # Groups whose members now lie in several components: compare those among themselves.
    def members(batches: Iterator) -> Iterator:
        for batch in batches:
            lists = [np.frombuffer(b, np.int64) for b in batch.column("blob").to_pylist()]
            group = np.repeat(batch.column("grp").to_numpy(), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.concatenate(lists))], names=["grp", "doc_id"])

    inside = large.select(F.xxhash64("blob").alias("grp"), "blob").mapInArrow(members, "grp long, doc_id long")
    placed = inside.join(of, "doc_id").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = stored(placed.select("grp", "rep", F.coalesce("component", "rep").alias("component")).distinct())
    open_ = placed.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("grp")
    rest = placed.join(open_, "grp", "left_semi").join(leads, "rep")
    more = rest.groupBy("grp").applyInArrow(_in_group(percent), "a long, b long").distinct()
    more = stored(more)
    if not more.isEmpty():
        label = stored(components(links.unionByName(_verified(more, docs, percent))))

    counted = nodes.select("doc_id", F.col("n").alias("n_shingles"))
    known = counted.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null").mapInArrow(_sizes, "doc_id long, n_shingles long, component_id long")
    return known.unionByName(lost)


def _sizes(batches: Iterator) -> Iterator:
    for part in A.slices(batches, "text"):
        _, first = shingle_sets(*A.text_bytes(part.column("text")))
        none = pa.nulls(part.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.diff(first)), none], names=["doc_id", "n_shingles", "component_id"])
