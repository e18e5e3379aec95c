"""Best-fit packing of tokenised documents by linear grouping.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces per length
matters for the plan, so the plan is made from that table, which has at most ``capacity``
rows however large the corpus is:

1. Lengths above ``capacity / 16`` are large. Sorted downwards they are cut into groups of
   equal cardinality, and each is rounded up to the largest length of its group.
2. Configurations of the few rounded sizes are chosen one by one, always the fullest one
   that the remaining counts allow (a bounded knapsack), as often as they allow it.
3. The places of a configuration are filled with actual lengths, longest first, so that
   equal runs stay together; what rounding wasted becomes room again.
4. Small lengths go best-fit into the least room that holds them, then into new sequences.

Every length then has a table of rank ranges with their sequences and offsets. Pieces get
their rank within a length from counts per (length, salt), so no length is ranked in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.exchange import arrow_schema, bucket_count, stored
from webtables.llm.windows import plain

CAPACITY = 4096
END = 1
GROUPS = 1024
#: Distinct units whose ids a worker keeps; then it goes on with those of the text at hand.
MEMORY = 400_000
#: Bytes of text that are tokenised at once.
SLICE = 2 << 20

#: Kinds of bytes: letters, digits and all else; digits stand alone.
_KIND = np.array([1 if chr(b).isalpha() or b >= 0x80 else 2 if b in range(0x30, 0x3A) else 3 for b in range(256)], np.uint8)
#: Second bytes of the letters U+00C0 to U+00FF; two signs lie among them.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


def _odd(data: np.ndarray) -> np.ndarray:
    """The bytes that keep a word whole: they are no letter, digit or sign of ASCII or Latin-1 that always stands alone."""
    after = np.append(data[1:], 0)
    before = np.append(0, data[:-1])
    pair = ((data == 0xC3) & _LATIN[after]) | ((before == 0xC3) & _LATIN[data])
    return (data == 0x27) | ((data >= 0x80) & ~pair) | ((data == 0x3C) & (after == 0x7C))


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the stretches that the tokenizer treats one by one; ``first`` by row.

    It drops white space and splits words into runs of letters, single digits and runs of other signs. That
    split is made here for words of ASCII and Latin-1 letters; words with an apostrophe (contractions), with other
    characters (which may compose, or be of another kind) or with a special token stay whole.
    """
    s, e, _ = A.words(data, off)
    if not len(s):
        return s, e, np.zeros(len(off), np.int64)
    odd = _odd(data)
    sums = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
    plain = sums[e] == sums[s]
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s[plain]] += 1
    inside[e[plain]] -= 1
    cut &= np.cumsum(inside, dtype=np.int8).astype(bool)
    cut[s] = True
    starts = np.flatnonzero(cut[:-1])
    word = np.searchsorted(s, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), e[word])
    return starts, ends, np.searchsorted(starts, off)


class _Known:
    """Units, each with a blank after it, and their ids, as arrays: ``flat[first[k]:first[k + 1]]`` belong to unit k."""

    def __init__(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.flat = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def add(self, units: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        self.units = pa.concat_arrays([self.units, units])
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(size))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these units one after the other, number of each)."""
        size = self.first[at + 1] - self.first[at]
        return self.flat[np.repeat(self.first[at], size) + A.ranges(size)], size


_KNOWN: dict[str, _Known] = {}


class Encoder:
    """Token ids of whole texts; each distinct unit is tokenised once while a worker remembers it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _KNOWN.setdefault(path, _Known())
        #: The tokens that end a stretch of text, by id.
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.last = np.array([(x or "").endswith("</w>") for x in tokens])

    def _one_by_one(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [x.ids for x in self.tokenizer.encode_batch_fast([w[:-1].decode() for w in units], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))

    def _together(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As one text: each unit is one stretch of its own there, and ends with a token that ends a stretch."""
        text, _ = A.text_bytes(units)
        ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(units) or ends[-1] != len(ids):  # a vocabulary that does not mark ends
            return self._one_by_one(units.to_pylist())
        return ids, np.diff(ends, prepend=0)

    def _learn(self, units: pa.Array) -> np.ndarray:
        """Where the units, none of them known, are from now on."""
        data, off = A.text_bytes(units)
        odd = np.logical_or.reduceat(_odd(data), off[:-1])
        rows, coded = [np.flatnonzero(~odd), np.flatnonzero(odd)], []
        for row, way in zip(rows, (self._together, lambda x: self._one_by_one(x.to_pylist()))):
            part = units.take(pa.array(row))
            coded += [way(part.slice(at, 4096)) for at in range(0, len(part), 4096)]
        order = np.concatenate(rows)
        at = np.empty(len(order), np.int64)
        at[order] = len(self.known.units) + np.arange(len(order))
        self.known.add(units.take(pa.array(order)), *(np.concatenate(x) for x in zip(*coded)))
        return at

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ``ids[first[d]:first[d + 1]]`` belong to row d."""
        s, e, first = units(data, off)
        if not len(s):
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64)
        text, s, _ = A.joined(A.LOWER[data], s, e)
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(text)).astype(np.int64)), pa.py_buffer(text)])
        coded = values.dictionary_encode()
        distinct, known = coded.dictionary, self.known
        at = pc.fill_null(pc.index_in(distinct, known.units), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(known.units) + len(new) > MEMORY:
                old = at[at >= 0]
                at[at >= 0] = np.arange(len(old))
                kept, coded_ids = known.units.take(pa.array(old)), known.ids(old)
                known.__init__()
                known.add(kept, *coded_ids)
            at[new] = self._learn(distinct.take(pa.array(new)))
        flat, size = known.ids(at)
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        length = size[which]
        ids = flat[np.repeat(start[which], length) + A.ranges(length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[first]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents; the end token counts."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(ddl)

    def task(batches: Iterator) -> Iterator:
        encoder = Encoder(path)
        for part in A.slices(batches, "text", SLICE):
            ids, first = encoder.ids(*A.text_bytes(part.column("text")))
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, s, e in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                own = np.append(ids[s:e], np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    one = own[at : at + capacity]
                    for column, value in zip(rows, (doc, k, at, len(one), zlib.crc32(one.tobytes()), one.astype(np.int32) if with_ids else None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(task, ddl)


def _groups(lengths: list[int], counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] of large pieces, longest first, in groups of equal cardinality."""
    total = sum(counts[x] for x in lengths)
    size = max(1, -(-total // groups))
    out, room = [], 0
    for x in lengths:
        left = counts[x]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append([x, take])
            left, room = left - take, room - take
    return out


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Copies of each size in the fullest configuration; the longest size left is always in it."""
    lead = next(i for i, n in enumerate(left) if n)
    copies = [0] * len(sizes)
    copies[lead] = 1
    reach = np.full(capacity - sizes[lead] + 1, -1, np.int64)
    reach[0] = 0
    steps = []
    for i in range(lead, len(sizes)):
        most = min(left[i] - (i == lead), (len(reach) - 1) // sizes[i])
        for _ in range(most):
            fresh = np.zeros(len(reach), bool)
            fresh[sizes[i] :] = (reach[: -sizes[i]] >= 0) & (reach[sizes[i] :] < 0)
            if not fresh.any():
                break
            steps.append(i)
            reach[fresh] = len(steps)
        if reach[-1] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        i = steps[reach[at] - 1]
        copies[i] += 1
        at -= sizes[i]
    return copies


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number, first sequence, offset): rank first + i goes to sequence first + i."""
    lengths = sorted((x for x in counts if counts[x]), reverse=True)
    large = [x for x in lengths if x > capacity // 16]
    grouped = _groups(large, counts, groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(n for _, n in g) for g in grouped]
    bins: list[tuple[int, tuple[int, ...]]] = []  # (number of sequences, lengths inside)
    while any(left):
        copies = _fullest(sizes, left, capacity)
        times = min(n // c for n, c in zip(left, copies) if c)
        left = [n - times * c for n, c in zip(left, copies)]
        # Substitute actual lengths: each place takes a run of its group, longest first.
        places: list[list[list[int]]] = []
        for g, c in zip(grouped, copies):
            for _ in range(c):
                need, place = times, []
                while need:
                    take = min(need, g[0][1])
                    place.append([g[0][0], take])
                    g[0][1] -= take
                    need -= take
                    if not g[0][1]:
                        g.pop(0)
                places.append(place)
        while times:
            take = min(p[0][1] for p in places)
            bins.append((take, tuple(p[0][0] for p in places)))
            times -= take
            for p in places:
                p[0][1] -= take
                if not p[0][1]:
                    p.pop(0)
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(number: int, inside: tuple[int, ...]) -> None:
        free = capacity - sum(inside)
        if free not in room:
            room[free] = []
            insort(rooms, free)
        room[free].append((number, inside))

    for number, inside in bins:
        put(number, inside)
    for x in lengths:
        if x > capacity // 16:
            continue
        n = counts[x]
        while n:
            k = bisect_left(rooms, x)
            if k < len(rooms):
                free = rooms[k]
                number, inside = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(k)
                fit = min(free // x, max(1, n // number))
                take = min(number, n // fit)
                put(take, inside + (x,) * fit)
                if number > take:
                    put(number - take, inside)
                n -= take * fit
            else:
                fit = min(capacity // x, n)
                put(n // fit, (x,) * fit)
                n -= n // fit * fit
    rank = dict.fromkeys(lengths, 0)
    rows, sequence = [], 0
    for free in rooms:
        for number, inside in room[free]:
            offset = 0
            for x in inside:
                rows.append((x, rank[x], number, sequence, offset))
                rank[x] += number
                offset += x
            sequence += number
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    ``path`` is the tokenizer's file. Null and empty texts are one piece, the end token alone.
    Rows with a null or repeated id are packed like any other.
    """
    spark = docs.sparkSession
    salts = bucket_count(spark)
    cut = pieces(plain(docs, id_col, text_col), path, capacity, with_ids)
    cut = stored(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    per = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # Ranks before each (length, salt): lengths are few, salts are bounded.
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order) - 1).join(before.drop("n"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    keys = rows[:, 0] << 44 | rows[:, 1]

    def place(batches: Iterator) -> Iterator:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            added = [pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])]
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=names)

    own = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids array<int>, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.select(*own, "rank").mapInArrow(place, ddl)
