"""Whole batches of texts as byte and word arrays, for tasks that work on Arrow batches.

Everything here is plain vector arithmetic inside one task; Spark partitions and
shuffles the work. Texts are cut into slices of a few megabytes, never shortened.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1024

#: The white space of the contracts: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_SPAN = 1 << 16
_BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    _POWER = np.concatenate([np.ones(1, U64), np.cumprod(np.full(2 * _SPAN, _BASE, U64))])
    _INVERSE = np.concatenate([np.ones(1, U64), np.cumprod(np.full(2 * _SPAN, pow(_BASE, -1, 1 << 64), U64))])
    #: Odd multipliers for the places of a word in a shingle.
    PLACES = np.cumprod(np.full(64, 0xD1342543DE82EF95, U64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(batches, text: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = min(max(int(np.searchsorted(ends, base + limit, "right")), at + 1), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of all words; ``first[d]:first[d + 1]`` are the words of row d."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of ascending, disjoint spans."""
    out = np.empty(len(starts), U64)
    length = ends - starts
    long = np.flatnonzero(length > _SPAN)
    i, stops = 0, [*long.tolist(), len(starts)]
    for stop in stops:
        while i < stop:
            base = int(starts[i])
            j = min(max(int(np.searchsorted(ends, base + 2 * _SPAN, "right")), i + 1), stop)
            part = data[base : int(ends[j - 1])].astype(U64)
            part += U64(1)
            part *= _POWER[: len(part)]
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(part, out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (total[e] - total[s]) * _INVERSE[s]
            i = j
        if i < len(starts):
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
    return mix(out ^ length.astype(U64))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, none of them empty, with one blank after each: (bytes, start, end)."""
    length = ends - starts
    stop = np.cumsum(length + 1)
    total = int(stop[-1]) if len(stop) else 0
    out = np.full(total, 0x20, np.uint8)
    begin = stop - length - 1
    step = np.zeros(total + 1, np.int8)
    # No place occurs twice among the starts, nor among the ends.
    step[begin] += 1
    step[begin + length] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    out[inside] = data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    return out, begin, begin + length


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    have, low = 1, values
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    stop = np.cumsum(lengths)
    return np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - lengths, lengths)


def pack(*parts: np.ndarray | bytes) -> bytes:
    """One compressed blob; integers are stored byte plane by byte plane."""
    out = []
    for x in parts:
        if isinstance(x, bytes):
            kind, raw = b"b1", x
        else:
            kind = x.dtype.str[1:].encode()
            raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
        out.append(kind + struct.pack("<q", len(raw)) + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list:
    raw, at, parts = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, (size,) = raw[at : at + 2], struct.unpack_from("<q", raw, at + 2)
        body = raw[at + 10 : at + 10 + size]
        at += 10 + size
        if kind == b"b1":
            parts.append(body)
        else:
            dtype = np.dtype("<" + kind.decode())
            planes = np.frombuffer(body, np.uint8).reshape(dtype.itemsize, -1)
            parts.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
    return parts


def sorted_by_id(batch: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """Rows that have an id, in the order of their ids."""
    if batch.column(key).null_count:
        batch = batch.filter(pc.is_valid(batch.column(key)))
    return batch.sort_by(key)
