"""Suffix-array dedup: bytes that lie in a string of 50 bytes which a smaller document has too.

The suffixes of a bucket are ordered to a depth of 50 bytes by bucket-pointer refinement:
they start in buckets of their first eight bytes; each bucket of more than one suffix is then
sorted on the bucket identifiers of the suffixes 8, 16 and 18 bytes further on. New identifiers
replace the old ones at once, so every pass reuses the refinement of the one before, which
doubles the depth that an identifier stands for. Suffixes alone in their bucket are done.

Texts are UTF-8 bytes, null counts as empty. Texts shorter than 50 bytes stay whole. Matches
never cross documents; strings are judged on the input; overlaps count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webtables.llm import arrays as A
from webtables.llm import windows as W

Q = 8
GRAM = 12
ADDED = "n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>"


def _bytes_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, in the order of the strings; zeros past the end."""
    wide = np.zeros(len(data) + Q, np.uint8)
    wide[: len(data)] = data
    return np.ndarray(len(data), ">u8", wide.data, strides=(1,)).astype(np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 12 bytes at each place."""
    eight = _bytes_at(data)
    rest = np.zeros(len(eight), np.uint64)
    rest[: max(0, len(eight) - 4)] = eight[4:]
    return A.mix(eight * A.PLACES[0] ^ A.mix(rest))


def refine(data: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifier of each suffix to ``depth`` bytes; -1 where no other suffix shares them or the string ends before."""
    n = len(data)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    pointer = np.full(n, -1, np.int64)
    at = np.flatnonzero(left >= Q)
    word = _bytes_at(data)[at]
    order = np.argsort(word, kind="stable")
    at, word = at[order], word[order]
    new = np.ones(len(at), bool)
    new[1:] = word[1:] != word[:-1]
    have = Q
    while True:
        # Identifiers are the ranks of the buckets' ends, as the suffixes now stand.
        ident = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        at, ident = at[~alone], ident[~alone]
        pointer[:] = -1
        pointer[at] = ident
        if have == depth or not len(at):
            return pointer
        step = min(have, depth - have)
        fits = left[at] >= have + step
        at, ident = at[fits], ident[fits]
        later = pointer[at + step]
        some = later >= 0
        at, ident, later = at[some], ident[some], later[some]
        both = ident.astype(np.uint64) * np.uint64(1 << 32) + later.astype(np.uint64)
        order = np.argsort(both, kind="stable")
        at, both = at[order], both[order]
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        have += step


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (removed, [start, end))."""

    def units(part: pa.RecordBatch) -> W.Units:
        data, off = A.text_bytes(part.column("text"))
        return W.Units(data.tobytes(), lambda i: i, lambda i: i + 1, off, _gram_hashes(data))

    def covered(data: np.ndarray, off: np.ndarray, docs_: np.ndarray):
        pointer = refine(data, off, size)
        at = np.flatnonzero(pointer >= 0)
        order = np.argsort(pointer[at], kind="stable")
        at = at[order]
        doc = docs_[np.searchsorted(off, at, "right") - 1]
        flags = np.zeros(len(data), bool)
        if len(at):
            flags[at] = doc > W.least_documents(pointer[at], doc)
        return flags, lambda i: i, lambda i: i + 1, off

    def contexts(data: np.ndarray, off: np.ndarray, key: np.ndarray, place: np.ndarray):
        # A window reaches over its minimiser by ``size - GRAM`` bytes, so by half of them on one side at least.
        half = (size - GRAM) // 2
        one = np.flatnonzero(place != W.MANY)
        at, owner = off[one] + place[one], one
        many = np.flatnonzero(place == W.MANY)
        if len(many):  # the minimiser moves inside the string: round every place where it may lie
            length = np.diff(off)[many]
            start = np.repeat(off[many], length) + A.ranges(length)
            held = np.repeat(many, length)
            alike = (_gram_hashes(data[start]) >> np.uint64(12)).astype(np.uint32) == key[held].astype(np.uint32)
            at, owner = np.concatenate([at, start[alike]]), np.concatenate([owner, held[alike]])
        eight = _bytes_at(data)
        steps = [*range(0, half + GRAM - Q, Q), half + GRAM - Q]
        for start in (at, at - half):
            known = np.flatnonzero((start >= off[owner]) & (start + half + GRAM <= off[owner + 1]))
            value = np.zeros(len(known), np.uint64)
            for k, step in enumerate(steps):
                value = A.mix(value + eight[start[known] + step] * A.PLACES[k])
            yield value, owner[known]

    def count(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.diff(off)

    def apply(text: bytes, cuts: list):
        gone = np.zeros(len(text), bool)
        for start, n, seen in cuts:
            if zlib.crc32(text[start : start + n]) == seen:
                gone[start : start + n] = True
        spans = [[int(i), int(j)] for i, j in zip(*A.runs(gone))]
        kept = b"".join([text[i:j] for i, j in zip(*A.runs(~gone))])
        return len(text), int(gone.sum()), len(spans), kept, spans

    plain = W.plain(docs, id_col, text_col)
    return W.with_cuts(plain, W.cuts_of(plain, units, covered, count, size, GRAM, A.SLICE_BYTES // 2, contexts), apply, ADDED)
