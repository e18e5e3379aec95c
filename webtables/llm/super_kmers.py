"""Substring dedup by words: super-k-mer partitioning and exact counting by sorting.

Windows of 13 words whose minimiser is the same word triple travel together as one packed
string. In its bucket all windows are sorted, and a window is covered where a smaller
document has the same words. A word goes if any covered window holds it; windows are
judged on the input. Null and empty texts have no words; a text shorter than a window
keeps all its words; repeated rows remove each other's windows only if their ids differ.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webtables.llm import arrays as A
from webtables.llm import windows as W

GRAM = 3
ADDED = "n_words long, n_removed long, kept_text string, spans array<array<long>>"


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, spans (removed words, [start, end))."""
    gram = min(GRAM, size)

    def units(part: pa.RecordBatch) -> W.Units:
        data, off = A.text_bytes(part.column("text"))
        s, e, first = A.words(data, off)
        h = A.hash_spans(data, s, e)
        grams = np.zeros(len(h), np.uint64)
        for k in range(gram):
            grams[: len(h) - k] += h[k:] * A.PLACES[k]
        text, s, e = A.joined(data, s, e)
        return W.Units(text.tobytes(), lambda i: s[i], lambda i: e[i] + 1, first, A.mix(grams))

    def covered(data: np.ndarray, off: np.ndarray, docs_: np.ndarray):
        s, e, first = A.words(data, off)
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(data)).astype(np.int64)), pa.py_buffer(data)])
        ids = values.dictionary_encode().indices.to_numpy()
        n = len(ids) - size + 1
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(row[:n] == row[size - 1 :])
        spread = A.mix(ids.astype(np.uint64) + np.uint64(1))
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = A.mix(h + spread[at + k])
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        same = np.zeros(len(at), bool)
        near = np.flatnonzero(h[1:] == h[:-1]) + 1
        equal = np.ones(len(near), bool)
        for k in range(size):
            equal &= ids[at[near] + k] == ids[at[near - 1] + k]
        if not equal.all():  # different windows with one hash: sort the words themselves
            order = np.lexsort([ids[at + k] for k in reversed(range(size))])
            at = at[order]
            near = np.arange(1, len(at))
            equal = np.ones(len(near), bool)
            for k in range(size):
                equal &= ids[at[1:] + k] == ids[at[:-1] + k]
        same[near] = equal
        doc = docs_[row[at]]
        flags = np.zeros(len(ids), bool)
        flags[at] = doc > W.least_documents(np.cumsum(~same), doc)
        return flags, lambda i: s[i], lambda i: e[i] + 1, first

    def count(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(data == 0x20)])[off])

    def apply(text: bytes, cuts: list):
        data = np.frombuffer(text, np.uint8)
        s, e, _ = A.words(data, np.array([0, len(data)]))
        flat, s, e = A.joined(data, s, e)
        raw = flat.tobytes()
        gone = np.zeros(len(s), bool)
        for start, n, seen in cuts:
            if start + n <= len(s) and zlib.crc32(raw[s[start] : e[start + n - 1] + 1]) == seen:
                gone[start : start + n] = True
        begin, stop = A.runs(~gone)
        kept = b"".join([raw[s[i] : e[j - 1] + 1] for i, j in zip(begin, stop)])[:-1]
        return len(s), int(gone.sum()), kept.decode(), [[int(i), int(j)] for i, j in zip(*A.runs(gone))]

    plain = W.plain(docs, id_col, text_col)
    return W.with_cuts(plain, W.cuts_of(plain, units, covered, count, size, gram, A.SLICE_BYTES), apply, ADDED)
