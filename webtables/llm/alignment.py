"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet.

A text is tokenised twice (A and B); a byte offset where tokens of both end cuts both lists into groups. All A and
B tokens of a group are linked with each other. Over the corpus, a pair of ids counts the documents that hold it linked.

Merging by path pieces. The ends of the A and of the B tokens of a slice of texts are two ascending lists.
Merging them is a path through the grid of both lists, which the diagonals i + j = n cut at equal numbers of steps; where
the path crosses a diagonal is found by a binary search, for all diagonals at once. Each piece between two
crossings is merged by itself: every step is an end, the bytes up to it are one overlap (A token, B token), and a step that
ends both closes a group. Pieces count the groups they close; the running sum of these counts
numbers the groups, so that one that is open at the end of a piece goes on in the next piece under its number.

Passes over the corpus:

1. Tasks tokenise and align slices of a few megabytes (one text at least) and store per slice its distinct stretches' ids, their
   order and the group sizes, packed, with the slice's distinct id pairs and the number of its documents that hold each.
2. Spark adds these up by pair, already summed by slice, and finds the highest count per A id (a window
   whose groups have one row per B id, so the size of B's vocabulary bounds them).
3. The counts return to the slices that have the pair, and tasks write a row per document. A hot pair has one row
   per slice, not per document or occurrence.

Within a group, equal ids are collapsed before they are paired, and pairs are made in blocks of bounded size, so a long
stretch without a common end costs (distinct A ids) x (distinct B ids), not the product of its lengths.

Null and empty texts, and texts whose joined A or B bytes differ from blank + text (a vocabulary may normalise),
have no tokens: all numbers are 0 and ``groups`` is empty. Equal texts give equal rows; documents with one id are aligned each
for itself. Rows without id are kept. Other columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.bpe import byte_letters
from webtables.llm.exchange import arrow_schema, stored

#: Bytes of text in a slice, steps in a piece of the merge, and pairs made at once.
SLICE = 3 << 19
ROWS = 1 << 12
#: Bytes of text given to the tokenizers at once (one text at least): what they return is many times as large.
BATCH = 1 << 18
PIECE = 1 << 16
BLOCK = 1 << 18


#: Distinct stretches of text whose ids a worker keeps; then it starts anew.
MEMORY = 300_000

#: Signs round a blank at which a text may be cut before it is tokenised.
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
#: Fixed value: the splitter that starts a word at every blank before a letter, a digit or a sign.
_BLANK_STARTS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def stretches(data: np.ndarray, off: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, first): where stretches begin, and the first one of each row; with ``cut`` texts are cut at single blanks between signs.

    Without it every text is one stretch. A stretch ends before the blank in front of the next one, or with its text.
    """
    blank = np.zeros(len(data), bool)
    if cut and len(data) > 2:
        blank[1:-1] = (data[1:-1] == 0x20) & _GRAPHIC[data[:-2]] & _GRAPHIC[data[2:]]
        edge = off[(off > 0) & (off < len(data))]
        blank[edge] = blank[edge - 1] = False
    start = np.append(False, blank)
    start[off[:-1][off[1:] > off[:-1]]] = True
    start = np.flatnonzero(start)
    return start, np.searchsorted(start, off)


class Pair:
    """The two tokenizers of a worker and the bytes of their tokens.

    Where both vocabularies allow it, texts are cut at blanks between signs of ASCII and each distinct stretch is tokenised once:
    A starts a new word at such a blank, and B has no piece with a blank after another sign.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: n for n, c in enumerate(byte_letters())}
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.bytes_a = pa.array([bytes(map(letters.__getitem__, s)) if all(c in letters for c in s) else s.encode() for s in names], pa.large_binary())
        b = self.b
        splitter = json.loads(self.a.pre_tokenizer.__getstate__()) if self.a.pre_tokenizer else {}
        mine = {k: splitter.get(k) for k in _BLANK_STARTS}
        inner = any("▁" in b.id_to_piece(k).lstrip("▁") for k in range(b.get_piece_size()))
        self.by_stretch = self.a.normalizer is None and mine == _BLANK_STARTS and not inner
        self._forget()
        pieces = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())]
        self.bytes_b = pa.array(pieces, pa.large_binary())

    def _forget(self) -> None:
        """Stretches known to this worker: their numbers, and per side the ids of all of them with first and length."""
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.size = ([np.empty(0, kind) for _ in "ab"] for kind in (np.int32, np.int64, np.int32))

    def _learn(self, texts: list[str]) -> None:
        a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        for k, rows in enumerate((a, self.b.encode(texts, num_threads=1))):
            size = np.fromiter(map(len, rows), np.int32, len(rows))
            stop = len(self.ids[k]) + np.cumsum(size, dtype=np.int64)
            self.ids[k] = np.append(self.ids[k], np.fromiter(chain.from_iterable(rows), np.int32))
            self.first[k], self.size[k] = np.append(self.first[k], stop - size), np.append(self.size[k], size)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Texts as stretches: their number by text, which distinct stretch each is, and the ids and sizes of these for A and for B."""
        start, first = stretches(data, off, self.by_stretch)
        # A blank follows every stretch: the one it was cut at, or one put in behind the text.
        full = off[1:] > off[:-1]
        text = np.insert(data, off[1:][full], 0x20)
        begin = start + np.repeat(np.cumsum(full) - full, np.diff(first))
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(text)).astype(np.int64)), pa.py_buffer(text)])
        coded = values.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        if len(known) > MEMORY or max(map(len, self.ids)) > 8 * MEMORY:
            self._forget()
            known = self.known
        new = [w for w in distinct if w not in known]
        size = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        at = 0
        while at < len(new):
            stop = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, "right")), at + 1)
            known.update(zip(new[at:stop], range(len(known), len(known) + stop - at)))
            self._learn([w[:-1].decode() for w in new[at:stop]])
            at = stop
        number = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        out = [np.diff(first).astype(np.int32), coded.indices.to_numpy().astype(np.int32)]
        for ids, place, length in zip(self.ids, self.first, self.size):
            n = length[number]
            out += [ids[np.repeat(place[number], n) + A.ranges(n)], n]
        return out


def expanded(stretched: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(A ids, tokens by text, B ids, tokens by text) of encoded texts."""
    count, which, *sides = stretched
    last, out = np.cumsum(count, dtype=np.int64), []
    for flat, n in zip(sides[::2], sides[1::2]):
        length = n[which]
        start = np.cumsum(n, dtype=np.int64) - n
        ids = flat[np.repeat(start[which], length) + A.ranges(length)]
        total = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        out += [ids, total[last] - total[last - count]]
    return tuple(out)


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def crossings(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first ``at[k]`` steps of merging ``a`` and ``b`` (equal values: a's first), for all k at once.

    Both lists ascend strictly and end with the same value.
    """
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # The middle lies on the path or before it if a's next value precedes b's last one on this diagonal.
        before = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(at - middle - 1, 0, len(b) - 1)]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each a token, group of each b token, number of groups) from the ends of the tokens."""
    at = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = crossings(a, b, at)
    j = at - i
    # A common end counts as one step: where a diagonal parts it, b's half comes over to a's piece.
    parted = (i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)])
    j = j + parted
    pieces = [_overlaps(a, b, *span) for span in zip(i, i[1:], j, j[1:])]
    base = np.cumsum([0, *(p[2][-1] if len(p[2]) else 0 for p in pieces)])
    of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    for first, (x, y, closed) in zip(base, pieces):
        # The group of an overlap is the number of groups closed before it; every token ends in one of its overlaps.
        number = first + np.append(0, closed[:-1])
        of_a[x[x < len(a)]], of_b[y[y < len(b)]] = number[x < len(a)], number[y < len(b)]
    return of_a, of_b, int(base[-1])


def _overlaps(a: np.ndarray, b: np.ndarray, i: int, i2: int, j: int, j2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a token, b token, groups closed so far) for each overlap that ends in this piece."""
    p, q = a[i:i2], b[j:j2]
    steps = np.sort(np.concatenate([p, q]), kind="stable")
    again = np.diff(steps, prepend=-1) == 0
    ends, both = steps[~again], np.append(again[1:], False)[~again]
    return i + np.searchsorted(p, ends), j + np.searchsorted(q, ends), np.cumsum(both)


def _aligned(pair: Pair, text) -> tuple[np.ndarray, ...]:
    """(encoded texts, A ids, B ids, group of A tokens, of B tokens, groups by text); texts that do not agree have no ids."""
    column = pc.fill_null(text, "")
    data, off = A.text_bytes(column)
    stretched = pair.encode(data, off)
    ids_a, n_a, ids_b, n_b = expanded(stretched)
    size = off[1:] - off[:-1] + 1
    keep = size > 1
    want = np.insert(data, off[:-1], 0x20)
    sides = []
    for table, ids, n in ((pair.bytes_a, ids_a, n_a), (pair.bytes_b, ids_b, n_b)):
        raw, ends = A.text_bytes(table.take(pa.array(ids)))
        until = ends[np.concatenate([[0], np.cumsum(n)])]
        own = until[1:] - until[:-1]
        keep &= own == size
        differ = np.flatnonzero(raw[np.repeat(keep, own)] != want[np.repeat(keep, size)])
        held = np.flatnonzero(keep)
        keep[held[np.searchsorted(np.cumsum(size[held]), differ, "right")]] = False
        sides.append((ids, n, ends[1:] - ends[:-1]))
    del raw, want, differ, data
    out = []
    for ids, n, length in sides:
        on = np.repeat(keep, n)
        out.append((ids[on], np.where(keep, n, 0), np.cumsum(length[on])))
    (ids_a, n_a, ends_a), (ids_b, n_b, ends_b) = out
    if not len(ends_a):
        return stretched, ids_a, ids_b, ends_a, ends_b, np.zeros(len(size), np.int64)
    of_a, of_b, _ = groups(ends_a, ends_b)
    last = np.concatenate([[-1], of_a])[np.cumsum(n_a)]
    return stretched, ids_a, ids_b, of_a, of_b, np.diff(np.concatenate([[-1], last]))


def _links(ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (group, A id, B id, links): the distinct id pairs of each group with the number of their occurrences."""
    # Runs of whole groups of about PIECE tokens: what is held at once does not grow with the text.
    stop_a, stop_b = (np.searchsorted(of, np.arange(n_groups), "right") for of in (of_a, of_b))
    work = stop_a + stop_b
    at = 0
    while at < n_groups:
        until = max(int(np.searchsorted(work, (work[at - 1] if at else 0) + PIECE, "right")), at + 1)
        a, b = (slice(stop[at - 1] if at else 0, stop[until - 1]) for stop in (stop_a, stop_b))
        for group, *rest in _group_links(ids_a[a], of_a[a] - at, ids_b[b], of_b[b] - at, until - at):
            yield group + at, *rest
        at = until


def _group_links(ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, ...]]:
    sides = []
    for ids, of in ((ids_a, of_a), (ids_b, of_b)):
        key = of.astype(np.int64) << 24 | ids
        size = np.bincount(of, minlength=n_groups)
        if len(key) and size.max() > 1:
            key, times = np.unique(key, return_counts=True)
        else:
            times = np.ones(len(key), np.int64)
        of = key >> 24
        sides.append((key & ((1 << 24) - 1), times, np.searchsorted(of, np.arange(n_groups + 1))))
    (a, times_a, first_a), (b, times_b, first_b) = sides
    width = np.diff(first_b)
    # One line for each distinct A id of a group; its pairs follow each other, cut into blocks.
    of = np.repeat(np.arange(n_groups), np.diff(first_a))
    pairs = np.cumsum(width[of])
    at = 0
    while at < len(a):
        stop = max(int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + BLOCK, "right")), at + 1)
        line = np.repeat(np.arange(at, stop), width[of[at:stop]])
        k = first_b[of[line]] + A.ranges(width[of[at:stop]])
        yield of[line], a[line], b[k], times_a[line] * times_b[k]
        at = stop


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _document_pairs(doc_of_group: np.ndarray, blocks: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct id pairs, documents that hold each)."""
    found = []
    for group, a, b, _ in blocks:
        pair, which = np.unique(a << 32 | b, return_inverse=True)
        both = distinct(which * np.int64(1 << 20) + doc_of_group[group])
        found.append((pair[both >> 20], both & ((1 << 20) - 1)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(found) > 1:
        pair, which = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        both = distinct(which * np.int64(1 << 20) + np.concatenate([d for _, d in found]))
        found = [(pair[both >> 20], both)]
    pair = found[0][0]
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[start], np.diff(np.append(start, len(pair)))


_SLICES = "slice long, docs array<long>, blob binary, pairs array<long>, held array<long>"


def _slices(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    schema = arrow_schema(_SLICES)

    def task(batches: Iterator) -> Iterator:
        pair, number = _pair(path_a, path_b), TaskContext.get().partitionId() << 32
        for part in A.slices(batches, "text", SLICE, ROWS):
            stretched, ids_a, ids_b, of_a, of_b, n_groups = _aligned(pair, part.column("text"))
            total = int(n_groups.sum())
            pairs, held = _document_pairs(np.repeat(np.arange(len(n_groups)), n_groups), _links(ids_a, of_a, ids_b, of_b, total))
            sizes = [np.bincount(of, minlength=total).astype(np.int32) for of in (of_a, of_b)]
            blob = A.pack(*stretched, *sizes, n_groups.astype(np.int64), pairs)
            row = [[number], [part.column("doc_id").to_pylist()], [blob], [pairs], [held]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)
            number += 1
            # Arrow's pool keeps what it has freed; a worker that idles in later stages should not.
            pa.default_memory_pool().release_unused()
        pair._forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _SLICES)


def _written(sizes: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray], n_groups: np.ndarray) -> list[str]:
    """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
    top = int(max(ids[0].max(initial=0), ids[1].max(initial=0))) + 1
    numbers = np.arange(top).astype(str)
    names = pa.array(np.concatenate([np.char.add(numbers, c) for c in ",|;"]))
    stop = [np.cumsum(s) for s in sizes]
    out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for own, other, sign in ((0, 1, 1), (1, 0, 2)):
        group = np.repeat(np.arange(len(sizes[own])), sizes[own])
        # B tokens stand after the A tokens of their own group as well.
        shift = stop[other] - (0 if own else sizes[other])
        last = np.zeros(len(ids[own]), bool)
        last[stop[own] - 1] = True
        out[np.arange(len(group)) + shift[group]] = ids[own] + top * np.where(last, sign, 0)
    tokens = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])[np.concatenate([[0], np.cumsum(n_groups)])]
    parts = names.take(pa.array(out))
    joined = pc.binary_join(pa.ListArray.from_arrays(tokens.astype(np.int32), parts), "")
    return [s[:-1] for s in joined.to_pylist()]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document of (doc_id, text)."""
    slices = stored(_slices(docs, path_a, path_b))
    rows = slices.select("slice", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p"))
    rows = rows.select("slice", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = rows.groupBy("pair").agg(F.sum("held").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))
    back = rows.join(counts, "pair").select(F.col("slice").alias("into"), "at", "n", "best")

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    schema = arrow_schema(ddl)

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_finished(row, right, schema) for row in left.to_batches() if row.num_rows]
        return pa.Table.from_batches(out, schema)

    return slices.select("slice", "docs", "blob").groupBy("slice").cogroup(back.groupBy("into")).applyInArrow(whole, ddl)


def _finished(row: pa.RecordBatch, counts: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """The documents of a slice (one row), with the counts of its pairs."""
    *stretched, size_a, size_b, n_groups, pairs = A.unpack(row.column("blob")[0].as_py())
    ids_a, n_a, ids_b, n_b = expanded(stretched)
    ids_a, ids_b = ids_a[np.repeat(n_groups > 0, n_a)], ids_b[np.repeat(n_groups > 0, n_b)]
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = counts.column("at").to_numpy()
    count[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    docs, total = len(n_groups), len(size_a)
    doc = np.repeat(np.arange(docs), n_groups)
    sums = np.zeros((docs, 3), np.int64)
    of_a, of_b = (np.repeat(np.arange(total), s) for s in (size_a, size_b))
    for group, a, b, times in _links(ids_a.astype(np.int64), of_a, ids_b.astype(np.int64), of_b, total):
        k = np.searchsorted(pairs, a << 32 | b)
        start = np.flatnonzero(np.append(True, doc[group][1:] != doc[group][:-1]))
        for column, value in enumerate((times, times * best[k], times * count[k])):
            sums[doc[group[start]], column] += np.add.reduceat(value, start)
    n = [np.bincount(doc, s, docs).astype(np.int64) for s in (size_a, size_b)]
    text = _written((size_a, size_b), (ids_a, ids_b), n_groups)
    columns = [row.column("docs")[0].as_py(), *n, n_groups, *sums.T, text]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
