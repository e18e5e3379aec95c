"""Benchmark decontamination: a BM25 index of test items, searched with every training passage.

Items are indexed with their BM25 impacts, each item's divided by the item's own total, so that one
threshold holds for all: a passage retrieves an item if it collects at least THRESHOLD of the
item's weight. Passages are windows of twice the longest item, half overlapping, so every run of
tokens as long as an item lies whole in one of them. Retrieval is block-max WAND over all passages
of a slice at once: the terms whose greatest impacts together stay below the threshold are not
essential; only blocks of items on the lists of essential terms are looked at, then bounded by
the greatest impacts within the block, and only what remains is scored item by item. Nothing above
the threshold is missed. Passages are searched in runs with at most STEP entries on their lists (one
passage at least), so a slice full of benchmark words needs no more memory than another. A retrieved item counts if both its question (all but its last sentence)
and its answer (the last sentence) overlap with the passage by half of their 5-grams.

The index is what travels to the tasks; a larger set of items is searched in shards of at most
SHARD_ITEMS, one pass each. Tokens are runs of letters and digits, A-Z lower-cased; bytes
beyond ASCII count as letters. Null and empty texts have no passages; null and empty items match
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm import arrays as A
from webtables.llm.exchange import arrow_schema
from webtables.llm.windows import plain

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
GRAM = 5
BLOCK = 8
SHARD_ITEMS = 50_000
#: Entries of posting lists that are looked at in one step.
STEP = 1 << 18
_PARTS = re.compile(r"(?s)^(.*[.!?])\s+(\S.*)$")

#: Bytes between tokens.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = A.LOWER[data]
    s, e, first = A.words(data, off, GAP)
    return A.hash_spans(data, s, e), first


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` tokens."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out += h[k : k + n] * A.PLACES[k]
    return A.mix(out)


def parts_of(text: str) -> tuple[str, str]:
    """Question and answer of an item: all but the last sentence, and that sentence; of one sentence, both are it."""
    found = _PARTS.match(text.strip())
    return (found[1], found[2]) if found else (text, text)


def _steps(many: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole groups (``group`` ascends) whose ``many`` come to at most STEP, one group at least."""
    last = np.append(np.flatnonzero(np.diff(group)) + 1, len(group)) if len(group) else group
    total = np.cumsum(many)
    at = 0
    while at < len(group):
        most = int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right"))
        k = max(int(np.searchsorted(last, most, "right")) - 1, int(np.searchsorted(last, at, "right")))
        yield at, int(last[k])
        at = int(last[k])


@dataclass
class Index:
    """Impacts by term and item, greatest impacts by term and block, and the items' n-grams."""

    items: list
    terms: np.ndarray
    first: np.ndarray  # postings of term t are first[t]:first[t + 1]
    item: np.ndarray
    impact: np.ndarray
    highest: np.ndarray
    block_first: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    grams: list
    stride: int

    @classmethod
    def of(cls, items: list[tuple]) -> Index:
        items = [(i, t) for i, t in items if t]
        h, first = _tokens(*A.text_bytes(pa.array([t for _, t in items], pa.string())))
        length = np.diff(first)
        kept = np.flatnonzero(length > 0)
        row = np.repeat(np.arange(len(items)), length)
        terms, term = np.unique(h, return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * max(len(items), 1) + row, return_counts=True)
        term, row = key // max(len(items), 1), key % max(len(items), 1)
        df = np.bincount(term, minlength=len(terms))
        idf = np.log(1 + (len(kept) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / (length[kept].mean() if len(kept) else 1.0))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[row])
        impact = impact / np.bincount(row, impact, minlength=len(items))[row]
        count = len(items) // BLOCK + 1
        pair, at = np.unique(term * count + row // BLOCK, return_inverse=True)
        block_impact = np.zeros(len(pair))
        np.maximum.at(block_impact, at, impact)
        highest = np.zeros(len(terms))
        np.maximum.at(highest, term, impact)
        grams = []
        for _, text in items:
            both = []
            for part in parts_of(text):
                own, _ = _tokens(*A.text_bytes(pa.array([part])))
                size = min(GRAM, len(own))
                both.append((size, np.unique(_grams(own, size)) if size else np.empty(0, np.uint64)))
            grams.append(both)
        bounds = np.arange(len(terms) + 1)
        return cls([i for i, _ in items], terms, np.searchsorted(term, bounds), row, impact, highest, np.searchsorted(pair // count, bounds), pair % count, block_impact, grams, int(length.max(initial=1)))

    def _weight(self, term: np.ndarray, value: np.ndarray, keys: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """Weight of (term, value), 0 where the term's list lacks the value; ``keys`` are the lists' entries term * size + value."""
        want = term * size + value
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, weights[at], 0.0)

    def retrieve(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first token of the passage in the row, item, score) above the threshold."""
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0),)
        if not len(self.terms) or not len(h):
            return none
        n = np.diff(first)
        passages = np.where(n > 0, np.maximum(-(-(n - 2 * self.stride) // self.stride), 0) + 1, 0)
        base = np.concatenate([[0], np.cumsum(passages)])
        flag = np.zeros(1 << 16, bool)
        flag[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(flag[(h & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        known = self.terms[term] == h[at]
        at, term = at[known], term[known]
        row = np.searchsorted(first, at, "right") - 1
        late = (at - first[row]) // self.stride
        key = [(base[row] + k)[(k >= 0) & (k < passages[row])] * len(self.terms) + term[(k >= 0) & (k < passages[row])] for k in (late, late - 1)]
        key = np.unique(np.concatenate(key))
        if not len(key):
            return none
        passage, term = key // len(self.terms), key % len(self.terms)
        # Essential terms of each passage: the highest ones, beyond a rest that cannot reach the threshold.
        order = np.lexsort((self.highest[term], passage))
        passage, term = passage[order], term[order]
        high = self.highest[term]
        start = np.flatnonzero(np.diff(passage, prepend=-1))
        count = np.diff(np.append(start, len(passage)))
        total = np.cumsum(high)
        total -= np.repeat(total[start] - high[start], count)
        essential = total >= THRESHOLD - 1e-9
        rest = np.zeros(int(base[-1]))
        np.add.at(rest, passage[~essential], high[~essential])
        # Blocks on the lists of essential terms, bounded by their greatest impacts there.
        p, t = passage[essential], term[essential]
        many = (self.block_first[1:] - self.block_first[:-1])[t]
        blocks = len(self.items) // BLOCK + 1
        block_keys, item_keys = (np.repeat(np.arange(len(f) - 1), np.diff(f)) * n + v for f, n, v in ((self.block_first, blocks, self.block), (self.first, blocks * BLOCK, self.item)))
        found = [none[2:]]
        for at, end in _steps(many, p):
            slot = np.repeat(self.block_first[t[at:end]], many[at:end]) + A.ranges(many[at:end])
            pair, back = np.unique(np.repeat(p[at:end], many[at:end]) * blocks + self.block[slot], return_inverse=True)
            bound = np.bincount(back, self.block_impact[slot], minlength=len(pair)) + rest[pair // blocks]
            pair = pair[bound >= THRESHOLD - 1e-9]
            bound = self._full(pair, blocks, passage, term, block_keys, self.block_impact)
            pair = pair[bound >= THRESHOLD - 1e-9]
            # Items of the blocks that are left.
            item = (pair % blocks * BLOCK)[:, None] + np.arange(BLOCK)
            single = ((pair // blocks)[:, None] * (blocks * BLOCK) + item)[item < len(self.items)].ravel()
            score = self._full(single, blocks * BLOCK, passage, term, item_keys, self.impact)
            hit = score >= THRESHOLD - 1e-9
            found.append((single[hit], score[hit]))
        single, score = (np.concatenate(x) for x in zip(*found))
        p, item = single // (blocks * BLOCK), single % (blocks * BLOCK)
        row = np.searchsorted(base, p, "right") - 1
        return row, (p - base[row]) * self.stride, item, score

    def _full(self, pair, size, passage, term, keys, weights):
        """Sum of weights over all terms of the passage, for pairs passage * size + value."""
        lo, hi = np.searchsorted(passage, pair // size), np.searchsorted(passage, pair // size, "right")
        count = hi - lo
        out = np.zeros(len(pair))
        for at, end in _steps(count, np.arange(len(pair))):
            slot = np.repeat(lo[at:end], count[at:end]) + A.ranges(count[at:end])
            owner = np.repeat(np.arange(end - at), count[at:end])
            weight = self._weight(term[slot], (pair[at:end] % size)[owner], keys, weights, size)
            out[at:end] = np.bincount(owner, weight, minlength=end - at)
        return out

    def matches(self, column) -> list[tuple]:
        """(row, item id, score, question hits, question grams, answer hits, answer grams), a verified passage each."""
        h, first = _tokens(*A.text_bytes(column))
        out = []
        for row, start, item, score in zip(*(x.tolist() for x in self.retrieve(h, first))):
            own = h[first[row] + start : min(first[row] + start + 2 * self.stride, first[row + 1])]
            hits = [(int(np.isin(grams, _grams(own, size)).sum()), len(grams)) for size, grams in self.grams[item]]
            if all(n and x >= OVERLAP * n for x, n in hits):
                out.append((row, self.items[item], score, *hits[0], *hits[1]))
        return out


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SHARD_ITEMS) -> Iterator[Index]:
    """Indexes of at most about ``size`` items each."""
    own = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    number = -(-own.count() // size)
    for k in range(number):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k) if number > 1 else own
        yield Index.of(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, passages, score, question_hits, question_grams, answer_hits, answer_grams."""
    docs = plain(docs, id_col, text_col)
    ddl = "doc_id long, item_id long, score double, question_hits long, question_grams long, answer_hits long, answer_grams long"
    found = docs.sparkSession.createDataFrame([], ddl)
    for index in shards(items):
        found = found.unionByName(docs.mapInArrow(_leak_task(docs.sparkSession, index, ddl), ddl))
    greatest = [F.max(c).alias(c) for c in ("score", "question_hits", "question_grams", "answer_hits", "answer_grams")]
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), *greatest)


def _leak_task(spark, index: Index, ddl: str):
    schema, sent = arrow_schema(ddl), spark.sparkContext.broadcast(index)

    def task(batches: Iterator) -> Iterator:
        for part in A.slices(batches, "text"):
            rows = sent.value.matches(part.column("text"))
            ids = part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            columns = list(zip(*rows))[1:] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return task


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text contains no item, as they are. The decision is local to the row: nothing is shuffled."""
    for index in shards(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator, sent=sent) -> Iterator:
            for part in A.slices(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in sent.value.matches(part.column(text_col))]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
