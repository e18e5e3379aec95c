"""Toxicity by class-conditional Kneser-Ney models.

Words are read as strings of bytes with a blank on either side. Two interpolated Kneser-Ney
models of order 7, one of toxic and one of ordinary labelled texts, give each byte's
log-likelihood. Both fall back on the same lower orders, whose continuation counts (in how
many different contexts a string was seen) come from both classes together: an expression
that is rare in both classes says little for either. As the fallback is shared, it cancels
where neither class has seen a string, and a word's log-likelihood ratio needs only the
strings and contexts that were seen.

A text's evidence is the difference of the two log-likelihoods, normalised by length: over the
whole text and over its most toxic stretches of words. Most labelled rows give the counts; the
others, which the models have not seen, fit the logistic curve from evidence to score.

The models are fitted on all labelled rows, unless the caller asks for fewer; then both classes are drawn
at one rate, which keeps their mix. Every document is scored on its whole text. Null and empty texts, and texts
without words, have no evidence and get the score of the curve's base rate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webtables.llm import arrays as A
from webtables.llm.exchange import BLOBS, arrow_schema, bucket_count, by_bucket, stored
from webtables.llm.windows import _grouped, plain

ORDER = 7
DISCOUNT = 0.75
#: Stretches over which the evidence is normalised, in words.
STRETCHES = (1, 3, 8, 32)
#: Words whose evidence a task keeps between slices.
MEMORY = 100_000
#: Bytes of text whose evidence is computed at once.
SLICE = 1 << 20
_BYTE = np.uint64(8)


def _words(column) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words, lower-cased and with a blank behind, coded; and the first word of each row."""
    data, off = A.text_bytes(column)
    data = A.LOWER[data]
    s, e, first = A.words(data, off)
    text, s, _ = A.joined(data, s, e)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.append(s, len(text)).astype(np.int64)), pa.py_buffer(text)])
    return values.dictionary_encode(), first


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the words: its string of up to ORDER bytes back to the blank before, and its word."""
    data, off = A.text_bytes(column)
    length = np.diff(off)
    place = A.ranges(length)
    gram = np.zeros(len(data), np.uint64)
    wide = np.concatenate([np.zeros(ORDER, np.uint64), data.astype(np.uint64)])
    for k in range(ORDER):
        byte = wide[ORDER - k : len(wide) - k]
        gram |= np.where(place >= k, byte, np.where(place == k - 1, np.uint64(0x20), np.uint64(0))) << np.uint64(8 * k)
    return gram, np.repeat(np.arange(len(length)), length)


def gram_counts(docs: DataFrame, labelled: Callable[[Iterator], Iterator], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts by class): all strings of the rows (text, label) that ``labelled`` makes of batches of ``docs``, counted by Spark."""
    ddl = "blob binary"

    def ship(batches: Iterator) -> Iterator:
        for part in A.slices(labelled(batches), "text"):
            coded, first = _words(part.column("text"))
            gram, word = _grams(coded.dictionary)
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            toxic = part.column("label").to_numpy(zero_copy_only=False)[row] == 1
            which = coded.indices.to_numpy()
            n = np.stack([np.bincount(which[toxic == c], minlength=len(coded.dictionary)) for c in (False, True)])
            values, back = np.unique(gram, return_inverse=True)
            counts = [np.bincount(back, n[c][word], minlength=len(values)).astype(np.int64) for c in (0, 1)]
            bucket, blob = [], []
            for b, at in _grouped((A.mix(values) % np.uint64(buckets)).astype(np.int64), np.arange(len(values))):
                bucket.append(b)
                blob.append(A.pack(values[at], counts[0][at], counts[1][at]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], schema=blobs)

    def total(held: list[bytes]) -> Iterator:
        parts = [A.unpack(b) for b in held]
        values, back = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        counts = [np.zeros(len(values), np.int64) for _ in (0, 1)]
        for c in (0, 1):
            np.add.at(counts[c], back, np.concatenate([x[1 + c] for x in parts]))
        yield pa.RecordBatch.from_arrays([pa.array([A.pack(values, *counts)], pa.binary())], schema=out)

    blobs, out = arrow_schema(BLOBS), arrow_schema(ddl)
    parts = [A.unpack(r["blob"]) for r in by_bucket(docs.mapInArrow(ship, BLOBS), total, ddl).collect()]
    if not parts:
        return np.empty(0, np.uint64), np.zeros((2, 0), np.int64)
    values = np.concatenate([x[0] for x in parts])
    order = np.argsort(values)
    return values[order], np.stack([np.concatenate([x[1 + c] for x in parts])[order] for c in (0, 1)])


def _sums(keys: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, and each weight summed over them."""
    values, back = np.unique(keys, return_inverse=True)
    return [values, *(np.bincount(back, w, minlength=len(values)) for w in weights)]


def _at(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """values of keys, 0 where the table lacks them."""
    if not len(table):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0)


@dataclass
class Model:
    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    curve: np.ndarray | None = None

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Model:
        """The log-likelihood ratios of all strings and contexts that were seen."""
        # Shared lower orders: the probability of a byte after 0, 1, .. ORDER - 2 bytes.
        levels = [grams]
        for k in range(ORDER - 1, 0, -1):
            levels.append(np.unique(levels[-1] & np.uint64((1 << 8 * k) - 1)))
        levels = levels[::-1]  # distinct strings of 1 .. ORDER bytes
        p = None
        for k in range(1, ORDER):
            mask = np.uint64((1 << 8 * k) - 1)
            strings, seen = _sums(levels[k] & mask, np.ones(len(levels[k])))
            context, base, kinds = _sums(strings >> _BYTE, seen, np.ones(len(strings)))
            total, rest = _at(context, base, strings >> _BYTE), DISCOUNT * _at(context, kinds, strings >> _BYTE)
            low = np.full(len(strings), 1 / 256) if p is None else _at(*p, strings & np.uint64((1 << 8 * (k - 1)) - 1))
            p = strings, (seen - DISCOUNT + rest * low) / total
        low = _at(*p, grams & np.uint64((1 << 8 * (ORDER - 1)) - 1)) if p else np.empty(0)
        contexts = np.unique(grams >> _BYTE)
        logs, rests = [], []
        for c in (0, 1):
            own = counts[c] > 0
            context, base, kinds = _sums(grams[own] >> _BYTE, counts[c][own].astype(float), np.ones(int(own.sum())))
            total, kinds_at = _at(context, base, grams >> _BYTE), _at(context, kinds, grams >> _BYTE)
            full = (np.maximum(counts[c] - DISCOUNT, 0) + DISCOUNT * kinds_at * low) / np.maximum(total, 1)
            logs.append(np.log(np.where(total > 0, full, low)))
            total = _at(context, base, contexts)
            rests.append(np.log(np.where(total > 0, DISCOUNT * _at(context, kinds, contexts) / np.maximum(total, 1), 1.0)))
        return cls(grams, logs[1] - logs[0], contexts, rests[1] - rests[0])

    def word_ratios(self, column: pa.Array) -> np.ndarray:
        gram, word = _grams(column)
        ratio = _at(self.contexts, self.context_ratio, gram >> _BYTE)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            ratio = np.where(self.grams[at] == gram, self.gram_ratio[at], ratio)
        return np.bincount(word, ratio, minlength=len(column))

    def evidence(self, column, known: dict) -> np.ndarray:
        """A row of evidence per text; ``known`` keeps the ratios of words between calls."""
        coded, first = _words(column)
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = distinct
        known.update(zip(new, self.word_ratios(pa.array(new, pa.binary())).tolist()))
        which = coded.indices.to_numpy()
        ratio = np.array([known[w] for w in distinct], float)[which] if len(which) else np.empty(0)
        size = np.array([len(w) for w in distinct], float)[which] if len(which) else np.empty(0)
        total, length = (np.concatenate([[0.0], np.cumsum(x)]) for x in (ratio, size))
        n = np.diff(first)
        some = n > 0
        out = np.zeros((len(n), len(STRETCHES) + 2))
        out[some, 0] = (total[first[1:]] - total[first[:-1]])[some] / (length[first[1:]] - length[first[:-1]])[some]
        last = np.repeat(first[1:], n)
        for k, w in enumerate(STRETCHES):
            if len(ratio):
                stop = np.minimum(np.arange(len(ratio)) + w, last)
                mean = (total[stop] - total[:-1]) / (length[stop] - length[:-1] + 6.0)
                out[some, k + 1] = np.maximum.reduceat(mean, first[:-1][some])
        out[:, -1] = np.log1p(n)
        return out

    def fit_curve(self, held: DataFrame) -> Model:
        """Logistic regression of rows (label, x) by Newton steps, with a small ridge; Spark adds up each step."""
        rows, total = np.split(_added(held, lambda x, y: np.append(float(len(x)), x.sum(0)), len(STRETCHES) + 3), [1])
        self.centre, self.spread = np.zeros(len(STRETCHES) + 2), np.ones(len(STRETCHES) + 2)
        if rows[0]:
            centre = self.centre = total / rows[0]
            self.spread = np.sqrt(_added(held, lambda x, y: ((x - centre) ** 2).sum(0), len(centre)) / rows[0]) + 1e-9
        centre, spread = self.centre, self.spread
        w = np.zeros(_design(np.zeros((0, len(centre))), centre, spread).shape[1])
        ridge = np.full(len(w), 1e-2)
        for _ in range(40 if rows[0] else 0):

            def slope(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                z = _design(x, centre, spread)
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                return np.append(z.T @ (y - p), (z.T * (p * (1 - p))) @ z)

            first, second = np.split(_added(held, slope, len(w) * (len(w) + 1)), [len(w)])
            step = np.linalg.solve(second.reshape(len(w), len(w)) + np.diag(ridge), first - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(x, self.centre, self.spread) @ self.curve, -30, 30)))


def _design(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = (x - centre) / spread
    return np.concatenate([z, z[:, 1:-1] * z[:, -1:], np.ones((len(z), 1))], 1)


def _added(held: DataFrame, of, size: int) -> np.ndarray:
    """``of(x, y)`` added up over all rows (label, x); one small array per task comes to the driver."""
    schema = arrow_schema("total binary")

    def task(batches: Iterator) -> Iterator:
        total = np.zeros(size)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if len(x):
                total = total + of(x, batch.column("label").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    return sum((np.frombuffer(r["total"]) for r in held.mapInArrow(task, "total binary").collect()), np.zeros(size))


def _packed(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) by id: nine bytes a labelled row."""
    schema = arrow_schema("blob binary")

    def task(batches: Iterator) -> Iterator:
        for batch in batches:
            blob = A.pack(batch.column("id").to_numpy(), batch.column("label").to_numpy().astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], schema=schema)

    parts = [A.unpack(r["blob"]) for r in labels.select("id", "label").mapInArrow(task, "blob binary").collect()]
    ids = np.concatenate([np.empty(0, np.int64), *(x[0] for x in parts if len(x[0]))])
    values = np.concatenate([np.empty(0, np.uint8), *(x[1] for x in parts if len(x[0]))])
    order = np.argsort(ids)
    return ids[order], values[order]


def _with_label(sent, held: bool) -> Callable[[Iterator], Iterator]:
    """Makes (text, label) of the documents whose id is among the labelled ones that are held back, or among the others.

    A step inside a task, for a task of its own would be a second Python worker per core.
    """
    schema = arrow_schema("text string, label long")

    def labelled(batches: Iterator) -> Iterator:
        ids, values = sent.value
        for batch in batches:
            if not len(ids):
                continue
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            own = A.mix(doc.astype(np.uint64)) % np.uint64(4) == 0
            hit = (ids[at] == doc) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (own == held)
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(values[at].astype(np.int64))], schema=schema).filter(pa.array(hit))

    return labelled


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int | None = None) -> Model:
    """Fit on the documents that ``labels`` (id, label) covers; an id labelled twice counts as toxic if one label says so.

    With ``most`` about that many rows of the larger class are drawn, and as large a share of the other one.
    """
    docs = plain(docs, id_col, text_col)
    one = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"))
    one = one.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")).where("label IN (0, 1)")
    if most is not None:
        larger = max((r["count"] for r in one.groupBy("label").count().collect()), default=0)
        if larger > most:
            one = one.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / larger * (1 << 30)))
    known = docs.sparkSession.sparkContext.broadcast(_packed(one))
    model = Model.of(*gram_counts(docs, _with_label(known, False), bucket_count(docs.sparkSession, 1)))
    held = _with_label(known, True)
    ddl = "label long, x array<double>"
    schema = arrow_schema(ddl)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator) -> Iterator:
        words: dict = {}
        for part in A.slices(held(batches), "text", SLICE):
            x = sent.value.evidence(part.column("text"), words)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), schema.field(1).type)], schema=schema)

    return model.fit_curve(stored(docs.mapInArrow(task, ddl)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a column ``name``: the score from 0 to 1 of the whole text.

    A column of that name is replaced; all others stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    own = [F.col(f"`{c}`") for c in kept]
    text = F.col(f"`{text_col}`")
    # A text that is kept as it is goes to the task once.
    as_it_is = text_col in kept and docs.select(text).schema[0].dataType == StringType()
    read = text_col if as_it_is else "_scored"
    rows = docs.select(*own) if as_it_is else docs.select(*own, text.cast("string").alias("_scored"))

    def task(batches: Iterator) -> Iterator:
        words: dict = {}
        for part in A.slices(batches, read, SLICE):
            values = sent.value.scores(sent.value.evidence(part.column(read), words))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(values)], names=[*part.schema.names[: len(kept)], name])

    return rows.mapInArrow(task, docs.select(*own).withColumn(name, F.lit(0.0)).schema)
