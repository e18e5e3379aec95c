"""Byte-pair encoding by speculation, and decoding.

A sequence of tokens is the encoding of its word exactly if every token encodes to itself and every pair of
neighbours is compatible: merging the text of the two alone never merges across their border. (The first
merge across any border of the whole word would also be the first one in that pair, as up to then
both sides merge as they would alone.) So words are encoded in three steps:

1. Speculate: from every place of every distinct new word the longest token is looked up, all places of a
   batch at once in a trie, and each word takes the tokens that follow each other from its start.
2. Verify: all distinct neighbours of a batch are tested at once. The right edge of the left token and the
   left edge of the right one are taken apart step by step, in the reverse order of their merges; the
   pair fails if two symbols that lie side by side on the way would have been merged there earlier.
3. Words with a failing pair, and only these, are merged exactly, by a heap of possible merges.

Texts are cut into words by the tokenizer's own normaliser and splitter, once per distinct stretch between
white space where the vocabulary file allows that (``units`` in ``packing``), else once per text.

Null and empty texts have no tokens (an empty list) and decode to an empty text. Strings of special tokens in a
text are these tokens. Truncation and padding of the file are not applied. Other columns are kept as
they are, a column named like the result is replaced; rows are not reordered or merged, so repeated ids stay repeated.
Vocabularies to which the theorem does not apply are refused with ValueError: other models than BPE,
dropout, unknown tokens, single symbols missing, merges listed before their parts, added tokens that strip.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webtables.llm import arrays as A
from webtables.llm.packing import units

NEVER = np.int64(1) << 40
#: Distinct stretches of at most SHORT bytes whose ids a worker keeps; then it starts anew.
MEMORY = 300_000
SHORT = 64
#: Bytes of text that are encoded at once (one text at least), and ids that are decoded at once (one list at least).
STEP = 2 << 20
IDS = 1 << 18

#: A splitter for which stretches between white space can be encoded one by one, and its normalisers.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Trie:
    """Symbol strings with the ids they spell; looked up from many places at once."""

    def __init__(self, entries: dict[tuple[int, ...], int], width: int):
        self.width, nodes, ids = width, {}, [-1]
        for symbols, value in entries.items():
            node = 0
            for s in symbols:
                node = nodes.setdefault(node * width + s, len(nodes) + 1)
                if node == len(ids):
                    ids.append(-1)
            ids[node] = value
        self.keys = np.fromiter(nodes, np.int64, len(nodes))
        self.next = np.fromiter(nodes.values(), np.int64, len(nodes))
        order = np.argsort(self.keys)
        self.keys, self.next, self.ids = self.keys[order], self.next[order], np.array(ids, np.int64)

    def longest(self, symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) of the longest entry from each place that ends at ``stop`` or before."""
        at = np.arange(len(symbols))
        best, size = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), np.int64)
        node = np.zeros(len(symbols), np.int64)
        depth = 0
        while len(at):
            key = node * self.width + symbols[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            at, node = at[on], self.next[k[on]]
            depth += 1
            full = self.ids[node] >= 0
            best[at[full]], size[at[full]] = self.ids[node[full]], depth
            on = at + depth < stop[at]
            at, node = at[on], node[on]
        return best, size


class Merges:
    """The merges of a byte-level vocabulary; ``encode`` turns words into ids by speculation."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        count = max(vocab.values()) + 1
        base = {vocab.get(c): b for b, c in enumerate(letters)}
        if suffix:
            base |= {vocab.get(c + suffix): 256 + b for b, c in enumerate(letters)}
        if None in base or len(base) != 256 * (2 if suffix else 1):
            raise ValueError("the vocabulary lacks single symbols")
        self.ended = bool(suffix)
        self.single = np.zeros(512, np.int64)
        self.single[list(base.values())] = list(base)
        names = {v: k for k, v in vocab.items()}
        spell: dict[int, tuple[int, ...]] = {i: (s,) for i, s in base.items()}
        self.left, self.right = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        self.born = np.full(count, -1, np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if x not in spell or y not in spell or z in spell:
                raise ValueError(f"merge {r} comes before its parts or makes a known token: {names[z]!r}")
            spell[z] = spell[x] + spell[y]
            self.left[z], self.right[z], self.born[z], self.rank[x, y] = x, y, r, (r, z)
        self.count = count
        key = np.array([x * count + y for x, y in self.rank], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = np.append(key[order], np.iinfo(np.int64).max), np.append(order, NEVER)
        made = np.flatnonzero(self.left >= 0)
        own = self.compatible(self.left[made], self.right[made], own=True)
        lost = set(made[~own].tolist())
        for z in made[np.argsort(self.born[made])].tolist():
            if self.left[z] in lost or self.right[z] in lost:
                lost.add(z)
        self.trie = Trie({s: i for i, s in spell.items() if i not in lost}, 512)

    def _merged_at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank at which two symbols merge, or NEVER."""
        key = x * self.count + y
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[k] == key, self.ranks[k], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, own: bool = False) -> np.ndarray:
        """For each pair of tokens: do they stay apart when merged together? (``own``: but for their own last merge.)

        ``until_x`` and ``until_y`` are the ranks at which the symbols vanish into the next larger one of their
        side. Of equal merges the leftmost comes first, so a merge across the border at just ``until_y``
        comes before that one, and one at ``until_x`` after it.
        """
        good = np.ones(len(x), bool)
        at = np.arange(len(x))
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        while len(at):
            rank = self._merged_at(x, y)
            if own:
                rank[:], own = NEVER, False
            across = (rank < until_x) & (rank <= until_y)
            good[at[across]] = False
            bx, by = self.born[x], self.born[y]
            on = ~across & (np.maximum(bx, by) >= 0)
            at, x, y, bx, by, until_x, until_y = (v[on] for v in (at, x, y, bx, by, until_x, until_y))
            # The later merge is undone first. Equal merges on both sides: the left one came first, the right one is undone.
            undo = bx > by
            until_x, until_y = np.where(undo, bx, until_x), np.where(undo, until_y, by)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ``ids[first[k]:first[k + 1]]`` belong to word k; ``exact`` counts the merged ones."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.ended:
            symbols[stop[size > 0] - 1] += 256
        token, length = self.trie.longest(symbols, np.repeat(stop, size))
        taken = self._followed(length, (stop - size)[size > 0], stop[size > 0])
        at = np.flatnonzero(taken)
        ids, word = token[at], np.searchsorted(stop, at, "right")
        same = np.flatnonzero(word[1:] == word[:-1])
        pair, which = np.unique(ids[same] * self.count + ids[same + 1], return_inverse=True)
        good = self.compatible(pair // self.count, pair % self.count)
        failing = np.unique(word[same[~good[which]]])
        self.exact = len(failing)
        n = np.bincount(word, minlength=len(words))
        if not len(failing):
            return ids, np.concatenate([[0], np.cumsum(n)])
        merged = [self.merge(symbols[stop[k] - size[k] : stop[k]]) for k in failing.tolist()]
        bad = np.zeros(len(words), bool)
        bad[failing] = True
        keep = ~bad[word]
        n[failing] = [len(m) for m in merged]
        first = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(first[-1], np.int64)
        target = np.ones(len(out), bool)
        for k, m in zip(failing.tolist(), merged):
            out[first[k] : first[k + 1]] = m
            target[first[k] : first[k + 1]] = False
        out[target] = ids[keep]
        return out, first

    @staticmethod
    def _followed(length: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Marks the places reached from each start by stepping over the tokens found there."""
        taken = np.zeros(len(length), bool)
        at = start
        for _ in range(64):
            taken[at] = True
            at = at + length[at]
            on = at < stop
            at, stop = at[on], stop[on]
            if not len(at):
                return taken
        for p, end in zip(at.tolist(), stop.tolist()):  # very long words
            own, step = [], length[p:end].tolist()
            k = 0
            while k < len(step):
                own.append(k)
                k += step[k]
            taken[np.array(own) + p] = True
        return taken

    def merge(self, symbols: np.ndarray) -> list[int]:
        """The ids of one word by its merges in order of rank, of equal ones the leftmost first."""
        ids = self.single[symbols].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank = self.rank
        heap = [(*rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heap = [(r, k, z) for r, z, k in heap]
        heapq.heapify(heap)
        while heap:
            r, k, z = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or rank.get((ids[k], ids[j]), (-1,))[0] != r:
                continue
            ids[k], ids[j] = z, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                new = rank.get((z, ids[after[k]]))
                if new:
                    heapq.heappush(heap, (new[0], k, new[1]))
            if before[k] >= 0:
                new = rank.get((ids[before[k]], z))
                if new:
                    heapq.heappush(heap, (new[0], before[k], new[1]))
        return [i for i in ids if i >= 0]


class Codec:
    """What encoding needs of a vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        last = pre.get("pretokenizers", [pre])[-1]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or last.get("type") != "ByteLevel" or last.get("add_prefix_space"):
            raise ValueError(f"no plain byte-level BPE: {odd or last}")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip or are normalised")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        split = pre.get("pretokenizers", [{}])[0]
        self.by_units = (
            (spec["normalizer"] or {}).get("normalizers") == _NORMAL and model["end_of_word_suffix"]
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
            and all("<|" in t and not set(t) & set(" \t\n\x0b\x0c\r") for t in self.added)
        )
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.known: dict[bytes, bytes] = {}

    def _words(self, text: str) -> list[bytes | int]:
        """The words of a stretch as bytes, special tokens as their ids."""
        out: list[bytes | int] = []
        at = 0
        for found in [*self.special.finditer(text), None]:
            piece = text[at : found.start() if found else len(text)]
            if piece and self.normalizer:
                piece = self.normalizer.normalize_str(piece)
            if piece:
                out += [bytes(map(self.letters.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(piece)]
            if found:
                out.append(self.added[found.group()])
                at = found.end()
        return out

    def _encoded(self, stretches: list[bytes]) -> list[bytes]:
        """The ids of stretches not seen before; plain lower-case ones are words as they stand."""
        simple = re.compile(rb"[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+").fullmatch
        parts = [[w] if self.by_units and simple(w) and b"<|" not in w else self._words(w.decode()) for w in stretches]
        number: dict[bytes, int] = {}
        for p in parts:
            for w in p:
                if not isinstance(w, int):
                    number.setdefault(w, len(number))
        ids, first = self.merges.encode(list(number)) if number else (np.empty(0, np.int64), np.zeros(1, np.int64))
        raw, first = ids.astype("<u4").tobytes(), (4 * first).tolist()
        return [b"".join(x.to_bytes(4, "little") if isinstance(x, int) else raw[first[number[x]] : first[number[x] + 1]] for x in p) for p in parts]

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ``ids[first[d]:first[d + 1]]`` belong to row d."""
        if self.by_units:
            s, e, first = units(data, off)
            text, s, e = A.joined(A.LOWER[data], s, e)
            ends = np.append(s, len(text))
        else:
            text, ends, first = data, off, np.arange(len(off))
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.by_units:
            distinct = [w[:-1] for w in distinct]
        if len(self.known) > MEMORY:
            self.known.clear()
        here = {w: self.known[w] for w in distinct if w in self.known}
        new = [w for w in distinct if w not in here]
        here.update(zip(new, self._encoded(new)))
        self.known.update((w, here[w]) for w in new if len(w) <= SHORT)
        parts = [here[w] for w in distinct]
        flat = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        which = coded.indices.to_numpy()
        length = size[which]
        ids = flat[np.repeat((np.cumsum(size) - size)[which], length) + A.ranges(length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[first]


class Names:
    """What decoding needs of a vocabulary file: the string of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            strings[i] = name
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder: {kind}")
        self.strings, self.raw = pa.array(strings), None
        if kind:
            letters = {c: b for b, c in enumerate(byte_letters())}
            self.raw = [bytes(map(letters.get, s)) if all(c in letters for c in s) else s.encode() for s in strings]

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The decoded text of each list of ids, special tokens included."""
        if self.raw is None:
            size = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(off, self.strings.take(ids.flatten())), " ")
        return pa.array([b"".join(map(self.raw.__getitem__, row)).decode("utf-8", "replace") for row in ids.to_pylist()], pa.string())


_READ: dict[tuple[type, str], Codec | Names] = {}


def _read(kind: type, path: str):
    """A vocabulary file as ``kind``, read once per worker."""
    if (kind, path) not in _READ:
        _READ[kind, path] = kind(path)
    return _READ[kind, path]


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, list[int]]:
    """Schema with ``name`` last, and the places of the columns kept before it."""
    keep = [k for k, f in enumerate(df.schema.fields) if f.name.lower() != name.lower()]
    return T.StructType([df.schema.fields[k] for k in keep] + [T.StructField(name, kind)]), keep


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of the whole text, by the vocabulary file ``path`` of every machine."""
    schema, keep = _with(docs, ids, T.ArrayType(T.IntegerType(), False))

    def task(batches: Iterator) -> Iterator:
        c = _read(Codec, path)
        for part in A.slices(batches, text, STEP, 4096):
            flat, first = c.ids(*A.text_bytes(part.column(text)))
            lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(flat.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], names=schema.names)

    return docs.mapInArrow(task, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add ``text``, the text that the token ids spell, special tokens included; a null list gives an empty text."""
    schema, keep = _with(docs, text, T.StringType())

    def task(batches: Iterator) -> Iterator:
        c = _read(Names, path)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + IDS, "right")), at + 1)
                part = batch.slice(at, stop - at)
                lists = part.column(ids).fill_null(pa.scalar([], part.column(ids).type))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), c.texts(lists)], names=schema.names)
                at = stop

    return docs.mapInArrow(task, schema)
