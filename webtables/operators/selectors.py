"""CSS selectors over the element tree: find elements, remove them.

Selectors are compiled to predicates on tags and to bits. Every compound of every chain has a bit; an
element gets the bits of the compounds its own tag satisfies, and keeps one if the compound before it was matched by an
element round it (blank) or by its parent (``>``). The bits of the open elements are carried along the page's tokens, so
a chain of any length costs one fold, inside the page's row.

Understood: ``tag``, ``*``, ``#id``, ``.class``, ``[name]``, the operators ``= ~= |= ^= $= *=`` with a plain or quoted value
and an ``i`` behind it, blanks and ``>`` between compounds, and commas. Names of tags and attributes are read without regard to
case, values with. Anything else (pseudo-classes, ``+``, ``~``, escapes) raises ValueError when the selectors are compiled.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import markup as M
from webtables.functions.stages import let, pin
from webtables.operators.tree import markup_of, outside, scan, token_structs, with_elements

_NAME = r"[\w-]+"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s\]"']+)"""
_PART = re.compile(rf"""([#.])({_NAME})|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*({_VALUE})\s*([iI])?\s*)?\]""")
_TAG = re.compile(rf"\*|{_NAME}")
_BETWEEN = re.compile(r"\s*([>,])\s*|\s+")
_BITS = 62


class Test(NamedTuple):
    """One condition on an attribute; ``op`` is '' for its presence."""

    name: str
    op: str = ""
    value: str = ""
    fold: bool = False


class Compound(NamedTuple):
    """What one element must satisfy. ``child``: the compound before it must be matched by the parent."""

    tag: str
    tests: tuple[Test, ...]
    child: bool = False


def compile_selectors(text: str) -> list[tuple[Compound, ...]]:
    """The chains of a list of selectors, outermost compound first."""
    chains: list[list[Compound]] = [[]]
    at, child, text = 0, False, text.strip()
    while True:
        start = at
        tag = _TAG.match(text, at)
        name = tag.group().lower() if tag else "*"
        at = tag.end() if tag else at
        tests = []
        while part := _PART.match(text, at):
            mark, word, attr, op, value, fold = part.groups()
            if mark:
                tests.append(Test("id", "=", word) if mark == "#" else Test("class", "~=", word))
            else:
                plain = value[1:-1] if value and value[0] in "\"'" else value or ""
                tests.append(Test(attr.lower(), op or "", plain, bool(fold)))
            at = part.end()
        if at == start:
            raise ValueError(f"no selector at {text[at:]!r}")
        chains[-1].append(Compound(name, tuple(tests), child))
        if at == len(text):
            return [tuple(c) for c in chains]
        between = _BETWEEN.match(text, at)
        if not between or between.end() == len(text):
            raise ValueError(f"cannot read {text[at:]!r}")
        child, at = between.group(1) == ">", between.end()
        if between.group(1) == ",":
            chains.append([])


def _holds(tok: Column, test: Test) -> Column:
    if not test.op:
        return M.has_attr(tok, test.name)
    value, wanted = M.attr(tok, test.name), test.value
    if test.fold:
        value, wanted = F.lower(value), wanted.lower()
    if test.op == "=":
        return M.has_attr(tok, test.name) & (value == wanted)
    if test.op == "|=":
        return M.has_attr(tok, test.name) & ((value == wanted) | value.startswith(f"{wanted}-"))
    if not wanted or (test.op == "~=" and re.search(r"\s", wanted)):
        return F.lit(False)
    if test.op == "~=":
        return F.concat(F.lit(" "), F.regexp_replace(value, r"\s+", " "), F.lit(" ")).contains(f" {wanted} ")
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[test.op](wanted)


def _satisfies(t: Column, c: Compound) -> Column:
    """The compound's own conditions on an opening tag; attributes are only read where the name occurs at all."""
    conditions = [] if c.tag == "*" else [t["tag"] == c.tag]
    for test in c.tests:
        conditions += [t["tok"].rlike(f"(?i)[\\s/]{re.escape(test.name)}"), _holds(t["tok"], test)]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any_bit(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _matched(chains: list[tuple[Compound, ...]]) -> Column:
    """One boolean per element: does it end one of the chains?"""
    bits = [c for chain in chains for c in chain]
    ends = [len(chain) for chain in chains]
    first, child, last, k = 0, 0, 0, 0
    for n in ends:
        first, last = first | 1 << k, last | 1 << (k + n - 1)
        child |= sum(1 << j for j in range(k + 1, k + n) if bits[j].child)
        k += n
    inside = ((1 << k) - 1) & ~first & ~child

    def own(e: Column) -> Column:
        t = F.get("toks", e["at"])
        return reduce(_any_bit, [F.when(_satisfies(t, c), F.lit(1 << j)).otherwise(F.lit(0)).cast("bigint") for j, c in enumerate(bits)])

    if all(n == 1 for n in ends):
        return F.transform("elements", lambda e: own(e) != 0)

    def step(s: Column, x: Column) -> Column:
        up = x["depth"] - 1

        def of(name: str) -> Column:
            return F.when(up >= 0, F.coalesce(F.get(s[name], up), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))

        before = _any_bit(F.shiftleft(of("round"), 1).bitwiseAND(inside), F.shiftleft(of("parent"), 1).bitwiseAND(child))
        here = x["bits"].bitwiseAND(_any_bit(before, F.lit(first)))

        def moved(h: Column) -> Column:
            held = F.concat(F.slice(s["round"], F.lit(1), x["depth"]), F.array(_any_bit(of("round"), h)))
            mine = F.concat(F.slice(s["parent"], F.lit(1), x["depth"]), F.array(h))
            kept = F.struct(s["round"].alias("round"), s["parent"].alias("parent"), h.alias("here"))
            return F.when(x["opens"], F.struct(held.alias("round"), mine.alias("parent"), h.alias("here"))).otherwise(kept)

        return let(here.cast("bigint"), moved)

    none = F.array().cast("array<bigint>")
    zero = F.struct(none.alias("round"), none.alias("parent"), F.lit(0).cast("bigint").alias("here"))
    items = F.transform("elements", lambda e: F.struct(own(e).alias("bits"), e["depth"].alias("depth"), e["opens"].alias("opens")))
    return scan(items, zero, step, lambda s, x: s["here"].bitwiseAND(last) != 0, "boolean")


def _with_matches(pages: DataFrame, selectors: str | tuple[str, ...]) -> DataFrame:
    """Add ``toks`` (the whole page; a script or style element with its text is one token) and ``hits``, the matching elements."""
    text = selectors if isinstance(selectors, str) else ", ".join(selectors)
    chains = compile_selectors(text)
    if max(map(len, chains)) > _BITS:
        raise ValueError(f"a chain of more than {_BITS} compounds")
    parts: list[list] = [[]]
    for chain in chains:
        if sum(map(len, parts[-1])) + len(chain) > _BITS:
            parts.append([])
        parts[-1].append(chain)
    found = pin(pages, {"toks": token_structs(F.coalesce("html", F.lit("")), M.WHOLE, M.RAW_TAGS)}, drop=("html",))
    found = with_elements(found)
    hit = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x | y), [_matched(part) for part in parts])
    hits = F.filter(F.zip_with("elements", hit, lambda e, h: F.when(h, e)), lambda e: e.isNotNull())
    return pin(found, {"hits": hits}, drop=("elements",))


def select_elements(pages: DataFrame, selectors: str | tuple[str, ...]) -> DataFrame:
    """(page_id, pos, tok, html): the matching elements of each page in page order, with their whole mark-up."""
    found = _with_matches(pages.select("page_id", "html"), selectors)

    def element(e: Column) -> Column:
        end = F.coalesce(e["end"], F.size("toks") - 1)
        whole = markup_of(F.slice("toks", e["at"] + 1, end - e["at"] + 1))
        return F.struct(e["at"].alias("pos"), F.get("toks", e["at"])["tok"].alias("tok"), whole.alias("html"))

    return found.select("page_id", F.explode(F.transform("hits", element)).alias("e")).select("page_id", "e.*")


def remove_elements(pages: DataFrame, selectors: str | tuple[str, ...]) -> DataFrame:
    """(page_id, html) without the matching elements and all they hold; everything else stays byte for byte."""
    found = _with_matches(pages.select("page_id", "html"), selectors)
    gone = F.transform("hits", lambda e: F.struct(e["at"].alias("at"), e["end"].alias("end")))
    return pin(found, {"__gone": gone}).select("page_id", markup_of(outside(F.col("toks"), F.col("__gone"))).alias("html"))
