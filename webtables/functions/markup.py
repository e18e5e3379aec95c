"""HTML as tokens: the patterns and the Column expressions that read single tokens.

Every loop in these patterns is possessive (or lazy over a single class), so matching is
iterative in the JVM: a tag with hundreds of thousands of attributes, an unclosed quote
or a data: URI of some MB neither recurses nor backtracks.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions.stages import let

# A tag, a declaration, a run of text, or a stray '<'. A quoted value (after '=') may hide '>'. Whatever
# never closes runs to the end of the page, so that its text is read once and not once per opener.
TOKEN = (
    r"""(</?[A-Za-z][^\s/>]*+(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"""
    r"""|<![^>]*+(?:>|\z)|[^<]++|<)"""
)

# Elements whose content is text whatever it looks like.
RAW_TAGS = ("script", "style")

# As TOKEN, but a comment, and a raw element with its text and end tag, are one token each.
WHOLE = (
    r"((?s:<!--.*?(?:-->|\z))|"
    + "|".join(rf"(?is:<{t}(?:[\s/][^>]*+)?+>.*?(?:</{t}(?:[\s/][^>]*+)?+(?:>|\z)|\z))" for t in RAW_TAGS)
    + "|" + TOKEN[1:]
)

# Elements that never have content.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)

def _read_number(n: int) -> str:
    """What HTML reads for the numbers 0 to 159: most control characters are dropped, 128 to 159 are Windows-1252."""
    if n in (0, 13):
        return "\ufffd\r"[n == 13]
    if n >= 0x80:
        return bytes([n]).decode("cp1252", "ignore") or chr(n)
    return "" if n < 9 or n == 11 or 14 <= n < 32 or n == 127 else chr(n)


# Names with their semicolon, the ones of mark-up itself first as they are looked up most; names
# that HTML decodes without a semicolon as well, longest first; and the low numbers.
FULL = {k: html5[k] for k in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")} | {k: v for k, v in html5.items() if k.endswith(";")}
BARE = {k: html5[k] for k in sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)}
LOW = {str(n): _read_number(n) for n in range(0xA0)}
_BARE = f"^(?>{'|'.join(BARE)})"
_NUMBER = "^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?"


def hidden_pattern(tags: tuple[str, ...]) -> str:
    """Comments and the whole bodies of ``tags``, leftmost first, in one pass; unclosed ones reach the end."""
    bodies = [rf"{t}(?:[\s/][^>]*+)?+(?:>.*?(?:</{t}(?:[\s/][^>]*+)?+(?:>|\z)|\z)|\z)" for t in tags]
    # The shared '<' in front lets the matcher skip to the next tag at once.
    return "(?is)<(?:" + "|".join([r"!--.*?(?:-->|\z)", *bodies]) + ")"


def visible(html: Column, tags: tuple[str, ...] = ("script", "style", "noscript")) -> Column:
    """HTML without comments and without the bodies of ``tags``."""
    return F.regexp_replace(html, hidden_pattern(tags), "")


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1))


def tag_name(tok: Column) -> Column:
    """Lower-case tag name, '' for text, declarations and a tag that the end of the page cuts off."""
    return F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][^\s/>]*)(?s:.*)>$", 1))


def _attr_pattern(name: str) -> str:
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
    other = rf"[\s/]++(?!{name}[\s=/>])[^\s=/>\"']++(?:\s*+=\s*+{value})?+"
    return rf"(?is)^<[A-Za-z][^\s/>]*+(?:{other})*+[\s/]++{name}(?=[\s=/>])(?:\s*+=\s*+({value}))?+"


def has_attr(tok: Column, name: str) -> Column:
    return tok.rlike(_attr_pattern(name))


def raw_attr(tok: Column, name: str) -> Column:
    """Attribute value without its quotes, '' when empty or absent."""
    return F.regexp_replace(F.regexp_extract(tok, _attr_pattern(name), 1), r"""^["']|["']$""", "")


def attr(tok: Column, name: str) -> Column:
    """As raw_attr, with character references decoded."""
    return unescape(raw_attr(tok, name), in_attribute=True)


def set_attr(tok: Column, name: str, value: Column) -> Column:
    """The tag with one present attribute set to ``value``, double-quoted and escaped."""

    def put(m: Column) -> Column:
        head = F.substring(m["all"], F.lit(1), F.length(m["all"]) - F.length(m["old"]))
        equals = F.when((m["old"] == "") & ~head.rlike(r"=\s*$"), "=").otherwise("")
        tail = F.substring(tok, F.length(m["all"]) + 1, F.length(tok))
        return F.concat(head, equals, F.lit('"'), escape(value), F.lit('"'), tail)

    pattern = _attr_pattern(name)
    return let(F.struct(F.regexp_extract(tok, pattern, 0).alias("all"), F.regexp_extract(tok, pattern, 1).alias("old")), put)


def escape(text: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def has_class(tok: Column, *names: str) -> Column:
    """The class list of the tag holds one of ``names``."""
    listed = F.concat(F.lit(" "), F.regexp_replace(raw_attr(tok, "class"), r"\s+", " "), F.lit(" "))
    wanted = "|".join(re.escape(n) for n in names)
    return tok.rlike("(?i)class") & listed.rlike(f" (?:{wanted}) ")


def _table(entries: dict[str, str]) -> Column:
    """A map as one constant; the optimizer folds it before anything runs."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(p: Column) -> Column:
    """The character of '#65;' or '#x41' at the start of ``p``; '' for those HTML forbids, NULL without one."""
    digits = F.upper(F.regexp_extract(p, "^#(?:[xX]0*+([0-9A-Fa-f]*)|0*+([0-9]*))", 0))
    digits = F.regexp_replace(digits, "^#(X?)0+(?=.)", "#$1")
    number = F.when(F.length(digits) > 9, 0x110000).otherwise(
        F.when(digits.startswith("#X"), F.conv(F.substring(digits, 3, 9), 16, 10)).otherwise(F.substring(digits, 2, 9)).cast("int")
    )
    outside = number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return (
        F.when(number < 0xA0, F.element_at(_table(LOW), number.cast("string")))
        .when(outside, "\ufffd")
        .when(number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE), "")
        .otherwise(_code_point(number))
    )


def _named(p: Column, in_attribute: bool) -> Column:
    """(decoded name + rest) of a piece after '&'; NULL without a known name."""
    # In an attribute '&copy=1' is a parameter of a URL, not a sign.
    bare = _BARE + ("(?![=A-Za-z0-9])" if in_attribute else "")
    full = F.element_at(_table(FULL), F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]*;", 0))
    short = F.element_at(_table(BARE), F.regexp_extract(p, bare, 0))
    return F.coalesce(F.concat(full, F.regexp_replace(p, "^[A-Za-z0-9]*;", "")), F.concat(short, F.regexp_replace(p, bare, "")))


def unescape(text: Column, in_attribute: bool = False) -> Column:
    """Decode all character references as HTML does; text without '&' passes untouched."""

    def piece(p: Column) -> Column:
        number = F.concat(_numeric(p), F.regexp_replace(p, _NUMBER, ""))
        return F.coalesce(F.when(p.rlike(_NUMBER), number).otherwise(_named(p, in_attribute)), F.concat(F.lit("&"), p))

    def whole(t: Column) -> Column:
        parts = F.split(t, "&")
        decoded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))
        return F.when(t.contains("&"), decoded).otherwise(t)

    # A one-element transform names the text, so that a long expression is not copied into every use.
    return F.element_at(F.transform(F.array(text), whole), 1)


def strip_blank(text: Column) -> Column:
    """Trim every kind of white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s++|\s++$", "")
