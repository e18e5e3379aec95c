"""Scope rules: which URLs belong to a crawl.

Three filters exist and differ on purpose. ``exact`` compares the host for equality and
takes patterns as substrings; ``regex`` looks for the domain inside the host and takes
patterns as regular expressions, with a depth bound; wiki links look for the domain
anywhere in the URL and have no list of valid patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtables.functions import urls as U

# What a crawl leaves out when nothing else is said.
DEFAULT_EXCLUDES = ("/admin", "/login", "/logout", "action=", "?delete")


@dataclass(frozen=True)
class Rules:
    base_domain: str | None = None
    base_url: str | None = None
    exclude: tuple[str, ...] = ()
    valid: tuple[str, ...] = ()
    mode: str = "exact"
    max_depth: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("exact", "regex"):
            raise ValueError(f"unknown scope mode {self.mode!r}")


# A pattern that counts or names its groups cannot share an expression with others.
_OWN_GROUPS = re.compile(r"\\[1-9]|\\k<|\(\?<[A-Za-z]")


def _check(patterns: tuple[str, ...]) -> None:
    """Raise for patterns that the engine which will run them (Java's) does not accept."""
    compile_ = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile
    bad = []
    for p in patterns:
        try:
            compile_(p)
        except (Py4JJavaError, IllegalArgumentException):
            bad.append(p)
    if bad:
        raise ValueError(f"not valid as Java regular expressions: {bad}")


def default_rules(start_url: str) -> Rules:
    """Rules for a start URL when the user gives none."""
    parts = urlsplit(start_url)
    return Rules(
        base_domain=parts.netloc,
        base_url=f"{parts.scheme}://{parts.netloc}",
        exclude=DEFAULT_EXCLUDES,
        valid=(parts.path or "/",),
    )


def _any_text(url: Column, texts: tuple[str, ...]) -> Column:
    """One of the texts occurs in the URL; one expression however many there are."""
    return F.exists(F.array(*[F.lit(t) for t in texts]), lambda t: url.contains(t))


def _any_regex(url: Column, patterns: tuple[str, ...]) -> Column:
    """One of the patterns is found in the URL; they are folded into one alternation."""
    _check(patterns)
    alone = [p for p in patterns if _OWN_GROUPS.search(p)]
    folded = "|".join(f"(?:{p})" for p in patterns if p not in alone)
    return reduce(lambda a, b: a | b, [url.rlike(p) for p in [*([folded] if folded else []), *alone]])


def in_scope(url: Column | str, rules: Rules) -> Column:
    """Condition of ``rules.mode`` on one URL column."""
    u = F.col(url) if isinstance(url, str) else url
    if rules.mode == "exact":
        keep = u.startswith("http://") | u.startswith("https://")
        any_of = _any_text
        if rules.base_domain:
            keep = keep & (U.netloc(u) == rules.base_domain)
    else:
        keep = u.isNotNull()
        any_of = _any_regex
        if rules.base_domain:
            keep = keep & U.netloc(u).contains(rules.base_domain)
    if rules.exclude:
        keep = keep & ~any_of(u, rules.exclude)
    if rules.valid:
        keep = keep & any_of(u, rules.valid)
    return keep


def filter_scope(
    df: DataFrame, rules: Rules, col: str = "url", depth: str | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Rows inside the scope. ``seen`` (column ``col``) takes out URLs already handled."""
    kept = df.where(in_scope(col, rules))
    if rules.max_depth is not None and depth:
        kept = kept.where(F.col(depth) <= rules.max_depth)
    if seen is not None:
        kept = kept.join(seen.select(col), col, "left_anti")
    return kept


def is_wiki_page_url(url: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return reduce(lambda a, b: a | b, [u.rlike(p) for p in U.WIKI_PAGE_PATTERNS])


def filter_wiki_links(df: DataFrame, rules: Rules, col: str = "url", pages_only: Column | None = None) -> DataFrame:
    """Wiki link filter. ``pages_only`` says which rows must also look like a page URL."""
    u = F.col(col)
    kept = df
    if pages_only is not None:
        kept = kept.where(~pages_only | is_wiki_page_url(u))
    if rules.base_domain:
        kept = kept.where(u.contains(rules.base_domain))
    if rules.exclude:
        kept = kept.where(~_any_regex(u, rules.exclude))
    return kept
