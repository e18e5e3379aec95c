"""URL columns: split, clean, normalise, resolve, identify, map to local paths.

The splitting follows RFC 3986 appendix B. ``parse_url`` is not used: it returns NULL on
spaces and keeps ``;params``. All functions take and return Columns; the ``with_*``
functions stage intermediate columns so that no regex runs twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions.stages import let, pin

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_RE_SCHEME = rf"^({_SCHEME}):"
_RE_NETLOC = rf"^(?:{_SCHEME}:)?//([^/?#]*)"
_RE_PATH = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"
_RE_QUERY = r"^[^?#]*\?([^#]*)"
_RE_FRAGMENT = r"(?s)^[^#]*#(.*)"
_RE_PARAMS = r";[^/]*$"
_RE_DOTS = r"(?:^|/)\.\.?(?:/|$)"

# Schemes whose last path segment may carry ;params (Python stdlib rule).
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "sip", "sips", "mms", "sftp", "tel",
)

# Leading path parts that local paths leave out.
LOCAL_PATH_PREFIXES = ("/wiki/", "/docs/", "/help/")

# Page id patterns, first match wins.
PAGE_ID_PATTERNS = (r"/pages/(\d+)", r"pageId=(\d+)", r"/content/(\d+)", r"/(\d{6,})")
PAGE_ID_PATTERNS_PLAIN = (r"/pages/(\d+)", r"pageId=(\d+)", r"/(\d{6,})")

# URL shapes of a wiki site (any letter case) and of a wiki page.
WIKI_SITE_PATTERNS = (
    r"\.atlassian\.net", r"/wiki/", r"/confluence/", r"/display/", r"/pages/", r"/rest/api/content/",
)
WIKI_PAGE_PATTERNS = (r"/pages/", r"/display/", r"/viewpage\.action", r"/content/")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- parts ---------------------------------------------------------------------------


def tidy(c: Column | str) -> Column:
    """Drop leading control characters and blanks, and any tab or line break inside."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _RE_SCHEME, 1))


def netloc(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _RE_NETLOC, 1)


def full_path(c: Column | str) -> Column:
    """Path with ;params of the last segment still on it."""
    return F.regexp_extract(_col(c), _RE_PATH, 1)


def query(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _RE_QUERY, 1)


def fragment(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _RE_FRAGMENT, 1)


def cut_params(path: Column) -> Column:
    return F.regexp_replace(path, _RE_PARAMS, "")


def path(c: Column | str) -> Column:
    raw = full_path(c)
    return F.when(scheme(c).isin(*PARAM_SCHEMES), cut_params(raw)).otherwise(raw)


# --- clean and normalise -------------------------------------------------------------


def clean_url(c: Column | str) -> Column:
    """scheme://netloc/path without query, fragment and ;params."""
    u = tidy(c)
    return F.concat(scheme(u), F.lit("://"), netloc(u), path(u))


def normalize_url(c: Column | str) -> Column:
    """As clean_url, but the query stays."""
    u = tidy(c)
    q = query(u)
    return F.concat(clean_url(c), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def with_clean_url(df: DataFrame, col: str = "url", out: str = "clean_url") -> DataFrame:
    return df.withColumn(out, clean_url(col))


def with_normalized_url(df: DataFrame, col: str = "url", out: str = "normalized_url") -> DataFrame:
    return df.withColumn(out, normalize_url(col))


# --- resolve -------------------------------------------------------------------------


def fold_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments; untouched paths skip the fold."""
    segs = F.split(p, "/", -1)
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(p.rlike(_RE_DOTS), F.array_join(F.concat(folded, tail), "/")).otherwise(p)


def _url_parts(href: Column, base: Column) -> dict[str, Column]:
    """Parts of a tidy href (h*) and of a tidy base (b*)."""
    return {
        "hs": scheme(href), "hn": netloc(href), "hp": full_path(href), "hq": query(href), "hf": fragment(href),
        "bs": scheme(base), "bn": netloc(base), "bp": full_path(base), "bq": query(base),
    }


def _joined_path(c) -> Column:
    """The path of an href with a path of its own, dot segments still in it; ``c`` has the parts."""
    main = cut_params(c["hp"])
    base_dir = F.regexp_replace(F.when(c["bp"] == "", "/").otherwise(cut_params(c["bp"])), r"[^/]*$", "")
    return F.when(c["hp"].startswith("/"), main).otherwise(F.regexp_replace(F.concat(base_dir, main), "/{2,}", "/"))


def _joined_url(c, dots: Column, base: Column, href: Column) -> Column:
    """The joined URL from the parts ``c`` and the folded path ``dots``."""
    rooted = F.when(dots.startswith("/"), dots).otherwise(F.concat(F.lit("/"), dots))
    params = F.substring(c["hp"], F.length(cut_params(c["hp"])) + 1, F.length(c["hp"]))
    origin = F.concat(c["bs"], F.lit("://"), c["bn"])
    q = F.when(c["hq"] != "", F.concat(F.lit("?"), c["hq"])).otherwise(F.lit(""))
    base_q = F.when(c["bq"] != "", F.concat(F.lit("?"), c["bq"])).otherwise(F.lit(""))
    f = F.when(c["hf"] != "", F.concat(F.lit("#"), c["hf"])).otherwise(F.lit(""))
    return (
        F.when(href == "", base)
        .when(base == "", href)
        .when((c["hs"] != "") & (c["hs"] != c["bs"]), href)
        .when(c["hn"] != "", F.concat(c["bs"], F.lit("://"), c["hn"], c["hp"], q, f))
        .when(c["hp"] == "", F.concat(origin, c["bp"], F.when(c["hq"] != "", q).otherwise(base_q), f))
        .otherwise(F.concat(origin, rooted, params, q, f))
    )


def with_resolved(df: DataFrame, base: str, href: str, out: str = "abs_url") -> DataFrame:
    """Join ``href`` onto ``base`` as a browser would (RFC 3986 with the usual leniency)."""
    t = "__r_"
    staged = df.withColumns({f"{t}h": tidy(href), f"{t}b": tidy(base)})
    staged = staged.withColumns({f"{t}{k}": v for k, v in _url_parts(F.col(f"{t}h"), F.col(f"{t}b")).items()})
    c = {k: F.col(f"{t}{k}") for k in ("hs", "hn", "hp", "hq", "hf", "bs", "bn", "bp", "bq")}
    staged = staged.withColumn(f"{t}j", _joined_path(c)).withColumn(f"{t}d", fold_dots(F.col(f"{t}j")))
    temps = tuple(n for n in staged.columns if n.startswith(t))
    return pin(staged, {out: _joined_url(c, F.col(f"{t}d"), F.col(base), F.col(href))}, drop=temps)


def resolved(base: Column, href: Column) -> Column:
    """As with_resolved, for use on the items of an array."""

    def parts(s: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in _url_parts(tidy(s["h"]), tidy(s["b"])).items()])

    def joined(s: Column) -> Column:
        return let(parts(s), lambda c: let(let(_joined_path(c), fold_dots), lambda d: _joined_url(c, d, s["b"], s["h"])))

    return let(F.struct(href.alias("h"), base.alias("b")), joined)


def with_wiki_resolved(df: DataFrame, base_url: str, href: str = "href", out: str = "abs_url") -> DataFrame:
    """Wiki-API rule: root-relative hrefs get the base in front, http ones stay, others go."""
    h = F.col(href)
    absolute = F.when(h.startswith("/"), F.concat(F.lit(base_url.rstrip("/")), h)).otherwise(h)
    return pin(df.where(h.startswith("/") | h.startswith("http")), {out: absolute})


# --- identify ------------------------------------------------------------------------


def page_id(c: Column | str, patterns: tuple[str, ...] = PAGE_ID_PATTERNS) -> Column:
    """First matching page id, NULL when there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_col(c), p, 1), F.lit("")) for p in patterns])


def space_key(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"/spaces/([^/]+)", 1), F.lit(""))


def last_segment(c: Column | str) -> Column:
    """Last non-empty path part, NULL when the path has none."""
    return F.nullif(F.regexp_extract(path(c), r"([^/]+)/*$", 1), F.lit(""))


def is_space_index(c: Column | str, space: str | None = None) -> Column:
    """A URL that lists a space: has /spaces/ and /overview, or ends with the space name."""
    u = _col(c)
    ends = u.endswith(space) if space else F.coalesce(u.endswith(space_key(u)), F.lit(False))
    return u.contains("/spaces/") & (u.contains("/overview") | ends)


def site_type(c: Column | str, override: Column | None = None) -> Column:
    """'confluence' or 'html'; an override of true or false wins over detection."""
    u = _col(c)
    found = F.lit(False)
    for p in WIKI_SITE_PATTERNS:
        found = found | u.rlike(f"(?i){p}")
    auto = F.when(F.coalesce(found, F.lit(False)), "confluence").otherwise("html")
    if override is None:
        return auto
    o = F.lower(override.cast("string"))
    return F.when(o == "true", "confluence").when(o == "false", "html").otherwise(auto)


# --- local paths ---------------------------------------------------------------------


def percent_decode(c: Column) -> Column:
    """Decode %XX as UTF-8; plus signs and broken escapes stay as they are."""
    safe = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.try_url_decode(safe)).otherwise(c)


def extension(fmt: str) -> str:
    return ".md" if fmt == "markdown" else ".html"


def _stored_path(c: Column | str) -> Column:
    """URL path without the leading parts that local paths leave out."""
    return F.regexp_replace(path(c), f"^(?:{'|'.join(LOCAL_PATH_PREFIXES)})", "")


def _file_name(p: Column, ext: str) -> Column:
    named = (
        F.when(p.isin("", "/"), f"index{ext}")
        .when(p.endswith("/"), F.concat(p, F.lit(f"index{ext}")))
        .when(p.endswith(".html") | p.endswith(".md"), p)
        .otherwise(F.concat(p, F.lit(ext)))
    )
    return F.translate(named, '<>:"|?*', "_______")


def _below(p: Column, out_dir: str) -> Column:
    return F.concat(F.lit(f"{out_dir}/"), F.regexp_replace(p, "^/+", ""))


def with_local_path(
    df: DataFrame, col: str = "clean_url", fmt: str = "markdown", out_dir: str = "out", out: str = "local_path"
) -> DataFrame:
    """File a page is stored under. Staged, so that every step runs once per row."""
    p = F.col("__path")
    df = df.withColumn("__path", _stored_path(col))
    df = df.withColumn("__path", _file_name(p, extension(fmt)))
    df = df.withColumn("__path", percent_decode(p))
    return df.withColumn(out, _below(p, out_dir)).drop("__path")


def local_path(u: Column, fmt: str = "markdown", out_dir: str = "out") -> Column:
    """As with_local_path, for use on the items of an array."""
    named = let(_stored_path(u), lambda p: _file_name(p, extension(fmt)))
    return _below(let(named, percent_decode), out_dir)


def page_dir(c: Column | str, space: Column, fmt: str = "markdown", out_dir: str = "out") -> Column:
    """Wiki layout: spaces/SPACE/pages/ID/index.ext."""
    u = _col(c)
    ident = F.coalesce(
        page_id(u, PAGE_ID_PATTERNS_PLAIN), last_segment(u), F.concat(F.lit("page_"), F.substring(F.md5(u), 1, 10))
    )
    return F.concat(F.lit(f"{out_dir}/spaces/"), space, F.lit("/pages/"), ident, F.lit(f"/index{extension(fmt)}"))


def dirname(p: Column) -> Column:
    """Directory part of a file path, '' when there is none."""
    return F.regexp_replace(p, r"/?[^/]*$", "")


def flat_parts(p: Column) -> Column:
    """The parts of a path, dot segments folded."""
    return F.filter(F.split(fold_dots(F.regexp_replace(p, "/{2,}", "/")), "/", -1), lambda s: s != "")


def _shared_parts(a: Column, b: Column) -> Column:
    """How many parts two paths share from the start on."""
    same = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return let(same, lambda n: F.when(n == 0, F.least(F.size(a), F.size(b))).otherwise(n - 1).cast("int"))


def _climbed(a: Column, b: Column, n: Column) -> Column:
    """From the directory of parts ``b`` to the file of parts ``a``, which share ``n`` parts."""
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - n), F.slice(a, n + 1, F.size(a))), "/")


def with_rel_path(df: DataFrame, target: str, start_dir: str, out: str = "rel_path") -> DataFrame:
    """Relative path from a directory to a file, '/' separators. NULL in, NULL out."""
    a, b = F.col("__to"), F.col("__from")
    df = df.withColumns({"__to": flat_parts(F.col(target)), "__from": flat_parts(F.col(start_dir))})
    df = df.withColumn("__same", F.when(a.isNotNull() & b.isNotNull(), _shared_parts(a, b)))
    df = df.withColumn("__to", F.when(F.col("__same").isNotNull(), _climbed(a, b, F.col("__same"))))
    return df.withColumn(out, F.when(F.col("__to") == "", ".").otherwise(F.col("__to"))).drop("__to", "__from", "__same")


def rel_path(target: Column, start_parts: Column) -> Column:
    """As with_rel_path, for use on the items of an array; ``start_parts`` is the directory as ``flat_parts``. No NULLs."""

    def climbed(a: Column) -> Column:
        return let(_shared_parts(a, start_parts), lambda n: _climbed(a, start_parts, n))

    return let(let(flat_parts(target), climbed), lambda r: F.when(r == "", ".").otherwise(r))


def safe_file_name(c: Column) -> Column:
    """Attachment file name that any file system takes."""
    name = F.regexp_replace(F.translate(c, " ", "_"), r'[<>:"/\\|?*]', "")
    ext = F.when(
        F.length(F.regexp_extract(name, r"(?s)^\.*[^.].*\.", 0)) > 0, F.regexp_extract(name, r"(\.[^.]*)$", 1)
    ).otherwise(F.lit(""))
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    short = F.concat(F.substring(stem, 1, 190), ext)
    name = F.when(F.length(name) > 200, short).otherwise(name)
    return F.when(name == "", "attachment").otherwise(name)
