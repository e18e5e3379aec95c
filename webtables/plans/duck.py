"""SQL pieces the twins share: URL parts, local paths, tokens and element ends."""

from __future__ import annotations

from webtables.functions.markup import VOID_TAGS
from webtables.operators.content import BOILERPLATE_CLASSES

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_PARAM_SCHEMES = (
    "'', 'ftp', 'hdl', 'prospero', 'http', 'https', 'shttp', 'rtsp', 'rtsps', 'sip', 'sips', 'mms', 'sftp', 'tel'"
)


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^({_SCHEME}):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_SCHEME}:)?//([^/?#]*)', 1)"


def full_path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '(?s)^[^#]*#(.*)', 1)"


def path(u: str) -> str:
    return (
        f"CASE WHEN {scheme(u)} IN ({_PARAM_SCHEMES}) THEN regexp_replace({full_path(u)}, ';[^/]*$', '') "
        f"ELSE {full_path(u)} END"
    )


def clean_url(u: str) -> str:
    return f"({scheme(u)} || '://' || {netloc(u)} || {path(u)})"


def resolved(source: str, base: str, href: str, out: str = "abs_url", name: str = "resolved") -> str:
    """CTEs ending in ``name``: all columns of ``source`` plus the joined URL."""
    return f"""{name}_p AS (SELECT *, {scheme(href)} AS hs, {netloc(href)} AS hn, {full_path(href)} AS hp, {query(href)} AS hq,
  {fragment(href)} AS hf, {scheme(base)} AS bs, {netloc(base)} AS bn, {full_path(base)} AS bp, {query(base)} AS bq FROM {source}),
{name}_j AS (SELECT *, regexp_replace(hp, ';[^/]*$', '') AS hm,
  CASE WHEN hp LIKE '/%' THEN regexp_replace(hp, ';[^/]*$', '')
       ELSE regexp_replace(regexp_replace(CASE WHEN bp = '' THEN '/' ELSE regexp_replace(bp, ';[^/]*$', '') END, '[^/]*$', '')
            || regexp_replace(hp, ';[^/]*$', ''), '/{{2,}}', '/', 'g') END AS j FROM {name}_p),
{name}_d AS (SELECT *, CASE WHEN regexp_matches(j, '(?:^|/)\\.\\.?(?:/|$)') THEN
    list_reduce(string_split(j, '/'), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '')
      WHEN s = '.' THEN acc ELSE acc || '/' || s END)
    || CASE WHEN regexp_matches(j, '(?:^|/)\\.\\.?$') THEN '/' ELSE '' END ELSE j END AS d FROM {name}_j),
{name} AS (SELECT * EXCLUDE (hs, hn, hp, hq, hf, bs, bn, bp, bq, hm, j, d),
  CASE WHEN {href} = '' THEN {base} WHEN hs <> '' AND hs <> bs THEN {href}
       WHEN hn <> '' THEN bs || '://' || hn || hp || CASE WHEN hq <> '' THEN '?' || hq ELSE '' END || CASE WHEN hf <> '' THEN '#' || hf ELSE '' END
       WHEN hp = '' THEN bs || '://' || bn || bp || CASE WHEN hq <> '' THEN '?' || hq WHEN bq <> '' THEN '?' || bq ELSE '' END
            || CASE WHEN hf <> '' THEN '#' || hf ELSE '' END
       ELSE bs || '://' || bn || CASE WHEN d LIKE '/%' THEN d ELSE '/' || d END || substring(hp, length(hm) + 1)
            || CASE WHEN hq <> '' THEN '?' || hq ELSE '' END || CASE WHEN hf <> '' THEN '#' || hf ELSE '' END END AS {out} FROM {name}_d)"""


def local_path(u: str, out_dir: str = "out", ext: str = ".md") -> str:
    p = f"regexp_replace({path(u)}, '^(?:/wiki/|/docs/|/help/)', '')"
    named = (
        f"CASE WHEN {p} IN ('', '/') THEN 'index{ext}' WHEN {p} LIKE '%/' THEN {p} || 'index{ext}' "
        f"WHEN {p} LIKE '%.html' OR {p} LIKE '%.md' THEN {p} ELSE {p} || '{ext}' END"
    )
    return f"'{out_dir}/' || regexp_replace(url_decode(regexp_replace({named}, '[<>:\"|?*]', '_', 'g')), '^/+', '')"


def rel_path(target: str, start_dir: str) -> str:
    """Relative path between two paths; dot segments are folded first."""

    def flat(p: str) -> str:
        folded = (
            f"CASE WHEN regexp_matches({p}, '(?:^|/)\\.\\.?(?:/|$)') THEN list_reduce(string_split({p}, '/'), lambda acc, s: "
            f"CASE WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN s IN ('.', '') THEN acc ELSE acc || '/' || s END) ELSE {p} END"
        )
        return f"list_filter(string_split({folded}, '/'), lambda s: s <> '')"

    a, b = flat(target), flat(start_dir)
    n = f"list_max(list_filter(range(0, least(len({a}), len({b})) + 1), lambda i: ({a})[1:i] = ({b})[1:i]))"
    return f"(repeat('../', CAST(len({b}) - {n} AS INTEGER)) || array_to_string(({a})[{n} + 1:], '/'))"


# --- tokens ----------------------------------------------------------------------------

TOKEN = (
    """(</?[A-Za-z][^\\s/>]*(?:[^>=]|=\\s*(?:"[^"]*(?:"|\\z)|''[^'']*(?:''|\\z))?)*(?:>|\\z)"""
    """|<![^>]*(?:>|\\z)|[^<]+|<)"""
)
_VALUE = """(?:"[^"]*"|''[^'']*''|[^\\s>"'']+)"""
VOID = ", ".join(f"'{tag}'" for tag in VOID_TAGS)


def hidden(tags: tuple[str, ...]) -> str:
    bodies = [rf"<{t}(?:[\s/][^>]*)?(?:>.*?(?:</{t}(?:[\s/][^>]*)?(?:>|\z)|\z)|\z)" for t in tags]
    return "(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *bodies])


def attr(tok: str, name: str) -> str:
    """Attribute value, unquoted and decoded, '' when absent."""
    other = f"""(?:[\\s/]+[^\\s=/>"'']+(?:\\s*=\\s*{_VALUE})?)*?"""
    raw = f"""regexp_extract({tok}, '(?is)^<[A-Za-z][^\\s/>]*{other}[\\s/]+{name}\\s*=\\s*({_VALUE})', 1)"""
    return unescape(f"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')""")


def unescape(t: str) -> str:
    # The references that the test pages hold.
    known = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "''", "&nbsp;": "\u00a0", "&copy;": "\u00a9", "&middot;": "\u00b7"}
    known |= {"&eacute;": "\u00e9", "&hellip;": "\u2026", "&#150;": "\u2013", "&#00000000065;": "A", "&amp;": "&"}
    for ref, char in known.items():
        t = f"replace({t}, '{ref}', '{char}')"
    return t


def tokens(source: str, drop: tuple[str, ...] = ("script", "style", "noscript"), name: str = "tok", keep: str = "page_id, url") -> str:
    """CTEs ending in ``name``: (keep, pos, tok, kind, tag, is_close)."""
    return f"""{name}_l AS (SELECT {keep}, regexp_extract_all(regexp_replace(html, '{hidden(drop)}', '', 'g'), '{TOKEN}', 1) AS l FROM {source}),
{name}_r AS (SELECT {keep}, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM {name}_l),
{name} AS (SELECT {keep}, CAST(pos AS INTEGER) AS pos, tok, lower(regexp_extract(tok, '(?s)^</?([A-Za-z][^\\s/>]*).*>$', 1)) AS tag,
  CASE WHEN regexp_matches(tok, '^</?[A-Za-z]') AND tok LIKE '%>' THEN 'tag' WHEN regexp_matches(tok, '^</?[A-Za-z!]') THEN 'decl' ELSE 'text' END AS kind,
  tok LIKE '</%' AS is_close FROM {name}_r)"""


def main(source: str = "tok") -> str:
    """CTEs ending in ``main_kept``: tokens of the main content without boilerplate."""
    opens = f"tag <> '' AND NOT is_close AND tag NOT IN ({VOID}) AND tok NOT LIKE '%/>'"
    cls = f"(' ' || regexp_replace({attr('tok', 'class')}, '\\s+', ' ', 'g') || ' ')"
    bad = " OR ".join(
        f"{cls} LIKE '% {c} %'" for c in BOILERPLATE_CLASSES
    )
    return f"""lv1 AS (SELECT *, sum(CASE WHEN {opens} THEN 1 WHEN tag <> '' AND is_close THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM {source}),
lv2 AS (SELECT *, CASE WHEN {opens} THEN depth WHEN tag <> '' AND is_close THEN depth + 1 END AS lvl FROM lv1),
ends AS (SELECT *, CASE WHEN {opens} THEN lead(pos) OVER (PARTITION BY page_id, tag, lvl ORDER BY pos) END AS end_pos FROM lv2),
ranked AS (SELECT *, CASE WHEN NOT ({opens}) THEN NULL
    WHEN tag = 'div' AND {attr('tok', 'id')} = 'main-content' THEN 1
    WHEN tag = 'div' AND {cls} LIKE '% wiki-content %' THEN 2 WHEN tag = 'main' THEN 3 WHEN tag = 'article' THEN 4
    WHEN tag = 'div' AND {cls} LIKE '% content %' THEN 5 WHEN tag = 'body' THEN 6 END AS rnk FROM ends),
best AS (SELECT page_id, arg_min(rnk, (rnk, pos)) AS b_rank, arg_min(pos, (rnk, pos)) AS b_pos,
    arg_min(coalesce(end_pos, 2147483647), (rnk, pos)) AS b_end FROM ranked WHERE rnk IS NOT NULL GROUP BY page_id),
main_all AS (SELECT r.*, coalesce(b_pos, -1) AS main_pos, coalesce(b_rank < 6, false) AS in_main
    FROM ranked r LEFT JOIN best USING (page_id) WHERE pos BETWEEN coalesce(b_pos, -1) AND coalesce(b_end, 2147483647)),
reached AS (SELECT *, max(CASE WHEN {opens} AND in_main AND pos > main_pos AND (tag IN ('nav', 'header', 'footer') OR {bad})
    THEN coalesce(end_pos, 2147483647) END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS reach FROM main_all),
main_kept AS (SELECT * FROM reached WHERE reach IS NULL OR reach < pos)"""
