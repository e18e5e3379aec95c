"""URL filters: rules first, then a tree of path templates per host.

The tree is grown level by level over the distinct paths of each host. A segment stays
literal where it is frequent under its parent and the paths below it (their form and the
verdicts of rules) differ from those of its siblings; infrequent segments are variable and
become wildcards, and so do branches that are statistically alike. URLs that a rule decides are
the labelled ones: a template is rejected if its share of blocked labels, smoothed
towards its host's, which is smoothed towards that of all hosts, is above one half.

Only built-in column functions. A hot host is never gathered: all steps are aggregates that
combine map-side and joins against aggregated tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.llm.exchange import stored

#: A literal segment needs this many URLs and this share of its parent's.
LEAST_URLS, LEAST_SHARE = 5, 0.05
#: Branches whose forms overlap more than this with all siblings' are alike.
ALIKE = 0.75
HOST_WEIGHT, TEMPLATE_WEIGHT = 2.0, 4.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _UPPER.lower()), F.regexp_extract(url, _URL, 2)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is host/path-prefix."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def _form(rest: Column) -> Column:
    """The remaining segments with digits and letters made alike."""
    return F.regexp_replace(F.regexp_replace(F.array_join(rest, "/"), "[0-9]+", "9"), r"\p{L}+", "a")


def template_tree(paths: DataFrame) -> DataFrame:
    """(host, path, template) for distinct paths (host, path, n, label); label is allow, block or null."""
    segments = F.expr("slice(split(path, '/'), 2, greatest(size(split(path, '/')) - 1, 0))")
    state = stored(paths.select("host", "path", "n", F.coalesce("label", F.lit("")).alias("label"), F.lit("").alias("template"), segments.alias("rest")))
    done = []
    parent = ["host", "template"]
    while not (live := state.where("size(rest) > 0")).isEmpty():
        done.append(state.where("size(rest) = 0").select("host", "path", "template"))
        live = live.withColumn("seg", F.element_at("rest", 1)).withColumn("rest", F.expr("slice(rest, 2, size(rest))"))
        per = live.groupBy(*parent, "seg", F.concat_ws(" ", "label", _form(F.col("rest"))).alias("form")).agg(F.sum("n").alias("own"))
        child = per.groupBy(*parent, "seg").agg(F.sum("own").alias("n_child"))
        total = child.groupBy(*parent).agg(F.sum("n_child").alias("n_all"))
        pool = per.groupBy(*parent, "form").agg(F.sum("own").alias("n_form"))
        often = child.join(total, parent).where((F.col("n_child") >= LEAST_URLS) & (F.col("n_child") >= LEAST_SHARE * F.col("n_all")))
        # Overlap of the branch's forms with those of all branches: 1 if they are the same.
        shares = per.join(often, [*parent, "seg"]).join(pool, [*parent, "form"])
        overlap = F.sum(F.least(F.col("own") / F.col("n_child"), F.col("n_form") / F.col("n_all")))
        literal = shares.groupBy(*parent, "seg").agg(overlap.alias("overlap"), F.max("n_child").alias("n_child"), F.max("n_all").alias("n_all"))
        literal = literal.where((F.col("overlap") <= ALIKE) | (F.col("n_child") == F.col("n_all"))).select(*parent, "seg", F.lit(True).alias("literal"))
        ending = F.regexp_extract("seg", r"(\.[A-Za-z]{1,5})$", 1)
        part = F.when(F.col("literal"), F.col("seg")).when(F.col("seg") == "", "").otherwise(F.concat(F.lit("*"), ending))
        grown = live.join(literal, [*parent, "seg"], "left")
        state = stored(grown.select("host", "path", "n", "label", F.concat("template", F.lit("/"), part).alias("template"), "rest"))
    out = state.where("size(rest) = 0").select("host", "path", "template")
    for part in done:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, blocked_share.

    Null URLs and URLs without ``://`` have an empty host, path and template and are judged by
    the share of all hosts. Rows with null or repeated ids are judged like any other.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    paths = stored(distinct.select("host", "path", "n", rule.alias("rule"), verdict.alias("label")))
    tree = paths.join(template_tree(paths.drop("rule")), ["host", "path"])
    tree = stored(tree)
    bad = F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0))
    known = F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0))
    per = tree.groupBy("host", "template").agg(bad.alias("bad"), known.alias("known"))
    hosts = per.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("known").alias("host_known"))
    everything = hosts.agg(((F.coalesce(F.sum("host_bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("host_known"), F.lit(0)) + 2)).alias("share")).first()["share"]
    of_host = (F.col("host_bad") + HOST_WEIGHT * everything) / (F.col("host_known") + HOST_WEIGHT)
    share = (F.col("bad") + TEMPLATE_WEIGHT * of_host) / (F.col("known") + TEMPLATE_WEIGHT)
    judged = per.join(hosts, "host").select("host", "template", share.alias("blocked_share"))
    decided = tree.join(judged, ["host", "template"]).select("host", "path", "rule", "label", "template", "blocked_share")
    out = urls.join(decided, ["host", "path"])
    method = F.when(F.col("blocked_share") > 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "blocked_share")
