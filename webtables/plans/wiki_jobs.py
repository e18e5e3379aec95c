"""Queries over wiki JSON, sources and sinks.

The JSON is built from whole documents by Spark; the SQL twins compute the expected
columns straight from the documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from webtables import schema as S
from webtables.functions import urls as U
from webtables.operators import content as C
from webtables.operators import links as L
from webtables.operators import lookups as K
from webtables.operators import markdown as M
from webtables.operators import reports as R
from webtables.operators import wiki as W
from webtables.operators.scope import Rules
from webtables.plans import duck as D
from webtables.plans import inputs as I
from webtables.plans.page_jobs import MARKDOWN, TITLE
from webtables.session import checkpoint_dir
from webtables.sources import export as X
from webtables.sources import files as N
from webtables.sources import progress as P

# Field expressions valid in both SQL dialects, over the documents table.
_ID = "'' || (100000 + doc_id)"
_KEY = "CASE WHEN doc_id % 9 <> 0 THEN upper(source) END"
_DAY = "'2024-01-' || lpad('' || (doc_id % 28 + 1), 2, '0')"
FIELDS = {
    "id": _ID,
    "title": "'Doc ' || doc_id || ' ' || lang",
    "space_key": _KEY,
    "space_name": "CASE WHEN doc_id % 9 <> 0 THEN 'Space ' || source END",
    "ari_new": "CASE WHEN doc_id % 2 = 0 THEN 'ari:x:' || doc_id WHEN doc_id % 5 = 0 THEN '' END",
    "ari_old": "CASE WHEN doc_id % 3 = 0 THEN 'ari:y:' || doc_id END",
    "status": "CASE WHEN doc_id % 6 <> 0 THEN 'current' END",
    "v_number": "CASE WHEN doc_id % 8 <> 0 THEN doc_id % 7 + 1 END",
    "v_when": f"{_DAY} || 'T10:30:00.000Z'",
    "v_by": "'User ' || (doc_id % 17)",
    "v_email": "CASE WHEN doc_id % 2 = 0 THEN 'u' || (doc_id % 17) || '@example.com' END",
    "v_account": "'acc-' || (doc_id % 17)",
    "v_message": "CASE WHEN doc_id % 3 = 0 THEN 'edit ' || doc_id END",
    "v_minor": "CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN false END",
    "c_when": "'2023-12-01T08:00:00.000Z'",
    "c_by": "'User ' || (doc_id % 5)",
    "u_when": f"CASE WHEN doc_id % 4 <> 0 THEN {_DAY} || 'T' || lpad('' || (doc_id % 24), 2, '0') || ':15:00.000Z' END",
    "u_by": "CASE WHEN doc_id % 4 <> 0 THEN 'User ' || (doc_id % 7) END",
    "webui": "CASE WHEN doc_id % 10 = 0 THEN 'https://wiki.example.com/wiki/x/' || doc_id WHEN doc_id % 10 = 1 THEN '/wiki/spaces/W/pages/' || doc_id "
    "WHEN doc_id % 23 <> 0 THEN '/spaces/' || upper(source) || '/pages/' || doc_id || '/T' END",
    "rest": "'https://wiki.example.com/wiki/rest/' || doc_id",
}
_URL = f"'https://wiki.example.com/wiki/spaces/' || upper(source) || '/pages/' || (100000 + doc_id) || '/T'"
_BODY_LINKS = (
    "'/spaces/' || upper(source) || '/pages/' || (100000 + (doc_id * 7 + 1) % 1000) || '/T?a=1&amp;b=2'",
    "'https://wiki.example.com/wiki/display/' || source",
    "'https://else.example.org/pages/' || doc_id",
    "'#top'",
    "'pages/' || doc_id",
    "'/login/pages/' || doc_id",
    "'/wiki/spaces/X/overview'",
)
_BODY = (
    "'<h1>Doc ' || doc_id || '</h1><p>' || replace(text, '<', '&lt;') || '</p>' || "
    "CASE WHEN doc_id % 3 = 0 THEN '<table><tr><td>1</td></tr></table>' ELSE '' END || "
    + " || ".join(f"'<a href=\"' || {link} || '\">l</a>'" for link in _BODY_LINKS)
    + " || '<!-- note --><img src=\"/wiki/download/attachments/' || doc_id || '/a.png\" alt=\"pic\">'"
)
RULES = Rules(base_domain="wiki.example.com", base_url=I.WIKI_BASE, exclude=("/login",))


def _fields(spark, sf):
    docs = I.table(spark, sf, "documents")
    return docs.select(
        "doc_id", "source", F.expr(_URL).alias("url"), F.expr(_BODY).alias("body"),
        *[F.expr(e).alias(f"f_{n}") for n, e in FIELDS.items()],
        F.expr(
            "CASE WHEN doc_id % 4 > 0 THEN transform(sequence(1, doc_id % 4), i -> named_struct('_links', named_struct('webui', "
            "CASE WHEN i = 3 THEN 'https://wiki.example.com/wiki/c' || doc_id ELSE '/spaces/C/kids/' || doc_id || '-' || i END))) END"
        ).alias("kids"),
    )


def wiki_raw(spark, sf):
    """(url, json): one API page object per document; absent fields are left out."""
    f = _fields(spark, sf)
    c = {n: F.col(f"f_{n}") for n in FIELDS}
    who = lambda name, email=None, account=None: F.struct(
        name.alias("displayName"), *([email.alias("email")] if email is not None else []),
        *([account.alias("accountId")] if account is not None else []),
    )
    page = F.struct(
        c["id"].alias("id"), F.lit("page").alias("type"), c["status"].alias("status"), c["title"].alias("title"),
        c["ari_old"].alias("ari"), F.struct(c["ari_new"].alias("ari")).alias("_expandable"),
        F.when(c["space_key"].isNotNull(), F.struct(c["space_key"].alias("key"), c["space_name"].alias("name"))).alias("space"),
        F.struct(
            c["v_number"].alias("number"), c["v_when"].alias("when"), c["v_message"].alias("message"),
            c["v_minor"].alias("minorEdit"), who(c["v_by"], c["v_email"], c["v_account"]).alias("by"),
        ).alias("version"),
        F.struct(
            c["c_when"].alias("createdDate"), who(c["c_by"]).alias("createdBy"),
            F.struct(c["u_when"].alias("when"), who(c["u_by"]).alias("by")).alias("lastUpdated"),
        ).alias("history"),
        F.struct(c["webui"].alias("webui"), c["rest"].alias("self")).alias("_links"),
        F.struct(F.struct(F.col("body").alias("value")).alias("view")).alias("body"),
        F.struct(F.struct(F.col("kids").alias("results")).alias("page")).alias("children"),
    )
    return f.select("url", F.to_json(page).alias("json"))


_ATT_FIELDS = {
    "id": "'att' || doc_id || '-' || i",
    "title": "CASE WHEN i = 0 THEN 'My file <' || doc_id || '>.v1.png' WHEN i = 2 THEN repeat('x', 205) || '.tar.gz' END",
    "download": "CASE WHEN i = 0 AND doc_id % 11 = 0 THEN NULL WHEN i = 0 THEN '/download/attachments/' || doc_id || '/a.png?version=1' "
    "WHEN i = 1 THEN 'https://cdn.example.org/a/' || doc_id ELSE '/wiki/download/attachments/' || doc_id || '/x.tar.gz' END",
    "m_type": "CASE WHEN i = 0 THEN 'image/png' WHEN i = 2 THEN '' END",
    "e_type": "CASE WHEN i <> 0 THEN 'application/x-' || i END",
    "size": "CASE WHEN i <> 1 THEN doc_id * 10 + i END",
    "version": "CASE WHEN i <> 2 THEN doc_id % 3 + 1 END",
    "created": "CASE WHEN i = 0 THEN '2024-01-02T00:00:00.000Z' END",
    "m_created": "CASE WHEN i = 1 THEN '2024-01-03T00:00:00.000Z' END",
    "creator": "CASE WHEN i = 0 THEN 'User ' || doc_id % 3 END",
    "m_creator": "CASE WHEN i >= 1 THEN 'Meta ' || doc_id % 3 END",
    "m_comment": "CASE WHEN i = 1 THEN 'note' END",
    "e_comment": "CASE WHEN i = 2 THEN 'remark' END",
}


def attachments_raw(spark, sf):
    """(page_url, page_id, space_key, json): one attachment list per document, up to three entries."""
    docs = I.table(spark, sf, "documents")
    rows = docs.where("doc_id % 4 > 0").select("doc_id", "source", F.explode(F.expr("sequence(0, doc_id % 4 - 1)")).alias("i"))
    rows = rows.select("doc_id", "source", "i", *[F.expr(e).alias(n) for n, e in _ATT_FIELDS.items()])
    entry = F.struct(
        "i", "id", "title", "created", F.struct(F.col("creator").alias("displayName")).alias("creator"),
        F.struct(F.col("version").alias("number")).alias("version"), F.struct("download").alias("_links"),
        F.struct(
            F.col("m_type").alias("mediaType"), F.col("m_created").alias("created"), F.col("m_comment").alias("comment"),
            F.struct(F.col("m_creator").alias("displayName")).alias("creator"),
        ).alias("metadata"),
        F.struct(F.col("e_type").alias("mediaType"), F.col("size").alias("fileSize"), F.col("e_comment").alias("comment")).alias("extensions"),
    )
    lists = rows.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list(entry)).alias("results"))
    return lists.select(
        F.expr(_URL).alias("page_url"), F.expr(_ID).alias("page_id"), F.upper("source").alias("space_key"),
        F.to_json(F.struct("results")).alias("json"),
    )


def _meta(spark, sf):
    return W.wiki_metadata(wiki_raw(spark, sf))


def _atts(spark, sf):
    return W.wiki_attachments(attachments_raw(spark, sf), I.WIKI_BASE)


def _records(spark, sf):
    return W.page_records(wiki_raw(spark, sf), _atts(spark, sf), I.AS_OF)


# --- queries -------------------------------------------------------------------------------


def _damaged(df, number, col="json"):
    """Five of thirteen rows spoilt, by ``number``: cut off, blank, NULL, an empty object, an array."""
    n, j = F.expr(f"({number}) % 13"), F.col(col)
    return df.withColumn(
        col,
        F.when(n == 0, F.substring(j, F.lit(1), F.length(j) - 7)).when(n == 1, F.lit(" ")).when(n == 2, F.lit(None).cast("string"))
        .when(n == 3, "{}").when(n == 4, F.concat(F.lit("["), j, F.lit("]"))).otherwise(j),
    )


_NUMBER = r"CAST(regexp_extract(url, '/pages/([0-9]+)/', 1) AS BIGINT)"


def _listings(spark, sf):
    """Listing pages of at most a hundred results per space."""
    docs = I.table(spark, sf, "documents")
    rows = docs.select(F.upper("source").alias("space_key"), F.floor(F.col("doc_id") / 100).alias("page"),
                       F.struct(F.expr(_ID).alias("id"), F.struct(F.expr(FIELDS["webui"]).alias("webui")).alias("_links")).alias("r"))
    lists = rows.groupBy("space_key", "page").agg(F.collect_list("r").alias("results"))
    return lists.select("space_key", "page", F.to_json(F.struct("results")).alias("json"))


def _sorted_out(spark, sf):
    """{kind: (good rows, bad rows)} of spoilt API answers."""
    return {
        "page": W.sort_out_answers(_damaged(wiki_raw(spark, sf), _NUMBER), "page", 0.5),
        "listing": W.sort_out_answers(_damaged(_listings(spark, sf), "page + 5"), "listing", 0.9),
        "attachments": W.sort_out_answers(_damaged(attachments_raw(spark, sf), "CAST(page_id AS BIGINT)"), "attachments", 0.9),
    }


def src_wiki_json(spark, sf):
    good, _ = W.sort_out_answers(_damaged(wiki_raw(spark, sf), _NUMBER), "page", 0.5)
    return W.metadata_table(W.wiki_metadata(good)).drop("days_since_update", "has_attachments", "attachment_count")


def src_wiki_listing(spark, sf):
    good, _ = W.sort_out_answers(_damaged(_listings(spark, sf), "page + 5"), "listing", 0.9)
    return W.space_page_urls(good, I.WIKI_BASE)


def src_attachments_json(spark, sf):
    good, _ = W.sort_out_answers(_damaged(attachments_raw(spark, sf), "CAST(page_id AS BIGINT)"), "attachments", 0.9)
    return W.wiki_attachments(good, I.WIKI_BASE).drop("file_size_local", "local_path")


def src_bad_rows(spark, sf):
    """What the four JSON sources put aside."""
    bad = {kind: rows for kind, (_, rows) in _sorted_out(spark, sf).items()}
    name = {"page": F.col("url"), "listing": F.concat_ws("/", "space_key", F.col("page").cast("string")), "attachments": F.col("page_url")}
    out = [rows.select(F.lit(kind).alias("source"), name[kind].alias("name"), "problem", F.when(F.lit(kind) == "page", F.md5("json")).alias("md5")) for kind, rows in bad.items()]
    files = _imported(spark, sf)["bad"].select(
        F.lit("progress").alias("source"), F.regexp_extract("file", "user=([0-9]+)", 1).alias("name"), "problem", F.lit(None).cast("string").alias("md5")
    )
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(files)


def listing_audit(spark, sf):
    """Listings of ten results a page, some pages lost, some asked for two places early, some totals too high."""
    docs = I.table(spark, sf, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = docs.select(F.upper("source").alias("space_key"), "doc_id", place.alias("place"), F.expr(_ID).alias("id"), F.count("*").over(Window.partitionBy("source")).alias("n"))
    page = F.floor(F.col("place") / 10)
    rows = rows.withColumn("page", F.explode(F.when((F.col("place") % 10 >= 8), F.array(page, page + 1)).otherwise(F.array(page))))
    # The last two results of a page belong to the next one as well, where that one is asked for early.
    rows = rows.where((F.col("page") == page) | (F.col("page") % 7 == 5)).where("page % 7 <> 3")
    lists = rows.groupBy("space_key", "page", "n").agg(F.min("place").alias("start"), F.sort_array(F.collect_list(F.struct("place", F.struct("id").alias("r")))).alias("l"))
    json = F.to_json(F.struct(F.transform("l", lambda x: x["r"]).alias("results"), (F.col("n") + F.when(F.col("n") % 2 == 0, 5).otherwise(0)).alias("totalSize")))
    return W.listing_audit(lists.select("space_key", "start", json.alias("json")))


def attachment_path(spark, sf):
    return _atts(spark, sf).select("attachment_id", "title", "local_path")


def html_links_wiki(spark, sf):
    return L.extract_wiki_links(W.parse_pages(wiki_raw(spark, sf)), RULES)


def join_page_attachments(spark, sf):
    meta = W.metadata_table(_meta(spark, sf))
    return K.page_attachments(meta.select("url", "version_number"), _atts(spark, sf)).select("url", "version_number", "attachment_id", "download_url")


def join_space_pages(spark, sf):
    return K.pages_in_space(W.metadata_table(_meta(spark, sf)), "SRC7").select("url", "page_id", "title", "space_key")


def meta_derived(spark, sf):
    return _records(spark, sf).select("url", "derived.*")


def space_summary(spark, sf):
    return R.space_summary(W.metadata_table(_meta(spark, sf)))


def snk_metadata_doc(spark, sf):
    return W.metadata_documents(_records(spark, sf))


def _room(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def snk_documents(spark, sf):
    """Rendered pages written by host, and what the written files hold."""
    pages = I.pages(spark, sf).withColumn("title", C.title_of(F.col("html")))
    docs = M.to_markdown(C.drop_boilerplate(C.main_content(pages)), keep=("url", "title"))
    docs = U.with_local_path(U.with_clean_url(M.with_md_header(docs)))
    path = _room(spark)
    X.write_documents(X.document_rows(docs).select("host", "clean_url", "local_path", "file_size", "content"), path)
    back = spark.read.parquet(path)
    return back.select("host", "clean_url", "local_path", "file_size", F.md5("content").alias("md5"))


def snk_wiki_pages(spark, sf):
    """Every page in four formats, written as files and read back."""
    root = f"{_room(spark)}/pages"
    N.save_files(W.page_files(_records(spark, sf)), root)
    return N.read_files(spark, root).select("path", "size", F.md5("content").alias("md5"))


def snk_tables_json(spark, sf):
    """The exported tables, read back and counted."""
    tables = {
        "discovered_urls": I.discovered(spark, sf), "downloaded_documents": I.documents(spark, sf),
        "downloaded_resources": I.resources(spark, sf), "crawler_stats": I.sessions(spark, sf),
        "url_mappings": I.documents(spark, sf).select("clean_url", "local_path"),
    }
    path = _room(spark)
    out = None
    for name in X.export_json(tables, path):
        back = spark.read.schema(S.TRACKER[name]).json(f"{path}/{name}")
        n = back.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def _imported(spark, sf):
    """One legacy progress file per 25 users, written from the crawl log and imported again."""
    number = F.regexp_extract("clean_url", r"/u(\d+)/", 1).cast("bigint")
    log = I.crawl_log(spark, sf).withColumn("user", F.floor(number / 25))
    done = F.col("action") == "complete"
    url = F.concat("clean_url", F.lit("?v=1#x"))
    item = F.array("clean_url", (F.col("k") % 5).cast("string"))
    first_done = log.where(done).select("user", url.alias("url")).distinct().groupBy("user").agg(
        F.sort_array(F.collect_list("url")).alias("downloaded_urls"),
        F.map_from_entries(F.collect_list(F.when(~F.col("url").endswith("7?v=1#x"), F.struct("url", F.concat(F.lit("out/"), F.md5("url")).alias("p")))))
        .alias("url_to_filename"),
    )
    queued = log.where("action = 'discover'").select("user", item.alias("item")).distinct()
    queue = queued.groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("download_queue"))
    res = log.where("action = 'fail'").select("user", F.concat("clean_url", F.lit(".css")).alias("r")).distinct().groupBy("user").agg(
        F.sort_array(F.collect_list("r")).alias("downloaded_resources"),
        F.map_from_entries(F.collect_list(F.struct("r", F.concat(F.lit("res/"), F.md5("r")).alias("p")))).alias("transversal_resources"),
    )
    files = first_done.join(queue, "user", "full").join(res, "user", "full")
    path = _room(spark)
    texts = files.select("user", F.to_json(F.struct(*[c for c in files.columns if c != "user"])).alias("value"))
    _damaged(texts, "user + 5", "value").write.partitionBy("user").text(path)
    return P.import_progress(spark, path, most_bad=0.9)


def src_progress_json(spark, sf):
    t = _imported(spark, sf)
    docs = t["downloaded_documents"].select(F.lit("document").alias("kind"), "url", "local_path", "depth")
    res = t["downloaded_resources"].select(F.concat(F.lit("resource-"), "resource_type").alias("kind"), "url", "local_path", F.lit(None).cast("int").alias("depth"))
    queue = t["discovered_urls"].select(F.lit("queue").alias("kind"), "url", F.lit("").alias("local_path"), "depth")
    return docs.unionByName(res).unionByName(queue)


def migration_stats(spark, sf):
    return P.migration_summary(_imported(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        src_wiki_json, src_wiki_listing, src_attachments_json, attachment_path, html_links_wiki, join_page_attachments,
        join_space_pages, meta_derived, space_summary, src_bad_rows, listing_audit, snk_metadata_doc, snk_documents, snk_wiki_pages, snk_tables_json, src_progress_json,
        migration_stats,
    )
}


# --- twins ---------------------------------------------------------------------------------

_F = {n: f"({e})" for n, e in FIELDS.items()}
_BODY_SQL = _BODY
_WIKI = f"wiki AS (SELECT doc_id, source, {_URL} AS url, {_BODY_SQL} AS body, {', '.join(f'{e} AS f_{n}' for n, e in FIELDS.items())} FROM documents)"
_A = {n: f"({e})" for n, e in _ATT_FIELDS.items()}
_NAME_SQL = "regexp_replace(replace(coalesce({t}, 'unknown'), ' ', '_'), '[<>:\"/\\\\|?*]', '', 'g')".format(t=_A["title"])
_SHORT = f"CASE WHEN length({_NAME_SQL}) > 200 THEN substring(regexp_replace({_NAME_SQL}, '\\.[^.]*$', ''), 1, 190) || regexp_extract({_NAME_SQL}, '\\.[^.]*$', 0) ELSE {_NAME_SQL} END"
_ATTS = f"""atts AS (SELECT doc_id, i, {_URL} AS page_url, {_ID} AS page_id, upper(source) AS space_key, {_A['id']} AS attachment_id,
  coalesce({_A['title']}, 'unknown') AS title, coalesce(nullif({_A['m_type']}, ''), {_A['e_type']}, '') AS media_type, coalesce({_A['size']}, 0) AS file_size_api,
  coalesce({_A['version']}, 1) AS version, coalesce({_A['created']}, {_A['m_created']}, '') AS created_when, coalesce({_A['creator']}, {_A['m_creator']}, '') AS created_by,
  coalesce({_A['m_comment']}, {_A['e_comment']}, '') AS comment,
  CASE WHEN {_A['download']} LIKE 'http%' THEN {_A['download']} WHEN {_A['download']} LIKE '/wiki%' THEN '{I.WIKI_BASE}' || {_A['download']}
    ELSE '{I.WIKI_BASE}/wiki' || {_A['download']} END AS download_url,
  'spaces/' || upper(source) || '/pages/' || {_ID} || '/attachments/' || {_A['id']} || '_' || {_SHORT} AS local_path
  FROM (SELECT *, unnest(range(doc_id % 4)) AS i FROM documents) WHERE {_A['download']} IS NOT NULL)"""
_DAYS = f"CAST(floor((epoch_us({I.AS_OF_SQL}) - epoch_us(CAST(replace(f_u_when, 'Z', '') AS TIMESTAMP))) / 86400000000) AS BIGINT)"
_DERIVED = f"""derived AS (SELECT w.*, coalesce(n, 0) > 0 AS has_attachments, coalesce(n, 0) AS attachment_count, {_DAYS} AS days_since_update,
  length(body) AS content_char_count, contains(lower(body), '<table') AS has_tables FROM wiki w LEFT JOIN (SELECT page_url, count(*) AS n FROM atts GROUP BY 1) ON page_url = w.url)"""


def _nested_doc() -> str:
    def obj(**kv: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in kv.items()) + "}"

    text = lambda n: f"coalesce(f_{n}, '')"
    none = "CAST(NULL AS VARCHAR)"
    doc = obj(
        source=obj(endpoint="'/content/' || f_id", query=f"'{W.PAGE_QUERY}'", request_url="url", rest="f_rest", web=text("webui"), tiny="''"),
        content=obj(id="f_id", ari="ari", type="'page'", status=text("status"), space_key=text("space_key"), space_name=text("space_name"), title="f_title"),
        history=obj(
            created=obj(when="f_c_when", by="f_c_by", by_email=none, by_account=none),
            updated=obj(when="f_u_when", by="f_u_by", by_email=none, by_account=none),
        ),
        version=obj(number="f_v_number", minor="coalesce(f_v_minor, false)", by="f_v_by", by_email="f_v_email", by_account="f_v_account", when="f_v_when", comment="f_v_message"),
        derived=obj(has_attachments="has_attachments", attachment_count="attachment_count", days_since_update="days_since_update",
                    content_char_count="content_char_count", has_tables="has_tables"),
        paths=obj(base=f"'out/spaces/' || {text('space_key')} || '/pages/' || f_id", html="f_id || '/index.html'", markdown="f_id || '/index.md'",
                  json="f_id || '/index.json'", metadata="f_id || '/index.yml'", attachments_dir="CASE WHEN has_attachments THEN 'attachments' END"),
        attachments=obj(count="attachment_count", items="coalesce(items, [])"),
    )
    return doc


_ITEM = """{'id': attachment_id, 'title': title, 'media_type': media_type, 'version': version, 'file_size_api': file_size_api, 'file_size_local': CAST(NULL AS BIGINT),
  'created': created_when, 'created_by': created_by, 'comment': comment, 'source_download': download_url, 'local_path': local_path}"""


def _json(*fields: tuple[str, str | tuple]) -> str:
    """A JSON object as text: an expression (left out when NULL), or fields for an object inside it."""
    parts = []
    for name, value in fields:
        if isinstance(value, tuple):
            parts.append(f"""',"{name}":' || {_json(*value)}""")
        else:
            parts.append(f"""coalesce(',"{name}":' || CAST({value} AS VARCHAR), '')""")
    return f"""('{{' || substring({" || ".join(parts)}, 2) || '}}')"""


_S = lambda n: f"to_json(f_{n})"
_KIDS = """CASE WHEN doc_id % 4 > 0 THEN '[' || array_to_string(list_transform(range(1, doc_id % 4 + 1), lambda i: '{"_links":{"webui":"' ||
  CASE WHEN i = 3 THEN 'https://wiki.example.com/wiki/c' || doc_id ELSE '/spaces/C/kids/' || doc_id || '-' || i END || '"}}'), ',') || ']' END"""
_PAGE_JSON = _json(
    ("id", _S("id")), ("type", "'\"page\"'"), ("status", _S("status")), ("title", _S("title")), ("ari", _S("ari_old")), ("_expandable", (("ari", _S("ari_new")),)),
    ("space", f"CASE WHEN f_space_key IS NOT NULL THEN {_json(('key', _S('space_key')), ('name', _S('space_name')))} END"),
    ("version", (("number", "f_v_number"), ("when", _S("v_when")), ("message", _S("v_message")), ("minorEdit", "f_v_minor"),
                 ("by", (("displayName", _S("v_by")), ("email", _S("v_email")), ("accountId", _S("v_account")))))),
    ("history", (("createdDate", _S("c_when")), ("createdBy", (("displayName", _S("c_by")),)),
                 ("lastUpdated", (("when", _S("u_when")), ("by", (("displayName", _S("u_by")),)))))),
    ("_links", (("webui", _S("webui")), ("self", _S("rest")))), ("body", (("view", (("value", "to_json(body)"),)),)), ("children", (("page", (("results", _KIDS),)),)),
)
_WIKI_FILES = f"""first AS (SELECT doc_id AS a_id, regexp_extract(local_path, '([^/]+)$', 1) AS file FROM atts WHERE i = 0),
shown AS (SELECT doc_id AS page_id, CASE WHEN file IS NULL THEN body ELSE replace(body, '"/wiki/download/attachments/' || doc_id || '/a.png"', '"attachments/' || file || '"') END AS html
  FROM wiki LEFT JOIN first ON a_id = doc_id),
{D.tokens('shown', keep='page_id')}, main_kept AS (SELECT * FROM tok), {MARKDOWN},
li AS (SELECT page_url, list({_ITEM} ORDER BY attachment_id) AS items FROM atts GROUP BY 1),
full_doc AS (SELECT *, coalesce(nullif(f_ari_new, ''), f_ari_old, '') AS ari FROM derived LEFT JOIN li ON page_url = url),
head AS (SELECT w.*, html, '# ' || f_title || chr(10) || chr(10) || '**Space:** ' || coalesce(f_space_key, 'N/A') || ' - ' || coalesce(f_space_name, 'N/A') || chr(10) || chr(10)
  || '**Page ID:** ' || f_id || chr(10) || chr(10) || '**Last Updated:** ' || coalesce(f_u_when, 'N/A') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown AS md,
  'out/spaces/' || upper(source) || '/pages/' || f_id || '/index.' AS stem FROM wiki w JOIN shown ON shown.page_id = doc_id JOIN markdown_of m ON m.page_id = doc_id),
files AS (SELECT stem || 'html' AS path, html AS content FROM head UNION ALL SELECT stem || 'md', md FROM head UNION ALL SELECT stem || 'json', {_PAGE_JSON} FROM head
  UNION ALL SELECT 'out/spaces/' || upper(source) || '/pages/' || f_id || '/index.yml', CAST(to_json({_nested_doc()}) AS VARCHAR) FROM full_doc)"""
_USER = "floor(CAST(regexp_extract(clean_url, '/u(\\d+)/', 1) AS BIGINT) / 25)::BIGINT"
_GOOD = "(100000 + doc_id) % 13 > 4"
_PROBLEM = "CASE WHEN n % 13 IN (1, 2) THEN 'missing' WHEN n % 13 = 3 THEN 'incomplete' ELSE 'unreadable' END"
_ATTENTION = f"users AS (SELECT DISTINCT {_USER} AS u, {_USER} + 5 AS n FROM log WHERE action IN ('complete', 'discover', 'fail'))"
_SOUND = f"({_USER} + 5) % 13 > 4"
_DONE = f"done AS (SELECT DISTINCT clean_url, clean_url || '?v=1#x' AS raw FROM log WHERE action = 'complete' AND {_SOUND})"
_MAPPED = "CASE WHEN raw NOT LIKE '%7?v=1#x' THEN 'out/' || md5(raw) ELSE '' END"

ORACLE = {
    "src_wiki_json": f"""WITH {_WIKI} SELECT url, f_id AS page_id, coalesce(nullif(f_ari_new, ''), f_ari_old, '') AS ari, f_title AS title, coalesce(f_space_key, '') AS space_key, coalesce(f_space_name, '') AS space_name,
      'page' AS content_type, coalesce(f_status, '') AS status, f_v_number AS version_number, f_v_when AS version_when, f_v_by AS version_by, f_v_email AS version_by_email,
      f_v_account AS version_by_account, f_v_message AS version_message, coalesce(f_v_minor, false) AS version_minor_edit, f_c_when AS created_when, f_c_by AS created_by,
      CAST(NULL AS VARCHAR) AS created_by_email, CAST(NULL AS VARCHAR) AS created_by_account, f_u_when AS updated_when, f_u_by AS updated_by,
      CAST(NULL AS VARCHAR) AS updated_by_email, CAST(NULL AS VARCHAR) AS updated_by_account, coalesce(f_webui, '') AS web_link, f_rest AS rest_link, '' AS tiny_link FROM wiki
      WHERE {_GOOD}""",
    "src_wiki_listing": f"""WITH {_WIKI} SELECT upper(source) AS space_key, CASE WHEN f_webui LIKE 'http%' THEN f_webui WHEN f_webui LIKE '/wiki%' THEN '{I.WIKI_BASE}' || f_webui
      ELSE '{I.WIKI_BASE}/wiki' || f_webui END AS url FROM wiki WHERE f_webui IS NOT NULL AND (doc_id // 100 + 5) % 13 > 4""",
    "src_attachments_json": f"WITH {_ATTS} SELECT page_url, page_id, attachment_id, title, media_type, file_size_api, version, created_when, created_by, comment, download_url FROM atts WHERE {_GOOD}",
    "listing_audit": """WITH r AS (SELECT upper(source) AS space_key, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents),
      e AS (SELECT space_key, n, place, place // 10 AS page FROM r UNION ALL SELECT space_key, n, place, place // 10 + 1 FROM r WHERE place % 10 >= 8 AND (place // 10 + 1) % 7 = 5),
      p AS (SELECT space_key, min(place) AS a, max(place) + 1 AS b, any_value(n) + CASE WHEN any_value(n) % 2 = 0 THEN 5 ELSE 0 END AS total FROM e WHERE page % 7 <> 3 GROUP BY space_key, page),
      w AS (SELECT *, coalesce(max(b) OVER (PARTITION BY space_key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM p)
      SELECT space_key, CASE WHEN a > m THEN 'gap' ELSE 'overlap' END AS problem, least(a, m)::BIGINT AS first, (CASE WHEN a > m THEN a ELSE least(m, b) END - 1)::BIGINT AS last FROM w WHERE a <> m
      UNION ALL SELECT space_key, 'early end', max(b)::BIGINT, (max(total) - 1)::BIGINT FROM p GROUP BY space_key HAVING max(b) < max(total)""",
    "src_bad_rows": f"""WITH {_WIKI}, {I.CRAWL_LOG}, {_ATTENTION}, p AS (SELECT url, 100000 + doc_id AS n, {_PAGE_JSON} AS j FROM wiki),
      l AS (SELECT DISTINCT upper(source) || '/' || (doc_id // 100) AS name, doc_id // 100 + 5 AS n FROM documents)
      SELECT 'page' AS source, url AS name, {_PROBLEM} AS problem, md5(CASE n % 13 WHEN 0 THEN substring(j, 1, length(j) - 7) WHEN 1 THEN ' ' WHEN 3 THEN '{{}}' WHEN 4 THEN '[' || j || ']' END) AS md5
        FROM p WHERE n % 13 < 5
      UNION ALL SELECT 'listing', name, {_PROBLEM}, NULL FROM l WHERE n % 13 < 5
      UNION ALL SELECT 'attachments', url, {_PROBLEM}, NULL FROM (SELECT url, 100000 + doc_id AS n FROM wiki WHERE doc_id % 4 > 0) WHERE n % 13 < 5
      UNION ALL SELECT 'progress', CAST(u AS VARCHAR), CASE WHEN n % 13 IN (1, 2) THEN 'missing' ELSE 'unreadable' END, NULL FROM users WHERE n % 13 < 5 AND n % 13 <> 3""",
    "attachment_path": f"WITH {_ATTS} SELECT attachment_id, title, local_path FROM atts",
    "html_links_wiki": f"""WITH {_WIKI}, l AS (SELECT url, '{I.WIKI_BASE}' || '/spaces/' || upper(source) || '/pages/' || (100000 + (doc_id * 7 + 1) % 1000) || '/T?a=1&b=2' AS link FROM wiki
      UNION SELECT url, 'https://wiki.example.com/wiki/display/' || source FROM wiki
      UNION SELECT url, CASE WHEN i = 3 THEN 'https://wiki.example.com/wiki/c' || doc_id ELSE '{I.WIKI_BASE}/spaces/C/kids/' || doc_id || '-' || i END
        FROM (SELECT url, doc_id, unnest(range(1, doc_id % 4 + 1)) AS i FROM wiki)) SELECT url, link FROM l""",
    "join_page_attachments": f"WITH {_WIKI}, {_ATTS} SELECT url, f_v_number AS version_number, attachment_id, download_url FROM wiki JOIN atts ON page_url = url",
    "join_space_pages": f"WITH {_WIKI} SELECT url, f_id AS page_id, f_title AS title, f_space_key AS space_key FROM wiki WHERE f_space_key = 'SRC7'",
    "meta_derived": f"WITH {_WIKI}, {_ATTS}, {_DERIVED} SELECT url, has_attachments, attachment_count, days_since_update, content_char_count, has_tables FROM derived",
    "space_summary": f"""WITH {_WIKI} SELECT 'space-' || coalesce(f_space_key, '') AS id, 'Space: ' || coalesce(f_space_key, '') AS title, coalesce(f_space_key, '') AS space_key,
      count(*) AS page_count FROM wiki GROUP BY ALL""",
    "snk_metadata_doc": f"""WITH {_WIKI}, {_ATTS}, {_DERIVED}, li AS (SELECT page_url, list({_ITEM} ORDER BY attachment_id) AS items FROM atts GROUP BY 1),
      d AS (SELECT *, coalesce(nullif(f_ari_new, ''), f_ari_old, '') AS ari FROM derived LEFT JOIN li ON page_url = url)
      SELECT url, CAST(to_json({_nested_doc()}) AS VARCHAR) AS doc FROM d""",
    "snk_documents": f"""WITH {D.tokens('pages')}, {D.main()}, {MARKDOWN},
      text AS (SELECT url, '# ' || {TITLE} || chr(10) || chr(10) || '**Original URL:** ' || url || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown AS content
        FROM pages JOIN markdown_of USING (page_id))
      SELECT lower({D.netloc('url')}) AS host, {D.clean_url('url')} AS clean_url, {D.local_path('url')} AS local_path, octet_length(encode(content))::BIGINT AS file_size,
        md5(content) AS md5 FROM text""",
    "snk_wiki_pages": f"""WITH {_WIKI}, {_ATTS}, {_DERIVED}, {_WIKI_FILES} SELECT path, octet_length(encode(content))::BIGINT AS size, md5(content) AS md5 FROM files""",
    "snk_tables_json": f"""WITH {I.DISCOVERED}, {I.DOCUMENTS.replace(I.CRAWL_LOG + ', ', '')}, {I.RESOURCES} SELECT 'discovered_urls' AS table_name, count(*) AS n_rows FROM discovered
      UNION ALL SELECT 'downloaded_documents', count(*) FROM docs UNION ALL SELECT 'url_mappings', count(*) FROM docs UNION ALL SELECT 'downloaded_resources', count(*) FROM resources""",
    "src_progress_json": f"""WITH {I.CRAWL_LOG}, {_DONE} SELECT 'document' AS kind, clean_url AS url, {_MAPPED} AS local_path, 0 AS depth FROM done
      UNION ALL SELECT DISTINCT 'resource-css', clean_url || '.css', 'res/' || md5(clean_url || '.css'), CAST(NULL AS INTEGER) FROM log WHERE action = 'fail' AND {_SOUND}
      UNION ALL SELECT DISTINCT 'queue', clean_url, '', CAST(k % 5 AS INTEGER) FROM log WHERE action = 'discover' AND {_SOUND}""",
    "migration_stats": f"""WITH {I.CRAWL_LOG}, {_DONE} SELECT 'urls' AS item, count(*) AS n FROM done UNION ALL SELECT 'mappings', count(*) FROM done WHERE raw NOT LIKE '%7?v=1#x'
      UNION ALL SELECT 'resources', count(DISTINCT clean_url) FROM log WHERE action = 'fail' AND {_SOUND} UNION ALL SELECT 'queue_items', count(DISTINCT clean_url) FROM log WHERE action = 'discover' AND {_SOUND}""",
}
