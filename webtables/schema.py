"""Table schemas as DDL. Names and meanings are shared by batch jobs, streams and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGES = "page_id bigint, url string, html string"

DISCOVERED = (
    "url string, clean_url string, depth int, discovered_at timestamp, status string, "
    "retry_count int, error_message string, parent_url string"
)
DOCUMENTS = (
    "url string, clean_url string, local_path string, file_size bigint, download_time double, "
    "downloaded_at timestamp, content_type string, last_modified timestamp, depth int, links_extracted int"
)
RESOURCES = (
    "url string, local_path string, resource_type string, file_size bigint, download_time double, "
    "downloaded_at timestamp, referenced_by string, is_transversal boolean"
)
MAPPINGS = "clean_url string, local_path string, created_at timestamp"
STATS = (
    "session_id string, start_time timestamp, end_time timestamp, total_urls_discovered bigint, "
    "total_documents_downloaded bigint, total_resources_downloaded bigint, total_errors bigint, config_snapshot string"
)
METADATA = (
    "url string, page_id string, ari string, title string, space_key string, space_name string, "
    "content_type string, status string, version_number bigint, version_when string, version_by string, "
    "version_by_email string, version_by_account string, version_message string, version_minor_edit boolean, "
    "created_when string, created_by string, created_by_email string, created_by_account string, "
    "updated_when string, updated_by string, updated_by_email string, updated_by_account string, "
    "web_link string, rest_link string, tiny_link string, "
    "days_since_update bigint, has_attachments boolean, attachment_count bigint"
)
ATTACHMENTS = (
    "page_url string, page_id string, attachment_id string, title string, media_type string, "
    "file_size_api bigint, file_size_local bigint, version bigint, created_when string, created_by string, "
    "comment string, download_url string, local_path string"
)

TRACKER = {
    "discovered_urls": DISCOVERED,
    "downloaded_documents": DOCUMENTS,
    "downloaded_resources": RESOURCES,
    "url_mappings": MAPPINGS,
}

# Wiki API JSON, as far as it is read.
_PERSON = "struct<displayName:string,email:string,accountId:string>"
WIKI_PAGE = (
    "id string, ari string, type string, status string, title string, _expandable struct<ari:string>, "
    "space struct<key:string,name:string>, "
    f"version struct<number:bigint,when:string,message:string,minorEdit:boolean,by:{_PERSON}>, "
    f"history struct<createdDate:string,createdBy:{_PERSON},lastUpdated:struct<when:string,by:{_PERSON}>>, "
    "_links struct<webui:string,self:string,tinyui:string>, "
    "body struct<view:struct<value:string>,storage:struct<value:string>>, "
    "children struct<page:struct<results:array<struct<_links:struct<webui:string>>>>>"
)
WIKI_LISTING = "results array<struct<id:string,_links:struct<webui:string>>>, totalSize bigint"
WIKI_ATTACHMENTS = (
    "results array<struct<id:string,title:string,created:string,creator:struct<displayName:string>,"
    "version:struct<number:bigint>,_links:struct<download:string>,"
    "metadata:struct<mediaType:string,created:string,comment:string,creator:struct<displayName:string>>,"
    "extensions:struct<mediaType:string,fileSize:bigint,comment:string>>>"
)
PROGRESS_FILE = (
    "downloaded_urls array<string>, completed_urls array<string>, url_to_filename map<string,string>, "
    "downloaded_resources array<string>, transversal_resources map<string,string>, "
    "download_queue array<array<string>>, url_queue array<array<string>>"
)


def conform(df: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``ddl``: cast what is there, default or NULL what is not."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = []
    for field in StructType.fromDDL(ddl).fields:
        value = F.col(field.name) if field.name in have else F.lit(defaults.get(field.name))
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)
