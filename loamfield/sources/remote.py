"""Listings of remote services, from the JSON pages that their interfaces answer with.

Fetching is the caller's (pages arrive as files or as a stream); what a page means is told here, by service: where its items
stand, what identifies an item and its state, and which items were removed. All services end in one shape:

    service, id, etag, name, updated, removed, content, metadata
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Service:
    """Paths are JSON paths within an item; ``removed`` is an SQL test over ``item`` (a JSON text)."""

    items: str
    id: str
    etag: str
    name: str
    updated: str | None = None
    removed: str = "false"
    content: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


_GET = "get_json_object(item, '{}')"
# Where the services' answers hold what a listing needs.
SERVICES: dict[str, Service] = {
    "azure_blob": Service("$.blobs", "$.name", "$.properties.etag", "$.name", "$.properties.lastModified"),
    "github": Service("$.tree", "$.path", "$.sha", "$.path", removed="get_json_object(item, '$.type') <> 'blob'"),
    "github_compare": Service("$.files", "$.filename", "$.sha", "$.filename", removed="get_json_object(item, '$.status') = 'removed'", metadata={"change_status": "$.status"}),
    "gitlab": Service("$", "$.path", "$.id", "$.name", removed="get_json_object(item, '$.type') <> 'blob'"),
    "gitlab_compare": Service("$.diffs", "$.new_path", "$.new_path", "$.new_path", removed="get_json_object(item, '$.deleted_file') = 'true'"),
    "bitbucket": Service("$.values", "$.path", "$.commit.hash", "$.path", removed="get_json_object(item, '$.type') <> 'commit_file'"),
    "bitbucket_diff": Service("$.values", "$.new.path", "$.new.path", "$.new.path", removed="get_json_object(item, '$.status') = 'removed'", metadata={"change_status": "$.status"}),
    "confluence": Service("$.results", "$.id", "$.version.number", "$.title", "$.version.when", content="$.body.storage.value"),
    "jira": Service("$.issues", "$.key", "$.fields.updated", "$.fields.summary", "$.fields.updated", content="$.fields.description", metadata={"status": "$.fields.status.name"}),
    "linear": Service("$.data.issues.nodes", "$.identifier", "$.updatedAt", "$.title", "$.updatedAt", content="$.description"),
    "notion": Service("$.results", "$.id", "$.last_edited_time", "$.id", "$.last_edited_time", removed="get_json_object(item, '$.archived') = 'true'"),
    "asana": Service("$.data", "$.gid", "$.modified_at", "$.name", "$.modified_at", content="$.notes"),
    "airtable": Service("$.records", "$.id", "$.createdTime", "$.id", "$.createdTime", content="$.fields"),
    "gmail": Service("$.messages", "$.uid", "$.uid", "$.subject", "$.date", content="$.body"),
    "google_drive": Service("$.changes", "$.fileId", "$.file.md5Checksum", "$.file.name", "$.file.modifiedTime", "get_json_object(item, '$.removed') = 'true'"),
    "dropbox": Service("$.entries", "$.path_lower", "$.rev", "$.name", "$.server_modified", "get_json_object(item, '$[\\'.tag\\']') <> 'file'"),
    "box": Service("$.entries", "$.id", "$.etag", "$.name", "$.modified_at", "get_json_object(item, '$.type') <> 'file'"),
    "zendesk_tickets": Service("$.tickets", "$.id", "$.updated_at", "$.subject", "$.updated_at", "get_json_object(item, '$.status') = 'deleted'", "$.description"),
    "zendesk_articles": Service("$.articles", "$.id", "$.updated_at", "$.title", "$.updated_at", "get_json_object(item, '$.draft') = 'true'", "$.body"),
    "sharepoint": Service("$.value", "$.id", "$.eTag", "$.name", "$.lastModifiedDateTime", "get_json_object(item, '$.deleted') is not null or get_json_object(item, '$.folder') is not null"),
    "onedrive": Service("$.value", "$.id", "$.eTag", "$.name", "$.lastModifiedDateTime", "get_json_object(item, '$.deleted') is not null or get_json_object(item, '$.folder') is not null"),
    "exchange": Service("$.value", "$.id", "$.receivedDateTime", "$.subject", "$.receivedDateTime", "get_json_object(item, '$[\\'@removed\\']') is not null", "$.body.content"),
    "web_search": Service("$.results", "$.url", "$.url", "$.title", content="$.content", metadata={"score": "$.score"}),
}


def listing(pages: DataFrame, service: str) -> DataFrame:
    """Items of the pages (body: JSON text) of a service; removed ones are marked. An item without an id is left out; of one
    that stands on several pages the state updated last counts."""
    s = SERVICES[service]
    some = "cast(body as string)" if s.items == "$" else f"get_json_object(cast(body as string), '{s.items}')"
    item = F.explode(F.from_json(F.expr(some), "array<string>"))
    at = lambda path: F.expr(_GET.format(path)) if path else F.lit(None).cast("string")
    kept = pages.select(item.alias("item")).select(
        F.lit(service).alias("service"), at(s.id).alias("id"), at(s.etag).alias("etag"), at(s.name).alias("name"), at(s.updated).alias("updated"),
        F.expr(f"coalesce({s.removed}, false)").alias("removed"), at(s.content).alias("content"),
        (F.create_map(*[x for k, p in s.metadata.items() for x in (F.lit(k), at(p))]) if s.metadata else F.expr("cast(map() as map<string,string>)")).alias("metadata"),
    ).filter("id is not null")
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated"), F.desc_nulls_last("etag"))
    return kept.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")


def since(items: DataFrame, token: str | None) -> DataFrame:
    """Items updated after a token (all, without one); those that tell no time are always taken."""
    return items if token is None else items.filter(F.col("updated").isNull() | (F.col("updated") > F.lit(token)))


def next_token(items: DataFrame, complete: bool, token: str | None = None) -> DataFrame:
    """One row with the ``token`` of the next run: the latest update seen, held back at the old one unless the traversal was
    complete."""
    latest = F.max("updated") if complete else F.max(F.lit(None).cast("string"))
    return items.agg(F.greatest(latest, F.lit(token).cast("string")).alias("token"))


def newest_first(items: DataFrame, token: str | None, page: int = 100) -> DataFrame:
    """Items as a service that lists the latest first gives them: pages up to the first that holds nothing newer."""
    w = Window.orderBy(F.desc("updated"), "id")  # one service's listing
    paged = items.withColumn("page", F.floor((F.row_number().over(w) - 1) / page).cast("int"))
    return paged if token is None else paged.withColumn("newer", F.max(F.col("updated") > F.lit(token)).over(Window.partitionBy("page"))).filter("newer").drop("newer")


def days(messages: DataFrame, channel: str = "channel", ts: str = "ts", thread: str | None = None, today: str | None = None) -> DataFrame:
    """``id, etag, n, text``: one document for each channel and UTC day, messages in the order of time; the etag is the latest
    time. Replies (``thread``: the time of the message that they answer) stand with it. A message without a time is of
    ``today``, or of no day if that isn't given."""
    root = F.coalesce(thread, ts) if thread else F.col(ts)
    day = F.coalesce(F.date_format(root, "yyyy-MM-dd"), F.lit(today).cast("string"))
    m = messages.withColumns({"day_": day, "root_": root}).filter("day_ is not null")
    told = F.sort_array(F.collect_list(F.struct(F.col("root_").alias("a"), F.col(ts).alias("b"), F.col("text").alias("t"))))  # one channel's day
    return m.groupBy(channel, "day_").agg(F.max(ts).alias("etag"), F.count(F.lit(1)).alias("n"), told.alias("x")).select(
        F.concat_ws("/", F.col(channel).cast("string"), "day_").alias("id"), "etag", "n", F.array_join("x.t", "\n").alias("text")
    )
