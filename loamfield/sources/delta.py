"""Listings of remote services that go on where the last one ended: a Spark data source whose offset is the service's token.

A service answers a request (a token, and within its traversal a page) with JSON: items, and either the page that follows or,
on the last one, the token of the next traversal. ``spark.readStream.format("listing")`` follows these; what it reads are the
pages (``since, page, place, complete, body``), whose items :func:`loamfield.sources.remote.listing` tells by expressions.

The driver walks from page to page, as each names the next, and keeps their names alone; tasks fetch the pages again and read
them. A traversal that breaks off gives no token, so a stream stays at the old one and the next poll begins there again.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loamfield.sources import remote


@dataclass(frozen=True)
class Paging:
    """Where an answer names the next page and the next token (keys from the outside in).

    ``more`` says whether a page follows, where one is named in any case; ``end`` says the opposite. Services that give no
    token are asked for what was updated since: ``latest`` leads to the times of the items, the greatest of which is the token.
    """

    next: tuple[str, ...]
    delta: tuple[str, ...] = ()
    more: tuple[str, ...] = ()
    end: tuple[str, ...] = ()
    latest: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())


_GRAPH = Paging(("@odata.nextLink",), ("@odata.deltaLink",))
# How the services' answers name what follows.
PAGING: dict[str, Paging] = {
    "sharepoint": _GRAPH,
    "onedrive": _GRAPH,
    "exchange": Paging(("@odata.nextLink",), latest=(("value",), ("receivedDateTime",))),
    "google_drive": Paging(("nextPageToken",), ("newStartPageToken",)),
    "dropbox": Paging(("cursor",), ("cursor",), more=("has_more",)),
    "box": Paging(("next_stream_position",), ("next_stream_position",), more=("chunk_size",)),
    "zendesk_tickets": Paging(("next_page",), ("end_time",), end=("end_of_stream",)),
    "zendesk_articles": Paging(("next_page",), ("end_time",), end=("end_of_stream",)),
    "linear": Paging(("data", "issues", "pageInfo", "endCursor"), more=("data", "issues", "pageInfo", "hasNextPage"), latest=(("data", "issues", "nodes"), ("updatedAt",))),
    "notion": Paging(("next_cursor",), more=("has_more",), latest=(("results",), ("last_edited_time",))),
    "asana": Paging(("next_page", "offset"), latest=(("data",), ("modified_at",))),
    "jira": Paging(("nextPageToken",), latest=(("issues",), ("fields", "updated"))),
    "confluence": Paging(("_links", "next"), latest=(("results",), ("version", "when"))),
    "airtable": Paging(("offset",), latest=(("records",), ("createdTime",))),
}


def _get(x, keys: tuple[str, ...]):
    for k in keys:
        x = x.get(k) if isinstance(x, dict) else None
    return x


def follows(body: str, service: str) -> tuple[str | None, str | None]:
    """The next page and, where there is none, the token that an answer gives (services with ``latest``: its latest time)."""
    p, x = PAGING[service], json.loads(body)
    going = _get(x, p.next) if not (p.more and not _get(x, p.more)) and not (p.end and _get(x, p.end)) else None
    if p.latest[0]:
        times = [t for t in (_get(i, p.latest[1]) for i in _get(x, p.latest[0]) or []) if t is not None]
        token = max(map(str, times), default=None)
    else:
        token = _get(x, p.delta) if going is None else None
    return (None if going is None else str(going)), (None if token is None else str(token))


# ---- fetching ------------------------------------------------------------------------------------------------------
def request_key(since: str, page: str) -> str:
    return hashlib.md5(f"{since}\n{page}".encode()).hexdigest()


def put_answers(pages: DataFrame, at: str) -> None:
    """Lay answers (since, page, body) out in a folder, from which the source reads them instead of from the service."""
    named = pages.select(F.md5(F.concat_ws("\n", "since", "page").cast("binary")).alias("request"), "body")
    named.write.mode("append").partitionBy("request").text(at)


def _files(at: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(at)
    return fs, where, path


def fetch(options: dict[str, str], since: str, page: str) -> str | None:
    """An answer's JSON text; None where it can't be had. Options: ``answers``, a folder of :func:`put_answers`, or ``url``
    with places for {since} and {page} (a token or page that is itself an address is asked as it stands) and ``headers``
    (JSON)."""
    try:
        if options.get("answers"):
            fs, where, path = _files(options["answers"])
            found = where.get_file_info(fs.FileSelector(f"{path}/request={request_key(since, page)}", allow_not_found=True))
            parts = sorted(f.path for f in found if f.path.endswith(".txt"))
            if not parts:
                return None
            with where.open_input_stream(parts[0]) as f:
                return f.read().decode()
        whole = next((x for x in (page, since) if x.startswith(("http://", "https://"))), None)
        url = whole or options["url"].format(since=urllib.parse.quote(since, ""), page=urllib.parse.quote(page, ""))
        asked = urllib.request.Request(url, headers=json.loads(options.get("headers") or "{}"))
        with urllib.request.urlopen(asked, timeout=float(options.get("timeout") or 60)) as f:
            return f.read().decode()
    except OSError:  # the network's errors are of this kind, too
        return None


def traverse(options: dict[str, str], since: str) -> tuple[list[str], str | None]:
    """The pages of one traversal in order, and the token it ends with: None if it broke off. A page that comes twice is an
    error. Listings of the latest first (``newest_first``) end at the first page without anything newer than the token."""
    service, page, pages, latest = options["service"], "", [], None
    newest = options.get("newest_first", "").lower() == "true"
    seen = set()
    while True:
        if page in seen:
            raise ValueError(f"{service}: page {page!r} follows itself")
        seen.add(page)
        body = fetch(options, since, page)
        if body is None:
            return pages, None
        going, token = follows(body, service)
        by_time = bool(PAGING[service].latest[0])
        if newest and since and by_time and (token is None or token <= since):
            going = None
        else:
            pages.append(page)
        if token is not None:
            latest = token if latest is None or not by_time else max(latest, token)
        if going is None:
            return pages, max(latest or "", since) if by_time else latest
        page = going


# ---- the source ----------------------------------------------------------------------------------------------------
class Pages(InputPartition):
    def __init__(self, since: str, at: list[tuple[int, str]], complete: bool):
        self.since, self.at, self.complete = since, at, complete


def _split(options, since: str, pages: list[str], first: int, complete: bool) -> list[Pages]:
    size = max(1, int(options.get("pages_per_task") or 8))
    numbered = list(enumerate(pages, first))
    return [Pages(since, numbered[i : i + size], complete) for i in range(0, len(numbered), size)]


def _read(options, part: Pages) -> Iterator[tuple]:
    for place, page in part.at:
        body = fetch(options, part.since, page)
        if body is None:  # the task fails and is tried again; the offset stays
            raise OSError(f"{options['service']}: page {page!r} since {part.since!r} is gone")
        yield part.since, page, place, part.complete, body


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        since = self.options.get("since") or ""
        pages, token = traverse(self.options, since)
        return _split(self.options, since, pages, 0, token is not None) or [Pages(since, [], False)]

    def read(self, partition):
        return _read(self.options, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are tokens. The engine doesn't tell a restarted reader where it stands, so a token that is done with is noted
    in the folder ``position``; from there (or the first token) the reader goes on, traversal by traversal, to the last."""

    def __init__(self, options):
        self.options, self.at = options, None

    def initialOffset(self):
        return {"since": self.options.get("since") or ""}

    def _noted(self) -> str | None:
        if not self.options.get("position"):
            return None
        fs, where, path = _files(self.options["position"])
        if where.get_file_info(f"{path}/token").type == fs.FileType.NotFound:
            return None
        with where.open_input_stream(f"{path}/token") as f:
            return json.loads(f.read())["since"]

    def _chain(self, since: str, end: str | None = None) -> list[tuple[str, list[str], str]]:
        out, seen = [], {since}
        while since != end:
            pages, token = traverse(self.options, since)
            if token is None or token in seen:
                break
            out.append((since, pages, token))
            seen.add(token)
            since = token
        return out

    def latestOffset(self):
        if self.at is None:
            self.at = self._noted() or self.initialOffset()["since"]
        chain = self._chain(self.at)
        self.at = chain[-1][2] if chain else self.at
        return {"since": self.at}

    def partitions(self, start, end):
        parts, n = [], 0
        for since, pages, _ in self._chain(start["since"], end["since"]):
            parts += _split(self.options, since, pages, n, True)
            n += len(pages)
        return parts

    def read(self, partition):
        return _read(self.options, partition)

    def commit(self, end):
        if self.options.get("position"):
            _, where, path = _files(self.options["position"])
            where.create_dir(path, recursive=True)
            with where.open_output_stream(f"{path}/token") as f:
                f.write(json.dumps(end).encode())


class Listing(DataSource):
    """Options: ``service`` (of :data:`PAGING`), those of :func:`fetch`, ``since``, ``newest_first``, ``pages_per_task``,
    ``position``. Read as a batch it gives one traversal; ``complete`` tells whether that came to its end."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "since string, page string, place int, complete boolean, body string"

    def reader(self, schema):
        return _Batch(dict(self.options))

    def streamReader(self, schema):
        return _Stream(dict(self.options))


def poll(spark: SparkSession, at: str, service: str, every: str | None = None, **options: str):
    """Follow a service into the folder ``at``: what has come since the last call is added, and the token kept. With ``every``
    (an interval) the query that goes on polling is given back; without it one poll is run to its end.

    A step that is tried again takes the place of its first attempt.
    """
    spark.dataSource.register(Listing)
    stream = spark.readStream.format("listing").options(service=service, position=f"{at}/position", **options).load()

    def write(pages, step):
        remote.listing(pages, service).write.mode("overwrite").parquet(f"{at}/items/step={step}")

    w = stream.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(write)
    if every is not None:
        return w.trigger(processingTime=every).start()
    w.trigger(availableNow=True).start().awaitTermination()
    return None


def polled_items(spark: SparkSession, at: str) -> DataFrame:
    """The items of all polls into ``at``, each in the last state told. As services tell removals without a state, these are
    skipped; ``gone`` marks items that a later poll told removed."""
    items = spark.read.parquet(f"{at}/items")
    w = Window.partitionBy("id")
    told = items.withColumns({"r_": F.row_number().over(w.orderBy("removed", F.desc("step"))), "last_": F.max("step").over(w), "gone_": F.max(F.when(F.col("removed"), F.col("step"))).over(w)})
    return told.filter("r_ = 1 and not removed").withColumn("gone", F.coalesce(F.col("gone_") == F.col("last_"), F.lit(False))).drop("r_", "last_", "gone_", "removed", "step")
