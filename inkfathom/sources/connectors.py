"""Connectors as Python data sources: a polled document list, a repository's
commits, and pages of blocks.

They read JSON over any URL that ``urllib`` opens. The two pollers are streaming
sources whose offset is a cursor, so a restart goes on where the checkpoint
stands and nothing is read twice; the driver plans, tasks fetch.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import sys
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def fetch(url: str):
    with urllib.request.urlopen(url, timeout=30) as r:
        return json.load(r)


class Breaker:
    """Lets no call through for ``open_seconds`` after ``failures`` failures in a row; then one, whose end decides."""

    def __init__(self, failures: int = 3, open_seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.failures, self.open_seconds, self.clock = failures, open_seconds, clock
        self.failed, self.opened = 0, 0.0

    @property
    def state(self) -> str:
        if self.failed < self.failures:
            return "closed"
        return "open" if self.clock() - self.opened < self.open_seconds else "half_open"

    def call(self, f: Callable[[], Any], otherwise: Any) -> Any:
        """What ``f`` gives, or ``otherwise`` while the breaker is open or where ``f`` fails."""
        if self.state == "open":
            return otherwise
        try:
            found = f()
        except Exception:  # a feed's failure is no failure of the query: it goes on at the same offset
            self.failed += 1
            self.opened = self.clock()
            return otherwise
        self.failed = 0
        return found


def pages(url: str, field: str) -> Iterator[tuple[str, list[dict]]]:
    """Each page of a feed with its items: a list, or an object with ``field`` and perhaps ``next``."""
    while url:
        page = fetch(url)
        yield url, page if isinstance(page, list) else page[field]
        url = "" if isinstance(page, list) else page.get("next") or ""


class FeedReader(DataSourceStreamReader):
    """A paged feed read by tasks.

    The driver asks the feed how far it goes (through a breaker) and plans
    partitions, each a page and the share of it that lies between two offsets; a
    task fetches its page, and what its items point to. A batch planned again after
    a restart has the same bounds, so the same rows.
    """

    field = ""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.size = int(options.get("items", "100"))
        self.breaker = Breaker(int(options.get("failures", "3")), float(options.get("openseconds", options.get("openSeconds", "60"))))
        self.last: dict | None = None

    def end(self, start: dict) -> dict:
        """The offset after all that the feed has."""
        raise NotImplementedError

    def shares(self, start: dict, end: dict) -> Iterator[tuple]:
        """What partitions are made of."""
        raise NotImplementedError

    def latestOffset(self) -> dict:
        known = self.last or self.initialOffset()
        self.last = self.breaker.call(lambda: self.end(known), known)
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(share) for share in self.shares(start, end)]

    def commit(self, end: dict) -> None:
        """Nothing to keep: the checkpoint has the offset."""


class PollReader(FeedReader):
    """``documents[]{url, checksum}`` in the order they came; the offset says how many have been read."""

    field = "documents"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.content = options.get("content", "false") == "true"

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def end(self, start: dict) -> dict:
        return {"seen": max(start["seen"], sum(len(items) for _, items in pages(self.url, self.field)))}

    def shares(self, start: dict, end: dict) -> Iterator[tuple]:
        at = 0
        for url, items in pages(self.url, self.field):
            first, last = max(start["seen"], at), min(end["seen"], at + len(items))
            yield from ((url, i - at, min(i + self.size, last) - at) for i in range(first, last, self.size))
            at += len(items)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, first, last = partition.value
        page = fetch(url)
        for d in (page if isinstance(page, list) else page[self.field])[first:last]:
            if d.get("url") and d.get("checksum"):
                yield (d["url"], d["checksum"], *([text_of(d["url"])] if self.content else []))


def text_of(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:
        return r.read().decode("utf-8", "replace")


class PolledDocuments(DataSource):
    """``spark.readStream.format("polled_documents").option("url", ...)``; with ``content`` true the documents' texts as well."""

    @classmethod
    def name(cls) -> str:
        return "polled_documents"

    def schema(self) -> str:
        return "url string, checksum string" + ", content string" * (self.options.get("content", "false") == "true")

    def streamReader(self, schema) -> PollReader:
        return PollReader(dict(self.options))


#: What a file's status in a commit means.
STATUS = {"added": "created", "removed": "deleted", "modified": "updated", "renamed": "updated"}


class CommitReader(FeedReader):
    """Commits ``{sha, date, files[]{filename, status}}``, or with ``url`` in place of files for
    a task to fetch; the offset is the latest (date, sha)."""

    field = "commits"

    def initialOffset(self) -> dict:
        return {"date": "", "sha": ""}

    @staticmethod
    def _key(c: dict) -> tuple[str, str]:
        return c["date"], c["sha"]

    def end(self, start: dict) -> dict:
        date, sha = max((self._key(c) for _, items in pages(self.url, self.field) for c in items), default=("", ""))
        return max(start, {"date": date, "sha": sha}, key=self._key)

    def shares(self, start: dict, end: dict) -> Iterator[tuple]:
        for url, items in pages(self.url, self.field):
            own = sorted(c["sha"] for c in items if self._key(start) < self._key(c) <= self._key(end))
            yield from ((url, own[i : i + self.size]) for i in range(0, len(own), self.size))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, wanted = partition.value
        page = fetch(url)
        for c in sorted(page if isinstance(page, list) else page[self.field], key=self._key):
            if c["sha"] in wanted:
                files = c["files"] if "files" in c else fetch(c["url"])["files"]
                yield from ((c["sha"], c["date"], f["filename"], STATUS.get(f["status"], "updated")) for f in files)


class Commits(DataSource):
    """``spark.readStream.format("commits").option("url", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> str:
        return "sha string, date string, path string, event string"

    def streamReader(self, schema) -> CommitReader:
        return CommitReader(dict(self.options))


class BlockReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, place = partition.value, 0
        while url:
            page = fetch(url)
            for b in page["results"]:
                yield (page.get("page_id"), place, b["type"], b.get("text", ""))
                place += 1
            url = page.get("next")


class PageBlocks(DataSource):
    """``spark.read.format("page_blocks").option("urls", "u1,u2")``: blocks of
    pages, a partition for each page, following its ``next`` links."""

    @classmethod
    def name(cls) -> str:
        return "page_blocks"

    def schema(self) -> str:
        return "page_id string, place int, type string, text string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["urls"].split(","))


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark) -> None:
    for source in (PolledDocuments, Commits, PageBlocks):
        spark.dataSource.register(source)


def documents_only(events: DataFrame, path: str = "path", folder: str = "docs/", extensions: tuple[str, ...] = (".md", ".html")) -> DataFrame:
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.col(path).endswith(e)
    return events.where(F.col(path).startswith(folder) & ends)


def push_events(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Push payloads (JSON) as one row for each file of each commit: removed
    files are deleted, else added ones created, else updated."""
    shape = "commits array<struct<id:string,added:array<string>,removed:array<string>,modified:array<string>>>"
    commits = payloads.select(F.inline(F.from_json(column, shape)["commits"]))
    none = F.array().cast("array<string>")
    lists = {"deleted": "removed", "created": "added", "updated": "modified"}
    rows = F.concat(
        *(F.transform(F.coalesce(c, none), _event(kind)) for kind, c in lists.items())
    )
    every = commits.select(F.col("id").alias("sha"), F.inline(rows))
    first = F.min_by("event", F.when(F.col("event") == "deleted", 0).when(F.col("event") == "created", 1).otherwise(2))
    return every.groupBy("sha", "path").agg(first.alias("event"))


def _event(kind: str):
    return lambda f: F.struct(f.alias("path"), F.lit(kind).alias("event"))


def signed(payload: bytes, secret: bytes, signature: str) -> bool:
    """Whether ``sha256=<hex>`` is the payload's HMAC."""
    return hmac.compare_digest("sha256=" + hmac.new(secret, payload, hashlib.sha256).hexdigest(), signature)
