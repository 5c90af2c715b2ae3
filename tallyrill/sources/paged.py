"""Streams over paged web APIs, through a landing log.

A walk asks an API for page after page, as the API's cursor says. Each page is
written to a log in the shared folder before the next one is asked for, under
a number that only grows; a stream's offset is the number of the last page that
landed. So a batch that is run again reads the same pages from the log, a
stream that is started again goes on with the cursor of the last page, and the
API is asked once for each page. Pages of finished batches are deleted.

Executors read the log themselves, one task a page. One stream may write a log.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# ---- fixed values -------------------------------------------------------------------------------------------------
PAGE_ROWS, MOST_PAGES, PACE_SECONDS, MOST_RETRIES, TIMEOUT_SECONDS = 100, 10, 1.2, 3, 15
DEFAULT_WAIT, MOST_WAIT = 5.0, 60.0
WALK_EVERY_SECONDS = 15 * 60
# -------------------------------------------------------------------------------------------------------------------
ROWS = "page bigint, value string"


class FetchFailed(RuntimeError):
    """The API did not give a page, also when asked again."""


@dataclass(frozen=True)
class Answer:
    status: int
    body: str = ""
    retry_after: str | None = None


def http_get(url: str, headers: dict[str, str], timeout: float = TIMEOUT_SECONDS) -> Answer:
    """What a server says to one request, whatever the status."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:  # noqa: S310  the adapters name the servers
            return Answer(r.status, r.read().decode("utf-8", "replace"), r.headers.get("Retry-After"))
    except urllib.error.HTTPError as e:
        return Answer(e.code, e.read().decode("utf-8", "replace"), e.headers.get("Retry-After"))


Get = Callable[[str, dict[str, str]], Answer]


def retry_wait(header: str | None) -> float:
    """Seconds to wait after a 429: what the header says, at most a minute; five seconds if it says nothing of use."""
    try:
        seconds = float(header)
    except (TypeError, ValueError):
        return DEFAULT_WAIT
    return min(seconds, MOST_WAIT) if math.isfinite(seconds) and seconds > 0 else DEFAULT_WAIT


def pages_of(wanted: float) -> int:
    return min(max(int(wanted), 1), MOST_PAGES)


def _with_query(url: str, **values: object) -> str:
    return f"{url}?{urllib.parse.urlencode({k: v for k, v in values.items() if v is not None})}"


@dataclass(frozen=True)
class ForumApi:
    """A forum's listing of posts; the cursor is the name of the last post."""

    base_url: str
    forum: str
    listing: str = "new"
    user_agent: str = "tallyrill/1.0"

    def request(self, cursor: str | None) -> tuple[str, dict[str, str]]:
        url = f"{self.base_url}/r/{urllib.parse.quote(self.forum, safe='')}/{self.listing}.json"
        return _with_query(url, limit=PAGE_ROWS, raw_json=1, after=cursor), {"User-Agent": self.user_agent}

    def items(self, body: dict, _cursor: str | None) -> tuple[list[dict], str | None]:
        data = body.get("data") or {}
        return [c["data"] for c in data.get("children") or () if c.get("data")], data.get("after") or None


@dataclass(frozen=True)
class MarketApi:
    """A marketplace's search; pages are numbered from 1, and each says whether there is another."""

    base_url: str
    query: str
    api_key: str = field(repr=False, default="")
    page_size: int = 60
    currency: str = "USD"
    language: str = "en_US"
    domain: str = "com"

    def request(self, cursor: str | None) -> tuple[str, dict[str, str]]:
        url = _with_query(self.base_url, query=self.query, page=cursor or 1, pageSize=self.page_size, currency=self.currency, language=self.language, domain=self.domain)
        return url, {"x-api-key": self.api_key, "Accept": "application/json"}

    def items(self, body: dict, cursor: str | None) -> tuple[list[dict], str | None]:
        found = body.get("results") or []
        more = (body.get("pagination") or {}).get("has_next_page") is True
        return found, str(int(cursor or 1) + 1) if found and more else None


@dataclass(frozen=True)
class CatalogApi:
    """A catalog's search by offset; token() gives a bearer token."""

    base_url: str
    token: Callable[[], str]
    query: str | None = None
    category: str | None = None
    filters: str | None = None
    limit: int = 50
    marketplace: str = "EBAY_US"

    def request(self, cursor: str | None) -> tuple[str, dict[str, str]]:
        kept = ",".join(["deliveryCountry:US", *([self.filters] if self.filters else [])])
        url = _with_query(self.base_url, q=self.query, category_ids=self.category, limit=self.limit, offset=cursor or 0, filter=kept)
        return url, {"Authorization": f"Bearer {self.token()}", "X-EBAY-C-MARKETPLACE-ID": self.marketplace, "Content-Type": "application/json"}

    def items(self, body: dict, cursor: str | None) -> tuple[list[dict], str | None]:
        found = body.get("itemSummaries") or []
        return found, str(int(cursor or 0) + self.limit) if len(found) >= self.limit else None


Api = ForumApi | MarketApi | CatalogApi


def fetch_page(api: Api, cursor: str | None, get: Get = http_get, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], str | None]:
    """(items, next cursor) of one page; a 429 is waited out, MOST_RETRIES times at most."""
    url, headers = api.request(cursor)
    for turn in range(MOST_RETRIES + 1):
        answer = get(url, headers)
        if answer.status != 429:
            break
        if turn < MOST_RETRIES:
            sleep(retry_wait(answer.retry_after))
    if answer.status == 429:
        raise FetchFailed(f"still too many requests after {MOST_RETRIES + 1} attempts")
    if not 200 <= answer.status < 300:
        raise FetchFailed(f"status {answer.status}: {answer.body[:400]}")
    try:
        body = json.loads(answer.body)
    except ValueError as e:
        raise FetchFailed("the answer is no JSON") from e
    return api.items(body, cursor)


def walk(api: Api, pages: int, get: Get = http_get, sleep: Callable[[float], None] = time.sleep, cursor: str | None = None, done: int = 0) -> Iterator[tuple[list[dict], str | None, int]]:
    """(items, next cursor, pages so far) of the pages of a walk, at the pace of the API; done pages were had before."""
    while done < pages:
        items, cursor = fetch_page(api, cursor, get, sleep)
        done += 1
        yield items, cursor, done
        if not cursor:
            return
        if done < pages:
            sleep(PACE_SECONDS)


class PageLog:
    """Numbered pages in a folder of any store that pyarrow opens; a page is there whole or not at all."""

    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, root.rstrip("/")

    def numbers(self) -> list[int]:
        store, root = self._open()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def append(self, number: int, header: dict, items: list[dict]) -> None:
        store, root = self._open()
        store.create_dir(root, recursive=True)
        aside = f"{root}/{number:012d}.aside"
        with store.open_output_stream(aside) as out:
            out.write("\n".join(json.dumps(x) for x in [header, *items]).encode())
        store.move(aside, f"{root}/{number:012d}.json")

    def read(self, number: int) -> tuple[dict, list[str]]:
        store, root = self._open()
        with store.open_input_stream(f"{root}/{number:012d}.json") as f:
            header, *items = f.read().decode().split("\n")
        return json.loads(header), items

    def prune(self, below: int) -> None:
        """Delete the pages below a number; the last page stays, since its cursor is where the walk goes on."""
        store, root = self._open()
        for n in self.numbers()[:-1]:
            if n < below:
                store.delete_file(f"{root}/{n:012d}.json")


class Landed(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedReader(DataSourceStreamReader):
    """Offsets are {"page": number of the last page landed}."""

    def __init__(self, api: Api, log: PageLog, pages: int, every: float, get: Get, sleep: Callable[[float], None], clock: Callable[[], float]):
        self.api, self.log, self.pages, self.every = api, log, pages_of(pages), every
        self.get, self.sleep, self.clock = get, sleep, clock

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Land the rest of a walk that was broken off, or, if the last one is long enough ago, a new walk from the top."""
        number = max(self.log.numbers(), default=0)
        last = self.log.read(number)[0] if number else {"ended": True, "at": -math.inf}
        if last["ended"] and self.clock() < last["at"] + self.every:
            return {"page": number}
        cursor, done = (None, 0) if last["ended"] else (last["after"], last["done"])
        for items, after, so_far in walk(self.api, self.pages, self.get, self.sleep, cursor, done):
            number += 1
            self.log.append(number, {"after": after, "done": so_far, "ended": not after or so_far >= self.pages, "at": self.clock()}, items)
        return {"page": number}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Landed(n) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return ((partition.value, item) for item in self.log.read(partition.value)[1])

    def commit(self, end: dict) -> None:
        self.log.prune(end["page"])

    def stop(self) -> None:
        pass


class WalkReader(DataSourceReader):
    """One walk, for batch reads; an API's pages come one after the other, so it is one task."""

    def __init__(self, api: Api, pages: int, get: Get, sleep: Callable[[float], None]):
        self.api, self.pages, self.get, self.sleep = api, pages_of(pages), get, sleep

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, _partition: InputPartition) -> Iterator[tuple]:
        for items, _, number in walk(self.api, self.pages, self.get, self.sleep):
            for item in items:
                yield number, json.dumps(item)


def paged_source(name: str, api: Api, log: str, pages: int = 3, every: float = WALK_EVERY_SECONDS, get: Get = http_get, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> type[DataSource]:
    """A data source class to register (spark.dataSource.register): rows (page, value: an item as JSON). A new walk begins `every` seconds after the end of the last."""

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROWS

        def reader(self, schema) -> WalkReader:
            return WalkReader(api, pages, get, sleep)

        def streamReader(self, schema) -> PagedReader:  # noqa: N802
            return PagedReader(api, PageLog(log), pages, every, get, sleep, clock)

    return PagedSource


def typed_items(rows: DataFrame, schema: str) -> DataFrame:
    """The items of a paged source in columns; what is no object of this kind has nulls."""
    return rows.select(F.from_json("value", schema).alias("_item")).select("_item.*")


def stream_items(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A registered paged source as a stream in columns."""
    return typed_items(spark.readStream.format(name).load(), schema)


def read_items(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """One walk over a registered paged source."""
    return typed_items(spark.read.format(name).load(), schema)


def land(text: str | bytes, path: str) -> str:
    """Text into a file of the store, whole or not at all; the path, to be read from there."""
    store, place = PageLog(path)._open()
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{place}.aside") as out:
        out.write(text.encode() if isinstance(text, str) else text)
    store.move(f"{place}.aside", place)
    return path


def land_url(url: str, path: str, timeout: float = TIMEOUT_SECONDS, chunk: int = 1 << 20) -> str:
    """What lies behind a URL into a file of the store, chunk by chunk."""
    store, place = PageLog(path)._open()
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with urllib.request.urlopen(url, timeout=timeout) as r, store.open_output_stream(f"{place}.aside") as out:  # noqa: S310  the caller names the server
        while part := r.read(chunk):
            out.write(part)
    store.move(f"{place}.aside", place)
    return path
