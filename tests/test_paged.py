"""Paged web APIs against a server on this machine: retries, pacing, replay, restarts, pruning."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from tallyrill.functions import watches as W
from tallyrill.sources import feeds, paged, schema


class Server:
    """Serves a forum of `total` posts in pages of `size`, and a market and a catalog; says what is in `trouble` (status, Retry-After) first."""

    def __init__(self, total, size=2):
        self.total, self.size, self.asked, self.trouble = total, size, [], []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                url = urllib.parse.urlparse(self.path)
                q = dict(urllib.parse.parse_qsl(url.query))
                outer.asked.append((url.path, q, {k.lower(): v for k, v in self.headers.items()}))
                status, wait = outer.trouble.pop(0) if outer.trouble else (200, None)
                body = json.dumps(outer.page(url.path, q)) if status == 200 else "no"
                self.send_response(status)
                if wait:
                    self.send_header("Retry-After", wait)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"

    def page(self, path, q):
        if path.startswith("/market"):
            a = (int(q["page"]) - 1) * self.size
            return {"pagination": {"has_next_page": a + self.size < self.total}, "results": [{"id": str(i), "title": f"Omega {i}", "url": "https://x", "price": {"amount": i, "currency": "$"}} for i in range(a, min(a + self.size, self.total))]}
        if path.startswith("/catalog"):
            a = int(q["offset"])
            return {"itemSummaries": [{"itemId": str(i), "title": f"Seiko {i}", "itemWebUrl": "https://x"} for i in range(a, min(a + self.size, self.total))]}
        if path.startswith("/feed"):
            return "unused"
        a = int(q.get("after", "p0")[1:])
        b = min(a + self.size, self.total)
        return {"data": {"children": [{"kind": "t3", "data": {"id": f"p{i}", "title": f"[WTS] Omega {i}"}} for i in range(a, b)], "after": f"p{b}" if b < self.total else None}}


@pytest.fixture
def serve():
    made = []

    def start(*args):
        made.append(Server(*args))
        return made[-1]

    yield start
    for s in made:
        s.http.shutdown()


def no_wait(_seconds):
    pass


def drain(spark, source, out, checkpoint):
    spark.dataSource.register(source)
    q = paged.stream_items(spark, source.name(), schema.POSTS).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(r.id for r in spark.read.schema(schema.POSTS).parquet(out).collect())


@pytest.mark.parametrize("total,pages", [(1, 1), (2, 1), (3, 2), (4, 2)])
def test_every_row_once(spark, tmp_path, serve, total, pages):
    server = serve(total)
    source = paged.paged_source(f"forum{total}", paged.ForumApi(server.url, "a b"), str(tmp_path / "log"), sleep=no_wait)
    expected = [f"p{i}" for i in range(total)]
    assert drain(spark, source, str(tmp_path / "out"), str(tmp_path / "c")) == expected
    assert len(server.asked) == pages and server.asked[0][0] == "/r/a%20b/new.json" and server.asked[0][1] == {"limit": "100", "raw_json": "1"}
    # started again within the time of a walk: nothing is asked, nothing comes twice
    assert drain(spark, source, str(tmp_path / "out"), str(tmp_path / "c")) == expected and len(server.asked) == pages


def test_too_many_requests(spark, tmp_path, serve):
    server = serve(3)
    server.trouble = [(429, "7"), (429, None), (429, "400")]
    waits = tmp_path / "waits"
    waits.write_text("")

    def sleep(seconds, path=str(waits)):
        with open(path, "a") as f:
            f.write(f"{seconds}\n")

    source = paged.paged_source("busy", paged.ForumApi(server.url, "w"), str(tmp_path / "log"), sleep=sleep)
    assert drain(spark, source, str(tmp_path / "out"), str(tmp_path / "c")) == ["p0", "p1", "p2"]
    assert waits.read_text().split() == ["7.0", "5.0", "60.0", "1.2"]


def test_failure_and_restart(spark, tmp_path, serve):
    """The third page fails for good: the stream fails, the pages that landed are not lost, and the next start goes on behind them."""
    server = serve(7)
    out, c, log = (str(tmp_path / x) for x in ("out", "c", "log"))
    calls = []
    reader = paged.PagedReader(paged.ForumApi(server.url, "w"), paged.PageLog(log), 10, 900, lambda u, h: calls.append(u) or (paged.Answer(500, "down") if len(calls) == 3 else paged.http_get(u, h)), no_wait, lambda: 0.0)
    with pytest.raises(paged.FetchFailed, match="500"):
        reader.latestOffset()
    assert paged.PageLog(log).numbers() == [1, 2]
    source = paged.paged_source("again", paged.ForumApi(server.url, "w"), log, pages=10, sleep=no_wait)
    assert drain(spark, source, out, c) == [f"p{i}" for i in range(7)]
    assert [q.get("after") for _, q, _ in server.asked] == [None, "p2", "p4", "p6"]


def test_new_walk_and_pruning(spark, tmp_path, serve):
    server = serve(4)
    now = tmp_path / "now"
    now.write_text("1000")
    clock = lambda path=str(now): float(Path(path).read_text())
    log = str(tmp_path / "log")
    source = paged.paged_source("walks", paged.ForumApi(server.url, "w"), log, every=60, sleep=no_wait, clock=clock)
    out, c = str(tmp_path / "out"), str(tmp_path / "c")
    drain(spark, source, out, c)
    now.write_text("1061")
    found = drain(spark, source, out, c)
    # the second walk has the same posts: merges take care of them
    assert found == sorted([f"p{i}" for i in range(4)] * 2)
    now.write_text("1200")
    drain(spark, source, out, c)
    # the pages of batches before the last one are gone, the last page is not
    assert max(paged.PageLog(log).numbers()) == 6 and min(paged.PageLog(log).numbers()) >= 4


def test_replayed_batch(tmp_path, serve):
    """The same offsets give the same rows from the log, though the forum has moved on."""
    server = serve(3)
    reader = paged.PagedReader(paged.ForumApi(server.url, "w"), paged.PageLog(str(tmp_path / "log")), 3, 900, paged.http_get, no_wait, lambda: 0.0)
    end = reader.latestOffset()
    rows = lambda: [r for p in reader.partitions({"page": 0}, end) for r in reader.read(p)]
    first = rows()
    server.total = 50
    assert end == {"page": 2} and rows() == first and [json.loads(v)["id"] for _, v in first] == ["p0", "p1", "p2"]
    assert reader.latestOffset() == end and len(server.asked) == 2


def test_other_apis(spark, tmp_path, serve):
    server = serve(5)
    spark.dataSource.register(paged.paged_source("market", paged.MarketApi(f"{server.url}/market", "omega", "key", page_size=2), str(tmp_path / "m"), pages=5, sleep=no_wait))
    rows = paged.read_items(spark, "market", schema.MARKET_ITEMS).collect()
    assert sorted(r.id for r in rows) == list("01234") and rows[1].price.amount == 1.0
    assert {a[2].get("x-api-key") for a in server.asked} == {"key"} and [a[1]["page"] for a in server.asked] == ["1", "2", "3"]
    server.asked.clear()
    spark.dataSource.register(paged.paged_source("catalog", paged.CatalogApi(f"{server.url}/catalog", lambda: "t", query="seiko", limit=2), str(tmp_path / "k"), pages=2, sleep=no_wait))
    assert sorted(r.itemId for r in paged.read_items(spark, "catalog", schema.CATALOG_ITEMS).collect()) == list("0123")
    assert {a[2].get("authorization") for a in server.asked} == {"Bearer t"} and server.asked[0][1]["filter"] == "deliveryCountry:US"


def test_failures_without_spark():
    api = paged.ForumApi("http://x", "w")
    waits = []
    with pytest.raises(paged.FetchFailed, match="4 attempts"):
        paged.fetch_page(api, None, lambda u, h: paged.Answer(429, "", "2"), waits.append)
    assert waits == [2.0] * 3
    with pytest.raises(paged.FetchFailed, match="no JSON"):
        paged.fetch_page(api, None, lambda u, h: paged.Answer(200, "<html>"), waits.append)
    assert paged.fetch_page(api, None, lambda u, h: paged.Answer(200, "{}"), waits.append) == ([], None)
    assert [paged.retry_wait(h) for h in ("90", "0", "-1", "nan", "inf", "x", None, "2.5")] == [60, 5, 5, 5, 5, 5, 5, 2.5]
    assert [paged.pages_of(n) for n in (0, 5, 99)] == [1, 5, 10]


def test_feed_from_text_and_url(spark, tmp_path):
    text = "title,link,price\nSeiko SBDC101,https://a.b/s,12\n"
    rows, _ = feeds.read_feed_text(spark, text, str(tmp_path / "land" / "f.csv"), 3, lambda c: W.parse_watch(c))
    assert [(r.external_id, r.price_cents) for r in rows.collect()] == [("s", 1200)]
    rows, counts = feeds.read_feed_url(spark, (tmp_path / "land" / "f.csv").as_uri(), str(tmp_path / "two" / "g.csv"), 3, lambda c: W.parse_watch(c))
    assert rows.count() == 1 and counts.first().n == 1
