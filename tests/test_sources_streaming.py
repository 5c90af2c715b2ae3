"""Sources, streams and the limiter."""

import json

from pyspark.sql import functions as F

from tallyrill.functions import watches as W
from tallyrill.operators import events as E
from tallyrill.operators import merge as M
from tallyrill.operators.search import at
from tallyrill.sources import feeds, schema
from tallyrill.sources.buckets import BucketTable
from tallyrill.sources.fixtures import view
from tallyrill.streaming import ingest, limiter

POST = {"id": "a1", "title": "[WTS] [CA] Omega Speedmaster 145.022 $4,500", "selftext": "Excellent condition", "permalink": "/r/x/a1", "author": "me", "created_utc": 1.0, "link_flair_text": "WTS", "is_gallery": True}
MEDIA = {"x": {"status": "valid", "s": {"u": "https://i/1?a&amp;b"}}, "y": {"status": "failed", "s": {"u": "https://i/2"}}}


def test_posts(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in [POST | {"media_metadata": MEDIA}, POST | {"id": "a2", "title": "[deleted]"}, POST | {"id": "a3", "stickied": True}]))
    rows = feeds.posts_to_listings(feeds.typed_posts(feeds.read_posts(spark, str(tmp_path))), 7, W.parse_watch("title"), W.detect_bundle("title", "selftext"), "https://forum.example")
    r = rows.collect()
    assert [x.external_id for x in r] == ["a1"]
    assert (r[0].brand, r[0].reference, r[0].price_cents, r[0].region, r[0].condition, r[0].image_url, r[0].listing_url) == ("Omega", "145.022", 450000, "CA", "very good", "https://i/1?a&b", "https://forum.example/r/x/a1")


def test_comments(spark):
    kinds = "post_id string, ok boolean, author string, selftext string, link_flair_text string, children array<struct<kind: string, data: struct<author: string, body: string>>>"
    rows = spark.createDataFrame([("p", True, "me", "[removed]", "WTS", [("t1", ("me", "one")), ("t1", ("you", "no")), ("more", ("me", "no")), ("t1", ("me", " two "))]), ("q", False, "me", "x", None, [])], kinds)
    got = {r.post_id: r for r in feeds.thread_contexts(rows).collect()}
    assert got["p"].op_comment == "one\n\ntwo" and got["p"].self_text is None and got["q"].ok is False


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('Product Name,LINK,Price,SKU\n"Omega ""Speed"", 145.022",https://a.b/c/d1,"$1,200.00",\n\nshort,only\nSeiko SBDC101,https://a.b/s,USD,s9\n')
    rows, counts = feeds.read_feed(spark, str(path), 3, lambda c: W.parse_watch(c))
    got = {r.external_id: r for r in rows.collect()}
    assert set(got) == {"d1", "s9"} and got["d1"].price_cents == 120000 and got["s9"].price_cents == 0 and got["d1"].title == 'Omega "Speed", 145.022'
    assert counts.first().skipped == 1 and counts.first().n == 3
    assert feeds.sniff_delimiter("a\tb,c") == "\t" and feeds.normal_header(" Sale Price! ") == "sale_price"


def test_markets(spark):
    items = spark.createDataFrame([("1", "https://x", "Omega Speedmaster", "145.022", ["https://i"], " US ", (10.5, "€"), 1), (None, "https://x", "t", None, None, None, None, 2)], schema.MARKET_ITEMS + ", pos int")
    r = feeds.market_to_listings(items, 5, lambda c: W.parse_watch(c)).collect()
    assert len(r) == 1 and (r[0].price_cents, r[0].currency, r[0].region, r[0].reference) == (1050, "EUR", "US", "145.022")
    items = spark.createDataFrame([("9", "Seiko", ("12.5", None), "Used", "3000", "https://x", None, [("https://t",)], ("US", "CA", "1"), 1)], schema.CATALOG_ITEMS + ", pos int")
    r = feeds.catalog_to_listings(items, 5, lambda c: W.parse_watch(c)).first()
    assert (r.price_cents, r.currency, r.condition, r.image_url, r.region) == (1250, "USD", "used", "https://t", "CA")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', True), (2, None, None)], "i int, t string, b boolean")
    feeds.write_csv(df.coalesce(1), str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert text == 'i,t,b\n1,"a ""b"", c",true\n2,,\n'


def test_stream_ingest(spark, tmp_path):
    source, table = tmp_path / "in", BucketTable(spark, str(tmp_path / "t"), schema.LISTINGS, M.KEY)
    source.mkdir()

    def drain():
        q = ingest.ingest_posts(feeds.stream_posts(spark, str(source)), table, lambda: spark.createDataFrame([], schema.REVIEWS), 7, W.parse_watch("title"), W.detect_bundle("title", "selftext"), lambda: at("2024-01-01"), str(tmp_path / "c"))
        q.awaitTermination(120)

    (source / "1.json").write_text(json.dumps(POST))
    drain()
    (source / "2.json").write_text(json.dumps(POST | {"title": "[WTS] [NY] Omega Speedmaster [SOLD]", "created_utc": 2.0}))
    drain()
    rows = table.read().collect()
    assert len(rows) == 1 and rows[0].region == "NY" and rows[0].is_sold and rows[0].price_cents == 450000 and table.version() == 2
    drain()
    assert table.version() == 2


def test_limiter_batch_and_stream(spark, tmp_path):
    rows = [("a", i * 1000, False) for i in range(9)] + [("a", 2_000_000, True), ("b", 0, False), ("b", 1, True), ("b", 700_000, False)]
    df = spark.createDataFrame(rows, "ip string, ms bigint, success boolean")
    got = {(r.ip, r.ms): r.outcome for r in limiter.decide(df).collect()}
    assert got["a", 6000] == "denied" and got["a", 7000] == "blocked" and got["a", 8000] == "blocked" and got["a", 2_000_000] == "ok" and got["b", 1] == "ok"
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limiter.decide_stream(stream).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.ip, r.ms): r.outcome for r in spark.table("limited").collect()} == got


def test_events(spark, sf_dir, tmp_path):
    events = view(spark, sf_dir, "analytics_events")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = ingest.day_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.day, r.event_type): r.n for r in events.groupBy(F.to_date("created_at").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.day, r.event_type): r.n for r in spark.table("days").collect()} == batch
    asked = spark.createDataFrame([("s", " omega ", {"brand": ""}), ("s", "", {"brand": "x"}), ("s", None, None)], "session_id string, q string, filters map<string,string>")
    assert sorted(r.event_type for r in E.emitted_events(asked).collect()) == ["filter_apply", "page_view", "page_view", "page_view", "search"]


def test_clicks(spark, sf_dir):
    listings = view(spark, sf_dir, "listings")
    some = listings.first()
    asked = spark.createDataFrame([(str(some.id), "1.2.3.4, 5.6.7.8", "ua", None, "home"), ("x", None, None, None, None), ("99999999999999", None, None, None, None)], "raw_id string, ip string, user_agent string, referer string, placement string")
    r = E.clicks_from_requests(asked, listings, "2024-01-31").collect()
    assert len(r) == 1 and r[0].listing_id == some.id and len(r[0].ip_hash) == 64


def test_upsert_rules(spark, sf_dir):
    listings = view(spark, sf_dir, "listings")
    cleared = M.clear_descriptions(listings, listings.select("id"))
    assert cleared.where("description = '[no comment]'").count() == 0 and cleared.count() == listings.count()


def test_classify(spark):
    from tallyrill.functions.classify import classify, prompt_text
    from tallyrill.sources.demo import demo_listings, demo_sources

    rows = spark.createDataFrame([(1, "a", "", None), (2, "b", "x" * 5000, "c"), (3, " ", None, None), (4, "d", None, None), (5, "e", None, None)], "id int, title string, description string, op_comment string")
    said = {"a": '{"condition": "good", "watch_type": "modern", "confidence": 1.7}', "d": "no json", "e": '{"condition": 5, "watchType": "vintage", "confidence": "0.9"}'}
    got = {r.id: (r.condition, r.watch_type, r.confidence) for r in classify(rows, lambda texts: [said.get(t) for t in texts]).collect()}
    assert got == {1: ("good", None, 1.0), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None), 5: (None, "vintage", 0.0)}
    assert rows.where("id = 2").select(F.length(prompt_text(F.col("title"), F.col("description"), F.col("op_comment"))).alias("n")).first().n == 4000
    demo = demo_listings(spark, lambda c: W.parse_watch(c), at("2024-01-01"))
    assert demo.count() == 20 and demo.where("brand is null").count() == 0 and demo_sources(spark).count() == 1
    assert demo.dtypes == spark.createDataFrame([], schema.LISTINGS).dtypes
