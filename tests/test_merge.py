"""Merge rules, alone and in properties."""

import pytest
from pyspark.sql import functions as F

from tallyrill.operators import merge as M
from tallyrill.operators import review as R
from tallyrill.operators import search as Q
from tallyrill.operators.schedule import due_source, gate_open, run_all, until_short
from tallyrill.sources import schema
from tallyrill.sources.fixtures import LISTINGS_AS_OF, view
from tests.oracle import spark_rows

def now():
    return Q.at("2024-01-01")


def triple(spark, old, new):
    df = spark.createDataFrame([(*old, *new)], ", ".join(f"{c} bigint" for c in "abcdef"))
    r = df.select(M.price_triple((F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("e"), F.col("f"))).alias("r")).first()["r"]
    return tuple(r)


def test_price_triple(spark):
    n = None
    assert triple(spark, (n, n, n), (1500, 1000, 1999)) == (1500, 1000, 1999)
    assert triple(spark, (1200, n, n), (1500, 1000, 1999)) == (1200, n, n)
    assert triple(spark, (1500, 1000, 1999), (1200, n, n)) == (1200, n, n)
    assert triple(spark, (1500, 1000, 1999), (n, n, n)) == (1500, 1000, 1999)


def test_description(spark):
    def merged(old, said, comment):
        df = spark.createDataFrame([(old, said, comment)], "o string, s string, c string")
        return df.select(M.merged_description(F.col("o"), F.col("s"), F.col("c")).alias("d")).first()["d"]

    assert merged(None, "a", "b") == "a\n\nb"
    assert merged("[no comment]", None, "b") == "b"
    assert merged("has a inside", "a", "b") == "has a inside\n\nb"
    assert merged(None, None, "[no comment]") == "[no comment]"
    assert merged("x", None, "[no comment]") == "x"
    assert merged("x", None, None) == "x"


def test_merge_is_idempotent_and_a_fold(spark, sf_dir):
    listings = view(spark, sf_dir, "listings").where("id % 50 = 0")
    reviews = view(spark, sf_dir, "reviews")
    rows = listings.where("id % 100 = 0").selectExpr("source_id", "external_id", "1 as pos", "'t' as title", "cast(null as string) as brand", "5000L as price_cents", "cast(null as bigint) as price_min_cents", "cast(null as bigint) as price_max_cents", "false as is_bundle", "true as is_sold")
    later = rows.withColumn("pos", F.lit(2)).withColumn("title", F.lit("u"))
    once = M.upsert_forum(listings, rows, reviews, now())
    assert spark_rows(M.upsert_forum(once, rows, reviews, now())) == spark_rows(once)
    both = M.upsert_forum(listings, rows.unionByName(later), reviews, now())
    assert spark_rows(both) == spark_rows(M.upsert_forum(once, later, reviews, now()))


def test_forum_moves_listings_once(spark, sf_dir):
    """A reviewer's lock holds by id, rows without a key are left out, and whole listings are joined by their key only."""
    listings = view(spark, sf_dir, "listings").where("id % 50 = 0")
    (held, was), *_ = [(r.id, r.is_bundle) for r in listings.select("id", "is_bundle").orderBy("id").limit(1).collect()]
    reviews = spark.createDataFrame([(held, True), (None, True)], "listing_id bigint, bundle_reviewed boolean")
    rows = listings.selectExpr("source_id", "external_id", "1 as pos", "'t' as title", "cast(null as string) as brand", "1L as price_cents", "2L as price_min_cents", "3L as price_max_cents", "not is_bundle as is_bundle", "false as is_sold")
    out = M.upsert_forum(listings, rows.unionByName(rows.limit(1).withColumn("external_id", F.lit(None).cast("string"))), reviews, now())
    got = {r.id: r.is_bundle for r in out.collect()}
    old = {r.id: r.is_bundle for r in listings.collect()}
    assert got == {k: v if k == held else not v for k, v in old.items()} and got[held] == was
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" in plan and "Join LeftOuter, (id#" not in plan and plan.count("max_by(") > 0 and plan.count("collect_list(") == 1 and "Join Inner, ((source_id" not in plan


def test_pages_partition_the_result(spark, sf_dir):
    listings, sources = view(spark, sf_dir, "listings"), view(spark, sf_dir, "sources")
    p = lambda **k: Q.SearchParams(include_stale=True, brand=("Omega",), **k)
    whole = [r.id for r in Q.search(listings, sources, p(limit=60), LISTINGS_AS_OF).collect()]
    parts = [r.id for i in range(0, 60, 20) for r in Q.search(listings, sources, p(limit=20, offset=i), LISTINGS_AS_OF).collect()]
    assert whole == parts


def test_search_parameters():
    p = Q.SearchParams.from_url({"q": " x ", "brand": ["Omega", "omega ", ""], "minPrice": "abc", "maxPrice": "5", "page": "3", "includeSold": "1", "includeStale": "0"})
    assert (p.brand, p.min_price, p.max_price, p.offset, p.include_sold, p.include_stale) == (("Omega",), None, 5.0, 100, True, False)
    assert Q.clamp(None, 1, 100, 25) == 25 and Q.clamp(0, 1, 100, 25) == 1 and Q.clamp(1e9, 1, 100, 25) == 100
    assert Q.page_bounds(101, 60, 9) == (2, 2, 60) and Q.cents(1.005) == 100
    assert R.like_escaped("100%") == "100\\%" and R.like_escaped("a_b") == "a\\_b" and R.like_escaped("path\\file") == "path\\\\file"
    assert R.split_quota(150, 8) == [19] * 6 + [18] * 2


def test_unknown_review_stays_null(spark):
    listings = spark.createDataFrame([(1, "Omega", "1", "good", None, 5, None, None)], "id bigint, brand string, reference string, condition string, watch_type string, price_cents bigint, price_min_cents bigint, price_max_cents bigint")
    reviews = spark.createDataFrame([(1, True)], "listing_id bigint, brand_reviewed boolean")
    for c in schema.REVIEWS.split(", "):
        n, t = c.split(" ")
        if n not in reviews.columns:
            reviews = reviews.withColumn(n, F.lit(None).cast(t))
    row = R.effective_labels(listings, reviews).first()
    assert row["effective_brand"] is None and row["effective_condition"] == "good"


def test_review_delta(spark):
    kinds = "listing_id bigint, brand string, reference string, condition string, watch_type string, price_cents bigint, price_min_cents bigint, price_max_cents bigint"
    base = spark.createDataFrame([(1, "Omega", "r", "good", None, 100, None, None)], kinds)
    form = spark.createDataFrame([(1, " Omega ", "s", "", None, None, 100, 201)], kinds)
    row = M.review_delta(base, form).first()
    assert (row.touch_brand, row.touch_reference, row.touch_condition, row.touch_price, row.price_cents) == (False, True, False, True, 151)


def test_schedule():
    from datetime import UTC, datetime

    at = datetime(2024, 1, 1, 6, 5, tzinfo=UTC)
    assert gate_open(at, 6) and not gate_open(at, 7) and due_source(at, []) is None and due_source(at, ["a"]) == "a"
    report = run_all({"a": lambda: 1}, {"b": lambda: 1 / 0, "c": lambda: 2})
    assert report.done == {"a": 1, "c": 2} and set(report.failed) == {"b"}
    left = [5, 5, 2]
    assert until_short(lambda: left.pop(0), 5) == 12


def test_rescue_pass(spark):
    from tallyrill.operators.rescue import rescue_pass

    kinds = [f.split(" ", 1) for f in schema.LISTINGS.split(", ")]
    base = {"source_id": 1, "currency": "USD", "is_bundle": False, "is_sold": False}
    import datetime

    at = datetime.datetime(2023, 12, 31)
    rows = [
        base | {"id": 1, "external_id": "a", "title": "Nice watch", "first_seen_at": at, "price_cents": 150000, "price_min_cents": 100000, "price_max_cents": 199900},
        base | {"id": 2, "external_id": "b", "title": "Omega", "first_seen_at": at, "price_cents": 5000, "brand": "Omega", "brand_source": "ai"},
        base | {"id": 3, "external_id": "c", "title": "x", "first_seen_at": at},
        base | {"id": 4, "external_id": "d", "title": "x", "first_seen_at": at, "description": "full"},
    ]
    listings = spark.createDataFrame([tuple(r.get(n) for n, _ in kinds) for r in rows], schema.LISTINGS)
    contexts = spark.createDataFrame([("a", True, "Omega Speedmaster 145.022, BNIB, asking 4500", "sold to u/x", None), ("b", True, None, "9/10", "Under $500"), ("c", False, "Rolex", None, None), ("d", True, "Rolex", None, None)], "post_id string, ok boolean, self_text string, op_comment string, flair string")
    got = {r.id: r for r in rescue_pass(listings, spark.createDataFrame([], schema.REVIEWS), contexts, 1, now()).collect()}
    assert (got[1].brand, got[1].reference, got[1].price_cents, got[1].price_min_cents, got[1].is_sold, got[1].condition) == ("Omega", "145.022", 450000, None, True, "unworn")
    assert got[1].description.endswith("sold to u/x") and got[1].brand_source == "regex"
    assert (got[2].price_cents, got[2].condition, got[2].brand_source, got[2].description) == (5000, "very good", "regex", "9/10")
    assert got[3].description is None and got[3].brand is None and got[4].brand is None


def test_until_short_does_not_stop_unsaid():
    with pytest.raises(RuntimeError, match="not done after 3 batches, which did 15"):
        until_short(lambda: 5, 5, most=3)
    assert until_short(iter([5, 5, 1]).__next__, 5, most=3) == 11
