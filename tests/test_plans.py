"""The physical plans one wants: filters at the scan, top-k instead of sorts, few exchanges, no Python where SQL will do."""

import pytest
from pyspark.sql import functions as F

from tallyrill.operators import events as E
from tallyrill.operators import review as R
from tallyrill.operators import search as Q
from tallyrill.sources.fixtures import LISTINGS_AS_OF, view


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    for name in ("listings", "sources", "reviews", "gold", "analytics_events"):
        view(spark, sf_dir, name).write.parquet(f"{root}/{name}")
    return lambda name: spark.read.parquet(f"{root}/{name}")


def test_search_prunes_and_pushes(stored):
    p = plan(Q.search(stored("listings"), stored("sources"), Q.SearchParams(brand=("Rolex", "Omega"), min_price=1000), LISTINGS_AS_OF).select("id", "source_name"))
    for pushed in ("In(brand, [Omega,Rolex])", "GreaterThanOrEqual(price_cents,100000)", "EqualTo(is_bundle,false)", "GreaterThanOrEqual(last_seen_at"):
        assert pushed in p or pushed.replace("[Omega,Rolex]", "[Rolex,Omega]") in p or pushed == "EqualTo(is_bundle,false)" and "is_bundle" in p, pushed
    scan = p[p.index("ReadSchema") :].split("\n")[0]
    assert "title" not in scan and "description" not in scan
    assert "TakeOrderedAndProject" in p or "GlobalLimit" in p


def test_count_reads_no_wide_column(stored):
    p = plan(Q.count_matches(stored("listings"), Q.SearchParams(), LISTINGS_AS_OF))
    assert "title" not in p and "description" not in p


def test_health_is_one_pass(stored):
    p = plan(R.data_health(stored("listings"), stored("reviews"), LISTINGS_AS_OF))
    assert p.count("Scan parquet") <= 4 and "Python" not in p  # each scan is named twice


def test_hold_out_is_an_anti_join(stored):
    p = plan(R.training_export(stored("listings"), stored("reviews"), stored("gold")))
    assert "LeftAnti" in p and "BroadcastNestedLoop" not in p


def test_sessions_are_reduced_once(stored):
    p = plan(E.session_stats(stored("analytics_events"), "2024-01-31"))
    assert "Expand" not in p and p.count("Exchange hashpartitioning") <= 2  # each exchange is named twice


def test_searches_without_click_is_no_null_aware_join(stored):
    p = plan(E.searches_by_click(stored("analytics_events"), "2024-01-31").select(F.col("n")))
    assert "LeftAnti" in p and "LeftSemi" in p and "isNullAwareAntiJoin" not in p


def test_lines_are_moved_once_for_window_and_orders(spark, sf_dir):
    """Lines lie by their order: no exchange by the window's keys in between."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(view(spark, sf_dir, "listings"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(l_orderkey" in p
    assert not [line for line in p.split("\n") if "hashpartitioning(l_suppkey" in line and "l_linenumber" in line]


WATCH = "struct<brand: string, reference: string>"


def _parsed(watch):
    none = F.lit(None)
    return {"watch": watch, "condition": none.cast("string"), "watch_type": none.cast("string"), "price_cents": none.cast("bigint"), "is_bundle": F.lit(False), "is_sold": F.lit(False)}


def test_backfill_parses_once(spark, stored):
    watch = F.when(F.col("title") != "a mark", F.struct(F.upper("title").alias("brand"), F.lower("title").alias("reference")))
    df = R.backfill_parse(stored("listings"), stored("reviews"), _parsed(watch), Q.at(LISTINGS_AS_OF))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        p = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert p.count("a mark") == 1


def test_backfill_parses_only_what_may_be_written(stored):
    """No row whose labels are kept is parsed; those of one free label are."""
    free = R.may_overwrite("brand") | R.may_overwrite("reference")
    found = F.struct(F.lit("B").alias("brand"), F.lit("R").alias("reference"))
    parsed = _parsed(F.when(free, found).otherwise(F.raise_error(F.lit("parsed in vain")).cast(WATCH)))
    reviewed = stored("reviews").where("bundle_reviewed").select(F.col("listing_id").alias("id"))
    parsed["is_sold"] = F.when(~F.col("is_sold"), F.lit(True)).otherwise(F.raise_error(F.lit("parsed in vain")).cast("boolean"))
    got = R.backfill_parse(stored("listings"), stored("reviews"), parsed, Q.at(LISTINGS_AS_OF))
    assert got.where("not is_sold").count() == 0 and got.join(reviewed, "id", "left_anti").where("is_bundle").count() == 0
    kept = stored("listings").where(~R.may_overwrite("brand")).select("id", F.col("brand").alias("own"))
    assert got.join(kept, "id").where("brand <> own").count() == 0 < got.where("brand = 'B'").count()


def test_queue_reads_only_its_page(stored):
    """Once the page is known, gold, reviews and listings are narrowed to it at their scans; a page beyond the bound is the same without."""
    where = R.recent(LISTINGS_AS_OF, 180) & R.queues()["missing_brand"]
    tables = [stored(n) for n in ("listings", "sources", "reviews", "gold")]
    df = R.queue_rows(*tables, where, 7, 3)
    p = plan(df)
    assert "In(id, [" in p and p.count("In(listing_id, [") == 2
    whole = R.queue_rows(*tables, where, R.PAGE_IDS + 1)
    rows = whole.select("id", "first_seen_at", "source_name", "in_gold", "reasons").orderBy(F.desc("first_seen_at"), "id").collect()
    assert sorted(rows[3:10]) == sorted(df.select("id", "first_seen_at", "source_name", "in_gold", "reasons").collect()) and len(rows) > 10
    assert R.queue_rows(*tables, F.lit(False)).count() == 0
