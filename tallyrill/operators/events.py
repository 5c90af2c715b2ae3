"""Event funnel, sessions and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import at

KINDS = ("page_view", "search", "click")


def since(as_of: str, days: int) -> Column:
    return F.col("created_at") >= at(as_of) - F.make_interval(days=F.lit(days))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves up, of a double of either sign."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def event_counts(events: DataFrame, as_of: str) -> DataFrame:
    """Events by type over 7 days and 24 hours, in one pass."""
    return events.where(since(as_of, 7)).groupBy("event_type").agg(F.count("*").alias("n_7d"), F.count_if(since(as_of, 1)).alias("n_24h"))


def session_stats(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Sessions in all, with a search, with a click. Reduced to one row a session first, so a hot session is pre-aggregated."""
    kind = lambda k: F.max(F.col("event_type") == k)
    each = events.where(since(as_of, days) & F.col("session_id").isNotNull()).groupBy("session_id").agg(kind("search").alias("s"), kind("click").alias("c"))
    return each.agg(F.count("*").alias("total_sessions"), F.count_if("s").alias("search_sessions"), F.count_if("c").alias("click_sessions"))


def top_queries(events: DataFrame, as_of: str, days: int = 7, limit: int = 15) -> DataFrame:
    asked = events.where(since(as_of, days) & (F.col("event_type") == "search") & (F.col("query") != ""))
    return asked.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def searches_by_click(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Searches in sessions without and with a click: anti and semi join against the clicking sessions."""
    recent = events.where(since(as_of, days) & F.col("session_id").isNotNull())
    clicking = recent.where("event_type = 'click'").select("session_id").distinct()
    asked = recent.where("event_type = 'search'").select("session_id")
    count = lambda how, name: asked.join(clicking, "session_id", how).agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
    return count("left_anti", "without_click").unionByName(count("left_semi", "with_click"))


def filter_usage(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """How often each filter was set; a JSON null counts as set, a missing key does not."""
    applied = events.where(since(as_of, days) & (F.col("event_type") == "filter_apply")).withColumn("_m", F.try_parse_json("metadata_json"))
    has = lambda k: F.try_variant_get("_m", f"$.{k}", "variant").isNotNull()
    true = lambda k: F.coalesce(F.try_variant_get("_m", f"$.{k}", "boolean"), F.lit(False))
    return applied.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.json_array_length(F.get_json_object("metadata_json", "$.brands")), F.lit(0)) > 0).alias("with_brand"),
        F.count_if(has("minPrice") | has("maxPrice")).alias("with_price"),
        F.count_if(has("condition")).alias("with_condition"),
        F.count_if(has("state")).alias("with_state"),
        F.count_if(true("includeSold")).alias("with_sold"),
        F.count_if(true("includeStale")).alias("with_stale"),
        F.count_if(true("includeBundles")).alias("with_bundles"),
    )


def by_source(clicks: DataFrame, sources: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    counted = clicks.where(since(as_of, days)).groupBy("source_id").agg(F.count("*").alias("n"))
    return counted.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")


def by_placement(clicks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return clicks.where(since(as_of, days)).groupBy(F.coalesce("placement", F.lit("unknown")).alias("placement")).agg(F.count("*").alias("n"))


def by_day(clicks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return clicks.where(since(as_of, days)).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def daily_funnel(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Page views, searches and clicks of each day."""
    recent = events.where(since(as_of, days)).groupBy(F.to_date("created_at").alias("day"))
    return recent.agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in KINDS])


def recent_sessions(events: DataFrame, as_of: str, days: int = 7, limit: int = 20) -> DataFrame:
    each = events.where(since(as_of, days) & F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == "search").alias("searches"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    return each.orderBy(F.desc("last_seen"), "session_id").limit(limit)


def funnel_ratios(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Searches per searching session, share of searching sessions that click, clicks per page view in percent; 0 where there is nothing to divide by."""
    recent = events.where(since(as_of, days))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    totals = recent.groupBy("session_id").agg(*[kind(k).alias(k) for k in KINDS])
    named = F.col("session_id").isNotNull()
    sums = totals.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS],
        F.count_if(named & (F.col("search") > 0)).alias("searching"),
        F.count_if(named & (F.col("click") > 0)).alias("clicking"),
    )
    ratio = lambda a, b, scale, digits: F.when(F.col(b) > 0, round_half_up(F.col(a) * scale / F.col(b), digits)).otherwise(F.lit(0.0))
    return sums.select(ratio("search", "searching", 1.0, 1).alias("searches_per_session"), ratio("clicking", "searching", 100.0, 1).alias("click_session_pct"), ratio("click", "page_view", 100.0, 1).alias("ctr_pct"))


def click_totals(clicks: DataFrame, as_of: str) -> DataFrame:
    return clicks.where(since(as_of, 7)).agg(F.count_if(since(as_of, 1)).alias("n_24h"), F.count("*").alias("n_7d"))


def recent_clicks(clicks: DataFrame, listings: DataFrame, sources: DataFrame, limit: int = 25) -> DataFrame:
    rows = clicks.select("id", "listing_id", "source_id", "placement", "created_at")
    rows = rows.join(listings.select(F.col("id").alias("listing_id"), "title"), "listing_id")
    rows = rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def top_listings(clicks: DataFrame, listings: DataFrame, as_of: str, days: int = 7, limit: int = 10) -> DataFrame:
    """Counted before the join: clicks shrink to one row a listing."""
    counted = clicks.where(since(as_of, days)).groupBy("listing_id").agg(F.count("*").alias("n"))
    return counted.join(listings.select(F.col("id").alias("listing_id"), "title"), "listing_id").orderBy(F.desc("n"), "listing_id").limit(limit)


def click_kpis(clicks: DataFrame, sources: DataFrame, listings: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Average a day, share of the top source in percent, busiest day, and listings in the top ten (at most 10, by its nature)."""
    total = clicks.where(since(as_of, days)).agg(F.count("*").alias("n"))
    source = by_source(clicks, sources, as_of, days).agg(F.max("n").alias("top"))
    day = by_day(clicks, as_of, days).agg(F.max_by("day", F.struct("n", F.negative(F.unix_date("day")))).alias("busiest_day"))
    ten = top_listings(clicks, listings, as_of, days).agg(F.count("*").alias("top_listings"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each is a single row
    row = one(total).join(one(source), "_one").join(one(day), "_one").join(one(ten), "_one")
    return row.select(
        F.floor(F.col("n") / float(days) + 0.5).alias("avg_per_day"),
        F.when(F.col("n") > 0, F.floor(F.coalesce("top", F.lit(0)) * 100.0 / F.col("n") + 0.5)).otherwise(F.lit(0)).cast("bigint").alias("top_source_pct"),
        "busiest_day",
        "top_listings",
    )


def without_repeats(events: DataFrame) -> DataFrame:
    """Events without those that repeat the one before in their session: same type, query, placement and metadata."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    same = F.struct("event_type", "query", "placement", "metadata_json")
    before = F.lag(same).over(w)
    return events.withColumn("_repeat", F.coalesce(before.eqNullSafe(same), F.lit(False))).where(~F.col("_repeat")).drop("_repeat")


def emitted_events(requests: DataFrame) -> DataFrame:
    """The events of a page request (session_id, q, filters: map of strings, created_at): always a page view, a search if q is set, a filter event if any filter is."""
    q = F.trim(F.coalesce("q", F.lit(""))) != ""
    filtered = F.exists(F.map_values(F.coalesce("filters", F.create_map().cast("map<string,string>"))), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    kinds = F.array_compact(F.array(F.lit("page_view"), F.when(q, F.lit("search")), F.when(filtered, F.lit("filter_apply"))))
    return requests.withColumn("event_type", F.explode(kinds))


def valid_events(events: DataFrame, most_json: int = 2048) -> DataFrame:
    """Events that clients may send (known types, all but clicks), with bounded strings; metadata beyond the bound is dropped, not cut."""
    bounds = {"session_id": 64, "path": 512, "query": 1024, "placement": 32, "referer": 512, "user_agent": 512}
    out = events.where(F.col("event_type").isin("page_view", "search", "filter_apply"))
    out = out.withColumns({c: F.substring(c, 1, n) for c, n in bounds.items() if c in events.columns})
    return out.withColumn("metadata_json", F.when(F.length("metadata_json") <= most_json, F.col("metadata_json")))


def clicks_from_requests(requests: DataFrame, listings: DataFrame, as_of: str) -> DataFrame:
    """Clicks of requests (raw_id, ip, user_agent, referer, placement): of whole positive ids, known listings and http(s) targets only; with the url to redirect to."""
    from tallyrill.functions.scalars import hash_ip, safe_url

    asked = requests.withColumn("listing_id", F.when(F.col("raw_id").rlike(r"^[1-9][0-9]{0,17}\z"), F.col("raw_id").cast("bigint"))).where("listing_id is not null")
    found = asked.join(listings.select(F.col("id").alias("listing_id"), "source_id", "listing_url"), "listing_id").where(safe_url(F.col("listing_url")))
    cut = lambda c, n: F.substring(c, 1, n).alias(c)
    return found.select("listing_id", "source_id", hash_ip(F.col("ip"), at(as_of)).alias("ip_hash"), cut("user_agent", 512), cut("referer", 512), cut("placement", 32), at(as_of).alias("created_at"), F.col("listing_url").alias("redirect_to"))
