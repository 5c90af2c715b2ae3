"""Search, dashboard and review queries over the fixture views, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.functions import scalars as S
from tallyrill.operators import events as E
from tallyrill.operators import review as R
from tallyrill.operators import search as Q
from tallyrill.sources.fixtures import EVENTS_AS_OF, LISTINGS_AS_OF, WINDOW_DAYS, view, with_views

HOURS = WINDOW_DAYS * 24
NOW = f"TIMESTAMP '{LISTINGS_AS_OF} 00:00:00'"
E_NOW = f"TIMESTAMP '{EVENTS_AS_OF} 00:00:00'"
FRESH = f"last_seen_at >= {NOW} - INTERVAL {HOURS} HOUR"
SHOWN = f"{FRESH} AND NOT is_bundle AND NOT is_sold"
RECENT = f"first_seen_at >= {NOW} - INTERVAL {WINDOW_DAYS} DAY"
LAST7 = f"created_at >= {E_NOW} - INTERVAL 7 DAY"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str):
    """Register fn(views...) under name, with its SQL."""

    def put(fn):
        QUERIES[name] = lambda spark, d: fn(*[view(spark, d, v) for v in views])
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return put


def params(**k) -> Q.SearchParams:
    return Q.SearchParams(stale_after_hours=HOURS, **k)


_HIT = "id, title, brand, price_cents, last_seen_at, source_name"


def _search_sql(where: str, order: str, limit: int = 25, offset: int = 0) -> str:
    return f"SELECT l.id, l.title, l.brand, l.price_cents, l.last_seen_at, s.name AS source_name FROM listings l JOIN sources s ON s.id = l.source_id WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


def _search(name: str, where: str, order: str, limit: int = 25, offset: int = 0, **k) -> None:
    @query(name, _search_sql(where, order, limit, offset), "listings", "sources")
    def run(listings, sources):
        return Q.search(listings, sources, params(limit=limit, offset=offset, **k), LISTINGS_AS_OF).select(*_HIT.split(", "))


_search("search_default", f"brand IN ('Rolex', 'Omega') AND price_cents >= 100000 AND {SHOWN}", "price_cents DESC NULLS LAST, l.id", brand=("Rolex", "Omega"), min_price=1000, sort="price_desc")
_search("search_price_asc", f"price_cents >= 500000 AND price_cents <= 2000000 AND {SHOWN}", "price_cents ASC NULLS FIRST, l.id", min_price=5000, max_price=20000, sort="price_asc")
_search("search_newest", f"region = 'CA' AND {SHOWN}", "first_seen_at DESC NULLS LAST, l.id", 10, state="CA", sort="newest")
_search("search_page_2", f"condition = 'good' AND {SHOWN}", "last_seen_at DESC NULLS LAST, l.id", 20, 20, condition="good")
_search("search_no_condition", f"condition IS NULL AND watch_type = 'vintage' AND {SHOWN}", "last_seen_at DESC NULLS LAST, l.id", condition="n/a", watch_type="vintage")
_search("search_text", f"(lower(title) LIKE '%red bolt%' OR lower(brand) LIKE '%red bolt%' OR lower(reference) LIKE '%red bolt%') AND {SHOWN}", "last_seen_at DESC NULLS LAST, l.id", 100, q=" Red Bolt ")
_search("search_wildcard", f"(lower(title) LIKE '%seiko%1%9%' OR lower(brand) LIKE '%seiko%1%9%' OR lower(reference) LIKE '%seiko%1%9%') AND {SHOWN}", "last_seen_at DESC NULLS LAST, l.id", 100, q="Seiko%1%9")
_search("search_with_sold", f"{FRESH} AND NOT is_bundle AND (NOT is_sold OR (is_sold AND sold_at >= {NOW} - INTERVAL 24 HOUR))", "last_seen_at DESC NULLS LAST, l.id", 100, include_sold=True)
_search("search_everything", "(NOT is_sold)", "price_cents DESC NULLS LAST, l.id", 50, include_stale=True, include_bundles=True, sort="price_desc")


@query("search_count", f"SELECT count(*) AS total FROM listings WHERE brand = 'Seiko' AND {SHOWN}", "listings")
def _(listings):
    return Q.count_matches(listings, params(brand=Q.normalize_brands([" Seiko", "seiko "])), LISTINGS_AS_OF)


def shown(**k):
    return Q.facet_filter(LISTINGS_AS_OF, stale_after_hours=HOURS, **k)


@query("facet_brands", f"SELECT DISTINCT brand FROM listings WHERE {SHOWN} AND brand <> ''", "listings")
def _(listings):
    return Q.brands(listings, shown())


@query("facet_top_brands", f"SELECT brand, count(*) AS n FROM listings WHERE {SHOWN} AND brand IS NOT NULL GROUP BY brand ORDER BY n DESC, brand LIMIT 12", "listings")
def _(listings):
    return Q.top_brands(listings, shown())


@query("facet_total", f"SELECT count(*) AS total FROM listings WHERE {SHOWN}", "listings")
def _(listings):
    return listings.where(shown()).agg(F.count("*").alias("total"))


@query("facet_typeahead", f"SELECT DISTINCT brand FROM listings WHERE {SHOWN} AND lower(brand) LIKE '%on%' ORDER BY brand LIMIT 10", "listings")
def _(listings):
    return Q.brand_typeahead(listings, shown(), "ON ")


@query(
    "facet_price_presets",
    f"SELECT count(*) FILTER (price_cents <= 100000) AS under_1k, count(*) FILTER (price_cents >= 100000 AND price_cents <= 500000) AS \"1k_5k\", count(*) FILTER (price_cents >= 500000 AND price_cents <= 1500000) AS \"5k_15k\", count(*) FILTER (price_cents >= 1500000) AS over_15k FROM listings WHERE {SHOWN}",
    "listings",
)
def _(listings):
    return Q.price_preset_counts(listings, shown())


@query(
    "dominant_source",
    f"SELECT source_name, n FROM (SELECT source_name, count(*) AS n, min(pos) AS p FROM (SELECT *, row_number() OVER (ORDER BY first_seen_at DESC, id) AS pos FROM ({_search_sql(SHOWN, 'first_seen_at DESC NULLS LAST, l.id', 50).replace('l.last_seen_at', 'l.first_seen_at, l.last_seen_at')})) GROUP BY source_name) ORDER BY n DESC, p LIMIT 1",
    "listings", "sources",
)
def _(listings, sources):
    return Q.dominant_source(Q.search(listings, sources, params(sort="newest", limit=50), LISTINGS_AS_OF), Q.sort_order("newest"))


@query(
    "home_summary",
    f""", shown AS (SELECT * FROM listings WHERE {SHOWN}),
    top AS (SELECT brand, count(*) AS n FROM shown WHERE brand IS NOT NULL GROUP BY brand ORDER BY n DESC, brand LIMIT 12),
    newest AS (SELECT l.id, l.first_seen_at, s.name FROM shown l JOIN sources s ON s.id = l.source_id ORDER BY first_seen_at DESC, l.id LIMIT 8),
    main AS (SELECT name, count(*) AS n, min(pos) AS p FROM (SELECT *, row_number() OVER (ORDER BY first_seen_at DESC, id) AS pos FROM newest) GROUP BY name ORDER BY n DESC, p LIMIT 1)
    SELECT (SELECT count(*) FROM shown) AS total, (SELECT string_agg(brand || ':' || n, '|' ORDER BY n DESC, brand) FROM top) AS top_brands,
      (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY first_seen_at DESC, id) FROM newest) AS newest_ids, (SELECT name FROM main) AS dominant_source""",
    "listings", "sources",
)
def _(listings, sources):
    return Q.home_summary(listings, sources, LISTINGS_AS_OF, HOURS)


@query("card_flags", f"SELECT id, last_seen_at > {NOW} - INTERVAL 24 HOUR AS is_fresh, price_min_cents IS NOT NULL OR price_max_cents IS NOT NULL AS is_approx FROM listings WHERE {FRESH}", "listings")
def _(listings):
    return Q.card_flags(listings.where(Q.seen_since(LISTINGS_AS_OF, HOURS)), LISTINGS_AS_OF).select("id", "is_fresh", "is_approx")


# ---- events -------------------------------------------------------------------------------------------------------


@query("event_counts", f"SELECT event_type, count(*) AS n_7d, count(*) FILTER (created_at >= {E_NOW} - INTERVAL 1 DAY) AS n_24h FROM analytics_events WHERE {LAST7} GROUP BY 1", "analytics_events")
def _(events):
    return E.event_counts(events, EVENTS_AS_OF)


@query("session_stats", f"SELECT count(DISTINCT session_id) AS total_sessions, count(DISTINCT CASE WHEN event_type = 'search' THEN session_id END) AS search_sessions, count(DISTINCT CASE WHEN event_type = 'click' THEN session_id END) AS click_sessions FROM analytics_events WHERE {LAST7}", "analytics_events")
def _(events):
    return E.session_stats(events, EVENTS_AS_OF)


@query("top_queries", f"SELECT query, count(*) AS n FROM analytics_events WHERE {LAST7} AND event_type = 'search' AND query <> '' GROUP BY query ORDER BY n DESC, query LIMIT 15", "analytics_events")
def _(events):
    return E.top_queries(events, EVENTS_AS_OF)


_CLICKING = f"SELECT session_id FROM analytics_events WHERE {LAST7} AND event_type = 'click' AND session_id IS NOT NULL"


@query(
    "searches_by_click",
    f"SELECT count(*) AS n, 'without_click' AS kind FROM analytics_events WHERE {LAST7} AND event_type = 'search' AND session_id NOT IN ({_CLICKING}) UNION ALL SELECT count(*), 'with_click' FROM analytics_events WHERE {LAST7} AND event_type = 'search' AND session_id IN ({_CLICKING})",
    "analytics_events",
)
def _(events):
    return E.searches_by_click(events, EVENTS_AS_OF)


def _json(kind: str, key: str) -> str:
    return f"count(*) FILTER ({kind.format(f"json_extract(metadata_json, '$.{key}')")})"


@query(
    "filter_usage",
    f"""SELECT count(*) AS n, count(*) FILTER (coalesce(json_array_length(metadata_json, '$.brands'), 0) > 0) AS with_brand,
      count(*) FILTER (json_extract(metadata_json, '$.minPrice') IS NOT NULL OR json_extract(metadata_json, '$.maxPrice') IS NOT NULL) AS with_price,
      {_json('{} IS NOT NULL', 'condition')} AS with_condition, {_json('{} IS NOT NULL', 'state')} AS with_state,
      {_json("{} = 'true'", 'includeSold')} AS with_sold, {_json("{} = 'true'", 'includeStale')} AS with_stale, {_json("{} = 'true'", 'includeBundles')} AS with_bundles
    FROM analytics_events WHERE {LAST7} AND event_type = 'filter_apply'""",
    "analytics_events",
)
def _(events):
    return E.filter_usage(events, EVENTS_AS_OF)


@query("event_clicks_by_source", f"SELECT source_id, s.name AS source_name, count(*) AS n FROM analytics_events e JOIN sources s ON s.id = e.source_id WHERE {LAST7} AND event_type = 'click' GROUP BY 1, 2", "analytics_events", "sources")
def _(events, sources):
    return E.by_source(events.where("event_type = 'click'"), sources, EVENTS_AS_OF)


@query("event_clicks_by_placement", f"SELECT coalesce(placement, 'unknown') AS placement, count(*) AS n FROM analytics_events WHERE {LAST7} AND event_type = 'click' GROUP BY 1", "analytics_events")
def _(events):
    return E.by_placement(events.where("event_type = 'click'"), EVENTS_AS_OF)


@query("daily_funnel", f"SELECT CAST(created_at AS DATE) AS day, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in E.KINDS)} FROM analytics_events WHERE {LAST7} GROUP BY 1", "analytics_events")
def _(events):
    return E.daily_funnel(events, EVENTS_AS_OF)


@query("recent_sessions", f"SELECT session_id, count(*) AS events, count(*) FILTER (event_type = 'search') AS searches, count(*) FILTER (event_type = 'click') AS clicks, min(created_at) AS first_seen, max(created_at) AS last_seen FROM analytics_events WHERE {LAST7} AND session_id IS NOT NULL GROUP BY 1 ORDER BY last_seen DESC, session_id LIMIT 20", "analytics_events")
def _(events):
    return E.recent_sessions(events, EVENTS_AS_OF)


@query(
    "funnel_ratios",
    f"""SELECT CASE WHEN ss > 0 THEN floor(s * CAST(1 AS DOUBLE) / ss * 10 + 0.5) / 10 ELSE 0 END AS searches_per_session, CASE WHEN ss > 0 THEN floor(cs * CAST(100 AS DOUBLE) / ss * 10 + 0.5) / 10 ELSE 0 END AS click_session_pct,
      CASE WHEN v > 0 THEN floor(c * CAST(100 AS DOUBLE) / v * 10 + 0.5) / 10 ELSE 0 END AS ctr_pct
    FROM (SELECT count(*) FILTER (event_type = 'search') AS s, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'page_view') AS v,
      count(DISTINCT CASE WHEN event_type = 'search' THEN session_id END) AS ss, count(DISTINCT CASE WHEN event_type = 'click' THEN session_id END) AS cs FROM analytics_events WHERE {LAST7})""",
    "analytics_events",
)
def _(events):
    return E.funnel_ratios(events, EVENTS_AS_OF)


@query("click_totals", f"SELECT count(*) FILTER (created_at >= {E_NOW} - INTERVAL 1 DAY) AS n_24h, count(*) AS n_7d FROM clicks WHERE {LAST7}", "clicks")
def _(clicks):
    return E.click_totals(clicks, EVENTS_AS_OF)


@query("recent_clicks", "SELECT c.id, c.listing_id, c.source_id, c.placement, c.created_at, l.title, s.name AS source_name FROM clicks c JOIN listings l ON l.id = c.listing_id JOIN sources s ON s.id = c.source_id ORDER BY c.created_at DESC, c.id LIMIT 25", "clicks", "listings", "sources")
def _(clicks, listings, sources):
    return E.recent_clicks(clicks, listings, sources)


@query("top_clicked_listings", f"SELECT c.listing_id, l.title, count(*) AS n FROM clicks c JOIN listings l ON l.id = c.listing_id WHERE {LAST7} GROUP BY 1, 2 ORDER BY n DESC, listing_id LIMIT 10", "clicks", "listings")
def _(clicks, listings):
    return E.top_listings(clicks, listings, EVENTS_AS_OF)


@query("clicks_by_source", f"SELECT c.source_id, s.name AS source_name, count(*) AS n FROM clicks c JOIN sources s ON s.id = c.source_id WHERE {LAST7} GROUP BY 1, 2", "clicks", "sources")
def _(clicks, sources):
    return E.by_source(clicks, sources, EVENTS_AS_OF)


@query("clicks_by_placement", f"SELECT coalesce(placement, 'unknown') AS placement, count(*) AS n FROM clicks WHERE {LAST7} GROUP BY 1", "clicks")
def _(clicks):
    return E.by_placement(clicks, EVENTS_AS_OF)


@query("clicks_by_day", f"SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM clicks WHERE {LAST7} GROUP BY 1", "clicks")
def _(clicks):
    return E.by_day(clicks, EVENTS_AS_OF)


@query(
    "click_kpis",
    f""", r AS (SELECT * FROM clicks WHERE {LAST7}), t AS (SELECT count(*) AS n FROM r),
    s AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM r JOIN sources s ON s.id = r.source_id GROUP BY source_id)),
    d AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, day LIMIT 1),
    l AS (SELECT count(*) AS k FROM (SELECT listing_id FROM r JOIN listings l ON l.id = r.listing_id GROUP BY 1 LIMIT 10))
    SELECT CAST(floor(n / CAST(7 AS DOUBLE) + 0.5) AS BIGINT) AS avg_per_day, CASE WHEN n > 0 THEN CAST(floor(coalesce(top, 0) * CAST(100 AS DOUBLE) / n + 0.5) AS BIGINT) ELSE 0 END AS top_source_pct,
      (SELECT day FROM d) AS busiest_day, (SELECT k FROM l) AS top_listings FROM t, s""",
    "clicks", "sources", "listings",
)
def _(clicks, sources, listings):
    return E.click_kpis(clicks, sources, listings, EVENTS_AS_OF)


@query(
    "events_without_repeats",
    "SELECT event_type, count(*) AS n FROM (SELECT *, lag(row(event_type, query, placement, metadata_json)) OVER (PARTITION BY session_id ORDER BY created_at, id) IS NOT DISTINCT FROM row(event_type, query, placement, metadata_json) AS rep FROM analytics_events) WHERE NOT rep GROUP BY 1",
    "analytics_events",
)
def _(events):
    return E.without_repeats(events).groupBy("event_type").agg(F.count("*").alias("n"))


# ---- review -------------------------------------------------------------------------------------------------------

_REVIEWED = """, j AS (SELECT l.*, r.listing_id IS NOT NULL AS has_review, r.brand AS r_brand, r.reference AS r_reference, r.condition AS r_condition, r.watch_type AS r_watch_type,
  r.price_cents AS r_price_cents, r.price_min_cents AS r_price_min_cents, r.price_max_cents AS r_price_max_cents, r.notes AS r_notes, r.brand_reviewed, r.reference_reviewed, r.condition_reviewed, r.watch_type_reviewed,
  r.price_reviewed, r.sold_reviewed, r.local_reviewed, r.bundle_reviewed, r.multi_brand_reviewed
  FROM listings l LEFT JOIN reviews r ON r.listing_id = l.id)"""
_QUEUES = {
    "missing_brand": "brand IS NULL AND brand_reviewed IS NOT TRUE",
    "missing_price": "price_cents IS NULL AND price_reviewed IS NOT TRUE",
    "missing_condition": "condition IS NULL AND condition_reviewed IS NOT TRUE",
    "sold": "is_sold AND sold_reviewed IS NOT TRUE",
    "bundle": "is_bundle AND bundle_reviewed IS NOT TRUE",
    "low_local": "local_classified_at IS NOT NULL AND coalesce(local_confidence > 0 AND local_confidence < 0.65, false) AND local_reviewed IS NOT TRUE",
}
_ANY = " OR ".join(f"({q})" for q in _QUEUES.values())
_LOW_REF = f"{RECENT} AND reference IS NOT NULL AND reference_confidence < 0.880"


@query(
    "data_health",
    f"""{_REVIEWED} SELECT count(*) AS n_listings, count(*) FILTER ({RECENT}) AS n_recent, count(*) FILTER (has_review) AS n_reviewed, count(*) FILTER (is_sold) AS n_sold, count(*) FILTER (is_bundle) AS n_bundle,
    count(*) FILTER (price_min_cents IS NOT NULL OR price_max_cents IS NOT NULL) AS n_bucket_price, count(*) FILTER (description IS NULL OR description = '[no comment]') AS n_no_description,
    count(*) FILTER (local_classified_at IS NOT NULL) AS n_local, count(*) FILTER (ai_classified_at IS NOT NULL) AS n_ai,
    {', '.join(f'count(*) FILTER ({RECENT} AND {q}) AS q_{k}' for k, q in _QUEUES.items())}, count(*) FILTER ({_LOW_REF}) AS q_low_reference, count(*) FILTER ({RECENT} AND ({_ANY})) AS q_any FROM j""",
    "listings", "reviews",
)
def _(listings, reviews):
    return R.data_health(listings, reviews, LISTINGS_AS_OF, WINDOW_DAYS)


def _queue(name: str) -> None:
    @query(
        f"queue_{name}",
        f"""{_REVIEWED} SELECT p.id, s.name AS source_name, g.listing_id IS NOT NULL AS in_gold, array_to_string(list_filter([
          CASE WHEN coalesce(p.brand, '') = '' AND brand_reviewed IS NOT TRUE THEN 'no-brand' END, CASE WHEN {_QUEUES['missing_price'].replace('price_cents', 'p.price_cents', 1)} THEN 'no-price' END,
          CASE WHEN coalesce(p.condition, '') = '' AND condition_reviewed IS NOT TRUE THEN 'no-condition' END, CASE WHEN p.{_QUEUES['bundle']} THEN 'bundle' END, CASE WHEN p.{_QUEUES['sold']} THEN 'sold' END,
          CASE WHEN {_QUEUES['low_local']} THEN 'low-local' END, CASE WHEN p.reference <> '' AND reference_confidence > 0 AND reference_confidence < 0.880 THEN 'ref-low-conf' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM (SELECT * FROM j WHERE {RECENT} AND {_QUEUES[name]} ORDER BY first_seen_at DESC, id LIMIT 60) p JOIN sources s ON s.id = p.source_id LEFT JOIN gold g ON g.listing_id = p.id""",
        "listings", "sources", "reviews", "gold",
    )
    def run(listings, sources, reviews, gold):
        where = R.recent(LISTINGS_AS_OF, WINDOW_DAYS) & R.queues()[name]
        return R.queue_rows(listings, sources, reviews, gold, where).select("id", "source_name", "in_gold", F.array_join("reasons", ",").alias("reasons"))


for _name in _QUEUES:
    _queue(_name)


@query("low_reference_list", f"SELECT id, reference, CAST(reference_confidence AS DOUBLE) AS reference_confidence FROM listings WHERE {_LOW_REF}", "listings")
def _(listings):
    return listings.where(R.low_reference(LISTINGS_AS_OF, WINDOW_DAYS)).select("id", "reference", F.col("reference_confidence").cast("double").alias("reference_confidence"))


@query("reviewed_tab", "SELECT l.id, s.name AS source_name, r.brand AS review_brand, g.listing_id IS NOT NULL AS in_gold FROM listings l JOIN reviews r ON r.listing_id = l.id JOIN sources s ON s.id = l.source_id LEFT JOIN gold g ON g.listing_id = l.id ORDER BY r.reviewed_at DESC, l.id LIMIT 60 OFFSET 60", "listings", "sources", "reviews", "gold")
def _(listings, sources, reviews, gold):
    page = R.with_reviews(listings, reviews, "inner").orderBy(F.desc("review_reviewed_at"), "id").offset(60).limit(60)
    named = page.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    marked = named.join(gold.select(F.col("listing_id").alias("id"), F.lit(True).alias("g")), "id", "left")
    return marked.select("id", "source_name", "review_brand", F.coalesce("g", F.lit(False)).alias("in_gold"))


@query("gold_tab_search", "SELECT l.id, g.brand AS gold_brand FROM gold g JOIN listings l ON l.id = g.listing_id WHERE contains(lower(l.title), 'rolex') OR contains(lower(coalesce(l.brand, '')), 'rolex') OR contains(lower(coalesce(g.brand, '')), 'rolex') OR contains(lower(coalesce(g.reference, '')), 'rolex')", "listings", "gold")
def _(listings, gold):
    rows = listings.join(gold.select(F.col("listing_id").alias("id"), F.col("brand").alias("gold_brand"), F.col("reference").alias("gold_reference")), "id")
    return rows.where(R.listing_search(" Rolex ", ("gold_brand", "gold_reference"))).select("id", "gold_brand")


@query("admin_search_literal", "SELECT id FROM listings WHERE contains(lower(title), '[ca] seiko') OR contains(lower(coalesce(brand, '')), '[ca] seiko')", "listings")
def _(listings):
    return listings.where(R.listing_search("[CA] Seiko")).select("id")


@query("admin_search_id", "SELECT id FROM listings WHERE contains(title, '1000') OR contains(coalesce(reference, ''), '1000') OR contains(listing_url, '1000') OR id = 1000", "listings")
def _(listings):
    return listings.where(R.listing_search("1000")).select("id")


_EFF = {f: f"CASE WHEN {f}_reviewed THEN r_{f} ELSE {f} END" for f in ("brand", "reference", "condition", "watch_type")}


@query(
    "effective_labels",
    f"{_REVIEWED} SELECT id, {', '.join(f'{v} AS effective_{k}' for k, v in _EFF.items())}, CASE WHEN price_reviewed THEN r_price_cents ELSE price_cents END AS effective_price_cents, nullif(trim(r_notes), '') AS notes_resolved FROM j WHERE {RECENT}",
    "listings", "reviews",
)
def _(listings, reviews):
    rows = R.effective_labels(listings.where(R.recent(LISTINGS_AS_OF, WINDOW_DAYS)), reviews)
    return rows.select("id", *[f"effective_{f}" for f in _EFF], "effective_price_cents", "notes_resolved")


def _tier(f: str) -> str:
    conf = f"{f}_confidence" if f != "watch_type" else "CAST(NULL AS DOUBLE)"
    return f"CASE WHEN {f}_reviewed THEN 'gold_manual' WHEN {f}_source = 'regex' THEN 'silver_regex' WHEN {f}_source IN ('local', 'ai') AND CAST({conf} AS DOUBLE) >= {R.THRESHOLDS[f]} THEN 'bronze_ml' WHEN {f}_source IN ('local', 'ai') THEN 'low_ml' WHEN coalesce({f}, '') <> '' THEN 'legacy_unknown' ELSE 'unlabeled' END"


@query(
    "training_export",
    f"{_REVIEWED} SELECT id, {', '.join(f'{_tier(f)} AS {f}_tier' for f in R.THRESHOLDS)}, CASE WHEN price_reviewed THEN 'gold_manual' WHEN coalesce(price_cents, 0) <> 0 THEN 'legacy_unknown' ELSE 'unlabeled' END AS price_tier FROM j WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.listing_id = j.id)",
    "listings", "reviews", "gold",
)
def _(listings, reviews, gold):
    return R.training_export(listings, reviews, gold).select("id", *[f"{f}_tier" for f in R.THRESHOLDS], "price_tier")


for _f in ("condition", "brand", "reference", "watch_type"):

    def _subset(field: str) -> None:
        label = _EFF[field]
        where = f"NOT (coalesce(watch_type_reviewed, false) AND {label} IS NULL)" if field == "watch_type" else f"({label}) IS NOT NULL"
        label = f"coalesce({label}, 'modern')" if field == "watch_type" else label

        @query(f"training_{field}", f"{_REVIEWED} SELECT {label} AS label, count(*) AS n FROM j WHERE {where} AND {_tier(field)} <> 'low_ml' AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.listing_id = j.id) GROUP BY 1", "listings", "reviews", "gold")
        def run(listings, reviews, gold):
            return R.label_distribution(R.training_subset(R.training_export(listings, reviews, gold), field), "label")

    _subset(_f)


_NORM = lambda c: f"lower(trim(coalesce({c}, '')))"
_OK = {f: f"{_NORM('l.' + f)} = {_NORM('g.' + f)}" for f in ("brand", "reference", "condition", "watch_type")} | {
    "price": "CASE WHEN g.price_cents IS NULL AND g.price_min_cents IS NULL AND g.price_max_cents IS NULL THEN l.price_cents IS NULL AND l.price_min_cents IS NULL AND l.price_max_cents IS NULL WHEN g.price_cents IS NOT NULL THEN l.price_cents IS NOT DISTINCT FROM g.price_cents ELSE l.price_min_cents IS NOT DISTINCT FROM g.price_min_cents AND l.price_max_cents IS NOT DISTINCT FROM g.price_max_cents END",
    "is_bundle": "coalesce(l.is_bundle, false) = coalesce(g.is_bundle, false)", "is_sold": "coalesce(l.is_sold, false) = coalesce(g.is_sold, false)",
}
_GOLD = " UNION ALL ".join(f"SELECT l.id, '{f}' AS field, {c} AS ok FROM gold g JOIN listings l ON l.id = g.listing_id" for f, c in _OK.items())


@query("gold_accuracy", f"SELECT field, count(*) FILTER (ok) AS n_ok, count(*) AS n, floor(count(*) FILTER (ok) * CAST(1000 AS DOUBLE) / count(*) + 0.5) / 10 AS pct FROM ({_GOLD}) GROUP BY field", "gold", "listings")
def _(gold, listings):
    return R.gold_accuracy(gold, listings)


@query("gold_mismatches", f"SELECT id, field FROM ({_GOLD}) WHERE NOT ok", "gold", "listings")
def _(gold, listings):
    return R.gold_mismatches(gold, listings)


@query(
    "classifier_coverage",
    "SELECT count(*) AS total, count(condition) AS has_condition, count(watch_type) AS has_watch_type, count(brand) AS has_brand, count(reference) AS has_reference, count(local_classified_at) AS local_classified, count(ai_classified_at) AS ai_classified, count(*) FILTER (classifier_source = 'regex') AS source_regex, count(*) FILTER (classifier_source = 'local') AS source_local, count(*) FILTER (classifier_source = 'ai') AS source_ai, count(*) FILTER (classifier_source IS NULL) AS source_null FROM listings",
    "listings",
)
def _(listings):
    return R.classifier_coverage(listings)


@query("field_coverage", "SELECT 'condition' AS field, count(*) AS total, count(condition) AS filled, CASE WHEN count(*) > 0 THEN floor(count(condition) * CAST(1000 AS DOUBLE) / count(*) + 0.5) / 10 ELSE 0 END AS pct FROM listings", "listings")
def _(listings):
    return R.field_coverage(listings)


for _by, _low, _n in (("local", True, 30), ("local", False, 20), ("ai", True, 30), ("ai", False, 20)):

    def _list(by: str, low: bool, n: int) -> None:
        edge = R.LOCAL_SHOWN if by == "local" else R.AI_SHOWN

        @query(f"confidence_{by}_{'low' if low else 'high'}", f"SELECT id, CAST({by}_confidence AS DOUBLE) AS confidence FROM listings WHERE {by}_classified_at IS NOT NULL AND CAST({by}_confidence AS DOUBLE) {'<' if low else '>='} {edge} ORDER BY confidence {'ASC' if low else 'DESC'}, id LIMIT {n}", "listings")
        def run(listings):
            return R.confidence_list(listings, by, low, n).select("id", F.col(f"{by}_confidence").cast("double").alias("confidence"))

    _list(_by, _low, _n)


@query("unclassified_list", "SELECT id FROM listings WHERE local_classified_at IS NULL AND ai_classified_at IS NULL ORDER BY last_seen_at DESC, id LIMIT 25", "listings")
def _(listings):
    return listings.where("local_classified_at is null and ai_classified_at is null").orderBy(F.desc("last_seen_at"), "id").limit(25).select("id")


_SRC_LESS = "SELECT *, CASE WHEN classifier_source IN ('regex', 'local', 'ai', 'manual') THEN classifier_source ELSE 'legacy' END AS guess FROM listings"


def _sourceless(listings):
    """Every third row loses its label sources, as rows from before they were kept."""
    return listings.withColumns({f"{f}_source": F.when(F.col("id") % 3 != 0, F.col(f"{f}_source")) for f in ("brand", "reference", "condition", "watch_type")})


_PROV = ", p AS (SELECT id, classifier_source, " + ", ".join(f"{f}, CASE WHEN id % 3 <> 0 THEN {f}_source END AS {f}_source" for f in ("brand", "reference", "condition", "watch_type")) + ", CASE WHEN classifier_source IN ('regex', 'local', 'ai', 'manual') THEN classifier_source ELSE 'legacy' END AS guess FROM listings)"


@query("backfill_provenance", f"{_PROV} SELECT id, {', '.join(f'CASE WHEN {f}_source IS NULL AND {f} IS NOT NULL THEN guess ELSE {f}_source END AS {f}_source' for f in ('brand', 'reference', 'condition', 'watch_type'))} FROM p", "listings")
def _(listings):
    return R.backfill_provenance(_sourceless(listings)).select("id", *[f"{f}_source" for f in ("brand", "reference", "condition", "watch_type")])


@query("provenance_counts", f"{_PROV} SELECT guess AS source, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT guess FROM p WHERE {f} IS NOT NULL AND {f}_source IS NULL" for f in ("brand", "reference", "condition", "watch_type")) + ") GROUP BY 1", "listings")
def _(listings):
    return R.provenance_counts(_sourceless(listings))


# ---- scalars ------------------------------------------------------------------------------------------------------

_USD = lambda c: f"CASE WHEN {c} IS NULL THEN '—' ELSE '$' || format('{{:,}}', CAST(floor({c} / CAST(100 AS DOUBLE) + 0.5) AS BIGINT)) END"


@query(
    "money_formats",
    f"SELECT id, {_USD('price_cents')} AS usd, CASE WHEN price_min_cents IS NOT NULL AND price_max_cents IS NOT NULL THEN ({_USD('price_min_cents')}) || '–' || ({_USD('price_max_cents')}) ELSE {_USD('price_cents')} END AS usd_range FROM listings WHERE {FRESH}",
    "listings",
)
def _(listings):
    rows = listings.where(Q.seen_since(LISTINGS_AS_OF, HOURS))
    return rows.select("id", S.format_usd(F.col("price_cents")).alias("usd"), S.format_usd_range(F.col("price_cents"), F.col("price_min_cents"), F.col("price_max_cents")).alias("usd_range"))


@query(
    "time_ago",
    f"""SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' WHEN s // 2592000 < 12 THEN (s // 2592000) || 'mo ago' ELSE (s // 2592000 // 12) || 'y ago' END AS ago
    FROM (SELECT id, greatest(0, date_diff('second', last_seen_at, {NOW})) AS s FROM listings)""",
    "listings",
)
def _(listings):
    return listings.select("id", S.time_ago(F.col("last_seen_at"), Q.at(LISTINGS_AS_OF)).alias("ago"))


@query(
    "scalar_values",
    """SELECT id, sha256('10.0.0.' || (id % 256) || ':2024-01-31') AS ip_hash, (id // 900) % 3 AS turn, CASE WHEN regexp_matches(listing_url, '^https?://') THEN true ELSE false END AS safe, regexp_extract(listing_url, '([^/]+)$', 1) AS last_part,
    nullif(concat_ws(' · ', brand, reference), '') AS subtitle, CASE WHEN local_confidence > 0 AND ai_confidence > 0 THEN 'L' || CAST(local_confidence AS VARCHAR) || '/A' || CAST(ai_confidence AS VARCHAR) WHEN local_confidence > 0 THEN 'L' || CAST(local_confidence AS VARCHAR) WHEN ai_confidence > 0 THEN 'A' || CAST(ai_confidence AS VARCHAR) ELSE '—' END AS confidence FROM listings""",
    "listings",
)
def _(listings):
    none = F.lit(None).cast("string")
    ip = F.concat(F.lit("10.0.0."), (F.col("id") % 256).cast("string"), F.lit(", 192.168.0.1"))
    return listings.select(
        "id", S.hash_ip(ip, Q.at(EVENTS_AS_OF)).alias("ip_hash"), S.rotation(F.col("id"), 3).cast("bigint").alias("turn"), S.safe_url(F.col("listing_url")).alias("safe"),
        S.fallback_id(F.col("listing_url")).alias("last_part"), S.subtitle(F.col("brand"), none, F.col("reference"), none, none).alias("subtitle"),
        S.confidence_label(F.col("local_confidence"), F.col("ai_confidence")).alias("confidence"),
    )
