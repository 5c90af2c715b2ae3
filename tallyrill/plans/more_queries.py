"""Further operators over the fixture views: other upserts, requests, coercions, pages of flagged rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.functions import scalars as S
from tallyrill.functions import text as T
from tallyrill.operators import events as E
from tallyrill.operators import merge as M
from tallyrill.operators import review as R
from tallyrill.operators import search as Q
from tallyrill.sources.fixtures import EVENTS_AS_OF, LISTINGS_AS_OF, WINDOW_DAYS

from .listing_queries import _ANY, _REVIEWED, E_NOW, NOW, RECENT, query
from .text_queries import _IN_SQL, _incoming, _one_of

_KEYS = ", keys AS (SELECT source_id, external_id FROM listings UNION SELECT source_id, external_id FROM incoming)"


@query(
    "upsert_feed",
    f"""{_IN_SQL}, n AS (SELECT source_id, external_id, arg_max(row(title, brand, price_cents), pos) AS v, arg_max(region, pos) AS r, true AS has FROM incoming GROUP BY 1, 2){_KEYS}
    SELECT k.source_id, k.external_id, CASE WHEN has THEN v[1] ELSE title END AS title, CASE WHEN has THEN v[2] ELSE brand END AS brand, CASE WHEN has THEN v[3] ELSE price_cents END AS price_cents, CASE WHEN id IS NULL THEN r ELSE region END AS region, condition
    FROM keys k LEFT JOIN listings USING (source_id, external_id) LEFT JOIN n USING (source_id, external_id)""",
    "listings",
)
def _(listings):
    out = M.upsert_overwriting(listings, _incoming(listings), M.FEED_TAKEN, Q.at(LISTINGS_AS_OF))
    return out.select("source_id", "external_id", "title", "brand", "price_cents", "region", "condition")


@query(
    "upsert_catalog",
    f"""{_IN_SQL}, n AS (SELECT source_id, external_id, arg_max(title, pos) AS t, CASE WHEN max(pos) = 2 THEN 'used' END AS c, true AS has FROM incoming GROUP BY 1, 2){_KEYS}
    SELECT k.source_id, k.external_id, CASE WHEN has THEN t ELSE title END AS title, CASE WHEN has THEN c ELSE condition END AS condition FROM keys k LEFT JOIN listings USING (source_id, external_id) LEFT JOIN n USING (source_id, external_id)""",
    "listings",
)
def _(listings):
    incoming = _incoming(listings).withColumn("condition", F.when(F.col("pos") == 2, "used"))
    return M.upsert_overwriting(listings, incoming, M.CATALOG_TAKEN, Q.at(LISTINGS_AS_OF)).select("source_id", "external_id", "title", "condition")


@query("refresh_bundles", "SELECT l.id, CASE WHEN r.bundle_reviewed THEN l.is_bundle ELSE contains(l.title, 'bolt') END AS is_bundle FROM listings l LEFT JOIN reviews r ON r.listing_id = l.id", "listings", "reviews")
def _(listings, reviews):
    return M.refresh_bundles(listings, reviews, F.col("title").contains("bolt")).select("id", "is_bundle")


@query(
    "review_delta",
    """SELECT id AS listing_id, (id % 2 = 0) AND trim(coalesce(brand, '')) <> 'Omega' AS touch_brand, false AS touch_reference, id % 3 <> 0 AND coalesce(condition, '') <> 'good' AS touch_condition, false AS touch_watch_type,
      price_min_cents IS NOT NULL AND price_cents IS DISTINCT FROM CAST(floor((price_min_cents + price_max_cents) / 2.0 + 0.5) AS BIGINT) AS touch_price, CASE WHEN price_min_cents IS NOT NULL THEN CAST(floor((price_min_cents + price_max_cents) / 2.0 + 0.5) AS BIGINT) ELSE price_cents END AS price_cents FROM listings""",
    "listings",
)
def _(listings):
    shown = listings.withColumnRenamed("id", "listing_id")
    form = shown.withColumns({
        "brand": F.when(F.col("listing_id") % 2 == 0, " Omega ").otherwise(F.col("brand")), "condition": F.when(F.col("listing_id") % 3 == 0, "").otherwise("good"),
        "price_cents": F.when(F.col("price_min_cents").isNull(), F.col("price_cents")),
    })
    return M.review_delta(shown, form)


@query(
    "valid_events",
    "SELECT id, event_type, substr(session_id, 1, 64) AS session_id, CASE WHEN length(m) <= 40 THEN m END AS metadata_json FROM (SELECT *, CASE WHEN id % 2 = 0 THEN metadata_json || repeat(' ', 30) ELSE metadata_json END AS m FROM analytics_events) WHERE event_type <> 'click'",
    "analytics_events",
)
def _(events):
    """With a bound of 40 characters of metadata, and every other event padded."""
    padded = F.when(F.col("id") % 2 == 0, F.concat("metadata_json", F.repeat(F.lit(" "), F.lit(30)))).otherwise(F.col("metadata_json"))
    return E.valid_events(events.withColumn("metadata_json", padded), 40).select("id", "event_type", "session_id", "metadata_json")


@query(
    "emitted_events",
    """SELECT id, 'page_view' AS event_type FROM analytics_events UNION ALL SELECT id, 'search' FROM analytics_events WHERE coalesce(trim(query), '') <> '' UNION ALL SELECT id, 'filter_apply' FROM analytics_events WHERE id % 3 = 0 AND placement IS NOT NULL""",
    "analytics_events",
)
def _(events):
    filters = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("brand"), F.lit(" "), F.lit("place"), F.coalesce("placement", F.lit(""))))
    return E.emitted_events(events.select("id", F.col("query").alias("q"), filters.alias("filters"))).select("id", "event_type")


@query(
    "click_requests",
    f"SELECT id AS listing_id, source_id, sha256('10.0.0.' || (id % 256) || ':{EVENTS_AS_OF}') AS ip_hash, 'home' AS placement, listing_url AS redirect_to, {E_NOW} AS created_at FROM listings WHERE id % 3 <> 0",
    "listings",
)
def _(listings):
    """Every third id is asked for with a sign before it, which is none."""
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    asked = listings.select(raw.alias("raw_id"), F.concat(F.lit("10.0.0."), (F.col("id") % 256).cast("string"), F.lit(", 1.1.1.1")).alias("ip"), F.lit("ua").alias("user_agent"), F.lit(None).cast("string").alias("referer"), F.lit("home").alias("placement"))
    return E.clicks_from_requests(asked, listings, EVENTS_AS_OF).select("listing_id", "source_id", "ip_hash", "placement", "redirect_to", "created_at")


_MULTI = "id % 11 = 0"


@query(
    "flagged_page",
    f"{_REVIEWED}, f AS (SELECT id, first_seen_at FROM j WHERE {RECENT} AND ({_ANY}) UNION SELECT id, first_seen_at FROM j WHERE {RECENT} AND {_MULTI}) SELECT id FROM f ORDER BY first_seen_at DESC, id LIMIT 40 OFFSET 20",
    "listings", "reviews",
)
def _(listings, reviews):
    multi = listings.where(R.recent(LISTINGS_AS_OF, WINDOW_DAYS)).where(_MULTI)
    return R.flagged_ids(listings, reviews, multi, LISTINGS_AS_OF, WINDOW_DAYS, 40, 20)


_VALUES = ("1", "true", "FALSE", " 0 ", "yes", "", "12.5", "$1,234.50", "-3")
_VALUE_SQL = f"list_extract([{', '.join(repr(v) for v in _VALUES)}], id % {len(_VALUES)} + 1)"


@query(
    "coercions",
    f"""SELECT id, CASE WHEN lower(trim(v)) IN ('1', 'true') THEN true WHEN lower(trim(v)) IN ('0', 'false') THEN false END AS flag, TRY_CAST(nullif(trim(v), '') AS DOUBLE) AS number,
      CASE WHEN TRY_CAST(nullif(regexp_replace(trim(v), '[$,\\s]', '', 'g'), '') AS DOUBLE) >= 0 THEN CAST(floor(TRY_CAST(regexp_replace(trim(v), '[$,\\s]', '', 'g') AS DOUBLE) * 100 + 0.5) AS BIGINT) END AS cents,
      CASE WHEN NOT coalesce(id % 2 = 0, false) THEN 'unset' WHEN trim(v) <> '' THEN 'value:' || trim(v) ELSE 'unknown' END AS outcome FROM (SELECT id, {_VALUE_SQL} AS v FROM listings)""",
    "listings",
)
def _(listings):
    v = _one_of(_VALUES)
    return listings.select("id", S.tri_state(v).alias("flag"), S.number_or_null(v).alias("number"), S.usd_to_cents(v).alias("cents"), S.brand_outcome_key(F.col("id") % 2 == 0, v).alias("outcome"))


_CELL_USD = "'$' || format('{:,}', CAST(floor(%s / CAST(100 AS DOUBLE) + 0.5) AS BIGINT))"


@query(
    "gold_cells",
    f"SELECT listing_id, CASE WHEN price_cents > 0 THEN {_CELL_USD % 'price_cents'} WHEN price_min_cents > 0 AND price_max_cents > 0 THEN {_CELL_USD % 'price_min_cents'} || '–' || {_CELL_USD % 'price_max_cents'} WHEN price_cents IS NULL AND price_min_cents IS NULL AND price_max_cents IS NULL THEN 'Unknown' ELSE '—' END AS cell FROM gold",
    "gold",
)
def _(gold):
    return gold.select("listing_id", S.gold_price_cell(F.col("price_cents"), F.col("price_min_cents"), F.col("price_max_cents")).alias("cell"))


_CODES = ("1000", "1500", "3000", "9999", None)
_SAID = ("New with tags", "Open box", "Pre-owned", "vintage piece", "?")
_CODE_SQL = "CASE id % 5 WHEN 0 THEN '1000' WHEN 1 THEN '1500' WHEN 2 THEN '3000' WHEN 3 THEN '9999' END"
_SAID_SQL = f"list_extract([{', '.join(repr(v) for v in _SAID)}], id % 7 % 5 + 1)"


@query(
    "condition_codes",
    f"SELECT id, CASE c WHEN '1000' THEN 'new' WHEN '1500' THEN 'unworn' WHEN '3000' THEN 'used' ELSE CASE WHEN contains(t, 'new with tag') OR t = 'new' THEN 'new' WHEN contains(t, 'open box') OR contains(t, 'unworn') THEN 'unworn' WHEN contains(t, 'pre-owned') OR contains(t, 'used') OR contains(t, 'refurb') THEN 'used' WHEN contains(t, 'vintage') THEN 'vintage' END END AS condition FROM (SELECT id, {_CODE_SQL} AS c, lower({_SAID_SQL}) AS t FROM listings)",
    "listings",
)
def _(listings):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("id") % 5 + 1).cast("int"))
    said = F.element_at(F.array(*[F.lit(c) for c in _SAID]), (F.col("id") % 7 % 5 + 1).cast("int"))
    return listings.select("id", T.condition_of_code(code, said).alias("condition"))


@query(
    "time_gates",
    f"SELECT id, hour(last_seen_at) = 0 AND minute(last_seen_at) < 20 AS gate, least(greatest(floor((id % 1000) / CAST(7 AS DOUBLE)), 1), 100) AS clamped, {NOW} - last_seen_at < INTERVAL 30 DAY AS month FROM listings",
    "listings",
)
def _(listings):
    seen = F.col("last_seen_at")
    return listings.select("id", S.in_hour_gate(seen, 0).alias("gate"), S.clamp_whole((F.col("id") % 1000) / F.lit(7.0), 1, 100, 25).cast("double").alias("clamped"), (seen > Q.at(LISTINGS_AS_OF) - F.make_interval(days=F.lit(30))).alias("month"))
