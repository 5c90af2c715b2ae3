"""Text extraction, merges and backfills over the fixture views, with DuckDB SQL where RE2 can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.functions import text as T
from tallyrill.functions import watches as W
from tallyrill.operators import merge as M
from tallyrill.operators import review as R
from tallyrill.operators import search as Q
from tallyrill.sources.fixtures import LISTINGS_AS_OF, WINDOW_DAYS

from . import watch_sql
from .listing_queries import _ANY as _ANY_FLAG
from .listing_queries import _REVIEWED, NOW, RECENT, query

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_ANY = lambda t, ps, flags="i": f"regexp_matches({t}, {_Q('|'.join(f'(?:{p})' for p in ps))}, '{flags or 'c'}')"
_GIVEN = "array_to_string(list_filter([title, description], lambda x: coalesce(x, '') <> ''), {})"


def _price_sql(t: str) -> str:
    tries = []
    for pattern, flags, least, included, factor in T.PRICES:
        n = f"TRY_CAST(replace(nullif(regexp_extract({t}, {_Q(pattern)}, 1, '{flags or 'c'}'), ''), ',', '') AS DOUBLE) * {factor}"
        tries.append(f"CASE WHEN {n} {'>=' if included else '>'} {least} AND {n} < {T.PRICE_LIMIT} THEN CAST(floor({n} * 100 + 0.5) AS BIGINT) END")
    return f"coalesce({', '.join(tries)})"


@query("text_price", f"SELECT id, {_price_sql('t')} AS price FROM (SELECT id, {_GIVEN.format("' ' || chr(10) || ' '")} AS t FROM listings)", "listings")
def _(listings):
    """No description here tells of a price change, so the whole text decides."""
    return listings.select("id", T.usd_price_cents(F.col("title"), F.col("description")).alias("price"))


_FLAIRS = ("WTS", "$1,000-$1,999", "Under $500", "$10,000+", "$5k to $9.9k", "over $2k", "SOLD", "less than 300", "$100 - $50")


def _one_of(values: tuple[str, ...]):
    """One of the values for each listing, by its id."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("id") % len(values) + 1).cast("int"))


_FLAIR_SQL = f"list_extract([{', '.join(_Q(x) for x in _FLAIRS)}], id % {len(_FLAIRS)} + 1)"


def _flair_sql() -> str:
    value = lambda p, g, k: f"(TRY_CAST(nullif(regexp_extract(f, {_Q(p)}, {g}), '') AS DOUBLE) * CASE WHEN regexp_extract(f, {_Q(p)}, {k}) <> '' THEN 1000 ELSE 1 END)"
    lo, hi, un, ov = value(T.FLAIR_RANGE, 1, 2), value(T.FLAIR_RANGE, 3, 4), value(T.FLAIR_UNDER, 1, 2), value(T.FLAIR_OVER, 1, 2)
    c = lambda x: f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"
    a, b, d = f"{hi} >= {lo} AND {hi} < 1e7", f"{un} > 0 AND {un} < 1e7", f"{ov} > 0 AND {ov} < 1e7 AND regexp_matches(f, '\\+|over|above|>|more than')"
    return f"""SELECT id, CASE WHEN {a} THEN {c(lo)} WHEN {b} THEN NULL WHEN {d} THEN {c(ov)} END AS min_cents, CASE WHEN {a} THEN {c(hi)} WHEN {b} THEN {c(un)} END AS max_cents,
      CASE WHEN {a} THEN {c(f'({lo} + {hi}) / 2')} WHEN {b} THEN {c(f'{un} / 2')} WHEN {d} THEN {c(ov)} END AS mid_cents FROM (SELECT id, lower(replace({_FLAIR_SQL}, ',', '')) AS f FROM listings)"""


@query("text_flair_range", _flair_sql(), "listings")
def _(listings):
    return listings.select("id", T.flair_range(_one_of(_FLAIRS)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in ("min_cents", "max_cents", "mid_cents")])


_COMMENTS = ("sold!", "Thanks, sold", "almost sold on this", "SOLD to u/someone", "price drop", "It has been sold", "x\nsold\ny")
_COMMENT_SQL = "list_extract([" + ", ".join(_Q(x).replace("\n", "' || chr(10) || '") for x in _COMMENTS) + f"], id % {len(_COMMENTS)} + 1)"


@query(
    "text_sold",
    f"SELECT id, {_ANY('trim(title)', T.SOLD_TITLE)} OR regexp_matches({_FLAIR_SQL}, '\\bsold\\b', 'i') OR {_ANY(_COMMENT_SQL, T.SOLD_COMMENT)} OR regexp_matches({_COMMENT_SQL}, '(?im)^\\s*sold\\s*$') AS sold FROM listings",
    "listings",
)
def _(listings):
    return listings.select("id", T.is_sold(F.col("title"), _one_of(_FLAIRS), _one_of(_COMMENTS)).alias("sold"))


@query("text_state", "SELECT id, nullif(regexp_extract(title, '\\[([A-Z]{2})\\]', 1), '') AS state FROM listings", "listings")
def _(listings):
    return listings.select("id", T.us_state(F.col("title")).alias("state"))


_T = _GIVEN.format("' '")
_SCORE = f"TRY_CAST(nullif(regexp_extract(t, {_Q(T.SCORE)}, 1, 'i'), '') AS DOUBLE)"


@query(
    "text_condition",
    f"""SELECT id, CASE WHEN {_SCORE} >= 10 THEN 'unworn' WHEN {_SCORE} >= 9.5 THEN 'excellent' WHEN {_SCORE} >= 8.5 THEN 'very good' WHEN {_SCORE} >= 7 THEN 'good' WHEN {_SCORE} > 0 THEN 'fair'
      WHEN {_ANY('t', T.UNWORN_CAPITALS, '')} OR {_ANY('t', T.UNWORN)} THEN 'unworn' WHEN {_ANY('t', T.VERY_GOOD_SAID)} THEN 'very good' WHEN {_ANY('t', T.EXCELLENT)} OR regexp_matches(t, '\\bflawless\\b', 'i') THEN 'excellent'
      WHEN {_ANY('t', T.VERY_GOOD)} OR {_ANY('t', T.VERY_GOOD_CAPITALS, '')} THEN 'very good' WHEN {_ANY('t', T.FAIR_SAID)} THEN 'fair' WHEN {_ANY('t', T.GOOD)} THEN 'good' WHEN {_ANY('t', T.FAIR)} THEN 'fair' END AS condition
    FROM (SELECT id, {_T} AS t FROM listings)""",
    "listings",
)
def _(listings):
    return listings.select("id", T.condition(F.col("title"), F.col("description")).alias("condition"))


@query("text_era", f"SELECT id, CASE WHEN regexp_matches(regexp_replace(t, '(?i)\\bvintage\\s+style\\b', ' ', 'g'), '(?i)\\bvintage\\b') OR regexp_matches(t, '(?i)\\bantique\\b') OR regexp_matches(t, '\\bNOS\\b') OR (regexp_matches(t, {_Q(T.OLD_YEAR)}) AND regexp_matches(t, {_Q(T.OLD_YEAR_BRANDS)}, 'i')) THEN 'vintage' END AS era FROM (SELECT id, {_T} AS t FROM listings)", "listings")
def _(listings):
    return listings.select("id", T.watch_type(F.col("title"), F.col("description")).alias("era"))


@query("text_clean_title", "SELECT id, trim(regexp_replace(regexp_replace(title, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM listings", "listings")
def _(listings):
    return listings.select("id", T.clean_title(F.col("title")).alias("clean"))


@query(
    "text_normal",
    "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN coalesce(description, '') <> '' THEN title || ' ' || substr(description, 1, 2000) ELSE title END), 'https?://\\S+', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '\\$[\\d,]+(?:\\.\\d{2})?', ' _PRICE_ ', 'g'), '\\s+', ' ', 'g')) AS t FROM listings",
    "listings",
)
def _(listings):
    return listings.select("id", T.normal_text(F.col("title"), F.col("description")).alias("t"))


_SHAPES = " || ".join(f"regexp_extract_all(title, {_Q(p)})" for p in T.REFERENCE_SHAPES)


@query("text_reference_candidates", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter({_SHAPES}, lambda x: len(x) >= 3 AND NOT regexp_matches(x, '^(19|20)\\d{{2}}$')))), ',') AS candidates FROM listings", "listings")
def _(listings):
    return listings.select("id", F.array_join(F.array_sort(T.reference_candidates(F.col("title"))), ",").alias("candidates"))


@query("parse_watch", watch_sql.PARSE, "listings")
def _(listings):
    return listings.select("id", W.parse_watch("title").alias("w")).select("id", "w.brand", "w.reference")


@query("brand_hits", watch_sql.HITS, "listings")
def _(listings):
    return listings.select("id", F.array_join(W.offered_brands(F.col("title"), F.col("description")), ",").alias("brands"))


@query("detect_bundle", watch_sql.BUNDLES, "listings")
def _(listings):
    return listings.select("id", W.detect_bundle("title", "description").alias("is_bundle"))


@query(
    "multi_brand_counts",
    f"""{_REVIEWED}, newest AS (SELECT *, {watch_sql.WHOLE} AS k FROM j WHERE {RECENT} ORDER BY first_seen_at DESC, id LIMIT {R.MULTI_BRAND_ROWS}), {watch_sql.offers("newest")},
    told AS (SELECT *, len(coalesce(brands, [])) >= 2 AS several, coalesce(multi_brand_reviewed, false) AS seen FROM newest LEFT JOIN offered USING (k))
    SELECT count(*) FILTER (several AND NOT seen) AS n_open, count(*) FILTER (several AND seen) AS n_reviewed, count(*) FILTER (several AND NOT seen AND NOT coalesce({_ANY_FLAG}, false)) AS n_only_multi_brand FROM told""",
    "listings", "reviews",
)
def _(listings, reviews):
    hits = F.size(W.offered_brands(F.col("title"), F.col("description")))
    return R.multi_brand_counts(listings, reviews, hits, LISTINGS_AS_OF, WINDOW_DAYS)


@query("gold_candidates", None, "listings", "reviews", "gold")
def _(listings, reviews, gold):
    hits = F.size(W.offered_brands(F.col("title"), F.col("description")))
    return R.gold_candidates(listings, reviews, gold, hits, LISTINGS_AS_OF, 150, WINDOW_DAYS)


@query("backfill_parse", None, "listings", "reviews")
def _(listings, reviews):
    parsed = R.parsed_columns(W.parse_watch("title"), W.detect_bundle("title", "description"))
    out = R.backfill_parse(listings, reviews, parsed, Q.at(LISTINGS_AS_OF))
    return out.select("id", "brand", "reference", "condition", "watch_type", "price_cents", "price_min_cents", "is_bundle", "is_sold", "brand_source", "condition_source", "classifier_source")


# ---- merges -------------------------------------------------------------------------------------------------------

#: What comes in: every fourth row again with other values (in two versions where its line is even), and new rows under new keys.
_IN_SQL = f""", incoming AS (
  SELECT source_id, CASE WHEN id % 8 = 0 THEN external_id || '-n' ELSE external_id END AS external_id, v AS pos, title || ' v' || v AS title, CASE WHEN (id + v) % 3 = 0 THEN brand ELSE NULL END AS brand,
    CASE WHEN (id + v) % 3 = 0 THEN 'regex' END AS brand_source, CASE WHEN (id // 8 + v) % 4 = 0 THEN NULL ELSE 100000 + id % 1000 + v END AS price_cents,
    CASE WHEN (id // 8 + v) % 4 = 2 THEN 100000 END AS price_min_cents, CASE WHEN (id // 8 + v) % 4 = 2 THEN 199900 END AS price_max_cents, (id // 16) % 2 = 0 AS is_bundle, (id // 4) % 3 = 0 AS is_sold, region
  FROM listings, (SELECT unnest([1, 2]) AS v) WHERE id % 4 = 0 AND (v = 1 OR l_linenumber % 2 = 0))"""


def _incoming(listings):
    rows = listings.where("id % 4 = 0").withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2)))).where("pos = 1 or l_linenumber % 2 = 0")
    return rows.selectExpr(
        "source_id", "case when id % 8 = 0 then concat(external_id, '-n') else external_id end as external_id", "pos", "concat(title, ' v', pos) as title", "case when (id + pos) % 3 = 0 then brand end as brand",
        "case when (id + pos) % 3 = 0 then 'regex' end as brand_source", "case when (id div 8 + pos) % 4 <> 0 then 100000 + id % 1000 + pos end as price_cents", "case when (id div 8 + pos) % 4 = 2 then 100000L end as price_min_cents",
        "case when (id div 8 + pos) % 4 = 2 then 199900L end as price_max_cents", "(id div 16) % 2 = 0 as is_bundle", "(id div 4) % 3 = 0 as is_sold", "region",
    )


_LAST = ", n AS (SELECT source_id, external_id, arg_max(title, pos) AS title, arg_max(region, pos) AS region, arg_max(brand, pos) FILTER (brand IS NOT NULL) AS brand, arg_max(brand_source, pos) FILTER (brand_source IS NOT NULL) AS brand_source, arg_max(is_bundle, pos) AS is_bundle, arg_max(is_sold, pos) AS is_sold FROM incoming GROUP BY 1, 2)"


def _fold(o: str, n: str) -> str:
    """SQL of the price triple after version n on top of o: three columns p, lo, hi each prefixed."""
    keep = f"({n}.price_cents IS NULL AND {n}.price_min_cents IS NULL AND {n}.price_max_cents IS NULL) OR (({n}.price_min_cents IS NOT NULL OR {n}.price_max_cents IS NOT NULL) AND {o}.price_min_cents IS NULL AND {o}.price_max_cents IS NULL AND {o}.price_cents IS NOT NULL)"
    return ", ".join(f"CASE WHEN {n}.has IS NULL OR ({keep}) THEN {o}.{c} ELSE {n}.{c} END AS {c}" for c in M.PRICE)


_PRICES = f""", keys AS (SELECT source_id, external_id FROM listings UNION SELECT source_id, external_id FROM incoming),
p0 AS (SELECT k.source_id, k.external_id, l.price_cents, l.price_min_cents, l.price_max_cents FROM keys k LEFT JOIN listings l USING (source_id, external_id)),
p1 AS (SELECT o.source_id, o.external_id, {_fold('o', 'n')} FROM p0 o LEFT JOIN (SELECT *, true AS has FROM incoming WHERE pos = 1) n USING (source_id, external_id)),
p2 AS (SELECT o.source_id, o.external_id, {_fold('o', 'n')} FROM p1 o LEFT JOIN (SELECT *, true AS has FROM incoming WHERE pos = 2) n USING (source_id, external_id))"""


@query(
    "upsert_forum",
    f"""{_IN_SQL}{_LAST}{_PRICES} SELECT k.source_id, k.external_id, coalesce(n.title, l.title) AS title, coalesce(n.brand, l.brand) AS brand, coalesce(n.brand_source, l.brand_source) AS brand_source, p2.price_cents, p2.price_min_cents, p2.price_max_cents,
      CASE WHEN n.source_id IS NULL OR (l.id IS NOT NULL AND r.bundle_reviewed) THEN l.is_bundle ELSE n.is_bundle END AS is_bundle, coalesce(n.is_sold, l.is_sold) AS is_sold,
      CASE WHEN n.source_id IS NULL THEN l.sold_at WHEN NOT n.is_sold THEN NULL WHEN l.is_sold THEN coalesce(l.sold_at, {NOW}) ELSE {NOW} END AS sold_at, CASE WHEN n.source_id IS NULL THEN l.last_seen_at ELSE {NOW} END AS last_seen_at
    FROM keys k LEFT JOIN listings l USING (source_id, external_id) LEFT JOIN n USING (source_id, external_id) LEFT JOIN reviews r ON r.listing_id = l.id JOIN p2 USING (source_id, external_id)""",
    "listings", "reviews",
)
def _(listings, reviews):
    out = M.upsert_forum(listings, _incoming(listings), reviews, Q.at(LISTINGS_AS_OF))
    return out.select("source_id", "external_id", "title", "brand", "brand_source", *M.PRICE, "is_bundle", "is_sold", "sold_at", "last_seen_at")


@query(
    "upsert_market",
    f"""{_IN_SQL}, n AS (SELECT source_id, external_id, arg_max(row(title, brand, price_cents, region), pos) AS v, true AS has FROM incoming GROUP BY 1, 2), keys AS (SELECT source_id, external_id FROM listings UNION SELECT source_id, external_id FROM incoming)
    SELECT k.source_id, k.external_id, CASE WHEN has THEN v[1] ELSE title END AS title, CASE WHEN has THEN v[2] ELSE brand END AS brand, CASE WHEN has THEN v[3] ELSE price_cents END AS price_cents, CASE WHEN has THEN v[4] ELSE region END AS region, condition, CASE WHEN has THEN {NOW} ELSE last_seen_at END AS last_seen_at
    FROM keys k LEFT JOIN listings USING (source_id, external_id) LEFT JOIN n USING (source_id, external_id)""",
    "listings",
)
def _(listings):
    out = M.upsert_overwriting(listings, _incoming(listings), M.MARKET_TAKEN, Q.at(LISTINGS_AS_OF))
    return out.select("source_id", "external_id", "title", "brand", "price_cents", "region", "condition", "last_seen_at")


@query("upsert_sources", "SELECT id, slug, CASE WHEN id % 2 = 0 THEN name || ' 2' ELSE name END AS name FROM sources UNION ALL SELECT 1000000 AS id, 'new' AS slug, 'New' AS name", "sources")
def _(sources):
    fresh = sources.sparkSession.createDataFrame([(1_000_000, "new", "New", True)], "id bigint, slug string, name string, is_active boolean")
    incoming = sources.where("id % 2 = 0").withColumn("name", F.concat("name", F.lit(" 2"))).unionByName(fresh)
    return M.upsert_sources(sources, incoming).select("id", "slug", "name")


@query(
    "rescue",
    f"""SELECT id, CASE WHEN p THEN coalesce(nb, brand) ELSE brand END AS brand, CASE WHEN p AND nb IS NOT NULL THEN 'regex' ELSE brand_source END AS brand_source, CASE WHEN p AND id % 6 = 0 THEN id % 1000 ELSE price_cents END AS price_cents,
      CASE WHEN p AND id % 6 = 0 THEN NULL ELSE price_min_cents END AS price_min_cents, is_sold OR (p AND id % 9 = 0) AS is_sold, CASE WHEN NOT (is_sold OR (p AND id % 9 = 0)) THEN CASE WHEN p THEN NULL ELSE sold_at END WHEN is_sold THEN sold_at ELSE {NOW} END AS sold_at,
      CASE WHEN NOT p THEN description WHEN coalesce(trim(description), '') IN ('', '[no comment]') THEN CASE WHEN id % 2 = 0 THEN 'self text' || chr(10) || chr(10) || 'op text' ELSE 'op text' END
        ELSE trim(description) || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'self text' ELSE '' END || chr(10) || chr(10) || 'op text' END AS description
    FROM (SELECT *, id % 3 = 0 AS p, CASE WHEN id % 12 = 0 THEN 'Omega' END AS nb FROM listings)""",
    "listings",
)
def _(listings):
    patches = listings.where("id % 3 = 0").selectExpr(
        "source_id", "external_id", "case when id % 12 = 0 then 'Omega' end as brand", "cast(null as string) as reference", "cast(null as string) as condition", "cast(null as string) as watch_type", "id % 9 = 0 as is_sold",
        "id % 6 = 0 as has_price", "id % 1000 as price_cents", "cast(null as bigint) as price_min_cents", "cast(null as bigint) as price_max_cents", "case when id % 2 = 0 then 'self text' end as self_text", "'op text' as op_comment",
    )
    return M.rescue(listings, patches, Q.at(LISTINGS_AS_OF)).select("id", "brand", "brand_source", "price_cents", "price_min_cents", "is_sold", "sold_at", "description")


@query(
    "fill_labels",
    "SELECT id, CASE WHEN f THEN coalesce(condition, 'good') ELSE condition END AS condition, CASE WHEN f THEN coalesce(condition_source, 'local') ELSE condition_source END AS condition_source, CASE WHEN f THEN 'local' ELSE classifier_source END AS classifier_source FROM (SELECT *, id % 5 = 0 AS f FROM listings)",
    "listings",
)
def _(listings):
    found = listings.where("id % 5 = 0").select("id", F.lit("good").alias("condition"), F.lit("0.700").cast("decimal(4,3)").alias("condition_confidence"))
    return M.fill_labels(listings, found, "local", Q.at(LISTINGS_AS_OF)).select("id", "condition", "condition_source", "classifier_source")


@query(
    "backfill_labels",
    "SELECT id, CASE WHEN u THEN 'fair' ELSE condition END AS condition, CASE WHEN u THEN 'local' ELSE condition_source END AS condition_source, CASE WHEN f THEN CASE WHEN u THEN floor(c * 100 + 0.5) / 100 ELSE 0 END ELSE CAST(local_confidence AS DOUBLE) END AS local_confidence, CASE WHEN u THEN 'local' ELSE classifier_source END AS classifier_source FROM (SELECT *, id % 5 = 0 AS f, (id % 100) / CAST(100 AS DOUBLE) AS c, id % 5 = 0 AND condition IS NULL AND (id % 100) / CAST(100 AS DOUBLE) >= 0.6 AS u FROM listings)",
    "listings",
)
def _(listings):
    found = listings.where("id % 5 = 0").select("id", F.lit("fair").alias("condition"), ((F.col("id") % 100) / 100.0).alias("condition_confidence"))
    out = R.backfill_labels(listings, found, "local", Q.at(LISTINGS_AS_OF))
    return out.select("id", "condition", "condition_source", F.col("local_confidence").cast("double").alias("local_confidence"), "classifier_source")


_DELTA_SQL = ", d AS (SELECT id AS listing_id, id % 2 = 0 AS tb, id % 3 = 0 AS tc, id % 5 = 0 AS tp, CASE WHEN id % 4 = 0 THEN 'Tudor' END AS brand, id % 7 = 0 AS unknown, CASE WHEN id % 9 <> 0 THEN 'good' END AS condition, price_cents FROM listings WHERE id % 6 IN (0, 2, 3))"


def _deltas(listings):
    no = "false as touch_reference, false as touch_watch_type, false as touch_sold, false as touch_local, false as touch_bundle, false as touch_multi_brand".split(", ")
    nulls = [f"cast(null as {t}) as {c}" for c, t in (("reference", "string"), ("watch_type", "string"), ("price_min_cents", "bigint"), ("price_max_cents", "bigint"), ("is_bundle", "boolean"))]
    return listings.where("id % 6 in (0, 2, 3)").selectExpr(
        "id as listing_id", "id % 2 = 0 as touch_brand", "id % 3 = 0 as touch_condition", "id % 5 = 0 as touch_price", "case when id % 4 = 0 then 'Tudor' end as brand", "id % 7 = 0 as brand_unknown",
        "case when id % 9 <> 0 then 'good' end as condition", "price_cents", "id % 11 = 0 as price_unknown", "'seen' as notes", *no, *nulls,
    )


@query(
    "upsert_reviews",
    f"""{_DELTA_SQL} SELECT coalesce(r.listing_id, d.listing_id) AS listing_id, CASE WHEN tb THEN CASE WHEN NOT unknown THEN d.brand END ELSE r.brand END AS brand, CASE WHEN tb THEN d.brand IS NOT NULL OR unknown ELSE coalesce(r.brand_reviewed, false) END AS brand_reviewed,
      CASE WHEN tc THEN d.condition ELSE r.condition END AS condition, coalesce(tc, false) OR coalesce(r.condition_reviewed, false) AS condition_reviewed, coalesce(tb OR tc, false) OR coalesce(r.local_reviewed, false) AS local_reviewed,
      CASE WHEN tp THEN CASE WHEN d.listing_id % 11 <> 0 THEN d.price_cents END ELSE r.price_cents END AS price_cents, CASE WHEN d.listing_id IS NOT NULL THEN 'seen' ELSE r.notes END AS notes
    FROM reviews r FULL JOIN d ON d.listing_id = r.listing_id""",
    "listings", "reviews",
)
def _(listings, reviews):
    out = M.upsert_reviews(reviews, _deltas(listings), Q.at(LISTINGS_AS_OF))
    return out.select("listing_id", "brand", "brand_reviewed", "condition", "condition_reviewed", "local_reviewed", "price_cents", "notes")


@query(
    "apply_reviews",
    f"""{_DELTA_SQL} SELECT id, CASE WHEN tb AND d.brand IS NOT NULL AND NOT unknown THEN d.brand WHEN tb AND unknown THEN NULL ELSE l.brand END AS brand, CASE WHEN tb AND d.brand IS NOT NULL AND NOT unknown THEN 'manual' ELSE l.brand_source END AS brand_source,
      CASE WHEN tc THEN d.condition ELSE l.condition END AS condition, CASE WHEN tb OR tc THEN 'manual' ELSE l.classifier_source END AS classifier_source, CASE WHEN tp AND id % 11 <> 0 THEN NULL ELSE l.price_min_cents END AS price_min_cents
    FROM listings l LEFT JOIN d ON d.listing_id = l.id""",
    "listings",
)
def _(listings):
    return M.apply_reviews(listings, _deltas(listings)).select("id", "brand", "brand_source", "condition", "classifier_source", "price_min_cents")


@query("gold_add", "SELECT listing_id FROM gold UNION SELECT id FROM listings WHERE id % 10 = 0", "listings", "gold")
def _(listings, gold):
    return M.add_gold(gold, listings.where("id % 10 = 0").select(F.col("id").alias("listing_id"), "brand")).select("listing_id")


@query("gold_remove", "SELECT listing_id FROM gold WHERE listing_id % 10 <> 0", "listings", "gold")
def _(listings, gold):
    return M.remove_gold(gold, listings.where("id % 10 = 0").select(F.col("id").alias("listing_id"))).select("listing_id")


@query("clear_descriptions", "SELECT id, CASE WHEN id % 2 = 0 AND description = '[no comment]' THEN NULL ELSE description END AS description FROM listings", "listings")
def _(listings):
    return M.clear_descriptions(listings, listings.where("id % 2 = 0").select("id")).select("id", "description")


@query("rescue_candidates", f"SELECT id FROM listings WHERE source_id = 1 AND first_seen_at >= {NOW} - INTERVAL 20000 HOUR AND (price_cents IS NULL OR brand IS NULL OR condition IS NULL OR price_min_cents IS NOT NULL OR price_max_cents IS NOT NULL) AND coalesce(description, '') = '' ORDER BY id LIMIT 100", "listings")
def _(listings):
    return M.rescue_candidates(listings, 1, Q.at(LISTINGS_AS_OF), 20_000).select("id")


# ---- reports and streams' batch twins -----------------------------------------------------------------------------


def _predictions(listings, reviews):
    return R.with_reviews(listings, reviews, "inner").where("condition is not null and review_condition is not null").select(F.col("condition").alias("actual"), F.col("review_condition").alias("predicted"))


_PRED = ", p AS (SELECT l.condition AS actual, r.condition AS predicted FROM listings l JOIN reviews r ON r.listing_id = l.id WHERE l.condition IS NOT NULL AND r.condition IS NOT NULL)"


@query("confusion_matrix", f"{_PRED} SELECT actual, predicted, count(*) AS n FROM p GROUP BY 1, 2", "listings", "reviews")
def _(listings, reviews):
    from tallyrill.operators.ml import confusion

    return confusion(_predictions(listings, reviews))


@query(
    "classification_report",
    f"""{_PRED}, k AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p),
    e AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS said, count(*) FILTER (actual = label) AS support FROM k, p GROUP BY label),
    f AS (SELECT label, tp, support, CASE WHEN said > 0 THEN tp / CAST(said AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall FROM e),
    g AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM f),
    r AS (SELECT label, precision, recall, f1, support FROM g
      UNION ALL SELECT 'accuracy', sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE), sum(support) FROM g
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM g
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM g)
    SELECT label, floor(precision * 10000 + 0.5) / 10000 AS precision, floor(recall * 10000 + 0.5) / 10000 AS recall, floor(f1 * 10000 + 0.5) / 10000 AS f1, CAST(support AS BIGINT) AS support FROM r""",
    "listings", "reviews",
)
def _(listings, reviews):
    from tallyrill.operators.ml import classification_report

    return classification_report(_predictions(listings, reviews))


@query("limiter_outcomes", None, "analytics_events")
def _(events):
    """Sign-in attempts as the events of 50 addresses: searches succeed, all else fails."""
    from tallyrill.streaming.limiter import decide

    ms = F.unix_millis(F.col("created_at").cast("timestamp"))
    return decide(events.select(F.concat(F.lit("ip"), (F.col("user_id") % 50).cast("string")).alias("ip"), ms.alias("ms"), (F.col("event_type") == "search").alias("success")))


@query(
    "ingest_counters",
    "SELECT count(*) AS upserted, count(price_cents) AS priced, count(brand) AS branded, count(reference) AS referenced, count(condition) AS with_condition, count(*) FILTER (is_sold) AS sold, count(*) FILTER (is_bundle) AS bundles FROM listings",
    "listings",
)
def _(listings):
    from tallyrill.streaming.ingest import counters

    return counters(listings)
