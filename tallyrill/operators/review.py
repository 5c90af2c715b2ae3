"""Human review: queues, effective labels, tiers, gold evaluation, candidates, backfills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions import text as T
from tallyrill.functions.scalars import effective, half_up, notes_resolved

from .search import any_of, at

RECENT_DAYS = 14
LOW_LOCAL = 0.65
LOW_REFERENCE = "0.880"
MULTI_BRAND_ROWS = 5000
#: Largest page whose ids become literals of the plan.
PAGE_IDS = 1000
FLAGS = ("brand", "reference", "condition", "watch_type", "price", "sold", "local", "bundle", "multi_brand")
#: Confidence from which a classifier's label counts.
THRESHOLDS = {"condition": 0.60, "watch_type": 0.60, "brand": 0.88, "reference": 0.88}
LOCAL_SHOWN, AI_SHOWN = 0.70, 0.80
TRUSTED = ("regex", "local", "ai", "manual")
PROTECTED = ("manual", "local", "ai")


def with_reviews(listings: DataFrame, reviews: DataFrame, how: str = "left") -> DataFrame:
    """listings with the review's columns as review_<name>, and <flag>_reviewed; null without a review."""
    r = reviews.select(F.col("listing_id").alias("id"), *[F.col(c).alias(c if c.endswith("_reviewed") else f"review_{c}") for c in reviews.columns if c != "listing_id"])
    return listings.join(r, "id", how)


def open_(flag: str) -> Column:
    """Not reviewed: the flag is false or there is no review."""
    return ~F.coalesce(F.col(f"{flag}_reviewed"), F.lit(False))


def queues() -> dict[str, Column]:
    """The conditions of the queues, over with_reviews()."""
    low = F.col("local_classified_at").isNotNull() & (F.col("local_confidence") > 0) & (F.col("local_confidence") < F.lit("0.65").cast("decimal(3,2)"))
    return {
        "missing_brand": F.col("brand").isNull() & open_("brand"),
        "missing_price": F.col("price_cents").isNull() & open_("price"),
        "missing_condition": F.col("condition").isNull() & open_("condition"),
        "sold": F.col("is_sold") & open_("sold"),
        "bundle": F.col("is_bundle") & open_("bundle"),
        "low_local": F.coalesce(low, F.lit(False)) & open_("local"),
    }


def any_flag() -> Column:
    return any_of(list(queues().values()))


def recent(as_of: str, days: int = RECENT_DAYS) -> Column:
    return F.col("first_seen_at") >= at(as_of) - F.make_interval(days=F.lit(days))


def low_reference(as_of: str, days: int = RECENT_DAYS) -> Column:
    return recent(as_of, days) & F.col("reference").isNotNull() & (F.col("reference_confidence") < F.lit(LOW_REFERENCE).cast("decimal(4,3)"))


def data_health(listings: DataFrame, reviews: DataFrame, as_of: str, days: int = RECENT_DAYS) -> DataFrame:
    """All counts of the health page, from one pass over the joined rows."""
    rows = with_reviews(listings, reviews)
    c = F.count_if
    here = recent(as_of, days)
    return rows.agg(
        F.count("*").alias("n_listings"),
        c(here).alias("n_recent"),
        c(F.col("review_reviewed_at").isNotNull()).alias("n_reviewed"),
        c(F.col("is_sold")).alias("n_sold"),
        c(F.col("is_bundle")).alias("n_bundle"),
        c(F.col("price_min_cents").isNotNull() | F.col("price_max_cents").isNotNull()).alias("n_bucket_price"),
        c(F.col("description").isNull() | (F.col("description") == "[no comment]")).alias("n_no_description"),
        c(F.col("local_classified_at").isNotNull()).alias("n_local"),
        c(F.col("ai_classified_at").isNotNull()).alias("n_ai"),
        *[c(here & q).alias(f"q_{k}") for k, q in queues().items()],
        c(low_reference(as_of, days)).alias("q_low_reference"),
        c(here & any_flag()).alias("q_any"),
    )


def tab_totals(listings: DataFrame, reviews: DataFrame, gold: DataFrame, as_of: str, days: int = RECENT_DAYS) -> DataFrame:
    """tab and n: the rows that each tab of the review page counts, one pass over the joined rows and one over gold."""
    here = recent(as_of, days)
    tabs = {k: here & q for k, q in queues().items()} | {"low_reference": low_reference(as_of, days), "any": here & any_flag(), "reviewed": F.col("review_reviewed_at").isNotNull()}
    counts = with_reviews(listings, reviews).agg(*[F.count_if(c).alias(k) for k, c in tabs.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("tab"), F.col(k).alias("n")) for k in tabs])).alias("t")).select("t.*")
    held = gold.join(listings.select(F.col("id").alias("listing_id")), "listing_id").agg(F.count("*").alias("n"))
    return rows.unionByName(held.select(F.lit("gold").alias("tab"), "n"))


def reasons(multi_brand_hits: Column | None = None) -> Column:
    """Why a row is in review, in a fixed order; blank labels count as none."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    q = queues()
    low_ref = (F.col("reference") != "") & (F.col("reference_confidence") > 0) & (F.col("reference_confidence") < F.lit(LOW_REFERENCE).cast("decimal(4,3)"))
    parts = [
        ("no-brand", blank("brand") & open_("brand")),
        ("no-price", F.col("price_cents").isNull() & open_("price")),
        ("no-condition", blank("condition") & open_("condition")),
        ("bundle", q["bundle"]),
        ("sold", q["sold"]),
        ("low-local", q["low_local"]),
        ("ref-low-conf", F.coalesce(low_ref, F.lit(False))),
    ]
    if multi_brand_hits is not None:
        parts.append(("multi-brand", (multi_brand_hits >= 2) & open_("multi_brand")))
    return F.array_compact(F.array(*[F.when(c, name) for name, c in parts]))


def queue_rows(listings: DataFrame, sources: DataFrame, reviews: DataFrame, gold: DataFrame, where: Column, limit: int = 60, offset: int = 0) -> DataFrame:
    """A page of a queue, newest first, with source_name, reasons and whether there is a gold row. Flags and page come before the wide joins.

    The ids of a page of up to PAGE_IDS rows are looked up first and narrow all
    tables at their scans: only that search goes over whole tables.
    """
    order = [F.desc("first_seen_at"), F.asc("id")]
    page = with_reviews(listings, reviews).where(where).orderBy(*order).offset(offset).limit(limit)
    if limit <= PAGE_IDS:
        ids = [r["id"] for r in page.select("id").collect()]  # at most `limit`
        listings, reviews, gold = (df.where(F.col(c).isin(ids)) for df, c in ((listings, "id"), (reviews, "listing_id"), (gold, "listing_id")))
        page = with_reviews(listings, reviews).where(where).orderBy(*order).limit(limit)
    named = page.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    marked = named.join(gold.select(F.col("listing_id").alias("id"), F.lit(True).alias("_gold")).distinct(), "id", "left")
    return marked.withColumn("in_gold", F.coalesce("_gold", F.lit(False))).withColumn("reasons", reasons()).drop("_gold")


def listing_search(q: str, extra: tuple[str, ...] = ()) -> Column:
    """Literal, case-insensitive substring of title, brand, reference or url (and extra columns), or the id itself."""
    t = q.strip()
    if not t:
        return F.lit(True)
    found = any_of([F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False)) for c in ("title", "brand", "reference", "listing_url", *extra)])
    if t.isascii() and t.isdigit() and 0 < int(t) <= 2**53 - 1:
        found = found | (F.col("id") == int(t))
    return found


def like_escaped(q: str) -> str:
    """q as a literal inside a LIKE pattern."""
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def review_url(filter_name: str, page: int = 1, limit: int = 60, q: str | None = None) -> str:
    """The query string of a review page; what is as by default is left out."""
    from urllib.parse import urlencode

    parts = {"filter": filter_name} | ({"page": page} if page > 1 else {}) | ({"limit": limit} if limit != 60 else {})
    return urlencode(parts | ({"q": q.strip()} if q and q.strip() else {}))


def unknown_price_only(price_reviewed: Column, *prices: Column) -> Column:
    """Reviewed without any price: the price is known to be unknown."""
    return F.coalesce(price_reviewed, F.lit(False)) & F.coalesce(*prices).isNull()


def multi_brand_counts(listings: DataFrame, reviews: DataFrame, hits: Column, as_of: str, days: int = RECENT_DAYS, rows: int = MULTI_BRAND_ROWS) -> DataFrame:
    """Among the newest rows: several brands and open, several brands and reviewed, and open ones that no other queue has. hits: number of brands offered."""
    newest = with_reviews(listings, reviews).where(recent(as_of, days)).orderBy(F.desc("first_seen_at"), "id").limit(rows).withColumn("_hits", hits)
    several = F.col("_hits") >= 2
    return newest.agg(
        F.count_if(several & open_("multi_brand")).alias("n_open"),
        F.count_if(several & ~open_("multi_brand")).alias("n_reviewed"),
        F.count_if(several & open_("multi_brand") & ~any_flag()).alias("n_only_multi_brand"),
    )


def flagged_ids(listings: DataFrame, reviews: DataFrame, multi_brand: DataFrame, as_of: str, days: int, limit: int, offset: int) -> DataFrame:
    """Ids of flagged rows and of multi-brand rows, each once, newest first, one page."""
    base = with_reviews(listings, reviews).where(recent(as_of, days) & any_flag()).select("id", "first_seen_at")
    more = multi_brand.select("id", "first_seen_at").join(base, "id", "left_anti")
    return base.unionByName(more).orderBy(F.desc("first_seen_at"), "id").offset(offset).limit(limit).select("id")


def effective_labels(listings: DataFrame, reviews: DataFrame) -> DataFrame:
    """effective_<field>: the review's value where the field was reviewed, even null; with notes_resolved."""
    rows = with_reviews(listings, reviews)
    done = lambda f: F.coalesce(F.col(f"{f}_reviewed"), F.lit(False))
    out = {f"effective_{f}": effective(done(f), F.col(f"review_{f}"), F.col(f)) for f in ("brand", "reference", "condition", "watch_type")}
    out |= {f"effective_{c}": effective(done("price"), F.col(f"review_{c}"), F.col(c)) for c in ("price_cents", "price_min_cents", "price_max_cents")}
    out["notes_resolved"] = notes_resolved(F.col("review_notes"))
    return rows.withColumns(out)


def tier(field: str) -> Column:
    """How far a label is to be trusted."""
    source, conf = F.col(f"{field}_source"), F.col(f"{field}_confidence").cast("double")
    return (
        F.when(F.coalesce(F.col(f"{field}_reviewed"), F.lit(False)), "gold_manual")
        .when(source == "regex", "silver_regex")
        .when(source.isin("local", "ai") & (conf >= THRESHOLDS[field]), "bronze_ml")
        .when(source.isin("local", "ai"), "low_ml")
        .when(F.coalesce(F.col(field), F.lit("")) != "", "legacy_unknown")
        .otherwise("unlabeled")
    )


def price_tier() -> Column:
    return F.when(F.coalesce(F.col("price_reviewed"), F.lit(False)), "gold_manual").when(F.coalesce(F.col("price_cents"), F.lit(0)) != 0, "legacy_unknown").otherwise("unlabeled")


def training_export(listings: DataFrame, reviews: DataFrame, gold: DataFrame) -> DataFrame:
    """All listings that are not held out as gold, with effective labels and tiers."""
    kept = listings.join(gold.select(F.col("listing_id").alias("id")), "id", "left_anti")
    if "watch_type_confidence" not in kept.columns:
        kept = kept.withColumn("watch_type_confidence", F.lit(None).cast("decimal(4,3)"))
    rows = effective_labels(kept, reviews)
    return rows.withColumns({f"{f}_tier": tier(f) for f in THRESHOLDS} | {"price_tier": price_tier()})


def training_subset(export: DataFrame, field: str, include_low: bool = False) -> DataFrame:
    """The rows that train a field's model. Era keeps rows without a value, as modern ones, unless a reviewer left it unknown."""
    value = F.col(f"effective_{field}")
    if field == "watch_type":
        rows = export.where(~(F.coalesce(F.col("watch_type_reviewed"), F.lit(False)) & value.isNull()))
        label = F.coalesce(value, F.lit("modern"))
    else:
        rows, label = export.where(value.isNotNull()), value
    if not include_low:
        rows = rows.where(F.col(f"{field}_tier") != "low_ml")
    return rows.withColumn("label", label)


def gold_compare(gold: DataFrame, listings: DataFrame) -> DataFrame:
    """Per gold row ok_<field> against the live listing."""
    fields = ("brand", "reference", "condition", "watch_type", "price_cents", "price_min_cents", "price_max_cents", "is_bundle", "is_sold")
    g = gold.select(F.col("listing_id").alias("id"), *[F.col(c).alias(f"g_{c}") for c in fields])
    rows = g.join(listings.select("id", *fields), "id")
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blank = lambda p: F.col(f"{p}price_cents").isNull() & F.col(f"{p}price_min_cents").isNull() & F.col(f"{p}price_max_cents").isNull()
    same = lambda c: F.col(c).eqNullSafe(F.col(f"g_{c}"))
    price = F.when(blank("g_"), blank("")).when(F.col("g_price_cents").isNotNull(), same("price_cents")).otherwise(same("price_min_cents") & same("price_max_cents"))
    ok = {f: norm(f) == norm(f"g_{f}") for f in ("brand", "reference", "condition", "watch_type")}
    ok |= {"price": price, "is_bundle": yes("is_bundle") == yes("g_is_bundle"), "is_sold": yes("is_sold") == yes("g_is_sold")}
    return rows.withColumns({f"ok_{f}": c for f, c in ok.items()})


GOLD_FIELDS = ("brand", "reference", "condition", "watch_type", "price", "is_bundle", "is_sold")


def gold_accuracy(gold: DataFrame, listings: DataFrame) -> DataFrame:
    """field, n_ok, n, pct (one decimal)."""
    rows = gold_compare(gold, listings)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"ok_{f}").alias("ok")) for f in GOLD_FIELDS]))
    out = rows.select(pairs.alias("p")).groupBy("p.field").agg(F.count_if("p.ok").alias("n_ok"), F.count("*").alias("n"))
    return out.withColumn("pct", F.floor(F.col("n_ok") * 1000.0 / F.col("n") + 0.5) / 10)


def gold_mismatches(gold: DataFrame, listings: DataFrame) -> DataFrame:
    """A row for each field of a gold row that differs: id, field."""
    rows = gold_compare(gold, listings)
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"ok_{f}"), f) for f in GOLD_FIELDS]))
    return rows.select("id", F.explode(wrong).alias("field"))


def split_quota(limit: int, buckets: int) -> list[int]:
    """limit in near-equal whole parts, the larger ones first."""
    base, rest = divmod(limit, buckets)
    return [base + (i < rest) for i in range(buckets)]


def gold_candidates(listings: DataFrame, reviews: DataFrame, gold: DataFrame, hits: Column, as_of: str, limit: int = 150, days: int = RECENT_DAYS) -> DataFrame:
    """listing_id, reason: up to `limit` recent rows without gold, a share for each kind of doubt, some clean, then the newest.

    A row that an earlier share has taken is left to it; a row that matches an
    earlier one but was beyond its share can still be taken later. Each share
    is at most `limit` rows; the slice of recent rows is written once.
    """
    q = queues()
    quotas = split_quota(limit, 8)
    slice_ = with_reviews(listings, reviews).where(recent(as_of, days)).join(gold.select(F.col("listing_id").alias("id")), "id", "left_anti")
    flags = {name: q[name] for name in ("missing_brand", "missing_price", "missing_condition", "low_local", "bundle", "sold")}
    flags |= {"clean": ~any_flag(), "multi_open": open_("multi_brand")}
    slim = slice_.select("id", "title", "description", "first_seen_at", *[c.alias(f"f_{k}") for k, c in flags.items()]).persist()
    order = [F.desc("first_seen_at"), F.asc("id")]
    said = {"missing_brand": "missing brand", "missing_price": "missing price", "missing_condition": "missing condition", "low_local": "low local confidence", "bundle": "possible bundle", "sold": "sold detected"}
    picked: DataFrame | None = None
    taken = 0

    def left() -> DataFrame:
        return slim if picked is None else slim.join(picked.select(F.col("listing_id").alias("id")), "id", "left_anti")

    def add(rows: DataFrame, n: int, reason: str) -> None:
        nonlocal picked, taken
        # at most `limit` rows in all: small enough to hold as literals between the steps
        ids = [r["id"] for r in rows.select("id").limit(n).collect()]
        taken += len(ids)
        part = slim.sparkSession.createDataFrame([(i, reason) for i in ids], "listing_id bigint, reason string")
        picked = part if picked is None else picked.unionByName(part)

    for (name, reason), n in zip(said.items(), quotas, strict=False):
        add(left().where(f"f_{name}").orderBy(*order), n, reason)
    several = left().orderBy(*order).limit(MULTI_BRAND_ROWS).withColumn("_hits", hits).where((F.col("_hits") >= 2) & F.col("f_multi_open"))
    add(several.orderBy(*order), quotas[6], "multi-brand mentions")
    clean = left().where("f_clean").orderBy(*order).limit(max(25 * quotas[7], quotas[7])).withColumn("_hits", hits).where(F.col("_hits") < 2)
    add(clean.orderBy(*order), quotas[7], "clean normal row")
    if taken < limit:
        add(left().orderBy(*order), limit - taken, "recent listing (quota fill)")
    slim.unpersist()
    return picked


def may_overwrite(field: str) -> Column:
    """Whether patterns may write a field: it is empty, or its source is not one to be kept."""
    source = F.coalesce(F.col(f"{field}_source"), F.lit(""))
    return F.col(field).isNull() | ~source.isin(*PROTECTED)


def backfill_parse(listings: DataFrame, reviews: DataFrame, parsed: dict[str, Column], now: Column) -> DataFrame:
    """Parse anew: guarded labels, prices, bundle flags that no reviewer fixed; sold only from false to true.

    parsed: Columns watch (a struct brand, reference), condition, watch_type,
    price_cents, is_bundle, is_sold over the listing's own columns. Each is
    computed once a row, and only where its value may be written.
    """
    locked = reviews.where("bundle_reviewed").select(F.col("listing_id").alias("id"), F.lit(True).alias("_locked")).distinct()
    free = {f: may_overwrite(f) for f in ("brand", "reference", "condition", "watch_type")}
    needed = {"watch": free["brand"] | free["reference"], "condition": free["condition"], "watch_type": free["watch_type"]}
    needed |= {"is_bundle": F.col("_locked").isNull(), "is_sold": ~F.coalesce(F.col("is_sold"), F.lit(False))}
    rows = listings.join(locked, "id", "left").withColumns({f"_p_{k}": F.when(needed.get(k, F.lit(True)), v) for k, v in parsed.items()})
    out: dict[str, Column] = {}
    written = []
    for f in ("brand", "reference", "condition", "watch_type"):
        new = F.col(f"_p_watch.{f}" if f in ("brand", "reference") else f"_p_{f}")
        ok = new.isNotNull() & ~new.eqNullSafe(F.col(f)) & free[f]
        written.append(ok)
        out[f] = F.when(ok, new).otherwise(F.col(f))
        out[f"{f}_source"] = F.when(ok, "regex").otherwise(F.col(f"{f}_source"))
        if f"{f}_confidence" in listings.columns:
            out[f"{f}_confidence"] = F.when(~ok, F.col(f"{f}_confidence"))
    price = F.col("_p_price_cents")
    out["price_cents"] = F.coalesce(price, F.col("price_cents"))
    out |= {c: F.when(price.isNull(), F.col(c)) for c in ("price_min_cents", "price_max_cents")}
    sells = F.col("_p_is_sold") & ~F.col("is_sold")
    out["is_sold"] = F.col("is_sold") | F.col("_p_is_sold")
    out["sold_at"] = F.when(sells, now).otherwise(F.col("sold_at"))
    out["is_bundle"] = F.when(F.coalesce(F.col("_locked"), F.lit(False)), F.col("is_bundle")).otherwise(F.col("_p_is_bundle"))
    out["classifier_source"] = F.when(reduce(lambda a, b: a | b, written), "regex").otherwise(F.col("classifier_source"))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in listings.columns])


def parsed_columns(watch: Column, bundle: Column) -> dict[str, Column]:
    """What backfill_parse takes, from a listing's title and description."""
    t, d = F.col("title"), F.col("description")
    return {
        "watch": watch, "condition": T.condition(t, d), "watch_type": T.watch_type(t, d),
        "price_cents": T.usd_price_cents(t, d), "is_bundle": bundle, "is_sold": T.is_sold(t),
    }


def backfill_labels(listings: DataFrame, found: DataFrame, by: str, now: Column, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Classifier output (id, per field value and _confidence) into empty fields where confident enough.

    by: local or ai. The row's confidence is the least that was applied, 0 if
    none was; rows in found are stamped either way.
    """
    limits = thresholds or THRESHOLDS
    fields = [f for f in limits if f in found.columns]
    f_ = found.select("id", *[F.col(c).alias(f"_f_{c}") for c in found.columns if c != "id"], F.lit(True).alias("_found"))
    rows = listings.join(f_, "id", "left")
    use = {f: F.coalesce(F.col(f).isNull() & F.col(f"_f_{f}").isNotNull() & (F.col(f"_f_{f}_confidence") >= limits[f]), F.lit(False)) for f in fields}
    out: dict[str, Column] = {}
    for f in fields:
        out[f] = F.when(use[f], F.col(f"_f_{f}")).otherwise(F.col(f))
        out[f"{f}_source"] = F.when(use[f], by).otherwise(F.col(f"{f}_source"))
        if f"{f}_confidence" in listings.columns:
            out[f"{f}_confidence"] = F.when(use[f], half_up(F.col(f"_f_{f}_confidence") * 1000) / 1000).otherwise(F.col(f"{f}_confidence")).cast("decimal(4,3)")
    some = reduce(lambda a, b: a | b, use.values())
    least = F.least(*[F.when(use[f], F.col(f"_f_{f}_confidence")) for f in fields], F.lit(None).cast("double")) if fields else F.lit(None)
    stamped = F.coalesce(F.col("_found"), F.lit(False))
    conf = F.when(some, half_up(least * 100) / 100).otherwise(F.lit(0.0)).cast("decimal(3,2)")
    out[f"{by}_confidence"] = F.when(stamped, conf).otherwise(F.col(f"{by}_confidence"))
    out[f"{by}_classified_at"] = F.when(stamped, now).otherwise(F.col(f"{by}_classified_at"))
    out["classifier_source"] = F.when(stamped & some, by).otherwise(F.col("classifier_source"))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in listings.columns])


def backfill_provenance(listings: DataFrame) -> DataFrame:
    """Sources of labels that have none: the row's classifier if it can be trusted, else legacy; none is overwritten."""
    guess = F.when(F.col("classifier_source").isin(*TRUSTED), F.col("classifier_source")).otherwise("legacy")
    fields = ("brand", "reference", "condition", "watch_type")
    has = lambda f: F.coalesce(F.col(f), F.lit("")) != ""
    return listings.withColumns({f"{f}_source": F.when(F.coalesce(F.col(f"{f}_source"), F.lit("")) != "", F.col(f"{f}_source")).when(has(f), guess).otherwise(F.col(f"{f}_source")) for f in fields})


def provenance_counts(before: DataFrame) -> DataFrame:
    """How many labels the provenance backfill gives each source."""
    guess = F.when(F.col("classifier_source").isin(*TRUSTED), F.col("classifier_source")).otherwise("legacy")
    fields = ("brand", "reference", "condition", "watch_type")
    open_fields = F.array_compact(F.array(*[F.when((F.coalesce(F.col(f), F.lit("")) != "") & (F.coalesce(F.col(f"{f}_source"), F.lit("")) == ""), f) for f in fields]))
    return before.select(guess.alias("source"), F.explode(open_fields).alias("field")).groupBy("source").agg(F.count("*").alias("n"))


def classifier_coverage(listings: DataFrame) -> DataFrame:
    has = lambda c: F.count_if(F.col(c).isNotNull())
    source = F.col("classifier_source")
    return listings.agg(
        F.count("*").alias("total"), has("condition").alias("has_condition"), has("watch_type").alias("has_watch_type"), has("brand").alias("has_brand"),
        has("reference").alias("has_reference"), has("local_classified_at").alias("local_classified"), has("ai_classified_at").alias("ai_classified"),
        *[F.count_if(source == s).alias(f"source_{s}") for s in ("regex", "local", "ai")], F.count_if(source.isNull()).alias("source_null"),
    )


def field_coverage(listings: DataFrame, fields: tuple[str, ...] = ("condition",)) -> DataFrame:
    """field, total, filled, pct (one decimal; 0 without rows)."""
    sums = listings.agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in fields])
    rows = sums.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])).alias("x"))
    pct = F.when(F.col("total") > 0, F.floor(F.col("x.filled") * 1000.0 / F.col("total") + 0.5) / 10).otherwise(F.lit(0.0))
    return rows.select("x.field", "total", "x.filled", pct.alias("pct"))


def confidence_list(listings: DataFrame, by: str, low: bool, limit: int) -> DataFrame:
    """Classified rows below (ascending) or from (descending) the confidence that is shown as high."""
    edge = LOCAL_SHOWN if by == "local" else AI_SHOWN
    conf = F.col(f"{by}_confidence").cast("double")
    rows = listings.where(F.col(f"{by}_classified_at").isNotNull()).where((conf < edge) if low else (conf >= edge))
    return rows.orderBy(F.asc(f"{by}_confidence") if low else F.desc(f"{by}_confidence"), "id").limit(limit)


def label_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
