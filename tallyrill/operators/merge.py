"""Upserts as pure merges: merge(target, incoming) gives the new target.

Parquet has no MERGE, so a merge reduces what comes in to one row a key, joins
it to the old rows by a full outer join on the key, and decides column by
column from the old and the new row. All rules see the old row as it was.
Writing the result to a new version and swapping is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("source_id", "external_id")
STICKY = ("brand", "reference", "brand_source", "reference_source", "condition", "condition_source", "watch_type", "watch_type_source", "classifier_source")
FORUM_TAKEN = ("title", "description", "listing_url", "image_url", "region", "is_sold")
#: What each overwriting source replaces, even by null.
MARKET_TAKEN = ("title", "brand", "reference", "price_cents", "currency", "listing_url", "image_url", "region")
FEED_TAKEN = ("title", "brand", "reference", "price_cents", "listing_url", "image_url")
CATALOG_TAKEN = ("title", "brand", "reference", "price_cents", "currency", "condition", "listing_url", "image_url", "region")
PRICE = ("price_cents", "price_min_cents", "price_max_cents")
NO_COMMENT = "[no comment]"
DESCRIPTION_CHARS = 65535


def latest(incoming: DataFrame, key: tuple[str, ...], pos: str, sticky: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row a key: the last by `pos`; of sticky columns the last value that is not null. more: other aggregates of the same pass."""
    others = [c for c in incoming.columns if c not in key and c not in sticky]
    aggs = [F.max_by(c, pos).alias(c) for c in others]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c) for c in sticky if c in incoming.columns]
    return incoming.groupBy(*key).agg(*aggs, *more)


def merge(target: DataFrame, incoming: DataFrame, key: tuple[str, ...], update: dict[str, Column], insert: dict[str, Column] | None = None) -> DataFrame:
    """target with incoming (one row a key) merged in.

    In update and insert, columns of the old row are o.<name>, of the new one
    n.<name>. Columns in neither stay as they were; inserted rows take theirs
    from incoming where it has them.
    """
    o, n = target.withColumn("_old", F.lit(True)).alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    both = o.join(n, on, "full_outer")
    old, new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    out = []
    for f in target.schema.fields:
        c = f.name
        fresh = (insert or {}).get(c, F.col(f"n.{c}") if c in incoming.columns else F.lit(None))
        kept = F.col(f"o.{c}")
        changed = update.get(c, kept)
        out.append(F.when(old & new, changed).when(old, kept).otherwise(fresh).cast(f.dataType).alias(c))
    return both.select(*out)


def price_triple(old: tuple[Column, Column, Column], new: tuple[Column, Column, Column]) -> Column:
    """A struct of the three price columns: nothing new keeps the old; a bucket does not replace an exact price; else the new."""
    (p, lo, hi), (q, qlo, qhi) = old, new
    make = lambda *x: F.struct(*[c.alias(n) for c, n in zip(x, PRICE, strict=True)])
    nothing = q.isNull() & qlo.isNull() & qhi.isNull()
    bucket = qlo.isNotNull() | qhi.isNotNull()
    exact_only = lo.isNull() & hi.isNull() & p.isNotNull()
    return F.when(nothing | (bucket & exact_only), make(p, lo, hi)).otherwise(make(q, qlo, qhi))


def sold_at(sold: Column, was_sold: Column, old_sold_at: Column, now: Column) -> Column:
    """None unless sold; the old moment if it was sold before; else now."""
    return F.when(~sold, None).when(F.coalesce(was_sold, F.lit(False)), F.coalesce(old_sold_at, now)).otherwise(now)


def _cols(side: str, names: tuple[str, ...]) -> tuple[Column, ...]:
    return tuple(F.col(f"{side}.{c}") for c in names)


def upsert_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """By slug; of known sources only the name changes."""
    return merge(sources, incoming, ("slug",), {"name": F.col("n.name")})


def upsert_forum(listings: DataFrame, incoming: DataFrame, reviews: DataFrame, now: Column, pos: str = "pos") -> DataFrame:
    """Forum posts: texts and flags are replaced, labels only by a value, prices by the triple rule, bundles unless a reviewer fixed them.

    Of several rows of a key the later prices are folded onto the earlier by
    the same rule, as if they had come one by one.
    """
    prices = F.array_sort(F.collect_list(F.struct(pos, *PRICE))).alias("_prices")
    one = latest(incoming.dropna(subset=list(KEY)), KEY, pos, STICKY, (prices,)).drop(pos)
    # ids and keys alone move to the reviews; whole listings move once, to their key. Null-safe joins put no filter of
    # their own on a scan, so that the moves of the lines below are the same and done once
    locked = reviews.where("bundle_reviewed").select("listing_id").alias("r")
    held = listings.select("id", *KEY).alias("l").join(locked, F.col("l.id").eqNullSafe(F.col("r.listing_id")), "left_semi").groupBy(*KEY).agg(F.collect_set("id").alias("_held"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in KEY]
    one = one.alias("n").join(held.alias("h"), same, "left").select("n.*", "h._held")
    fold = lambda start: F.aggregate(F.col("n._prices"), start, lambda a, x: price_triple(tuple(a[c] for c in PRICE), tuple(x[c] for c in PRICE)))
    start = F.struct(*[F.col(f"o.{c}").cast("bigint").alias(c) for c in PRICE])
    none = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in PRICE])
    update = {c: F.col(f"n.{c}") for c in FORUM_TAKEN if c in incoming.columns}
    update |= {c: F.coalesce(f"n.{c}", f"o.{c}") for c in STICKY if c in incoming.columns}
    update |= {c: fold(start)[c] for c in PRICE}
    update |= {
        "is_bundle": F.when(F.coalesce(F.array_contains("n._held", F.col("o.id")), F.lit(False)), F.col("o.is_bundle")).otherwise(F.col("n.is_bundle")),
        "sold_at": sold_at(F.col("n.is_sold"), F.col("o.is_sold"), F.col("o.sold_at"), now),
        "last_seen_at": now,
    }
    insert = {c: fold(none)[c] for c in PRICE} | {"sold_at": F.when(F.col("n.is_sold"), now), "first_seen_at": now, "last_seen_at": now}
    return merge(listings, one, KEY, update, insert)


def upsert_overwriting(listings: DataFrame, incoming: DataFrame, taken: tuple[str, ...], now: Column, pos: str = "pos") -> DataFrame:
    """Marketplaces, feeds and catalogs: `taken` columns are replaced, even by null; condition only where it is taken."""
    one = latest(incoming, KEY, pos).drop(pos)
    update = {c: F.col(f"n.{c}") for c in taken if c in incoming.columns} | {"last_seen_at": now}
    no = F.lit(False)
    insert = {"is_bundle": no, "is_sold": no, "first_seen_at": now, "last_seen_at": now}
    return merge(listings, one, KEY, update, insert)


def merged_description(old: Column, self_text: Column, comment: Column) -> Column:
    """A description with the thread's texts: replaced if there was none, else each part appended that it does not contain; the sentinel where nothing was found."""
    said = F.trim(F.coalesce(self_text, F.lit("")))
    op = F.when(comment == NO_COMMENT, F.lit("")).otherwise(F.trim(F.coalesce(comment, F.lit(""))))
    both = F.array_join(F.filter(F.array(said, op), lambda t: t != ""), "\n\n")
    now = F.trim(F.coalesce(old, F.lit("")))
    add = lambda text, part: F.when((part != "") & ~F.contains(text, part), F.concat(F.rtrim(text), F.lit("\n\n"), part)).otherwise(text)
    longer = add(add(now, said), op)
    return (
        F.when((both != "") & now.isin("", NO_COMMENT), F.substring(both, 1, DESCRIPTION_CHARS))
        .when((both != "") & (longer != now), F.substring(longer, 1, DESCRIPTION_CHARS))
        .when((both == "") & (comment == NO_COMMENT) & (now == ""), F.lit(NO_COMMENT))
        .otherwise(old)
    )


def rescue(listings: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Sparse updates of known rows: patches (source_id, external_id, brand, reference, condition, watch_type, is_sold, has_price and the price triple, self_text, op_comment).

    Values that are there are written with source regex. A price patch sets
    all three columns. Sold stays sold.
    """
    fields = ("brand", "reference", "condition", "watch_type")
    update = {}
    for c in fields:
        given = F.col(f"n.{c}").isNotNull()
        update[c] = F.coalesce(f"n.{c}", f"o.{c}")
        update[f"{c}_source"] = F.when(given, "regex").otherwise(F.col(f"o.{c}_source"))
    some = F.coalesce(*[F.col(f"n.{c}") for c in fields]).isNotNull()
    update["classifier_source"] = F.when(some, "regex").otherwise(F.col("o.classifier_source"))
    priced = F.coalesce(F.col("n.has_price"), F.lit(False))
    update |= {c: F.when(priced, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in PRICE}
    sold = F.coalesce(F.col("n.is_sold"), F.lit(False)) | F.col("o.is_sold")
    update |= {"is_sold": sold, "sold_at": sold_at(sold, F.col("o.is_sold"), F.col("o.sold_at"), now)}
    update["description"] = merged_description(F.col("o.description"), F.col("n.self_text"), F.col("n.op_comment"))
    known = patches.join(listings.select(*KEY), list(KEY), "left_semi")
    return merge(listings, known, KEY, update)


def refresh_bundles(listings: DataFrame, reviews: DataFrame, detected: Column) -> DataFrame:
    """is_bundle as detected, but where a reviewer fixed it."""
    locked = reviews.where("bundle_reviewed").select(F.col("listing_id").alias("id"), F.lit(True).alias("_locked")).distinct()
    fixed = F.coalesce(F.col("_locked"), F.lit(False))
    return listings.join(locked, "id", "left").withColumn("is_bundle", F.when(fixed, F.col("is_bundle")).otherwise(detected)).select(*listings.columns)


def fill_labels(listings: DataFrame, found: DataFrame, by: str, now: Column) -> DataFrame:
    """Classifier output (id, for each field value and confidence, maybe <by>_confidence of the row) into empty fields; value, source and confidence each on its own."""
    fields = [c for c in ("brand", "reference", "condition", "watch_type") if c in found.columns]
    update = {}
    for c in fields:
        given = F.col(f"n.{c}").isNotNull()
        update[c] = F.coalesce(f"o.{c}", f"n.{c}")
        update[f"{c}_source"] = F.coalesce(F.col(f"o.{c}_source"), F.when(given, by))
        if f"{c}_confidence" in listings.columns:
            update[f"{c}_confidence"] = F.coalesce(F.col(f"o.{c}_confidence"), F.col(f"n.{c}_confidence"))
    update |= {"classifier_source": F.lit(by), f"{by}_classified_at": now}
    if f"{by}_confidence" in found.columns:
        update[f"{by}_confidence"] = F.col(f"n.{by}_confidence")
    known = found.join(listings.select("id"), "id", "left_semi")
    return merge(listings, known, ("id",), update)


_REVIEW_FIELDS = ("brand", "reference", "condition", "watch_type")


def upsert_reviews(reviews: DataFrame, deltas: DataFrame, now: Column) -> DataFrame:
    """Review forms (one a listing): touched fields replace the stored review, others stay, notes always do.

    deltas: listing_id, touch_<field> for brand, reference, condition,
    watch_type, price, sold, local, bundle and multi_brand, the values,
    brand_unknown, price_unknown, notes. A brand that is neither given nor
    unknown is un-reviewed; other touched fields are reviewed, value or not.
    """
    update, insert = {}, {}
    touch = lambda f: F.coalesce(F.col(f"n.touch_{f}"), F.lit(False))

    def put(name: str, touched: Column, value: Column, blank: Column) -> None:
        update[name] = F.when(touched, value).otherwise(F.col(f"o.{name}"))
        insert[name] = F.when(touched, value).otherwise(blank)

    none, no, yes = F.lit(None), F.lit(False), F.lit(True)
    unknown = F.coalesce(F.col("n.brand_unknown"), no)
    given = F.coalesce(F.trim(F.col("n.brand")), F.lit("")) != ""
    put("brand", touch("brand"), F.when(given & ~unknown, F.trim(F.col("n.brand"))), none)
    put("brand_reviewed", touch("brand"), given | unknown, no)
    for f in _REVIEW_FIELDS[1:]:
        put(f, touch(f), F.nullif(F.trim(F.col(f"n.{f}")), F.lit("")), none)
        put(f"{f}_reviewed", touch(f), yes, no)
    priceless = F.coalesce(F.col("n.price_unknown"), no)
    for c in PRICE:
        put(c, touch("price"), F.when(~priceless, F.col(f"n.{c}")), none)
    put("price_reviewed", touch("price"), yes, no)
    labels = touch("brand") | touch("reference") | touch("condition") | touch("watch_type")
    put("local_reviewed", labels | touch("local"), yes, no)
    for f in ("sold", "bundle", "multi_brand"):
        put(f"{f}_reviewed", touch(f), yes, no)
    update |= {"notes": F.col("n.notes"), "reviewed_at": now}
    insert |= {"notes": F.col("n.notes"), "reviewed_at": now}
    return merge(reviews, deltas, ("listing_id",), update, insert)


def apply_reviews(listings: DataFrame, deltas: DataFrame) -> DataFrame:
    """What review forms change in listings: touched labels become manual; an unknown brand loses its value but keeps its source; unknown prices and sold marks change nothing."""
    d = deltas.withColumnRenamed("listing_id", "id")
    touch = lambda f: F.coalesce(F.col(f"n.touch_{f}"), F.lit(False))
    unknown = F.coalesce(F.col("n.brand_unknown"), F.lit(False))
    given = touch("brand") & (F.coalesce(F.trim(F.col("n.brand")), F.lit("")) != "") & ~unknown
    update = {
        "brand": F.when(given, F.trim(F.col("n.brand"))).when(touch("brand") & unknown, None).otherwise(F.col("o.brand")),
        "brand_source": F.when(given, "manual").otherwise(F.col("o.brand_source")),
        "brand_confidence": F.when(given, F.lit("1.000").cast("decimal(4,3)")).otherwise(F.col("o.brand_confidence")),
    }
    for f in _REVIEW_FIELDS[1:]:
        update[f] = F.when(touch(f), F.nullif(F.trim(F.col(f"n.{f}")), F.lit(""))).otherwise(F.col(f"o.{f}"))
        update[f"{f}_source"] = F.when(touch(f), "manual").otherwise(F.col(f"o.{f}_source"))
        if f"{f}_confidence" in listings.columns:
            update[f"{f}_confidence"] = F.when(~touch(f), F.col(f"o.{f}_confidence"))
    priced = touch("price") & ~F.coalesce(F.col("n.price_unknown"), F.lit(False))
    update |= {c: F.when(priced, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in PRICE}
    labels = touch("brand") | touch("reference") | touch("condition") | touch("watch_type")
    update["classifier_source"] = F.when(labels, "manual").otherwise(F.col("o.classifier_source"))
    update["is_bundle"] = F.when(touch("bundle"), F.col("n.is_bundle")).otherwise(F.col("o.is_bundle"))
    known = d.join(listings.select("id"), "id", "left_semi")
    return merge(listings, known, ("id",), update)


def review_delta(baseline: DataFrame, form: DataFrame, key: str = "listing_id") -> DataFrame:
    """touch_<field> of a form against what it showed; a blank choice is no change, a price of bounds only is their middle."""
    o, n = baseline.alias("o"), form.alias("n")
    clean = lambda side, f: F.coalesce(F.trim(F.col(f"{side}.{f}")), F.lit(""))
    changed = {f: clean("n", f) != clean("o", f) for f in ("brand", "reference")}
    changed |= {f: (clean("n", f) != "") & (clean("n", f) != clean("o", f)) for f in ("condition", "watch_type")}
    low, high = F.col("n.price_min_cents"), F.col("n.price_max_cents")
    middle = F.when(low.isNotNull() & high.isNotNull(), F.floor((low + high) / 2.0 + 0.5).cast("bigint"))
    price = F.coalesce(F.col("n.price_cents"), middle)
    changed["price"] = ~(price.eqNullSafe(F.col("o.price_cents")) & low.eqNullSafe(F.col("o.price_min_cents")) & high.eqNullSafe(F.col("o.price_max_cents")))
    rows = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"))
    return rows.select(F.col(f"n.{key}").alias(key), price.alias("price_cents"), *[c.alias(f"touch_{f}") for f, c in changed.items()])


def add_gold(gold: DataFrame, incoming: DataFrame) -> DataFrame:
    """Gold rows of listings that have none yet; others are left as they are."""
    return gold.unionByName(incoming.dropDuplicates(["listing_id"]).join(gold.select("listing_id"), "listing_id", "left_anti"), allowMissingColumns=True)


def remove_gold(gold: DataFrame, ids: DataFrame) -> DataFrame:
    return gold.join(ids.select("listing_id"), "listing_id", "left_anti")


def clear_descriptions(listings: DataFrame, ids: DataFrame, sentinel: str = NO_COMMENT) -> DataFrame:
    """The sentinel description of the listed rows becomes null, so that they are looked at again."""
    listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    stale = F.coalesce(F.col("_listed"), F.lit(False)) & (F.col("description") == sentinel)
    return listings.join(listed, "id", "left").withColumn("description", F.when(~F.coalesce(stale, F.lit(False)), F.col("description"))).select(*listings.columns)


def rescue_candidates(listings: DataFrame, source_id: int, now: Column, hours: int = 72, limit: int = 100) -> DataFrame:
    """Recent rows of a source that lack a price, brand or condition, or have a bucket price, and no description; by id."""
    lacking = F.col("price_cents").isNull() | F.col("brand").isNull() | F.col("condition").isNull() | F.col("price_min_cents").isNotNull() | F.col("price_max_cents").isNotNull()
    recent = F.col("first_seen_at") >= now - F.make_interval(hours=F.lit(hours))
    return listings.where((F.col("source_id") == source_id) & recent & lacking & (F.coalesce("description", F.lit("")) == "")).orderBy("id").limit(limit)
