"""Faceted search over listings: predicates, sort orders, pages, facets."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_AFTER_DAYS = 3
SOLD_VISIBLE_HOURS = 24
SORTS = ("last_seen", "price_asc", "price_desc", "newest")
TEXT_COLUMNS = ("title", "brand", "reference", "brand_raw", "model_raw", "reference_raw")
#: Inclusive at both ends, in whole currency units.
PRICE_PRESETS = {"under_1k": (None, 1000), "1k_5k": (1000, 5000), "5k_15k": (5000, 15000), "over_15k": (15000, None)}


@dataclass(frozen=True)
class SearchParams:
    """What a search asks for. Prices are in whole units, `condition` may be 'n/a' for none."""

    q: str | None = None
    brand: tuple[str, ...] = ()
    min_price: float | None = None
    max_price: float | None = None
    state: str | None = None
    condition: str | None = None
    watch_type: str | None = None
    include_stale: bool = False
    stale_after_hours: float | None = None
    include_bundles: bool = False
    include_sold: bool = False
    sort: str = "last_seen"
    limit: int | None = None
    offset: int | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_url(cls, query: dict[str, str | list[str]], page_size: int = 50) -> SearchParams:
        """From URL parameters: unreadable numbers are dropped, flags are '1', pages count from 1."""

        def one(name: str) -> str | None:
            v = query.get(name)
            v = v[0] if isinstance(v, list) and v else v
            return v if isinstance(v, str) and v.strip() else None

        def number(name: str) -> float | None:
            try:
                v = float(one(name) or "")
            except ValueError:
                return None
            return v if math.isfinite(v) else None

        page = max(1, math.floor(number("page") or 1))
        return cls(
            q=one("q"), brand=normalize_brands(query.get("brand")), min_price=number("minPrice"), max_price=number("maxPrice"), state=one("state"),
            condition=one("condition"), watch_type=one("watchType"), include_stale=one("includeStale") == "1", include_bundles=one("includeBundles") == "1",
            include_sold=one("includeSold") == "1", sort=one("sort") or "last_seen", limit=page_size, offset=(page - 1) * page_size,
        )


def clamp(value: float | None, low: int, high: int, default: int) -> int:
    """value as a whole number in [low, high]; default where it is none or not finite."""
    if value is None or not math.isfinite(value):
        return default
    return int(min(max(math.floor(value), low), high))


def page_bounds(total: int, limit: int, page: int) -> tuple[int, int, int]:
    """(page, pages, offset), the page clamped to those there are."""
    pages = max(1, -(-total // limit))
    page = min(max(1, page), pages)
    return page, pages, (page - 1) * limit


def normalize_brands(value: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """Trimmed, without blanks and case-insensitive repeats; the first spelling stays."""
    values = [value] if isinstance(value, str) else list(value or ())
    out: dict[str, str] = {}
    for v in values:
        v = (v or "").strip()
        if v:
            out.setdefault(v.lower(), v)
    return tuple(out.values())


def cents(amount: float) -> int:
    """Nearest cent, halves up."""
    return math.floor(amount * 100 + 0.5)


def at(moment: str | datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def seen_since(as_of: str, hours: float) -> Column:
    return F.col("last_seen_at") >= at(as_of) - F.make_interval(hours=F.lit(math.floor(hours)))


def sold_visible(include_sold: bool, as_of: str, hours: int = SOLD_VISIBLE_HOURS) -> Column:
    """Not sold; with include_sold also those sold in the last hours."""
    unsold = ~F.col("is_sold")
    if not include_sold:
        return unsold
    return unsold | (F.col("is_sold") & (F.col("sold_at") >= at(as_of) - F.make_interval(hours=F.lit(hours))))


def facet_filter(as_of: str, include_stale: bool = False, include_bundles: bool = False, include_sold: bool = False, stale_after_hours: float | None = None) -> Column:
    """What the index shows: fresh, no bundles, not sold, unless included."""
    parts = []
    if not include_stale:
        parts.append(seen_since(as_of, STALE_AFTER_DAYS * 24 if stale_after_hours is None else stale_after_hours))
    if not include_bundles:
        parts.append(~F.col("is_bundle"))
    parts.append(sold_visible(include_sold, as_of))
    return all_of(parts)


def text_match(q: str, columns: list[str]) -> Column:
    """Case-insensitive LIKE '%q%' in any column; % and _ in q are wildcards."""
    pattern = f"%{q.strip().lower()}%"
    return any_of([F.lower(c).like(pattern) for c in columns])


def search_filter(params: SearchParams, as_of: str, columns: list[str]) -> Column:
    """The conjunction of all that is asked; cheap predicates that reach the scan come first."""
    parts: list[Column] = []
    if len(params.brand) == 1:
        parts.append(F.col("brand") == params.brand[0])
    elif params.brand:
        parts.append(F.col("brand").isin(*params.brand))
    if params.min_price is not None:
        parts.append(F.col("price_cents") >= cents(params.min_price))
    if params.max_price is not None:
        parts.append(F.col("price_cents") <= cents(params.max_price))
    if params.state:
        parts.append(F.col("region") == params.state)
    if params.condition == "n/a":
        parts.append(F.col("condition").isNull())
    elif params.condition:
        parts.append(F.col("condition") == params.condition)
    if params.watch_type:
        parts.append(F.col("watch_type") == params.watch_type)
    parts.append(facet_filter(as_of, params.include_stale, params.include_bundles, params.include_sold, params.stale_after_hours))
    if params.q and params.q.strip():
        parts.append(text_match(params.q, [c for c in TEXT_COLUMNS if c in columns]))
    return all_of(parts)


def sort_order(sort: str) -> list[Column]:
    """Nulls first upwards, last downwards; the id decides ties."""
    key = {
        "price_asc": F.col("price_cents").asc_nulls_first(),
        "price_desc": F.col("price_cents").desc_nulls_last(),
        "newest": F.col("first_seen_at").desc_nulls_last(),
    }.get(sort, F.col("last_seen_at").desc_nulls_last())
    return [key, F.col("id").asc()]


def search(listings: DataFrame, sources: DataFrame, params: SearchParams, as_of: str) -> DataFrame:
    """One page of listings with source_name; the top rows are found before the dimension is joined."""
    hits = listings.where(search_filter(params, as_of, listings.columns))
    order = sort_order(params.sort)
    limit, offset = clamp(params.limit, 1, 100, 25), max(0, params.offset or 0)
    # listings without a source do not count, as in an inner join
    known = hits.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return known.orderBy(*order).offset(offset).limit(limit)


def count_matches(listings: DataFrame, params: SearchParams, as_of: str) -> DataFrame:
    return listings.where(search_filter(params, as_of, listings.columns)).agg(F.count("*").alias("total"))


def by_locale(name: str) -> Column:
    """Order of people, not of bytes: accents and case only decide between equals."""
    return F.collate(F.col(name), "UNICODE")


def brands(listings: DataFrame, shown: Column) -> DataFrame:
    return listings.where(shown).where("brand <> ''").select("brand").distinct().orderBy(by_locale("brand"))


def top_brands(listings: DataFrame, shown: Column, limit: int = 12) -> DataFrame:
    counted = listings.where(shown & F.col("brand").isNotNull()).groupBy("brand").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "brand").limit(limit).where("brand <> ''")


def brand_typeahead(listings: DataFrame, shown: Column, typed: str, limit: int = 10) -> DataFrame:
    found = listings.where(shown).where("brand <> ''").where(F.contains(F.lower("brand"), F.lit(typed.strip().lower())))
    return found.select("brand").distinct().orderBy(by_locale("brand")).limit(limit)


def dominant_source(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The most frequent source_name of a page of rows; among equals the one that comes first."""
    from pyspark.sql import Window

    placed = rows.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
    counted = placed.groupBy("source_name").agg(F.count("*").alias("n"), F.min("_pos").alias("first_pos"))
    return counted.orderBy(F.desc("n"), "first_pos").limit(1).select("source_name", "n")


def price_preset_counts(listings: DataFrame, shown: Column) -> DataFrame:
    """How many listings each preset finds; presets overlap at their ends."""
    def within(low: int | None, high: int | None) -> Column:
        parts = [F.col("price_cents") >= low * 100] if low is not None else []
        return all_of(parts + ([F.col("price_cents") <= high * 100] if high is not None else []))

    return listings.where(shown).agg(*[F.count_if(within(*v)).alias(k) for k, v in PRICE_PRESETS.items()])


def card_flags(listings: DataFrame, as_of: str) -> DataFrame:
    return listings.withColumns({
        "is_fresh": F.col("last_seen_at") > at(as_of) - F.make_interval(hours=F.lit(24)),
        "is_approx": F.col("price_min_cents").isNotNull() | F.col("price_max_cents").isNotNull(),
    })


def home_summary(listings: DataFrame, sources: DataFrame, as_of: str, stale_after_hours: float | None = None) -> DataFrame:
    """One row: total shown, the top 12 brands, the ids of the newest 8 and their dominant source."""
    shown = listings.where(facet_filter(as_of, stale_after_hours=stale_after_hours))
    total = shown.agg(F.count("*").alias("total"))
    top = top_brands(shown, F.lit(True)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "brand"))), lambda b: F.concat(b["brand"], F.lit(":"), -b["m"])), "|").alias("top_brands"))
    newest = search(listings, sources, SearchParams(sort="newest", limit=8, stale_after_hours=stale_after_hours), as_of)
    ids = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.negative(F.unix_micros(F.col("first_seen_at").cast("timestamp"))).alias("t"), "id"))), lambda r: r["id"].cast("string")), ",").alias("newest_ids"))
    main = dominant_source(newest, sort_order("newest")).agg(F.max("source_name").alias("dominant_source"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each is a single row
    return one(total).join(one(top), "_one").join(one(ids), "_one").join(one(main), "_one").drop("_one")
