"""Schemas of the listing store."""

from __future__ import annotations

SOURCES = "id bigint, slug string, name string, base_url string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz"

LISTINGS = (
    "id bigint, source_id bigint, external_id string, title string, description string, brand_raw string, model_raw string, reference_raw string, "
    "brand string, reference string, price_cents bigint, price_min_cents bigint, price_max_cents bigint, currency string, condition string, watch_type string, "
    "ai_confidence decimal(3,2), ai_classified_at timestamp_ntz, local_confidence decimal(3,2), local_classified_at timestamp_ntz, classifier_source string, "
    "brand_source string, brand_confidence decimal(4,3), reference_source string, reference_confidence decimal(4,3), condition_source string, "
    "condition_confidence decimal(4,3), watch_type_source string, watch_type_confidence decimal(4,3), listing_url string, image_url string, region string, "
    "is_bundle boolean, is_sold boolean, sold_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)

CLICKS = "id bigint, listing_id bigint, source_id bigint, ip_hash string, user_agent string, referer string, placement string, created_at timestamp_ntz"

REVIEWS = (
    "listing_id bigint, brand string, reference string, condition string, watch_type string, brand_reviewed boolean, reference_reviewed boolean, "
    "condition_reviewed boolean, watch_type_reviewed boolean, price_reviewed boolean, sold_reviewed boolean, local_reviewed boolean, bundle_reviewed boolean, "
    "multi_brand_reviewed boolean, price_cents bigint, price_min_cents bigint, price_max_cents bigint, notes string, reviewed_at timestamp_ntz"
)

GOLD = (
    "listing_id bigint, brand string, reference string, condition string, watch_type string, price_cents bigint, price_min_cents bigint, price_max_cents bigint, "
    "is_bundle boolean, is_sold boolean, notes string, created_at timestamp_ntz, updated_at timestamp_ntz"
)

EVENTS = (
    "id bigint, event_type string, session_id string, ip_hash string, user_agent string, referer string, path string, query string, placement string, "
    "listing_id bigint, source_id bigint, metadata_json string, created_at timestamp_ntz"
)

POSTS = (
    "id string, name string, title string, selftext string, permalink string, url string, author string, created_utc double, link_flair_text string, "
    "removed_by_category string, thumbnail string, stickied boolean, is_self boolean, is_gallery boolean, "
    "preview struct<images: array<struct<source: struct<url: string>, resolutions: array<struct<url: string, width: int>>>>>, "
    "media_metadata map<string, struct<status: string, s: struct<u: string>, p: array<struct<u: string, x: int>>>>"
)

COMMENTS = "data struct<children: array<struct<kind: string, data: struct<author: string, body: string>>>>"

MARKET_ITEMS = "id string, url string, title string, subtitle string, images array<string>, location string, price struct<amount: double, currency: string>"

CATALOG_ITEMS = (
    "itemId string, title string, price struct<value: string, currency: string>, condition string, conditionId string, itemWebUrl string, "
    "image struct<imageUrl: string>, thumbnailImages array<struct<imageUrl: string>>, itemLocation struct<country: string, stateOrProvince: string, postalCode: string>"
)

#: Label values; fixed.
CONDITIONS = ("unworn", "excellent", "very good", "good", "fair")
WATCH_TYPES = ("vintage",)
LABEL_SOURCES = ("regex", "local", "ai", "manual", "legacy")
EVENT_TYPES = ("page_view", "search", "filter_apply", "click")
