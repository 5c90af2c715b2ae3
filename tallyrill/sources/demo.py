"""Twenty made-up listings of one demo source, for trying things out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .fixtures import BRAND_NAMES, CONDITION_NAMES, REGION_NAMES

ROWS = 20


def demo_sources(spark: SparkSession) -> DataFrame:
    row = (1, "demo", "Demo data", "https://example.com", True, None, None)
    return spark.createDataFrame([row], schema.SOURCES)


def demo_listings(spark: SparkSession, parse: Callable[[Column], Column], now: Column) -> DataFrame:
    """Rows made by rule; brand and reference are what the title tells, or else the raw ones."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    i = F.col("id")
    raw = spark.range(1, ROWS + 1).select(i, pick(BRAND_NAMES, i).alias("brand_raw"), (i * 7919 + 10_000).cast("string").alias("reference_raw"), pick(CONDITION_NAMES, i).alias("condition"), pick(REGION_NAMES, i).alias("region"), (i * 12_345 + 50_000).alias("price_cents"))
    titled = raw.withColumn("title", F.when(i % 4 == 0, F.concat(F.lit("Watch "), "reference_raw")).otherwise(F.concat_ws(" ", "brand_raw", "reference_raw"))).withColumn("_p", parse(F.col("title")))
    values = {
        "source_id": F.lit(1), "external_id": F.concat(F.lit("demo-"), i.cast("string")), "brand": F.coalesce("_p.brand", "brand_raw"), "reference": F.coalesce("_p.reference", "reference_raw"), "currency": F.lit("USD"),
        "listing_url": F.concat(F.lit("https://example.com/"), i.cast("string")), "is_bundle": F.lit(False), "is_sold": F.lit(False), "first_seen_at": now, "last_seen_at": now, "created_at": now, "updated_at": now,
    }
    fields = [f.strip().split(" ", 1) for f in schema.LISTINGS.split(", ")]
    return titled.select(*[(values[n] if n in values else F.col(n) if n in titled.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
