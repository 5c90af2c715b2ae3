"""Structured Streaming: ingest as micro-batch merges, event sinks, day counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrill.operators.events import valid_events
from tallyrill.operators.merge import upsert_forum
from tallyrill.sources.buckets import BucketTable
from tallyrill.sources.feeds import posts_to_listings, typed_posts

INGEST_EVERY, RESCUE_EVERY = "15 minutes", "60 minutes"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def with_ids(listings: DataFrame) -> DataFrame:
    """Rows without an id get one from their key; a hash, so that no counter is shared."""
    return listings.withColumn("id", F.coalesce("id", F.xxhash64("source_id", "external_id").bitwiseAND((1 << 62) - 1)))


def counters(rows: DataFrame) -> DataFrame:
    """What a batch of listing rows held."""
    has = lambda c: F.count(c)
    return rows.agg(F.count("*").alias("upserted"), has("price_cents").alias("priced"), has("brand").alias("branded"), has("reference").alias("referenced"), has("condition").alias("with_condition"), F.count_if("is_sold").alias("sold"), F.count_if("is_bundle").alias("bundles"))


def ingest_posts(posts: DataFrame, table: BucketTable, reviews: Callable[[], DataFrame], source_id: int, parsed: Column, bundle: Column, now: Callable[[], Column], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream of raw posts into the stored listings; each batch is one merge of the buckets it touches, and is written once even if it is replayed. chain.py has the whole chain."""

    def each(batch: DataFrame, number: int) -> None:
        rows = posts_to_listings(typed_posts(batch), source_id, parsed, bundle)
        table.merge(rows, lambda old: with_ids(upsert_forum(old, rows, reviews(), now())), "ingest", number)

    return _start(posts, each, checkpoint, every)


def append_events(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Client events, validated, to an append-only folder by day."""
    rows = valid_events(events).withColumn("day", F.to_date("created_at"))
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_clicks(requests: DataFrame, listings: Callable[[], DataFrame], make: Callable[[DataFrame, DataFrame], DataFrame], clicks_path: str, events_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Click requests to the clicks and to the events; make(requests, listings) gives the valid clicks."""

    def each(batch: DataFrame, number: int) -> None:
        clicks = make(batch, listings()).persist()
        # a batch has a folder of its own: a replay overwrites it
        clicks.write.mode("overwrite").parquet(f"{clicks_path}/batch={number}")
        clicks.withColumn("event_type", F.lit("click")).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        clicks.unpersist()

    return _start(requests, each, checkpoint, every)


def day_counts(events: DataFrame) -> DataFrame:
    """Events of each day and type, as a running aggregate; no watermark, since late events count too."""
    return events.groupBy(F.window("created_at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")
