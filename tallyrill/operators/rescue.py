"""The rescue pass: rows that lack something are read again together with their thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions import text as T
from tallyrill.functions import watches as W

from .merge import NO_COMMENT, refresh_bundles, rescue, rescue_candidates

PARSED_CHARS = 2000


def watch_in(*texts: Column) -> Column:
    """A struct brand, reference of the texts, joined, cleaned and cut."""
    return W.parse_watch(F.substring(T.clean_title(T.joined(" ", *texts)), 1, PARSED_CHARS))


def rescue_patches(candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Patches for merge.rescue() of candidates (listings) and fetched threads (thread_contexts(), post_id being the external id).

    Threads that were not fetched give no patch, so their rows stay due. An
    exact price replaces what is stored, a bucket only what is no exact price.
    Values are written if anything is new, the row's own ones included.
    """
    c = contexts.where("ok").withColumnRenamed("post_id", "external_id").drop("ok")
    rows = candidates.join(c, "external_id")
    texts = [F.col(x) for x in ("title", "description", "self_text", "op_comment")]
    body = T.joined("\n\n", F.col("self_text"), F.col("op_comment"))
    rows = rows.withColumns({
        "_w": watch_in(*texts), "_exact": T.usd_price_cents(*texts), "_range": T.flair_range(F.col("flair")), "_condition": T.condition(*texts), "_era": T.watch_type(*texts),
        "_sold": F.col("is_sold") | T.is_sold(F.col("title"), F.col("flair"), F.nullif(body, F.lit(""))),
    })
    exact_only = F.col("price_cents").isNotNull() & F.col("price_min_cents").isNull() & F.col("price_max_cents").isNull()
    priced = F.col("_exact").isNotNull() | (~exact_only & F.col("_range").isNotNull())
    found = {"brand": F.col("_w.brand"), "reference": F.col("_w.reference"), "condition": F.col("_condition"), "watch_type": F.col("_era")}
    new = (F.col("_sold") & ~F.col("is_sold")) | priced
    for f, v in found.items():
        new = new | (F.col(f).isNull() & v.isNotNull())
    said, op = T.usable_body(F.col("self_text")), T.usable_body(F.col("op_comment"))
    bucket = F.col("_exact").isNull()
    return rows.select(
        "source_id", "external_id", *[F.when(new, F.coalesce(F.col(f), v)).alias(f) for f, v in found.items()], F.col("_sold").alias("is_sold"), priced.alias("has_price"),
        F.coalesce("_exact", "_range.mid_cents").alias("price_cents"), F.when(bucket, F.col("_range.min_cents")).alias("price_min_cents"), F.when(bucket, F.col("_range.max_cents")).alias("price_max_cents"),
        said.alias("self_text"), F.coalesce(op, F.when(said.isNotNull(), F.lit("")).otherwise(F.lit(NO_COMMENT))).alias("op_comment"),
    )


def rescue_pass(listings: DataFrame, reviews: DataFrame, contexts: DataFrame, source_id: int, now: Column, hours: int = 72, limit: int = 50) -> DataFrame:
    """listings after one pass over the candidates whose threads are in contexts; bundles of the rows that were read are judged anew."""
    due = rescue_candidates(listings, source_id, now, hours, limit)
    patches = rescue_patches(due, contexts)
    out = rescue(listings, patches, now)
    read = patches.select("source_id", "external_id", F.lit(True).alias("_read"))
    marked = out.join(read, ["source_id", "external_id"], "left")
    bundle = F.when(F.coalesce(F.col("_read"), F.lit(False)), W.detect_bundle("title", "description")).otherwise(F.col("is_bundle"))
    return refresh_bundles(marked, reviews, bundle).select(*listings.columns)
