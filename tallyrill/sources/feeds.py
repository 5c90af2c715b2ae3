"""Sources: forum posts and threads, marketplace and catalog items, delimited product feeds.

Each reads what lies in a landing zone; paged.py fetches it over the network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrill.functions import text as T
from tallyrill.functions.scalars import fallback_id
from tallyrill.sources import schema
from tallyrill.sources.paged import land, land_url

# ---- fixed values -------------------------------------------------------------------------------------------------
LINK_KEYS = ("link", "buy_url", "product_url", "program_url", "destination_url", "url")
ID_KEYS = ("sku", "id", "program_sku", "product_id")
TITLE_KEYS = ("title", "name", "product_name", "product title")
PRICE_KEYS = ("price", "sale_price", "buy_price", "current_price", "sale price")
IMAGE_KEYS = ("image_link", "image_url", "image", "primary_image", "large image")
# -------------------------------------------------------------------------------------------------------------------


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.POSTS).json(path)


def stream_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema.POSTS).json(path)


def gallery_images(is_gallery: Column, media: Column) -> Column:
    """The urls of a gallery's pictures that are valid (or say nothing of it), links unescaped."""
    ok = F.filter(F.map_values(media), lambda m: F.coalesce(m["status"], F.lit("valid")) == "valid")
    urls = F.filter(F.transform(ok, lambda m: F.replace(m["s"]["u"], F.lit("&amp;"), F.lit("&"))), lambda u: u.isNotNull())
    return F.when(F.coalesce(is_gallery, F.lit(False)) & media.isNotNull(), urls).otherwise(F.array().cast("array<string>"))


def typed_posts(raw: DataFrame) -> DataFrame:
    """Posts in plain columns, missing flags false, with images and preview."""
    no = F.lit(False)
    first = F.get(F.col("preview.images"), F.lit(0))
    return raw.select(
        "id", "name", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("selftext", F.lit("")).alias("selftext"), "permalink", "url", "author",
        F.col("created_utc"), "link_flair_text", "removed_by_category", "thumbnail", F.coalesce("stickied", no).alias("stickied"), F.coalesce("is_self", no).alias("is_self"),
        F.replace(first["source"]["url"], F.lit("&amp;"), F.lit("&")).alias("preview_url"), gallery_images(F.col("is_gallery"), F.col("media_metadata")).alias("images"),
    )


def author_comments(children: Column, author: Column) -> Column:
    """The author's own top-level comments, a blank line between them; null where there is none."""
    mine = F.filter(children, lambda c: (c["kind"] == "t1") & (c["data"]["author"] == author) & (F.trim(F.coalesce(c["data"]["body"], F.lit(""))) != ""))
    return F.nullif(F.array_join(F.transform(mine, lambda c: F.trim(c["data"]["body"])), "\n\n"), F.lit(""))


def thread_contexts(threads: DataFrame) -> DataFrame:
    """post_id, ok, self_text, op_comment, flair of fetched threads (post_id, ok, author, selftext, link_flair_text, children); failed ones stay, marked."""
    ok = F.coalesce("ok", F.lit(False))
    return threads.select("post_id", ok.alias("ok"), F.when(ok, T.usable_body(F.col("selftext"))).alias("self_text"), F.when(ok, author_comments(F.col("children"), F.col("author"))).alias("op_comment"), F.when(ok, F.col("link_flair_text")).alias("flair"))


def posts_to_listings(posts: DataFrame, source_id: int, parsed: Column, bundle: Column, base_url: str = "") -> DataFrame:
    """Offers among typed posts as rows for the forum upsert. parsed: struct brand, reference; bundle: boolean; both over the posts' columns."""
    wts = T.is_wts(F.col("stickied"), F.col("removed_by_category"), F.col("author"), F.col("title"), F.col("selftext"), F.col("link_flair_text"))
    t, body, flair = F.col("title"), F.col("selftext"), F.col("link_flair_text")
    rows = posts.where(wts).withColumns({"_p": parsed, "_bundle": bundle, "_exact": T.usd_price_cents(t, body), "_range": T.flair_range(flair), "_condition": T.condition(t, body), "_type": T.watch_type(t, body)})
    said = lambda c: F.when(c.isNotNull(), "regex")
    bucket = F.col("_exact").isNull()
    some = F.coalesce(F.col("_p.brand"), F.col("_p.reference"), F.col("_condition"), F.col("_type"))
    return rows.select(
        F.lit(source_id).cast("bigint").alias("source_id"), F.col("id").alias("external_id"), F.substring(T.clean_title(t), 1, 512).alias("title"), F.substring(body, 1, 4000).alias("description"),
        F.col("_p.brand").alias("brand"), F.col("_p.reference").alias("reference"), F.coalesce("_exact", "_range.mid_cents").alias("price_cents"), F.when(bucket, F.col("_range.min_cents")).alias("price_min_cents"),
        F.when(bucket, F.col("_range.max_cents")).alias("price_max_cents"), F.lit("USD").alias("currency"), F.col("_condition").alias("condition"), F.col("_type").alias("watch_type"), said(some).alias("classifier_source"),
        said(F.col("_p.brand")).alias("brand_source"), said(F.col("_p.reference")).alias("reference_source"), said(F.col("_condition")).alias("condition_source"), said(F.col("_type")).alias("watch_type_source"),
        F.substring(F.concat(F.lit(base_url), F.col("permalink")), 1, 2048).alias("listing_url"), F.substring(T.image_of(F.col("preview_url"), F.col("images"), F.col("thumbnail")), 1, 2048).alias("image_url"),
        T.us_state(t).alias("region"), F.col("_bundle").alias("is_bundle"), T.is_sold(t, flair).alias("is_sold"), F.col("created_utc").alias("pos"),
    )


def market_to_listings(items: DataFrame, source_id: int, parse: Callable[[Column], Column]) -> DataFrame:
    """Marketplace items (schema.MARKET_ITEMS and pos) as rows for the overwriting upsert; those without id, url or title are left out."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    currency = F.when(F.col("price").isNotNull(), T.currency_of(F.col("price.currency"))).otherwise("USD")
    rows = items.where(there("id") & there("url") & there("title")).withColumn("_p", parse(F.concat_ws(" ", "title", F.nullif(F.col("subtitle"), F.lit("")))))
    state = F.trim(F.col("location"))
    return rows.select(
        F.lit(source_id).cast("bigint").alias("source_id"), F.col("id").alias("external_id"), F.substring("title", 1, 512).alias("title"), F.col("_p.brand").alias("brand"), F.col("_p.reference").alias("reference"),
        T.minor_units(F.col("price.amount"), currency).alias("price_cents"), currency.alias("currency"), F.substring("url", 1, 2048).alias("listing_url"), F.substring(F.get(F.col("images"), F.lit(0)), 1, 2048).alias("image_url"),
        F.when(state.rlike(r"^[A-Z]{2}\z"), state).alias("region"), "pos",
    )


def catalog_to_listings(items: DataFrame, source_id: int, parse: Callable[[Column], Column]) -> DataFrame:
    """Catalog items (schema.CATALOG_ITEMS and pos) as rows for the overwriting upsert."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = items.where(there("itemId") & there("title") & there("itemWebUrl")).withColumn("_p", parse(F.col("title")))
    image = F.coalesce(F.col("image.imageUrl"), F.get(F.col("thumbnailImages"), F.lit(0))["imageUrl"])
    return rows.select(
        F.lit(source_id).cast("bigint").alias("source_id"), F.col("itemId").alias("external_id"), F.substring("title", 1, 512).alias("title"), F.col("_p.brand").alias("brand"), F.col("_p.reference").alias("reference"),
        T.catalog_price_cents(F.col("price.value")).alias("price_cents"), F.coalesce("price.currency", F.lit("USD")).alias("currency"), T.condition_of_code(F.col("conditionId"), F.col("condition")).alias("condition"),
        F.substring("itemWebUrl", 1, 2048).alias("listing_url"), F.substring(image, 1, 2048).alias("image_url"), T.catalog_state(F.col("itemLocation.country"), F.col("itemLocation.stateOrProvince")).alias("region"), "pos",
    )


def sniff_delimiter(header: str) -> str:
    """TAB if there are as many tabs as commas or more."""
    return "\t" if header.count("\t") >= header.count(",") else ","


def normal_header(name: str) -> str:
    kept = "_".join(name.strip().lower().split())
    return "".join(c for c in kept if c.isascii() and (c.isalnum() or c == "_"))


def column_for(headers: list[str], keys: tuple[str, ...]) -> int | None:
    """The first header that is among the keys."""
    return next((i for i, h in enumerate(headers) if h in keys), None)


def read_feed(spark: SparkSession, path: str, source_id: int, parse: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows for the overwriting upsert, one row with skipped and read counts) of a product feed; fields never span lines.

    The header decides delimiter and columns; only it is read on the driver.
    Rows shorter than the header, or without link or title, are skipped.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.first()
    header = first["value"] if first else ""
    sep = sniff_delimiter(header)
    names = [normal_header(x.strip().strip('"')) for x in header.split(sep)]
    fields = ", ".join(f"_c{i} string" for i in range(len(names)))
    quote = "" if sep == "\t" else '"'
    # with its columns pruned, the parser would not see that a row is short
    reader = spark.read.option("columnPruning", False)
    raw = reader.csv(path, schema=f"{fields}, _bad string", sep=sep, quote=quote, escape='"', header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)

    def cell(keys: tuple[str, ...]) -> Column:
        i = column_for(names, keys)
        return F.lit(None).cast("string") if i is None else F.nullif(F.trim(F.col(f"_c{i}")), F.lit(""))

    link, title = cell(LINK_KEYS), cell(TITLE_KEYS)
    rows = raw.select(link.alias("link"), title.alias("title"), cell(ID_KEYS).alias("own_id"), cell(PRICE_KEYS).alias("price"), cell(IMAGE_KEYS).alias("image"), (F.col("_bad").isNotNull() & F.col(f"_c{len(names) - 1}").isNull()).alias("short"), F.monotonically_increasing_id().alias("pos"))
    good = ~F.col("short") & F.col("link").isNotNull() & F.col("title").isNotNull()
    counts = rows.agg(F.count_if(~good).alias("skipped"), F.count("*").alias("n"))
    external = F.substring(F.coalesce("own_id", fallback_id(F.col("link")), F.col("link")), 1, 191)
    kept = rows.where(good).withColumn("_p", parse(F.col("title")))
    out = kept.select(
        F.lit(source_id).cast("bigint").alias("source_id"), external.alias("external_id"), F.substring("title", 1, 512).alias("title"), F.col("_p.brand").alias("brand"), F.col("_p.reference").alias("reference"),
        T.feed_price_cents(F.col("price")).alias("price_cents"), F.lit("USD").alias("currency"), F.substring("link", 1, 2048).alias("listing_url"), F.substring("image", 1, 2048).alias("image_url"), "pos",
    )
    return out, counts


def read_feed_text(spark: SparkSession, text: str, landing: str, source_id: int, parse: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """read_feed() of a feed given as text; it is written to the file `landing` first."""
    return read_feed(spark, land(text, landing), source_id, parse)


def read_feed_url(spark: SparkSession, url: str, landing: str, source_id: int, parse: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """read_feed() of a feed behind a URL; it is fetched to the file `landing` first."""
    return read_feed(spark, land_url(url, landing), source_id, parse)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled, nulls and empty texts empty."""
    flat = df.select(*[F.col(c).cast("string").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])
    flat.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ranges of a whole-number column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def health(spark: SparkSession) -> DataFrame:
    return spark.sql("select 1 as ok")
