"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source whose target is r times its size takes r copies of each text on
average. The texts of a source lie on a line, r apart, behind one random
offset; a text is taken once for each whole number that its stretch crosses.
The line is ordered by size, so that the words taken differ from the target by
about the largest text at most, and by a hash of the id among equal sizes.

A text's place on the line comes from counts: texts per source and size, with
a running sum over the sizes, split further by hash where one size has many.
Only texts of one source, size and split are numbered together, so a source
of any share of the rows is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, checkpointed, keeps_own, table, without

MOST = 3
SEED = 20240
#: Texts of one source and size that are numbered together.
GROUP = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(source, source_size, target, ratio) of sizes (source, size).

    weights: (source, weight), all positive; sources not in it, or all if None,
    weigh 1, 2, 3 and so on again, by code point, null last. Targets share the
    sum of all sizes by weight; none is above `most` times its source's size,
    the excess goes to the others by weight. One row per source from here on.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    if weights is not None:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("_weight"))
        ranked = ranked.join(given, F.col("source").eqNullSafe(F.col("_source")), "left")
        ranked = ranked.withColumn("weight", F.coalesce("_weight", "weight")).drop("_source", "_weight")
    # those that reach their limit at the lowest level of filling come first; the level is then known for each prefix
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("_level", level)
    full = F.col("_level") * F.col("weight") >= most * F.col("source_size")
    ranked = ranked.withColumn("_open", F.max(F.when(~full, F.col("_level"))).over(everything))
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("_open") * F.col("weight"))
    ranked = ranked.withColumn("target", target)
    return ranked.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"))


@keeps_own("_sub", "_order", "_before", "_ratio", "_subs", "_in", "_rank", "_head", "_s", "_z", "_u")
def plan_mix(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size (long), target (double) and copies (long, 0 to `most`).

    docs: doc_id, text, source and any other columns; columns of the four names
    are replaced. A null or empty text has size 0 and is taken like any other
    of its source, at no cost. Null sources are one source. Rows of one doc_id
    and size are interchangeable: which of them is taken is not defined, how
    many are is. Without rows there are no results.
    """
    base = without(docs, ["size", "source_size", "target", "copies"])
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = base.withColumn("size", word_count(F.col("text"))).withColumn("_order", order)
    slim = rows.select("source", "size", F.substring("_order", 1, 4).alias("_head"))
    heads = checkpointed(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    limits = checkpointed(targets(heads.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most))
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    places = heads.withColumn("_below", F.coalesce(F.sum("n").over(by_size), F.lit(0)))
    places = places.withColumn("_subs", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP))))).cast("int"))
    split = places.where("_subs > 1").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_subs")
    # a size with many texts: they are told apart by the first digits of their order, so that splits follow each other
    sub_of = lambda digits: F.floor(F.conv(digits, 16, 10).cast("bigint") * F.col("_subs") / 65536).cast("int")
    match = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    subs = slim.join(split, match).withColumn("_sub", sub_of(F.col("_head"))).groupBy("source", "size", "_sub").agg(F.count("*").alias("_here"))
    by_sub = Window.partitionBy("source", "size").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = subs.withColumn("_in", F.coalesce(F.sum("_here").over(by_sub), F.lit(0)))
    single = places.withColumn("_sub", F.lit(0)).withColumn("_in", F.lit(0).cast("bigint"))
    several = subs.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_sub", "_in")
    spread = places.where("_subs > 1").join(several, match).drop("_s", "_z")
    names = ["source", "size", "_below", "_subs", "_sub", "_in"]
    places = single.where("_subs = 1").select(*names).unionByName(spread.select(*names))
    limits = limits.select(F.col("source").alias("_s"), "source_size", "target", "ratio")
    places = places.join(limits, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    places = checkpointed(places.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_sub").alias("_u"), (F.col("_below") + F.col("_in")).alias("_before"), "_subs", "source_size", "target", F.col("ratio").alias("_ratio")))
    most_subs = places.agg(F.max("_subs")).first()[0] or 1
    if most_subs > 1:
        many = places.where("_subs > 1").select("_s", "_z", "_subs").distinct()
        rows = rows.join(many, match, "left").drop("_s", "_z").withColumn("_subs", F.coalesce("_subs", F.lit(1)))
        rows = rows.withColumn("_sub", sub_of(F.substring("_order", 1, 4))).drop("_subs")
    else:
        rows = rows.withColumn("_sub", F.lit(0))
    within = Window.partitionBy("source", "size", "_sub").orderBy("_order", F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn("_rank", F.row_number().over(within))
    here = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_sub") == F.col("_u"))
    rows = rows.join(places.drop("_subs"), here)
    offset = unit_hash(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00"))))
    place = F.col("_before") + F.col("_rank")
    copies = F.floor(place * F.col("_ratio") + offset) - F.floor((place - 1) * F.col("_ratio") + offset)
    copies = F.least(F.greatest(copies, F.lit(0)), F.lit(most)).cast("bigint")
    return rows.withColumn("copies", copies).select(*base.columns, "size", "source_size", "target", "copies")


@keeps_own("size", "source_size", "target", "copies", "_copy")
def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs in their own columns, each row as often as the mix takes it."""
    planned = plan_mix(docs, weights, most, seed).where("copies > 0")
    return planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """The text goes before the shuffles; its size stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned = plan_mix(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - {MOST} * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
),
t AS (
  SELECT source, source_size, CASE WHEN level * weight >= {MOST} * source_size THEN CAST({MOST} * source_size AS DOUBLE)
    ELSE (max(level) FILTER (NOT level * weight >= {MOST} * source_size) OVER ()) * weight END AS target FROM l
),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, o, doc_id) AS place FROM d),
c AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(r.source, chr(0))), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(least(greatest(floor(place * ratio + u) - floor((place - 1) * ratio + u), 0), {MOST}) AS BIGINT) AS taken FROM c
"""
