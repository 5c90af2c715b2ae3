"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles. Equal fingerprints are one class from the start. To link classes at
`distance` or fewer differing bits, the 64 bits are split into more blocks
than that: two close fingerprints agree in all but `distance` blocks, so they
meet under the key of some choice of equal blocks. The number of blocks
follows from the number of classes, so that a bucket of unrelated fingerprints
stays about constant. Within a bucket Hamming distances are verified, and only
the edges of a spanning forest leave it, never all pairs. Buckets beyond
CHUNK classes are split into pairs of chunks, each a unit of its own.

Texts at a Jaccard similarity of 0.8 differ in 7 to 8 of 64 bits on average, so
one fingerprint finds less than half of them at 6 bits. Several fingerprints of
a text, from independent mixes of the same hashes, may be taken; texts are then
linked if any of them are within `distance`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append_columns, as_bytes, checkpointed, keeps_own, mix_bits, table
from .components import components

SHINGLE = 5
DISTANCE = 4
#: Classes of one bucket compared in one unit of work.
CHUNK = 8192
#: What a row of a bucket costs (shuffled, sorted, passed on), in comparisons of two fingerprints.
ROW_COST = 3000.0
#: Hot buckets that may be broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
#: Tasks among which the classes of one component are dealt.
SALTS = 16
_SLICE = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit majority fingerprint, as a signed long; of no words: 0."""
    return fingerprints(text, shingle, 1)[0]


def fingerprints(text: bytes | None, shingle: int, number: int) -> list[int]:
    """That fingerprint, and those of number - 1 mixes of the shingles' hashes."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return [0] * number
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros((number, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _SLICE):
        part = range(i, min(n, i + _SLICE))
        h = np.fromiter((digest(joined[starts[j] : stops[j]], 42) for j in part), np.uint64, len(part))
        for k in range(number):
            mixed = h if not k else mix_bits(mix_bits((h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)))
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64).tolist()


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, number: int = 1) -> DataFrame:
    """docs with fingerprint_bits (long; an array of longs if number is above 1)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fingerprints(t, shingle, number) for t in as_bytes(batch.column("text"))]
        return [pa.array([f[0] for f in found], pa.int64()) if number == 1 else pa.array(found, pa.list_(pa.int64()))]

    return append_columns(docs, [T.StructField("fingerprint_bits", T.LongType() if number == 1 else T.ArrayType(T.LongType()))], make)


def block_masks(n_classes: int, distance: int = DISTANCE) -> list[int]:
    """Masks (as signed longs) of every choice of blocks that may be the equal ones.

    With b blocks of 64 / b bits, b - distance are equal. More blocks make
    keys longer, so buckets smaller, but rows more; b is what costs least for
    so many classes. Any b finds the same links.
    """

    def plan(b: int) -> tuple[float, list[int]]:
        cuts = [64 * i // b for i in range(b + 1)]
        bits = sum(sorted(cuts[i + 1] - cuts[i] for i in range(b))[: b - distance])
        return comb(b, distance) * (ROW_COST + n_classes / 2.0**bits / 2), cuts

    cuts = min(plan(b) for b in range(distance + 1, 17))[1]
    blocks = [((1 << (y - x)) - 1) << x for x, y in pairwise(cuts)]
    masks = [sum(c) for c in combinations(blocks, len(blocks) - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges between places in values that connect just what all pairs at `distance` or less connect; fewer than values."""
    n = len(values)
    root = np.arange(n)
    edges = []
    for s in range(0, n, 64):
        e = min(n, s + 64)
        i, j = np.nonzero(np.bitwise_count(values[s:e, None] ^ values[None, :e]) <= distance)
        i += s
        before = j < i
        i, j = i[before], j[before]
        if not len(i):
            continue
        bounds = np.flatnonzero(np.diff(i, prepend=-1))
        for at, to in zip(bounds.tolist(), [*bounds[1:].tolist(), len(i)], strict=True):
            me = int(i[at])
            for r in np.unique(root[j[at:to]]).tolist():
                if r != root[me]:
                    edges.append((me, r))
                    root[: me + 1][root[: me + 1] == r] = root[me]
    return edges


def _bucket_edges(distance: int):
    """Over rows (unit, no, fp), sorted by unit: the forest edges of each unit, with its no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # of the unit not yet ended

        def edges(rows: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            found = [np.zeros((0, 3), np.int64)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    values = np.unique(rows[2, a:b])
                    found.append(np.array([(rows[1, a], values[i], values[j]) for i, j in forest(values.view(np.uint64), distance)], np.int64).reshape(-1, 3))
            e = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0].astype(np.int32)), pa.array(e[:, 1]), pa.array(e[:, 2])], names=["no", "u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            bounds = np.concatenate(([0], np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1))
            held = rows[:, bounds[-1] :].copy()
            yield edges(rows, bounds)
        if held is not None:
            yield edges(held, np.array([0, held.shape[1]]))

    return run


def link_fingerprints(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp, long) that connect all those within `distance` bits."""
    return link_numbered(classes.select(F.lit(0).alias("no"), "fp"), distance).select("u", "v")


def link_numbered(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (no, u, v) between distinct fingerprints (no: which of a text's, fp) that connect all those of one number within `distance` bits."""
    spark = classes.sparkSession
    masks = block_masks(classes.groupBy("no").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], distance)
    keyed = classes.select(
        "no", "fp", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask_no", "mask")
    ).select(F.xxhash64("no", "mask_no", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "no", "fp")
    sizes = checkpointed(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
    hot = sizes.count()
    if hot:
        sizes = sizes.select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        keyed = keyed.join(F.broadcast(sizes) if hot <= BROADCAST_BUCKETS else sizes, "bucket", "left")
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        keyed = keyed.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("mine", chunk)
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        keyed = keyed.select(F.when(F.col("chunks") > 1, F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("bucket")).alias("unit"), "no", "fp")
    else:
        keyed = keyed.withColumnRenamed("bucket", "unit")
    ordered = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(_bucket_edges(distance), "no int, u bigint, v bigint")


def _class_links(classes: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) between the nodes of classes (node, fps): those that share a fingerprint, or have close ones."""
    each = checkpointed(classes.select("node", F.posexplode("fps").alias("no", "fp")))
    first = checkpointed(each.groupBy("no", "fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    shared = each.join(first.where("n > 1"), ["no", "fp"]).where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    close = checkpointed(link_numbered(first.select("no", "fp"), distance).distinct())
    named = lambda c: first.select("no", F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    close = close.join(named("u"), ["no", "u"]).join(named("v"), ["no", "v"])
    return shared.unionByName(close.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, number: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint_bits (an array if number is above 1), component_id.

    docs: doc_id (a whole number) and text. component_id is the least doc_id
    that links of `distance` or fewer differing bits in one of `number`
    fingerprints reach, itself included. A null or empty text has fingerprint 0
    and links like any other; a text of fewer words than a shingle is one
    shingle. A row without doc_id links too, but names no component; it is null
    where no row of it has a doc_id. Repeated rows give repeated rows.
    """
    prints = checkpointed(with_fingerprints(docs.select(F.col("doc_id").cast("bigint"), "text"), shingle, number).select("doc_id", F.col("fingerprint_bits").alias("fps")))
    node = F.col("fps") if number == 1 else F.xxhash64("fps")
    classes = checkpointed(prints.groupBy("fps").agg(F.min("doc_id").alias("first_id")).withColumn("node", node))
    links = link_fingerprints(classes.select(F.col("node").alias("fp")), distance) if number == 1 else _class_links(classes, distance)
    labels = components(links)
    joined = checkpointed(classes.join(labels, "node", "left"))
    # classes of one large component are dealt to SALTS tasks
    linked = joined.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = joined.where("root is null").select("fps", F.col("first_id").alias("component_id"))
    named = linked.join(least, ["root", "salt"]).select("fps", "component_id").unionByName(alone)
    return prints.join(named, "fps").select("doc_id", F.col("fps").alias("fingerprint_bits"), "component_id")


@keeps_own("fingerprint_bits", "component_id", "_pick", "_n", "_row")
def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, number: int = 1) -> DataFrame:
    """docs, but of each group of near-duplicates only the row with the least doc_id.

    Of rows that share this doc_id one stays: that with the least text hash,
    and among these the one with the least hash of the row. Groups in which no
    row has a doc_id are kept whole, since nothing names the row to keep.
    """
    found = near_duplicates(docs, shingle, distance, number)
    stay = found.where("component_id = doc_id").select("doc_id").distinct()
    one = docs.join(stay, "doc_id", "left_semi")
    many = one.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    many = checkpointed(many)
    if not many.isEmpty():
        plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        twice = one.join(many, "doc_id", "left_semi").withColumn("_pick", F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c in plain])))
        rest = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
        picked = twice.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "_pick").alias("_row")).select("doc_id", "_row.*")
        one = one.join(many, "doc_id", "left_anti").unionByName(picked)
    nameless = docs.where("doc_id is null")
    if not nameless.isEmpty():
        alone = found.where("component_id is null").select("fingerprint_bits").distinct()
        kept = with_fingerprints(nameless, shingle, number).join(alone, "fingerprint_bits", "left_semi")
        one = one.unionByName(kept.select(*docs.columns))
    return one.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")
