"""Vector code compression: product codes found through segment-mean lower bounds.

A vector's components become integers and the vector is cut into PARTS equal
parts; each part is replaced by the number of the nearest of ENTRIES codebook
entries. Most entries are ruled out without their distance: with both sides cut
into blocks, block means and the norms of what is left around them bound the
distance from below. One block comes first, then halves, quarters and so on;
an entry goes as soon as a bound exceeds the distance to one entry that is
already known. Entries that survive get their exact integer distance, so the
code is the same as without the bounds.

Codebooks are learned by a fixed number of rounds from the vectors with the
least ids. A round sends sums and counts of each entry, combined in each task;
only these (their number does not depend on the number of vectors) and the
codebooks themselves pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, keeps_own, small_batches, stored, table, without

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are below this, so that scaled distances over thousands of components fit in 64 bits.
LARGEST = float(1 << 19)
#: Vectors assigned at a time; a bound for all entries takes 8 bytes each.
SLICE = 4096
#: Labels whose sums may be broadcast; beyond, they are joined by a shuffle in which a label is dealt to SALTS tasks.
BROADCAST_LABELS, SALTS = 100_000, 16
#: Bounds are computed in floating point: a bound must exceed a distance by this share and amount.
SLACK, LEAST_SLACK = 1e-6, 1e-3


class _Blocks:
    """Of the columns (width, n) of vectors cut into `count` blocks: block means times the root of the block's size, and the norm of the rest."""

    def __init__(self, width: int, count: int):
        self.cuts = [width * i // count for i in range(count + 1)]

    def __call__(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        means, rest = [], np.zeros(columns.shape[1])
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            mean = columns[a:b].sum(axis=0) / (b - a)
            means.append(mean * (b - a) ** 0.5)
            for c in columns[a:b]:
                rest += np.square(c - mean)
        return np.stack(means, axis=1), np.sqrt(rest)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Codebook:
    """The entries of one part, and what their lower bounds need."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.levels = []
        count = 1
        while count < width:
            blocks = _Blocks(width, count)
            self.levels.append((blocks, *blocks(entries.T.astype(float))))
            count *= 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, the lower among equals; squared distance; exact distances taken) of each row of x."""
        if not self.levels:
            distance = np.square(x[:, None] - self.entries[None]).sum(axis=2)
            return distance.argmin(axis=1), distance.min(axis=1), distance.size
        blocks, means, norms = self.levels[0]
        columns = x.T.astype(float)
        mean, norm = blocks(columns)
        bound = np.square(mean - means[:, 0]) + np.square(norm[:, None] - norms)
        known = _distance(x, self.entries[bound.argmin(axis=1)])
        limit = known * (1 + SLACK) + LEAST_SLACK
        row, entry = np.nonzero(bound <= limit[:, None])
        for blocks, means, norms in self.levels[1:]:
            mean, norm = blocks(columns)
            bound = np.square(norm[row] - norms[entry])
            for b in range(means.shape[1]):
                bound += np.square(mean[row, b] - means[entry, b])
            # the entry of the least bound may be nearer than the one known
            begin = np.searchsorted(row, np.arange(len(x)))
            least = np.flatnonzero(bound == np.minimum.reduceat(bound, begin)[row])
            known = np.full(len(x), np.iinfo(np.int64).max)
            np.minimum.at(known, row[least], _distance(x[row[least]], self.entries[entry[least]]))
            limit = np.minimum(limit, known * (1 + SLACK) + LEAST_SLACK)
            stay = bound <= limit[row]
            row, entry = row[stay], entry[stay]
        distance = _distance(x[row], self.entries[entry])
        begin = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(distance, begin)
        hit = np.flatnonzero(distance == least[row])
        _, first = np.unique(row[hit], return_index=True)
        return entry[hit[first]], least, len(row)


def quantize(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors with _ints, floor(scale * component); rows whose embedding is null, or holds a null, non-finite or too large component, go."""
    fine = F.expr(f"embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) >= {LARGEST}D)")
    return vectors.where(fine).withColumn("_ints", F.expr(f"transform(embedding, x -> floor(double(x) * {scale}D))"))


def _matrix(column: pa.Array, parts: int, width: int, dims: int) -> np.ndarray:
    """Lists of dims integers as (rows, parts, width), with zeros behind them."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)
    if parts * width > dims:
        flat = np.pad(flat, ((0, 0), (0, parts * width - dims)))
    return flat.reshape(len(column), parts, width)


def _assign(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    codes, errors = np.zeros(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), SLICE):
        for p, book in enumerate(books):
            entry, distance, _ = book.nearest(x[a : a + SLICE, p])
            codes[a : a + SLICE, p] = entry
            errors[a : a + SLICE] += distance
    return codes, errors


def train_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, at most `entries`, width) of rows (vec_id, _ints), all of one length that is a multiple of parts or filled up with zeros."""
    spark = rows.sparkSession
    first = [r["_ints"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "_ints").select("_ints").limit(entries).collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0])
    width = -(-dims // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    start[:, :dims] = first
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    small_batches(spark)
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            made = [Codebook(c) for c in now]
            total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), parts, width, dims)
                codes, _ = _assign(x, made)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=now.shape[1])
            part, entry = np.nonzero(count)
            each = np.concatenate((count[part, entry][:, None], total[part, entry]), axis=1)
            place = np.broadcast_to((part * now.shape[1] + entry)[:, None] * (width + 1) + np.arange(width + 1), each.shape)
            yield pa.RecordBatch.from_arrays([pa.array(place.ravel()), pa.array(each.ravel())], names=["place", "total"])

        found = rows.select("_ints").mapInArrow(sums, "place bigint, total bigint").groupBy("place").agg(F.sum("total").alias("total")).collect()
        cells = np.zeros(parts * now.shape[1] * (width + 1), np.int64)
        for r in found:
            cells[r["place"]] = r["total"]
        cells = cells.reshape(parts, now.shape[1], width + 1)
        count = cells[:, :, :1]
        books = np.where(count > 0, cells[:, :, 1:] // np.maximum(count, 1), now)
    return books


def encode_vectors(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (with _ints) and code (array of entries, in the order of parts) and error (squared distances summed over parts)."""
    parts, width = books.shape[0], books.shape[2]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column("_ints")
        dims = len(column[0]) if len(column) else 0
        codes, errors = _assign(_matrix(column, parts, width, dims), [Codebook(c) for c in books])
        return [pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array(errors)]

    return append_columns(rows, [T.StructField("code", T.ArrayType(T.LongType())), T.StructField("error", T.LongType())], make)


def of_one_length(rows: DataFrame) -> DataFrame:
    """rows without those whose _ints is of another length than that of the row with the least vec_id."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_ints").select(F.size("_ints")).first()
    return rows.where(F.size("_ints") == first[0]) if first else rows


@keeps_own("_ints")
def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, books: np.ndarray | None = None) -> DataFrame:
    """vectors with code (array of parts long) and error (long), and codebooks_sha256.

    vectors: vec_id, embedding (array of float or double) and any other
    columns; columns of these names are replaced. Rows go whose embedding is
    null or holds a null, a component that is not finite, or one of LARGEST or
    more (its error would not fit), and rows of another length than that of the
    kept row with the least vec_id (null vec_ids last, then by components). A
    length that is no multiple of `parts` is filled up with zeros; vectors
    without components get codes and an error of 0. Repeated rows give repeated
    rows; with fewer than `entries` kept rows the codebooks are shorter.
    books: codebooks that are known already (train_codebooks).
    """
    rows = of_one_length(quantize(without(vectors, ["code", "error", "codebooks_sha256"]), scale))
    books = train_codebooks(rows, parts, entries, rounds) if books is None else books
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return encode_vectors(rows, books).drop("_ints").withColumn("codebooks_sha256", F.lit(digest))


def decode(code: list[int], books: np.ndarray) -> np.ndarray:
    """The vector of integers that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(code)])


def with_label_sums(rows: DataFrame, name: str = "label_error") -> DataFrame:
    """rows (label, error and others) and the sum of error over equal labels, nulls together."""
    sums = rows.groupBy("label").agg(F.sum("error").alias(name))
    sums = stored(sums.select(F.col("label").alias("_label"), name), "label-sums")
    if sums.count() <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        every = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        every = every.withColumnRenamed("_salt", "_salt2")
        joined = salted.join(every, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_salt2"))).drop("_salt", "_salt2")
    return joined.drop("_label")


def query(spark, sf_dir: str) -> DataFrame:
    coded = compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("embedding")
    summed = with_label_sums(stored(coded, "vector-codes"))
    return summed.select("vec_id", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error", "label_error", "codebooks_sha256")


def _round(n: int) -> str:
    """Assignment to the codebooks of round n - 1, and those of round n."""
    return f"""
a{n} AS (SELECT q.vec_id, q.part, min(struct_pack(d := list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := c.entry)) AS best
    FROM q JOIN c{n - 1} AS c ON q.part = c.part GROUP BY q.vec_id, q.part),
s{n} AS (SELECT part, best.entry AS entry, unnest(range(1, CAST(len(x) + 1 AS BIGINT))) AS i, unnest(x) AS v FROM a{n} JOIN q USING (vec_id, part)),
m{n} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (SELECT part, entry, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM s{n} GROUP BY part, entry, i) GROUP BY part, entry),
c{n} AS (SELECT part, entry, coalesce(m{n}.x, c{n - 1}.x) AS x FROM c{n - 1} LEFT JOIN m{n} USING (part, entry)),"""


ORACLE = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, part, e[part * (len(e) // {PARTS}) + 1:(part + 1) * (len(e) // {PARTS})] AS x FROM v, range({PARTS}) AS t(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),{"".join(_round(n) for n in range(1, ROUNDS + 1))}
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
f AS (SELECT q.vec_id, q.part, min(struct_pack(d := list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := c.entry)) AS best
    FROM q JOIN c{ROUNDS} AS c ON q.part = c.part GROUP BY q.vec_id, q.part),
r AS (SELECT vec_id, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), b
"""
