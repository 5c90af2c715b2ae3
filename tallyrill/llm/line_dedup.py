"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

Every distinct line key of a document is one posting. Exact tables hold, for
each key, how many postings it has and the least and greatest document that
holds it; a key is shared if these differ. Cuckoo filters, one for each shard
of the key space, hold the shared keys. They answer for most postings that no
lookup is needed, so that only the few that may be shared meet the exact
table, and their entries can be deleted, so that documents can be taken out
again.

The state is a folder of immutable runs of postings (and of ids taken out) and
one folder of tables for each version; a version counts once its manifest is
renamed to its number, after its tables, which fails for all but one of several
writers. An index on an existing folder goes on from the last manifest. Shards
of the filters are split as keys grow. Postings meet the filters by shard, in
slices of bounded size, so that no filter is broadcast and no line, however
common, is in one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, as_bytes, commit_once, fresh_path, hadoop_path, keeps_own, read_text, remove_path, sha256_hex, table, without

LEAST_CHARS = 10
#: Rows without doc_id count as one document after all others.
NO_ID = (1 << 63) - 1
#: Keys of a shard when it is made; shards are split at twice as many.
SHARD_KEYS = 50_000
#: Postings that meet a shard's filter in one group.
SLICE_ROWS = 500_000
#: Shards whose numbers of slices may be broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000
SLOTS = 4
KICKS = 500


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """16 bytes for a line of at least `least` code points, else None."""
    key = line.strip(SPACE).translate(LOWER)
    n = len(key)
    if n < least or n < 4 * least and sum(b & 0xC0 != 0x80 for b in key) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Of 16-byte keys: buckets of four 16-bit fingerprints, each key in one of two buckets."""

    def __init__(self, expected: int = 0, slots: np.ndarray | None = None):
        if slots is None:
            buckets = 1 << max(4, int(expected / SLOTS / 0.8)).bit_length()
            slots = np.zeros((buckets, SLOTS), np.uint16)
        self.slots = slots
        self.mask = len(slots) - 1

    @staticmethod
    def _parts(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        prints = (halves[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        return (halves[:, 0] >> np.uint64(16)).astype(np.int64), np.where(prints == 0, 1, prints)

    def _other(self, bucket, prints):
        return (bucket ^ (prints * 0x5BD1E995)) & self.mask

    def might_hold(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        first, prints = self._parts(keys)
        first &= self.mask
        p = prints[:, None]
        return (self.slots[first] == p).any(axis=1) | (self.slots[self._other(first, prints)] == p).any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """False if the table is full; it is then to be built anew, larger, from the exact table."""
        if not keys:
            return True
        for b, p in zip(*(x.tolist() for x in self._parts(keys)), strict=True):
            b &= self.mask
            if self._put(b, p):
                continue
            b = int(self._other(b, p))
            for turn in range(KICKS):
                if self._put(b, p):
                    break
                victim = (p + turn) % SLOTS
                p, self.slots[b][victim] = int(self.slots[b][victim]), p
                b = int(self._other(b, p))
            else:
                return False
        return True

    def _put(self, bucket: int, print_: int) -> bool:
        row = self.slots[bucket]
        free = np.flatnonzero(row == 0)
        if len(free):
            row[free[0]] = print_
        return len(free) > 0

    def delete(self, keys: list[bytes]) -> None:
        """Of keys that were inserted."""
        if not keys:
            return
        for b, p in zip(*(x.tolist() for x in self._parts(keys)), strict=True):
            b &= self.mask
            for at in (b, int(self._other(b, p))):
                held = np.flatnonzero(self.slots[at] == p)
                if len(held):
                    self.slots[at][held[0]] = 0
                    break


_ROW = "key binary, doc_id bigint, h bigint"
_FILTER = "shard int, slots binary"


def doc_key() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def line_postings(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(key, doc_id, h) for each distinct key of each row; h is the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for text in as_bytes(batch.column("text")):
                found = {line_key(x, least) for x in set(text.split(b"\n"))} - {None} if text else ()
                keys += found
                counts.append(len(found))
            ids, hashes = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("doc_id", "h"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["key", "doc_id", "h"])

    return docs.select(doc_key().alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, _ROW)


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


class LineIndex:
    """Line keys of the documents inserted so far, under a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = LEAST_CHARS):
        self.spark, self.least = spark, least
        self.path = path or fresh_path(spark, "lines")
        #: Names of the runs of postings, and (name, runs there were) of the ids taken out.
        self.runs: list[str] = []
        self.gone: list[tuple[str, int]] = []
        self.version = 0
        self.shards = 1
        if path:
            self._load()

    def _load(self) -> None:
        """Take up the last version; its own `least` holds."""
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if done:
            state = json.loads(read_text(self.spark, f"{self.path}/manifests/{max(done)}.json"))
            self.runs, self.gone = state["runs"], [tuple(g) for g in state["gone"]]
            self.version, self.shards, self.least = state["version"], state["shards"], state["least"]
            self.tables = state["tables"]

    def _save(self, runs: list[str], gone: list[tuple[str, int]], shards: int, tables: str) -> None:
        version = self.version + 1
        state = {"version": version, "runs": runs, "gone": gone, "shards": shards, "least": self.least, "tables": tables}
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        fs.mkdirs(folder)
        commit_once(self.spark, f"{self.path}/manifests/{version}.json", json.dumps(state))
        self.runs, self.gone, self.shards, self.tables, self.version = runs, gone, shards, tables, version

    def _read_runs(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(*[f"{self.path}/{r}" for r in runs])

    def _postings(self, runs: list[str], gone: list[tuple[str, int]]) -> DataFrame:
        """What is left of the runs: an id taken out is gone from the runs before, but may come again in a later one."""
        if not runs:
            return self.spark.createDataFrame([], _ROW)
        if not gone:
            return self._read_runs(runs)
        taken = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{name}").withColumn("upto", F.lit(upto)) for name, upto in gone])
        taken = taken.groupBy("doc_id").agg(F.max("upto").alias("upto"))
        # runs between two removals share their fate
        cuts = sorted({0, len(runs), *(upto for _, upto in gone)})
        parts = [self._read_runs(runs[a:b]).withColumn("run", F.lit(a)) for a, b in pairwise(cuts)]
        held = reduce(DataFrame.unionByName, parts).join(taken, "doc_id", "left")
        return held.where(F.col("upto").isNull() | (F.col("run") >= F.col("upto"))).select("key", "doc_id", "h")

    def postings(self) -> DataFrame:
        return self._postings(self.runs, self.gone)

    def counts(self) -> DataFrame:
        """The exact table: key, refs, first_doc, last_doc."""
        return self.spark.read.parquet(f"{self.path}/{self.tables}/counts")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTER).parquet(f"{self.path}/{self.tables}/filters")

    def shared(self) -> DataFrame:
        return self.counts().where("first_doc <> last_doc").select("key", "first_doc")

    def insert(self, docs: DataFrame) -> None:
        """Add the lines of docs (doc_id, text)."""
        run = f"postings-{uuid.uuid4().hex}"
        line_postings(docs, self.least).write.parquet(f"{self.path}/{run}")
        new = _counted(self._read_runs([run]))
        if self.version:
            new = self.counts().unionByName(new).groupBy("key").agg(F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
        self._commit(new, [*self.runs, run], self.gone)

    def remove(self, docs: DataFrame) -> None:
        """Take out the documents whose doc_id is in docs, lines and all."""
        if not self.version:
            return
        name = f"gone-{uuid.uuid4().hex}"
        docs.select(doc_key().alias("doc_id")).distinct().write.parquet(f"{self.path}/{name}")
        gone = [*self.gone, (name, len(self.runs))]
        ids = self.spark.read.parquet(f"{self.path}/{name}")
        touched = f"{self.path}/lost-{uuid.uuid4().hex}"
        self.postings().join(ids, "doc_id", "left_semi").select("key").distinct().write.parquet(touched)
        keys = self.spark.read.parquet(touched)
        left = self._postings(self.runs, gone).join(keys, "key", "left_semi")
        self._commit(self.counts().join(keys, "key", "left_anti").unionByName(_counted(left)), self.runs, gone)
        remove_path(self.spark, touched)

    def _commit(self, counts: DataFrame, runs: list[str], gone: list[tuple[str, int]]) -> None:
        """Write the next version's tables, then its manifest."""
        tables = f"tables-{uuid.uuid4().hex}"
        counts.write.parquet(f"{self.path}/{tables}/counts")
        fresh = self.spark.read.parquet(f"{self.path}/{tables}/counts").where("first_doc <> last_doc").select("key")
        shards = self.shards
        while fresh.count() > 2 * SHARD_KEYS * shards:
            shards *= 2
        if self.version and shards == self.shards:
            before = self.shared().select("key")
            changes = fresh.join(before, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(before.join(fresh, "key", "left_anti").withColumn("add", F.lit(False)))
            filters = self._changed_filters(changes, fresh, f"{self.path}/{tables}/made")
        else:
            filters = self._built(fresh, shards)
        filters.write.parquet(f"{self.path}/{tables}/filters")
        self._save(runs, gone, shards, tables)

    def vacuum(self) -> None:
        """Delete the tables and manifests of all versions before the last; no other writer may be at work."""
        fs, folder = hadoop_path(self.spark, self.path)
        used = {self.tables, *self.runs, *(name for name, _ in self.gone), "manifests"}
        for x in fs.listStatus(folder):
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)
        for v in range(self.version - 1, 0, -1):
            _, old = hadoop_path(self.spark, f"{self.path}/manifests/{v}.json")
            if not fs.delete(old, False):
                break

    def _built(self, keys: DataFrame, shards: int) -> DataFrame:
        def build(group: pa.Table) -> pa.Table:
            held = group.column("key").to_pylist()
            size = len(held)
            while not (made := CuckooFilter(size)).insert(held):
                size *= 2
            return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "slots": pa.array([made.slots.tobytes()], pa.binary())})

        return keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, _FILTER)

    def _changed_filters(self, changes: DataFrame, keys: DataFrame, path: str) -> DataFrame:
        """Shards with changes get them by insertion and deletion; those that overflow are built anew."""

        def change(old: pa.Table, new: pa.Table) -> pa.Table:
            shard = (old if old.num_rows else new).column("shard")[0].as_py()
            rows = list(zip(new.column("key").to_pylist(), new.column("add").to_pylist(), strict=True))
            if old.num_rows:
                made = CuckooFilter(slots=np.frombuffer(old.column("slots")[0].as_py(), np.uint16).reshape(-1, SLOTS).copy())
            else:
                made = CuckooFilter(len(rows))
            made.delete([k for k, add in rows if not add])
            full = not made.insert([k for k, add in rows if add])
            return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([None if full else made.slots.tobytes()], pa.binary())})

        sharded = changes.withColumn("shard", _shard(self.shards))
        made = self.filters().groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(change, _FILTER)
        made.write.parquet(path)
        made = self.spark.read.schema(_FILTER).parquet(path)
        full = made.where("slots is null").select("shard")
        if full.isEmpty():
            return made
        again = self._built(keys.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").select("key"), self.shards)
        return made.where("slots is not null").unionByName(again)

    def _maybe_shared(self, postings: DataFrame) -> DataFrame:
        """Postings that their shard's filter does not rule out."""
        sizes = self.counts().withColumn("shard", _shard(self.shards)).groupBy("shard").agg(F.sum("refs").alias("n"))
        sizes = sizes.select("shard", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
        if self.shards <= BROADCAST_SHARDS:
            sizes = F.broadcast(sizes)
        sliced = postings.withColumn("shard", _shard(self.shards)).join(sizes, "shard").withColumn("slice", F.pmod(F.xxhash64("doc_id", "h"), F.col("slices")).cast("int")).drop("slices")
        filters = self.filters().join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "slots")

        def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
            rows = rows.select(["key", "doc_id", "h"])
            if not held.num_rows:  # no key of the shard is shared
                return rows.slice(0, 0)
            made = CuckooFilter(slots=np.frombuffer(held.column("slots")[0].as_py(), np.uint16).reshape(-1, SLOTS))
            return rows.filter(pa.array(made.might_hold(rows.column("key").to_pylist())))

        return sliced.groupBy("shard", "slice").cogroup(filters.groupBy("shard", "slice")).applyInArrow(probe, _ROW)

    def drops(self) -> DataFrame:
        """(doc_id, h, keys): the shared keys of each document text that does not hold them first."""
        found = self._maybe_shared(self.postings()).join(self.shared(), "key").where("doc_id <> first_doc")
        return found.groupBy("doc_id", "h").agg(F.collect_set("key").alias("keys"))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


_OUT = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]


@keeps_own("_doc", "_h", "_keys")
def dedup_lines(docs: DataFrame, index: LineIndex, text_too: bool = True) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (or kept_sha256 instead, if not text_too), judged by the index.

    docs: doc_id (a whole number), text and any other columns; columns of
    these names are replaced. Lines shared by several documents stay in the
    one with the least doc_id in the index, with all their repeats there. Rows
    of one doc_id are one document; rows without one count together as a
    document after all others. A null or empty text is one empty line. A row
    that the index does not hold with this text keeps all its lines.
    """
    names = ["n_lines", "n_dropped", "kept_text" if text_too else "kept_sha256"]
    base = without(docs, names)
    least = index.least
    rows = base.withColumn("_doc", doc_key()).withColumn("_h", F.xxhash64("text"))
    joined = rows.join(index.drops().withColumnsRenamed({"doc_id": "_doc", "h": "_h", "keys": "_keys"}), ["_doc", "_h"], "left")
    fields = [*_OUT[:2], T.StructField(names[2], T.StringType())]
    own = base.columns
    out_names = [*own, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for text, keys in zip(as_bytes(batch.column("text")), batch.column("_keys").to_pylist(), strict=True):
                parts = (text or b"").split(b"\n")
                stay = parts
                if keys:
                    gone = set(keys)
                    stay = [x for x in parts if line_key(x, least) not in gone]
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
                kept.append(b"\n".join(stay))
            last = pa.array(kept, pa.binary()).cast(pa.string()) if text_too else pa.array([sha256_hex(x) for x in kept])
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), last], names=out_names)

    return joined.select(*base.columns, "_keys").mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark)
    index.insert(docs)
    return dedup_lines(docs, index, text_too=False).drop("text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
),
k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT l.*, k.first_doc IS NOT NULL AND k.first_doc <> l.doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
