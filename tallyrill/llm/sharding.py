"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as they come, one immutable Parquet shard per task.
Shards whose sizes lie in one tier (a power of `fanout`) are merged once there
are `fanout` of them, into files of about the target size. Readers only see
what a manifest names. A manifest names segments, lists of shards that are
written once, so that a version costs what it changes. It is written aside and
renamed to its version number, which fails if another writer has taken that
number; so a version is there as a whole or not at all, and what a lost job
left behind is in none. The loser starts again from the winner's version:
an append is added to it, a merge too if the shards it merged are still there.
Vacuum spares what is younger than a grace period, since a writer may be about
to commit it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import VersionTaken, commit_once, fresh_path, hadoop_path, read_text, remove_path, table, without

TARGET_BYTES = 128 << 20
FANOUT = 4
LEAST_BYTES = 1 << 16
#: Shards of one segment; segments of fewer are put together when there are SEGMENTS of them.
SEGMENT_SHARDS = 10_000
SEGMENTS = 8
#: Files that no manifest names are kept so long.
GRACE_SECONDS = 24 * 3600.0
#: Shards merged by one job.
MERGE_SHARDS = 5_000
#: Shards whose names may be broadcast to number rows; beyond, they are joined by a shuffle.
BROADCAST_SHARDS = 100_000


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int

    def tier(self, fanout: int) -> int:
        return int(math.log(max(1.0, self.bytes / LEAST_BYTES), fanout))


class ShardStore:
    """Shards and manifests under a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str | None = None, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root = spark, root or fresh_path(spark, "shards")
        self.target_bytes, self.fanout = target_bytes, fanout

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def latest(self) -> int:
        """The latest version; 0 before the first commit."""
        fs, path = hadoop_path(self.spark, f"{self.root}/manifests")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _root(self, version: int) -> dict:
        return json.loads(read_text(self.spark, self._manifest_path(version))) if version else {"version": 0, "schema": None, "segments": []}

    def _segment(self, name: str) -> list[Shard]:
        return [Shard(**s) for s in json.loads(read_text(self.spark, f"{self.root}/segments/{name}"))]

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and shards of a version, by default the latest."""
        found = self._root(self.latest() if version is None else version)
        return {"version": found["version"], "schema": found["schema"], "shards": [s for name, _ in found["segments"] for s in self._segment(name)]}

    def _new_segments(self, shards: list[Shard]) -> list[tuple[str, int]]:
        fs, folder = hadoop_path(self.spark, f"{self.root}/segments")
        fs.mkdirs(folder)
        out = []
        for i in range(0, len(shards), SEGMENT_SHARDS):
            part = shards[i : i + SEGMENT_SHARDS]
            name = f"{uuid.uuid4().hex}.json"
            commit_once(self.spark, f"{self.root}/segments/{name}", json.dumps([asdict(s) for s in part]))
            out.append((name, len(part)))
        return out

    def _commit(self, base: int, added: list[Shard], schema: str, gone: frozenset[str] = frozenset()) -> int:
        """Version base + 1: base without the shards of the paths in gone, and with the added ones. Segments without a change stay as they are."""
        kept, moved = [], list(added)
        segments = self._root(base)["segments"]
        small = [name for name, n in segments if n < SEGMENT_SHARDS]
        fold = len(small) >= SEGMENTS
        for name, n in segments:
            if gone or fold and name in small:
                held = self._segment(name)
                stay = [s for s in held if s.path not in gone]
                if len(stay) < len(held) or fold and name in small:
                    moved = stay + moved
                    continue
            kept.append((name, n))
        root = {"version": base + 1, "schema": schema, "segments": [*kept, *self._new_segments(moved)]}
        fs, folder = hadoop_path(self.spark, f"{self.root}/manifests")
        fs.mkdirs(folder)
        commit_once(self.spark, self._manifest_path(base + 1), json.dumps(root))
        return base + 1

    def _write(self, df: DataFrame, rows_per_file: int = 0) -> list[Shard]:
        """df as new shards that no manifest names yet."""
        target = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(target)
        counts = {}
        there = self.spark.read.schema(df.schema).parquet(target)
        for r in there.select(there.metadataColumn("_metadata")["file_name"].alias("f")).groupBy("f").count().collect():
            counts[r["f"]] = r["count"]
        fs, path = hadoop_path(self.spark, target)
        files = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path))
        return [Shard(f"{target[len(self.root) + 1:]}/{n}", counts[n], size) for n, size in files if counts.get(n)]

    def append(self, docs: DataFrame) -> int:
        """Commit the rows of docs as small shards; returns the new version. Without rows the shards stay as they are."""
        new = self._write(docs)
        while True:
            held = self._root(self.latest())
            try:
                return self._commit(held["version"], new, held["schema"] or docs.schema.json())
            except VersionTaken:
                continue

    def _due(self, shards: list[Shard], idle: set[int]) -> list[Shard]:
        """The shards of the lowest tier that has `fanout` of them, short of the target, and is not idle."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes * 0.75 and s.tier(self.fanout) not in idle:
                tiers.setdefault(s.tier(self.fanout), []).append(s)
        due = [v for _, v in sorted(tiers.items()) if len(v) >= self.fanout]
        return due[0][:MERGE_SHARDS] if due else []

    def compact(self) -> int:
        """Merge tiers until none is due; each merge is a version. Returns the latest version."""
        idle: set[int] = set()
        while True:
            held = self.manifest()
            due = self._due(held["shards"], idle)
            if not due:
                return held["version"]
            size, rows = sum(s.bytes for s in due), sum(s.rows for s in due)
            files = max(1, round(size / self.target_bytes))
            merged = self._read(due, held["schema"]).coalesce(files)
            new = self._write(merged, max(1, math.ceil(1.3 * rows / files)))
            if len(new) >= len(due):
                # nothing was gained (compression of merged rows differs); a further round would not end
                self._discard(new)
                idle.add(due[0].tier(self.fanout))
            elif not self._replace(held, due, new):
                self._discard(new)

    def _replace(self, held: dict, due: list[Shard], new: list[Shard]) -> bool:
        """Commit new in the place of due; False if another writer has taken one of these away."""
        gone, base = frozenset(s.path for s in due), held["version"]
        while True:
            try:
                self._commit(base, new, held["schema"], gone)
                return True
            except VersionTaken:
                now = self.manifest()
                if not gone <= {s.path for s in now["shards"]}:
                    return False
                base = now["version"]

    def _discard(self, shards: list[Shard]) -> None:
        for d in {s.path.rsplit("/", 1)[0] for s in shards}:
            remove_path(self.spark, f"{self.root}/{d}")

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> None:
        """Delete shards, segments and manifests that the latest version does not need, if they are older than grace_seconds.

        A writer commits what it has written within that time, or loses it.
        """
        held = self._root(self.latest())
        named = {s.path for s in self.manifest(held["version"])["shards"]}
        before = (time.time() - grace_seconds) * 1000
        old = lambda status: status.getModificationTime() <= before
        fs, data = hadoop_path(self.spark, f"{self.root}/data")
        for run in fs.listStatus(data) if fs.exists(data) else ():
            inside = list(fs.listStatus(run.getPath()))
            used = [p for p in inside if f"data/{run.getPath().getName()}/{p.getPath().getName()}" in named]
            if not used:
                if old(run) and all(old(p) for p in inside):
                    fs.delete(run.getPath(), True)
            else:
                for p in inside:
                    if p not in used and old(p):
                        fs.delete(p.getPath(), True)
        names = {name for name, _ in held["segments"]} | {f"{held['version']:012d}.json"}
        for folder in ("segments", "manifests"):
            _, path = hadoop_path(self.spark, f"{self.root}/{folder}")
            for p in fs.listStatus(path) if fs.exists(path) else ():
                if p.getPath().getName() not in names and old(p):
                    fs.delete(p.getPath(), False)

    def _read(self, shards: list[Shard], schema: str | None) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)) if schema else T.StructType())
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self._read(held["shards"], held["schema"])

    def read_numbered(self, version: int | None = None) -> DataFrame:
        """The rows with shard (its place in the manifest, from 0), shard_rows, shard_bytes and version."""
        names = ["shard", "shard_rows", "shard_bytes", "version"]
        held = self.manifest(version)
        rows = self._read(held["shards"], held["schema"])
        own = without(rows, names)
        at = "_file"
        while at in [c.lower() for c in own.columns]:
            at = "_" + at
        if not held["shards"]:
            return own.withColumns({"shard": F.lit(0), "shard_rows": F.lit(0).cast("bigint"), "shard_bytes": F.lit(0).cast("bigint"), "version": F.lit(0)})
        listed = self.spark.createDataFrame(
            [(s.path.rsplit("/", 2)[1] + "/" + s.path.rsplit("/", 1)[1], i, s.rows, s.bytes) for i, s in enumerate(held["shards"])],
            f"{at} string, shard int, shard_rows bigint, shard_bytes bigint",
        )
        file = F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], "([^/]+/[^/]+)$", 1)
        rows = rows.select(*[F.col(f"`{c}`") for c in own.columns], file.alias(at))
        listed = F.broadcast(listed) if len(held["shards"]) <= BROADCAST_SHARDS else listed
        return rows.join(listed, at).drop(at).withColumn("version", F.lit(held["version"]))


def shard_documents(docs: DataFrame, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Append docs to a new store, compact it, and give all rows with shard, shard_rows, shard_bytes and version.

    docs: any columns; those of the four names are replaced. Values, nulls and
    repeated rows are stored as they are, and no row is lost or added. Without
    rows there are no shards and no results.
    """
    names = ["shard", "shard_rows", "shard_bytes", "version"]
    store = ShardStore(docs.sparkSession, target_bytes=target_bytes, fanout=fanout)
    store.append(without(docs, names))
    store.compact()
    store.vacuum(grace_seconds=0)  # no one else knows of this store
    return store.read_numbered()


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "shard", "shard_rows", "shard_bytes", "version")
