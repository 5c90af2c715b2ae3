"""Stored tables that are merged bucket by bucket.

A row lies in the bucket of its key's hash. A merge reads and rewrites only the
buckets that its incoming rows touch: their new files go beside the old ones,
and then a manifest (version, the folder of each bucket, the last batch of each
writer) is committed under the next number. A number can be taken once. The
loser takes up the newer manifest: if none of its buckets changed, it only
commits again; otherwise it merges again. Readers hold on to the version they
began with, until vacuum() deletes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commit import VersionTaken, names, put_new, read_text, remove, store

BUCKETS = 64
MOST_TRIES = 20


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    #: Bucket number to the folder with its rows, below the table's path.
    buckets: dict[int, str] = field(default_factory=dict)
    #: Writer to the number of its last batch, and what it counted.
    batches: dict[str, dict] = field(default_factory=dict)
    at: float = 0.0

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "batches": self.batches, "at": self.at})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {int(b): f for b, f in d["buckets"].items()}, d["batches"], d["at"])


@dataclass(frozen=True)
class Merged:
    """What a merge did; if its batch was there before, nothing now, and the counts are those of then."""

    version: int
    buckets: int
    counts: dict[str, int]
    again: bool = False


class BucketTable:
    """Rows of a schema under a path, in `buckets` buckets of the key columns; the number of buckets is fixed when the first rows are written."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    # ---- versions ---------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in names(self.spark, f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        at = max(self.versions(), default=0) if version is None else version
        return Manifest.of(read_text(self.spark, self._name(at))) if at else Manifest()

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:012d}.json"

    def version(self) -> int:
        return max(self.versions(), default=0)

    # ---- reads ------------------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one."""
        return self._rows(self.manifest(version), None)

    def _rows(self, manifest: Manifest, only: set[int] | None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in sorted(manifest.buckets.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The stored rows of keys, from their buckets only."""
        return self._rows(self.manifest(), self._touched(keys)).join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def _touched(self, rows: DataFrame) -> set[int]:
        """The buckets of rows: a number each, `buckets` at most."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    # ---- writes -----------------------------------------------------------------------------------------------------

    def merge(self, incoming: DataFrame, make: Callable[[DataFrame], DataFrame], writer: str | None = None, batch: int | None = None, counts: dict[str, int] | None = None) -> Merged:
        """make(the stored rows of the touched buckets) becomes their rows.

        incoming holds the keys of all rows that make() changes or adds; other
        rows of the buckets must come back as they were. With writer and batch,
        a batch of the writer that is not above its last one changes nothing.
        counts: numbers to be kept with the batch, committed together with it.
        """
        return self._commit(lambda: self._touched(incoming), make, writer, batch, counts)

    def replace(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Merged:
        """rows become the whole table, in one version."""
        return self._commit(lambda: set(range(self.buckets)), lambda _old: rows, writer, batch, None)

    def done(self, writer: str, batch: int) -> Merged | None:
        """What a batch of a writer did, if it is committed."""
        now = self.manifest()
        last = now.batches.get(writer)
        if last and last["batch"] >= batch:
            return Merged(now.version, 0, last["counts"] if last["batch"] == batch else {}, again=True)
        return None

    def _commit(self, touches: Callable[[], set[int]], make: Callable[[DataFrame], DataFrame], writer: str | None, batch: int | None, counts: dict[str, int] | None) -> Merged:
        touched: set[int] | None = None
        tried: tuple[Manifest, dict[int, str]] | None = None
        for _ in range(MOST_TRIES):
            before = self.done(writer or "", batch) if batch is not None else None
            if before:
                self._forget(tried)
                return before
            now = self.manifest()
            if touched is None:
                touched = touches()
            if tried is None or any(tried[0].buckets.get(b) != now.buckets.get(b) for b in touched):
                self._forget(tried)
                tried = (now, self._write(make(self._rows(now, touched)), touched))
            rest = {b: f for b, f in now.buckets.items() if b not in touched}
            batches = now.batches if batch is None else now.batches | {writer or "": {"batch": batch, "counts": counts or {}}}
            try:
                put_new(self.spark, self._name(now.version + 1), Manifest(now.version + 1, rest | tried[1], batches, time.time()).text())
            except VersionTaken:
                continue
            return Merged(now.version + 1, len(touched), counts or {})
        self._forget(tried)
        raise RuntimeError(f"no version was free in {MOST_TRIES} tries")

    def _write(self, rows: DataFrame, touched: set[int]) -> dict[int, str]:
        if not touched:
            return {}
        folder = f"data/{uuid.uuid4().hex}"
        # a bucket is one task's file
        rows.withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {int(n[8:]) for n in names(self.spark, f"{self.path}/{folder}") if n.startswith("_bucket=")}
        if not there <= touched:
            remove(self.spark, f"{self.path}/{folder}")
            raise ValueError("make() gave rows of buckets that incoming does not touch")
        return {b: f"{folder}/_bucket={b}" for b in there}

    def _forget(self, tried: tuple | None) -> None:
        """Files that were written and never committed."""
        if tried:
            for folder in {f.rsplit("/", 1)[0] for f in tried[1].values()}:
                remove(self.spark, f"{self.path}/{folder}")

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Delete all but the last `keep` versions, and files that none of these names, if they are that many seconds old; the number of deleted folders."""
        versions, limit = sorted(self.versions()), time.time() - older_than
        kept = [self.manifest(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            if self.manifest(v).at <= limit:
                remove(self.spark, self._name(v))
            else:
                kept.append(self.manifest(v))
        named = {f.rsplit("/", 1)[0] for m in kept for f in m.buckets.values()}
        used = {f for m in kept for f in m.buckets.values()}
        fs_names = [f"data/{n}" for n in names(self.spark, f"{self.path}/data")]
        gone = 0
        for folder in fs_names:
            if self._modified(folder) > limit:
                continue
            if folder not in named:
                remove(self.spark, f"{self.path}/{folder}")
                gone += 1
                continue
            for n in names(self.spark, f"{self.path}/{folder}"):
                if n.startswith("_bucket=") and f"{folder}/{n}" not in used:
                    remove(self.spark, f"{self.path}/{folder}/{n}")
                    gone += 1
        return gone

    def _modified(self, folder: str) -> float:
        fs, path = store(self.spark, f"{self.path}/{folder}")
        return fs.getFileStatus(path).getModificationTime() / 1000

