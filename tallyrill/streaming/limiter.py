"""Blocking of addresses that fail too often: a state machine for each address, on a stream or over a table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# ---- fixed values -------------------------------------------------------------------------------------------------
WINDOW_MS, BLOCK_MS, MOST_FAILURES = 10 * 60 * 1000, 30 * 60 * 1000, 8
# -------------------------------------------------------------------------------------------------------------------
OUT = "ip string, ms bigint, outcome string, retry_after bigint"


@dataclass
class Bucket:
    count: int = 0
    reset_at: int = -1
    blocked_until: int = 0

    def step(self, ms: int, success: bool) -> tuple[str, int]:
        """(outcome, seconds to wait) of an attempt; a success clears all, attempts while blocked change nothing."""
        if ms < self.blocked_until:
            return "blocked", max(1, -(-(self.blocked_until - ms) // 1000))
        if success:
            self.count, self.reset_at, self.blocked_until = 0, -1, 0
            return "ok", 0
        if ms > self.reset_at:
            self.count, self.reset_at, self.blocked_until = 1, ms + WINDOW_MS, 0
        else:
            self.count += 1
        if self.count < MOST_FAILURES:
            return "denied", 0
        self.count, self.reset_at, self.blocked_until = 0, ms + WINDOW_MS, ms + BLOCK_MS
        return "blocked", BLOCK_MS // 1000


def decide(attempts: DataFrame) -> DataFrame:
    """Outcomes of attempts (ip, ms, success), in order of ms within an address; among equal times failures come first.

    Sorted partitions are read through once with one state, so no address is
    held in memory, however many attempts it has.
    """
    n = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = attempts.select("ip", "ms", "success").repartition(n, "ip").sortWithinPartitions("ip", "ms", "success")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, bucket = None, Bucket()
        for batch in batches:
            rows = []
            for ip, ms, success in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ip != who:
                    who, bucket = ip, Bucket()
                rows.append((ip, ms, *bucket.step(ms, success)))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["ip", "ms", "outcome", "retry_after"])

    return ordered.mapInArrow(run, OUT)


class LimiterProcessor(StatefulProcessor):
    """The same on a stream; the state of an address expires once neither window nor block can matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "count int, reset_at bigint, blocked_until bigint", WINDOW_MS + BLOCK_MS)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        bucket = Bucket(*self.state.get()) if self.state.exists() else Bucket()
        frame = pd.concat(list(rows)).sort_values(["ms", "success"])
        out = [(key[0], ms, *bucket.step(ms, success)) for ms, success in zip(frame["ms"].tolist(), frame["success"].tolist(), strict=True)]
        if bucket == Bucket():
            self.state.clear()
        else:
            self.state.update((bucket.count, bucket.reset_at, bucket.blocked_until))
        yield pd.DataFrame(out, columns=["ip", "ms", "outcome", "retry_after"])

    def close(self) -> None:
        pass


def decide_stream(attempts: DataFrame) -> DataFrame:
    """decide() on a stream; needs the RocksDB state store."""
    return attempts.groupBy("ip").transformWithStateInPandas(LimiterProcessor(), OUT, "Append", "ProcessingTime")
