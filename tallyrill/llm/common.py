"""Helpers shared by the training-data operators.

Texts cross to Python as Arrow batches and are handled as UTF-8 bytes, so that
the word rules below are plain byte rules: every byte of a non-ASCII code point
is 0x80 or more and therefore part of a word under both of them.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z lower-cased, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, with every ASCII character but digits and letters turned to a space.
ALNUM = bytes(LOWER[b] if b >= 128 or 48 <= b <= 57 or 97 <= LOWER[b] <= 122 else 32 for b in range(256))
#: White space of the word rule ``[^\x20\x09-\x0D]+``; bytes.split() splits at the same bytes.
SPACE = b" \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch. The default is a number of rows, which for whole texts is too much memory in each worker,
#: as several workers live beside an executor's heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let no batch that goes to Python be larger than BATCH_BYTES, but for a single longer text; the session keeps a smaller setting."""
    now = spark.conf.get(_BATCH)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is missing (tests on one machine) a folder of this
    machine is made and set as checkpoint folder.
    """
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(root)
        return root
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyrill-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so that later stages neither redo nor lose it."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path in whichever store it lies."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove_path(spark: SparkSession, path: str) -> None:
    fs, jpath = hadoop_path(spark, path)
    fs.delete(jpath, True)


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


def commit_once(spark: SparkSession, path: str, text: str) -> None:
    """Write text under path, whole or not at all: it is written aside and renamed, which fails if the path is taken."""
    aside = f"{path.rsplit('/', 1)[0]}/.aside-{uuid.uuid4().hex}"
    fs, jaside = hadoop_path(spark, aside)
    stream = fs.create(jaside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    _, final = hadoop_path(spark, path)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jaside, final, none)
    except Exception as e:
        if fs.exists(final):
            fs.delete(jaside, False)
            raise VersionTaken(f"{path} was committed by another writer") from e
        raise


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = hadoop_path(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add (its own win), whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def keeps_own(*hidden: str):
    """For operators f(docs, ...): columns of docs with the names that f uses inside are put aside and come back as they were."""
    taken = {h.lower() for h in hidden}

    def wrap(f):
        @wraps(f)
        def run(docs: DataFrame, *args, **kwargs):
            aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
            out = f(docs.withColumnsRenamed(aside), *args, **kwargs)
            return out.withColumnsRenamed({v: k for k, v in aside.items()})

        return run

    return wrap


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if pa.types.is_string(column.type):
        return pc.cast(column, pa.binary()).to_pylist()
    if pa.types.is_large_string(column.type):
        return pc.cast(column, pa.large_binary()).to_pylist()
    return column.to_pylist()


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df and new columns, computed batch by batch; columns of the same name are replaced."""
    small_batches(df.sparkSession)
    df = without(df, [f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=names)

    return df.mapInArrow(run, schema)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            make = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
            self.up, self.down = make(_BASE), make(inverse)
        return self.up[:n], self.down[:n]


_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_POWERS = _Powers()


def mix_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, starts, ends) of the words of buffer, which ends in white space."""
    data = np.frombuffer(buffer, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[data])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))
    return mix_bits((sums[ends] - sums[starts]) * down[starts]), starts, ends


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside drops its shuffle files at its end, for plans that are not executed again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet to the shared folder; smaller than a checkpoint of many short rows."""
    path = fresh_path(df.sparkSession, label)
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are written and no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()
