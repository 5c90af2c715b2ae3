"""Small files in the store that Spark writes to, each written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


def store(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, jpath = store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = store(spark, path)
    fs.delete(jpath, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = store(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Text under a path that is free; of several writers one succeeds, the others get VersionTaken."""
    fs, final = store(spark, path)
    folder, name = path.rsplit("/", 1)
    _, aside = store(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        # without the option to overwrite, a rename onto a path that is taken fails
        context.rename(aside, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if not fs.exists(final):
            raise
        fs.delete(aside, False)
        raise VersionTaken(path) from e
