"""The corpus pipeline: documents in, the shards of a training mix out.

Each stage takes all that its predecessor kept, reread from Parquet in the
shared folder, and calls one operator of tallyrill.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrill.llm import decontaminate, mixing, quality, sharding, simhash
from tallyrill.llm.common import fresh_path, remove_path, table

#: Of five-word shingles; texts link if one of NEAR_PRINTS fingerprints differs in NEAR_BITS of 64 bits or fewer.
NEAR_BITS = 6
NEAR_PRINTS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules, or lie beyond the fences of their language and source, go."""
    return quality.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the text with the least doc_id stays."""
    return simhash.keep_one(docs, shingle=5, distance=NEAR_BITS, number=NEAR_PRINTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; texts that are mostly such go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in the number of copies that brings sources to their targets."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with the shard that holds each."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Quantile sketches, fingerprints and the suffix automaton are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
