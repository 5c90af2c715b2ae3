"""Every query and the pipeline over empty tables, and over tables of nulls, blanks, long texts and repeated rows."""

import pytest

import corpus_pipeline
from tallyrill.llm import registry

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = "item_id bigint, text string"
VECTORS = "vec_id bigint, embedding array<float>, label int"
ALL = {**registry.QUERIES, "pipeline": corpus_pipeline.run}


def folder(spark, root, docs, items, vectors=()):
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(list(vectors), VECTORS).coalesce(2).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), [], [])


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    words = " ".join(f"word{i % 97}" for i in range(60_000))
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "en", None, 0), (2, words, None, "s", len(words)), (3, words, "en", "s", len(words)), (3, words, "en", "s", len(words)), (None, "x" * 300_000, "de", "t", None), (4, "\n" * 5000, "en", "s", 5000), (5, "é " * 12, "fr", "t", 24)]
    return folder(spark, tmp_path_factory.mktemp("ragged"), rows, [(None, None), (1, ""), (2, "word1 word2 word3"), (2, "word5")], [(None, None, None), (1, [0.5] * 32, None), (1, [0.5] * 32, None), (2, [None] * 32, 1), (3, [], 1)])


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ALL))
def test_ragged_rows(spark, ragged, name):
    rows = ALL[name](spark, ragged).collect()
    assert len(rows) == (2 if name.startswith("op13") else 10) or name == "pipeline"
