"""Labels from a language model: the text it is asked about, and what counts of its answer. The call itself is injected."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.sources.schema import CONDITIONS, WATCH_TYPES

from .text import joined

MOST_CHARS = 4000


def prompt_text(title: Column, body: Column, comment: Column) -> Column:
    """The texts that are there, a blank line between them, cut to what is sent; null if blank."""
    t = F.substring(joined("\n\n", title, body, comment), 1, MOST_CHARS)
    return F.when(F.trim(t) != "", t)


def answer(text: Column) -> Column:
    """A struct condition, watch_type, confidence of a JSON answer: unknown labels are null, confidence is 0 if it is no number and within 0 and 1; null if it is no JSON object."""
    v = F.try_parse_json(text)
    said = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    condition, era = said("condition"), F.coalesce(said("watch_type"), said("watchType"))
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant")) != "STRING", F.try_variant_get(v, "$.confidence", "double"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
    whole = F.struct(F.when(condition.isin(*CONDITIONS), condition).alias("condition"), F.when(era.isin(*WATCH_TYPES), era).alias("watch_type"), confidence.alias("confidence"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), whole)


def classify(rows: DataFrame, ask: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """rows (title, description, op_comment) with condition, watch_type and confidence; ask(texts) gives JSON answers, None where a call failed. Nothing is asked about blank texts."""

    @F.pandas_udf(T.StringType())
    def asked(texts: pd.Series) -> pd.Series:
        there = texts[texts.notna()]
        return pd.Series(ask(list(there)), index=there.index, dtype="object").reindex(texts.index)

    own = [c for c in rows.columns if c not in ("condition", "watch_type", "confidence")]
    text = prompt_text(F.col("title"), F.col("description"), F.col("op_comment"))
    got = rows.select(*own, answer(asked(text)).alias("_a"))
    return got.select(*own, "_a.condition", "_a.watch_type", "_a.confidence")
