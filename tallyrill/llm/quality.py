"""Quality rules with thresholds learned from the corpus.

Each text is measured; for each language and source, each measure goes into a
log-linear histogram (16 steps per power of two), a quantile sketch that is
merged by adding counts: per task, per group, and again from groups to a
language and to the corpus. A measure's fence is its upper (for two-sided ones
also lower) quartile and `spread` times its reach. The reach is the distance of
the quartiles, but no less than what the least event (one symbol, one repeated
line, two windows of words) adds to a text of the group's median size, or to
the text in question if that is shorter, since rates that are 0 in most texts
have no distance of quartiles, and a few words have any rate; nor less than
the histogram can tell apart. Quartiles and
reaches (these in logarithms) of a group are drawn to those of its language,
and these to the corpus', with the weight of `least` texts. Measuring, and joining fences to
rows, are two passes over the input: no text is shuffled or kept.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, append_columns, as_bytes, checkpointed, keeps_own, table, without

MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
LEAST = 100
SPREAD = 6.0
#: Groups whose fences may be broadcast (under 200 bytes each); beyond, the fences are joined by a salted shuffle.
BROADCAST_GROUPS = 50_000
SALTS = 64
SYMBOLS = b"#*$%&|<>"

#: Measures, with what the least event adds to them, and the size of a text that this is divided by. In thousandths;
#: word_length in hundredths; length in hundredths of powers of two of words, of which any is seen.
UPPER = {"symbol_rate": (1000, "words"), "repeat_rate": (2000 * REPEAT_WINDOW, "words"), "dup_line_rate": (1000, "lines"), "upper_rate": (1000, "letters"), "mark_rate": (1000, "words")}
BOTH = {"word_length": (100, "words"), "length": (1, None)}
SIZES = {"words": "n_words", "lines": "_n_lines", "letters": "word_chars"}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"


def repeated_words(words: list[bytes], k: int = REPEAT_WINDOW) -> int:
    """Words in k-word windows that are found twice or more, the first included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(grams)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered, until = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + k - max(i, until)
            until = i + k
    return covered


def measure(text: bytes | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks)"""
    if not text:
        return (0,) * 8
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    size = len(text)
    letters = len(text.translate(None, SPACE + _CONTINUATION))
    return (
        len(words),
        letters,
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        size - len(text.translate(None, _UPPER)),
        size - len(text.translate(None, _MARKS)),
    )


_HIDDEN = ["_n_lines", "_n_upper", "_n_marks", "_lang", "_source", "_salt", "_row_salt", *(f"_{k}" for k in {**UPPER, **BOTH}), *(f"{e}_{k}" for e in ("high", "low", "reach") for k in {**UPPER, **BOTH}), *(f"_{k}" for k in SIZES)]
_MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines", "_n_upper", "_n_marks"]


def measured(docs: DataFrame) -> DataFrame:
    fields = [T.StructField(n, T.LongType()) for n in _MEASURED]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [measure(t) for t in as_bytes(batch.column("text"))]
        return [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(fields)

    out = append_columns(docs, fields, run)
    words, letters, lines = (F.greatest(F.lit(1), F.col(c)) for c in ("n_words", "word_chars", "_n_lines"))
    rates = {
        "symbol_rate": F.col("n_symbols") * 1000,
        "repeat_rate": F.col("n_repeat_words") * 1000,
        "dup_line_rate": F.col("n_dup_lines") * 1000,
        "upper_rate": F.col("_n_upper") * 1000,
        "mark_rate": F.col("_n_marks") * 1000,
        "word_length": F.col("word_chars") * 100,
    }
    by = {"symbol_rate": words, "repeat_rate": words, "dup_line_rate": lines, "upper_rate": letters, "mark_rate": words, "word_length": words}
    out = out.withColumns({f"_{k}": F.floor(v / by[k]).cast("bigint") for k, v in rates.items()})
    out = out.withColumn("_length", F.floor(F.log(words) / F.lit(math.log(2.0)) * 100).cast("bigint"))
    out = out.withColumns({f"_{k}": F.col(c) for k, c in SIZES.items()})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bucket_of(v: Column) -> Column:
    """The sketch's bucket of a whole number >= 0: itself below 16, else 16 steps per power of two."""
    e = F.length(F.bin(v)) - 1
    return F.when(v < 16, v).otherwise((e - 3) * 16 + F.floor(v / F.pow(F.lit(2.0), e - 4)).cast("bigint") - 16).cast("int")


def value_of(b: Column) -> Column:
    """The least value in a bucket."""
    return F.when(b < 16, b.cast("double")).otherwise((b % 16 + 16) * F.pow(F.lit(2.0), F.floor(b / 16) - 1))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the rows that the base rules keep."""
    names = [*UPPER, *BOTH, *SIZES]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket_of(F.col(f"_{k}")).alias("bucket")) for k in names]))
    return rows.where(~F.col("base_failed")).select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q1, q2, q3) of sketches merged over all but keys."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    merged = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value_of(F.col("bucket"))))
    return merged.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def fences(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per (lang, source): quartiles low_<measure> and high_<measure>, and reach_<measure>, from its own sketch, its language's and the corpus'."""
    measures = {**UPPER, **BOTH}

    def wide(keys: list[str], tag: str) -> DataFrame:
        q = quartiles(sketch, keys)
        of = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c)))
        cols = [F.max("total").alias(f"{tag}_total")]
        for k, (event, size) in measures.items():
            least_reach = F.lit(float(event)) / F.greatest(F.lit(1.0), of(size, "q2")) if size else F.lit(float(event))
            cols += [of(k, "q1").alias(f"{tag}_low_{k}"), of(k, "q3").alias(f"{tag}_high_{k}"), F.greatest(of(k, "q3") - of(k, "q1"), of(k, "q3") / 16, least_reach).alias(f"{tag}_reach_{k}")]
        return q.groupBy(*keys).agg(*cols)

    source = wide(["lang", "source"], "s")
    lang = wide(["lang"], "l").withColumnRenamed("lang", "_lang")
    corpus = wide([], "c").first()  # one row
    joined = source.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumns({c: F.lit(v).cast("double") for c, v in corpus.asDict().items()})

    def drawn(name: str, scale=lambda c: c) -> Column:
        weight = F.lit(float(least))
        lang = (F.col("l_total") * scale(F.col(f"l_{name}")) + weight * scale(F.col(f"c_{name}"))) / (F.col("l_total") + weight)
        return (F.col("s_total") * scale(F.col(f"s_{name}")) + weight * lang) / (F.col("s_total") + weight)

    edges = [drawn(f"{e}_{k}").alias(f"{e}_{k}") for k in measures for e in ("low", "high")]
    return joined.select("lang", "source", *edges, *[F.exp(drawn(f"reach_{k}", F.log)).alias(f"reach_{k}") for k in measures])


@keeps_own(*_HIDDEN)
def judge_quality(docs: DataFrame, least: int = LEAST, spread: float = SPREAD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept (boolean).

    docs: text, lang, source and any other columns; columns of the seven names
    are replaced. A null or empty text has no words and fails. Null languages
    and sources are groups of their own. Rows are judged one by one, repeated
    ones alike. Without rows there are no fences and no results.
    """
    names = [*BASE, "kept"]
    docs = without(docs, names)
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    sketch = checkpointed(sketches(measured(docs.select("text", "lang", "source"))))
    limits = checkpointed(fences(sketch, least))
    groups = limits.count()
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = measured(docs)
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if groups <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(limits), on, "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, on & (F.col("_row_salt") == F.col("_salt")), "left")
    outlier = F.lit(False)
    for k, (event, size) in {**UPPER, **BOTH}.items():
        own = F.lit(float(event)) / F.greatest(F.lit(1), F.col(SIZES[size])) if size else F.lit(float(event))
        reach = F.lit(spread) * F.greatest(F.col(f"reach_{k}"), own)
        outlier = outlier | F.coalesce(F.col(f"_{k}") > F.col(f"high_{k}") + reach, F.lit(False))
        if k in BOTH:
            outlier = outlier | F.coalesce(F.col(f"_{k}") < F.col(f"low_{k}") - reach, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~outlier).select(*docs.columns, *names)


@keeps_own(*BASE, "kept", *_HIDDEN)
def keep_quality(docs: DataFrame, least: int = LEAST, spread: float = SPREAD) -> DataFrame:
    """The rows that judge_quality keeps, in the columns of docs."""
    return judge_quality(docs, least, spread).where("kept").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs).select("doc_id", *BASE, "kept")


def _oracle() -> str:
    """The same in DuckDB."""
    rates = {
        "symbol_rate": "n_symbols * 1000 // greatest(1, n_words)", "repeat_rate": "n_repeat_words * 1000 // greatest(1, n_words)", "dup_line_rate": "n_dup_lines * 1000 // greatest(1, n_lines)",
        "upper_rate": "n_upper * 1000 // greatest(1, word_chars)", "mark_rate": "n_marks * 1000 // greatest(1, n_words)", "word_length": "word_chars * 100 // greatest(1, n_words)",
        "length": f"CAST(floor(ln(greatest(1, n_words)) / {math.log(2.0)!r} * 100) AS BIGINT)",
    }
    sizes = {"words": "n_words", "lines": "n_lines", "letters": "word_chars"}
    gone = lambda c: f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))"
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CAST({v} AS BIGINT) AS v FROM r WHERE NOT base_failed" for k, v in {**{k: k for k in rates}, **sizes}.items())
    events = " ".join(f"WHEN '{k}' THEN CAST({e} AS DOUBLE)" for k, (e, _) in {**UPPER, **BOTH}.items())
    owners = " ".join(f"WHEN '{k}' THEN '{size}'" for k, (_, size) in {**UPPER, **BOTH}.items() if size)

    def quart(tag: str, keys: str) -> str:
        over = f"PARTITION BY {keys}measure"
        same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.replace(",", " ").split()) or "TRUE"
        at = lambda q: f"min(CASE WHEN upto >= ceil(total * {q}) THEN val END)"
        return f"""q{tag}0 AS (SELECT {keys}measure, max(total) AS total, {at(0.25)} AS q1, {at(0.5)} AS q2, {at(0.75)} AS q3
          FROM (SELECT {keys}measure, val, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS total FROM (SELECT {keys}measure, bucket, any_value(val) AS val, sum(n) AS n FROM h GROUP BY {keys}measure, bucket)) GROUP BY {keys}measure),
        q{tag} AS (SELECT a.*, greatest(a.q3 - a.q1, a.q3 / 16, (CASE a.measure {events} END) / greatest(CAST(1 AS DOUBLE), coalesce(b.q2, 1))) AS reach FROM q{tag}0 a LEFT JOIN q{tag}0 b ON {same} AND b.measure = (CASE a.measure {owners} END))"""

    weight = f"CAST({LEAST} AS DOUBLE)"
    drawn = lambda c, f="": f"((s.total * {f}(s.{c}) + {weight} * ((l.total * {f}(l.{c}) + {weight} * {f}(c.{c})) / (l.total + {weight}))) / (s.total + {weight}))"
    spread = f"CAST({SPREAD} AS DOUBLE)"
    tests = []
    for k, (event, size) in {**UPPER, **BOTH}.items():
        own = f"CAST({event} AS DOUBLE) / greatest(1, {sizes[size]})" if size else f"CAST({event} AS DOUBLE)"
        beyond = f"r.{k} > f.high + {spread} * greatest(f.reach, {own})" + (f" OR r.{k} < f.low - {spread} * greatest(f.reach, {own})" if k in BOTH else "")
        tests.append(f"EXISTS (SELECT 1 FROM f WHERE f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source AND f.measure = '{k}' AND ({beyond}))")
    out = " OR ".join(tests)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - {REPEAT_WINDOW - 2} AS BIGINT))) AS i FROM d WHERE len(w) >= {REPEAT_WINDOW}))),
p AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + {REPEAT_WINDOW} AS BIGINT))) AS x FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({gone('#*$%&|<>')} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, {gone('A-Z')} AS n_upper, {gone('!?')} AS n_marks FROM d LEFT JOIN p USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, {', '.join(f'{v} AS {k}' for k, v in rates.items())} FROM m),
b AS (SELECT *, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 16 + (v >> CAST(length(bin(v)) - 5 AS BIGINT)) - 16 END AS bucket FROM ({pairs})),
h AS (SELECT lang, source, measure, bucket, any_value(CASE WHEN bucket < 16 THEN CAST(bucket AS DOUBLE) ELSE (bucket % 16 + 16) * pow(CAST(2 AS DOUBLE), bucket // 16 - 1) END) AS val, count(*) AS n FROM b GROUP BY 1, 2, 3, 4),
{quart('s', 'lang, source, ')}, {quart('l', 'lang, ')}, {quart('c', '')},
f AS (SELECT s.lang, s.source, s.measure, {drawn('q3')} AS high, {drawn('q1')} AS low, exp({drawn('reach', 'ln')}) AS reach
  FROM qs s JOIN ql l ON l.lang IS NOT DISTINCT FROM s.lang AND l.measure = s.measure JOIN qc c ON c.measure = s.measure)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({out}) AS kept FROM r
"""


ORACLE = _oracle()
