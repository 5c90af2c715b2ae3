"""Secret scans in DataFrame operations only.

Three patterns find secrets in known forms. Beyond them, runs of key
characters are compared under two character Markov models, of random strings
and of ordinary identifiers, by their log-likelihood ratio. The models are
trained on samples that the patterns label: values they find are random
strings, runs in texts without a find are ordinary. The samples are bounded
(SAMPLE_TEXTS); every text is scanned whole.

Spans are in code points, the end excluded. SQL functions give the matches of
a pattern (regexp_extract_all) and what lies between them (split); their
lengths, added up, are the positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, keeps_own, table, without

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]"
ASSIGN_CHARS = 8
#: Runs of these are maximal, so the least length in the pattern drops the same matches as a test afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
RUN_CHARS = 20
RUN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}+"
#: Expected number of texts in the training sample: those with finds, and those without.
SAMPLE_TEXTS = (20_000, 1_000)
#: Least mean log-likelihood ratio (nats a transition) of a secret.
THRESHOLD = 0.7
_SPANS = "array<struct<start:int,end:int,no:int>>"


def _found(matches: str, pattern: str, no: int, condition: str = "true") -> str:
    """SQL for the spans of a pattern's matches in _t. matches: SQL of an array of structs whose first field m is the match."""
    return f"""aggregate(
      arrays_zip({matches}, split(_t, r'{pattern}', -1)),
      named_struct('at', 0, 'out', cast(array() as {_SPANS})),
      (a, x) -> named_struct(
        'at', a.at + length(coalesce(x.`1`, '')) + length(coalesce(x.`0`.m, '')),
        'out', if(x.`0`.m is not null and ({condition}), concat(a.out, array(named_struct('start', a.at + length(x.`1`), 'end', a.at + length(x.`1`) + length(x.`0`.m), 'no', {no}))), a.out)),
      a -> a.out)"""


def _matches(pattern: str) -> str:
    return f"transform(regexp_extract_all(_t, r'{pattern}', 0), m -> named_struct('m', m))"


_NONE = f"cast(array() as {_SPANS})"
_ASSIGN_MATCHES = f"transform(arrays_zip(regexp_extract_all(_t, r'{ASSIGN}', 0), regexp_extract_all(_t, r'{ASSIGN}', 2)), z -> named_struct('m', z.`0`, 'v', z.`1`))"


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs with _t (the text, null as empty) and _assign, _access, _hex (spans)."""
    return docs.withColumn("_t", F.coalesce(F.col("text"), F.lit(""))).select(
        "*",
        F.expr(f"if(_t rlike r'{ASSIGN_HINT}', {_found(_ASSIGN_MATCHES, ASSIGN, 0, f'length(x.`0`.v) >= {ASSIGN_CHARS}')}, {_NONE})").alias("_assign"),
        F.expr(f"if(contains(_t, 'AKIA'), {_found(_matches(ACCESS), ACCESS, 1)}, {_NONE})").alias("_access"),
        F.expr(f"if(_t rlike r'{HEX}', {_found(_matches(HEX), HEX, 2)}, {_NONE})").alias("_hex"),
    )


def _transitions(strings: Column) -> Column:
    """The pairs of neighbouring characters of each string of an array, as numbers; an array."""
    n = len(ALPHABET)
    codes = lambda s: F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = lambda s: F.zip_with(F.slice(codes(s), 1, F.length(s) - 1), F.slice(codes(s), 2, F.length(s)), lambda a, b: a * n + b)
    return F.flatten(F.transform(F.filter(strings, lambda s: F.length(s) > 1), pairs))


def train(docs: DataFrame, sample_texts: tuple[int, int] = SAMPLE_TEXTS) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all transitions, row by row; add-one smoothed.

    Without a find the random model is uniform, as random strings are; without
    an ordinary run the ordinary one is. The result has len(ALPHABET) ** 2
    numbers, whatever the corpus.
    """
    total = docs.count()
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rate = max(sample_texts) / max(1, total)
    sample = docs.select("text").where(draw < rate)
    found = with_base_spans(sample)
    values = F.expr(
        f"concat(filter(regexp_extract_all(_t, r'{ASSIGN}', 2), v -> length(v) >= {ASSIGN_CHARS}), regexp_extract_all(_t, r'{ACCESS}', 0), regexp_extract_all(_t, r'{HEX}', 0))"
    )
    words = F.expr("regexp_extract_all(_t, r'[A-Za-z0-9+/_=.-]{4,}', 0)")
    any_found = (F.size("_assign") + F.size("_access") + F.size("_hex")) > 0
    less = draw < sample_texts[1] / max(1, total)
    pairs = found.select(any_found.alias("secret"), F.explode(F.when(any_found, _transitions(values)).when(less, _transitions(words))).alias("pair"))
    n = len(ALPHABET)
    counts = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    for r in pairs.where("pair >= 0").groupBy("secret", "pair").count().collect():  # at most 2 * n * n rows
        counts[r["secret"]][r["pair"]] += r["count"]
    out = []
    for i in range(n):
        here = {k: v[i * n : i * n + n] for k, v in counts.items()}
        sums = {k: sum(v) for k, v in here.items()}
        out += [math.log(here[True][j] / sums[True]) - math.log(here[False][j] / sums[False]) for j in range(n)]
    return out


@keeps_own("_t", "_assign", "_access", "_hex", "_runs")
def scan_secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with base_spans and model_spans: arrays of (start, end, no), no being the place in KINDS.

    docs: text and any other columns; columns of the two names are replaced.
    The model is trained on docs unless given. A null or empty text has no
    spans. Row by row: ids do not matter, repeated rows are treated alike.
    A run that overlaps a base span is not reported again.
    """
    names = ["base_spans", "model_spans"]
    base = without(docs, names)
    ratios = model if model is not None else train(base)
    n = len(ALPHABET)
    table_sql = f"cast(split('{','.join(f'{x:.6f}' for x in ratios)}', ',') as array<double>)"
    score = f"""aggregate(transform(split(x.`0`.m, ''), c -> instr('{ALPHABET}', c) - 1), named_struct('p', -1, 's', 0D),
      (a, c) -> named_struct('p', c, 's', if(a.p < 0, a.s, a.s + element_at({table_sql}, a.p * {n} + c + 1))), a -> a.s) >= {threshold} * (length(x.`0`.m) - 1)"""
    rows = with_base_spans(base).withColumn("base_spans", F.expr("array_sort(concat(_assign, _access, _hex), (l, r) -> if(l.start <> r.start, l.start - r.start, l.no - r.no))"))
    runs = F.expr(f"if(_t rlike r'{RUN}', {_found(_matches(RUN), RUN, 3, score)}, {_NONE})")
    clear = F.expr("filter(_runs, r -> not exists(base_spans, b -> b.start < r.end and r.start < b.end))")
    return rows.withColumn("_runs", runs).withColumn("model_spans", clear).select(*base.columns, *names)


def spelled(spans: str) -> Column:
    """SQL array of spans, as kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array('assign', 'access', 'hex', 'model'), s.no + 1), ':', s.start, ':', s.end)), ',')")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda no: F.expr(f"cast(size(filter(base_spans, s -> s.no = {no})) as bigint)")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(spelled("base_spans"), 256).alias("base_sha256"),
        spelled("array_sort(concat(base_spans, model_spans), (l, r) -> if(l.start <> r.start, l.start - r.start, l.no - r.no))").alias("spans"),
    )
