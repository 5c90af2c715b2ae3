"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items go into one suffix automaton over words. Every
training text streams through it; the state holds the longest suffix of what
was read that occurs in an item. A length of `window` or more means that the
last words lie inside an occurrence of item windows. Items shorter than a
window count as one window of their own length.

The automaton is broadcast, so its size is bounded: items are taken in blocks
of at most `block_words` words, and each block is one more pass over the rows
(a query set in blocks), never one larger broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, append_columns, as_bytes, checkpointed, keeps_own, table

WINDOW = 10
COVERAGE = 0.5
BLOCK_WORDS = 500_000
#: Passes that may run in one stage, each with a worker and an automaton of its own.
PASSES_PER_STAGE = 3
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


class SuffixAutomaton:
    """Of several word sequences; transitions are dictionaries keyed by word."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[bytes] = []

    def _clone(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(length)
        self.link.append(self.link[q])
        return len(self.length) - 1

    def _redirect(self, p: int, word: bytes, q: int, clone: int) -> None:
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            clone = self._clone(q, self.length[last] + 1)
            self.link[q] = clone
            self._redirect(last, word, q, clone)
            return clone
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, p = len(self.length) - 1, last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._clone(q, self.length[p] + 1)
                self.link[q] = self.link[new] = clone
                self._redirect(p, word, q, clone)
        return new

    def build(self, items: list[tuple[bytes, list[bytes]]]) -> SuffixAutomaton:
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n, k = len(self.length), self.window
        self.items = [name for name, _ in items]
        #: state of length >= window -> the ancestor or itself that has the word sequence of just `window` words
        self.at_window = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[v] >= k:
                up = self.link[v]
                self.at_window[v] = self.at_window[up] if self.length[up] >= k else v
        self.window_items: dict[int, set[int]] = {}
        self.short_here: dict[int, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(items):
            v = 0
            for m, w in enumerate(words, 1):
                v = self.next[v][w]
                if m >= k:
                    # the prefix read is the longest sequence of its class or shares its window state
                    self.window_items.setdefault(self.at_window[v], set()).add(i)
            if 0 < len(words) < k:
                self.short_here.setdefault(v, []).append((len(words), i))
        self.has_short = [False] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            self.has_short[v] = v in self.short_here or self.has_short[self.link[v]]
        return self

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (first, last) that lie in an occurrence of a window, merged, and the items concerned."""
        next_, link, length, k = self.next, self.link, self.length, self.window
        root, has_short = next_[0], self.has_short
        v = matched = 0
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(words):
            n = next_[v].get(w)
            while n is None and v:
                v = link[v]
                matched = length[v]
                n = next_[v].get(w)
            if n is None:
                matched = 0
                continue
            v = n
            matched += 1
            start = -1
            if matched >= k:
                start = i - matched + 1
                found |= self.window_items[self.at_window[v]]
            if has_short[v]:
                u = v
                while u > 0 and has_short[u]:
                    for m, item in self.short_here.get(u, ()):
                        if m <= matched:
                            found.add(item)
                            start = i - m + 1 if start < 0 else min(start, i - m + 1)
                    u = link[u]
            if start >= 0:
                while hits and start <= hits[-1][1] + 1:
                    start = min(start, hits.pop()[0])
                hits.append((start, i))
        return hits, found


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of the items, of at most block_words words each (an item alone may be longer)."""
    block: list[tuple[bytes, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator()
    for name, text in rows:
        words = words_of(text.encode() if text else None)
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield SuffixAutomaton(window).build(block)
            block, size = [], 0
        block.append(((name or "").encode(), words))
        size += len(words)
    if block:
        yield SuffixAutomaton(window).build(block)


_HITS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_PA_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS), T.StructField("items", T.ArrayType(T.StringType()))]
_CLEAN = T.StructField("clean_text", T.StringType())


def cut(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each range."""
    spans = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for first, last in hits:
        out.append(text[at : spans[first][0]])
        at = spans[last][1]
    out.append(text[at:])
    return b"".join(out)


def _scan(automaton: SuffixAutomaton | None, texts: list[bytes | None], before: tuple[list, list] | None, clean: bool) -> list[pa.Array]:
    """The columns of _FIELDS, and clean_text if clean, of texts; before: hits and items of earlier blocks."""
    counts, ranges, names, cleaned = [], [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        hits, found = automaton.scan(words) if automaton else ([], set())
        ids = {automaton.items[j].decode() for j in found}
        if before:
            hits = merge_ranges(hits + [(x["first"], x["last"]) for x in before[0][i]])
            ids |= set(before[1][i])
        counts.append(len(words))
        ranges.append([{"first": x, "last": y} for x, y in hits])
        names.append(sorted(ids))
        if clean:
            cleaned.append(cut(text, hits) if hits else text)
    out = [pa.array(counts, pa.int64()), pa.array(ranges, _PA_HITS), pa.array(names, pa.list_(pa.string()))]
    return [*out, pa.array(cleaned, pa.binary()).cast(pa.string())] if clean else out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """docs with n_words, hits (merged ranges of word positions) and items (ids as strings, sorted); with clean also clean_text, the text without its hits.

    docs: text and any other columns; columns of these names are replaced.
    Rows are judged one by one, so repeated and null ids do not matter. A null
    or empty text has no words and no hits. Items without words match nothing,
    repeated items count once, a null item_id is named by the empty string. An
    empty benchmark leaves all rows without hits.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, window, block_words)
    block = next(blocks, None)
    out, n = docs, 0
    while True:
        after = next(blocks, None)
        # plain data is broadcast: workers need not import this module
        shared = spark.sparkContext.broadcast(vars(block)) if block else None
        fields = _FIELDS + ([_CLEAN] if clean and after is None else [])

        def run(batch: pa.RecordBatch, shared=shared, first=n == 0, cleans=len(fields) > len(_FIELDS)) -> list[pa.Array]:
            automaton = None
            if shared:
                automaton = SuffixAutomaton.__new__(SuffixAutomaton)
                automaton.__dict__ = shared.value
            before = None if first else (batch.column("_hits").to_pylist(), batch.column("_items").to_pylist())
            return _scan(automaton, as_bytes(batch.column("text")), before, cleans)

        if n:
            out = out.withColumnsRenamed({"hits": "_hits", "items": "_items"})
        out = append_columns(out, fields, run).drop("_hits", "_items") if n else append_columns(out, fields, run)
        n += 1
        if after is None:
            return out
        if n % PASSES_PER_STAGE == 0:
            out = checkpointed(out)
        block = after


@keeps_own("n_words", "hits", "items", "clean_text", "_hits", "_items")
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Clean docs in their own columns: rows covered by more than `coverage` go, spans of `window` words or more are cut.

    n_chars, where docs have it, is set anew for texts that lost a span. Null
    and empty texts stay as they are.
    """
    found = find_contamination(docs, benchmark, window, block_words, clean=True)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["last"] - h["first"] + 1)
    kept = found.where((n_hit <= coverage * F.col("n_words")) | (F.size("hits") == 0))
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("hits") > 0, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: Words of a text in DuckDB, in the same normal form.
_SQL_WORDS = r"""list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"""

ORACLE = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, CAST(len(w) - least(len(w), {WINDOW}) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM grams),
spots AS (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT a.doc_id, a.i, a.k, g.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM spots) a JOIN grams g USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + k AS BIGINT))) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
