"""Periodic runs of words, by matching aligned blocks.

A run is a stretch of words with smallest period q that is LEAST words long or
more, has at least two periods, and cannot be made longer on either side. The
start of a run holds, for some power of two B, a whole block of B words that is
aligned to B in the document, and the run holds the same words again q further
on; which B serves a period depends on the period alone. So for each B the
aligned blocks of a document are keys (sequences of word numbers) of an
Aho-Corasick automaton that searches the whole document, and each occurrence at
a distance that fits B is a seed: it is extended word by word, exactly, in both
directions. Blocks that hold a pair of words found once in the document, or a
half that was not found again, cannot occur again and are no keys.

A stretch is extended once for each distance; seeds inside it, and seeds inside
a run whose period divides their distance, are passed over.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, small_batches, table, without

LEAST = 12


def scales(n: int, least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(block size, ranges of periods that it serves), for documents of n words.

    The first max(least, 2 * q) - q words of a run come again q further on, so
    a block of B words serves if 2 * B - 1 of them are that many at most.
    """
    sizes: dict[int, list[tuple[int, int]]] = {}
    for q in range(1, least // 2 + 1):
        sizes.setdefault(1 << (least - q + 1).bit_length() - 2, []).append((q, q))
    q = least // 2 + 1
    while 2 * q <= n:
        size = 1 << (q + 1).bit_length() - 2
        sizes.setdefault(size, []).append((q, 4 * size - 2))
        q = 4 * size - 1
    return iter(sorted(sizes.items()))


class _Known:
    """Maximal runs by period: which stretches lie inside one?"""

    def __init__(self):
        self.by: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, stop: int, period: int) -> bool:
        starts, stops = self.by.setdefault(period, ([], []))
        i = bisect_right(starts, start)
        if i and starts[i - 1] == start:
            return False
        starts.insert(i, start)
        stops.insert(i, stop)
        return True

    def outside(self, a: np.ndarray, width: int, fits: Callable[[int], bool]) -> np.ndarray:
        """The a for which [a, a + width) lies in no run of a period that fits."""
        for period, (starts, stops) in self.by.items():
            if len(a) and fits(period):
                i = np.searchsorted(starts, a, "right") - 1
                a = a[(i < 0) | (np.array(stops)[i] < a + width)]
        return a


def _reach(ids: np.ndarray, a: int, d: int, step: int) -> int:
    """How far from a (in direction step) ids equals itself d further on."""
    room = len(ids) - d - a if step > 0 else a + 1
    done, size = 0, 16
    while done < room:
        size = min(2 * size, room - done)
        x = a + done if step > 0 else a - done - size + 1
        differ = np.flatnonzero(ids[x : x + size] != ids[x + d : x + d + size])
        if len(differ):
            return done + int(differ[0] if step > 0 else size - 1 - differ[-1])
        done += size
    return done


def _smallest_period(part: np.ndarray, d: int) -> int:
    """The smallest period of part, which has period d twice or more: it divides d."""
    rest, r = d, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        while rest % r == 0:
            rest //= r
            if np.array_equal(part[: -(d // r)], part[d // r :]):
                d //= r
        r += 1
    return d


def _seeds(ids: np.ndarray, whole: tuple, size: int, ranges: list[tuple[int, int]], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """(places, distances) where an aligned block occurs again at a distance in ranges, and the aligned blocks that occur again at all; numbers: which blocks to search."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    blocks: dict[tuple, list[int]] = {}
    for b in numbers.tolist():
        blocks.setdefault(whole[b * size : (b + 1) * size], []).append(b * size)
    for key, places in blocks.items():
        automaton.add_word(key, (places, []))
    automaton.make_automaton()
    for end, (_, found) in automaton.iter(whole):
        found.append(end - size + 1)
    at, far, again = [], [], set()
    for _, (places, found) in automaton.items():
        if len(found) < 2:
            continue
        again.update(p // size for p in places)
        mine, all_places = np.array(places), np.array(found)
        for low, high in ranges:
            a, b = np.searchsorted(all_places, mine + low), np.searchsorted(all_places, mine + high, "right")
            n = b - a
            if n.any():
                start = np.repeat(mine, n)
                at.append(start)
                far.append(all_places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)] - start)
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *at]), np.concatenate([nothing, *far]), again


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    index: dict = {}
    whole = tuple(index.setdefault(w, len(index)) for w in words)
    if n < least or len(index) == n:
        return []
    ids = np.array(whole)
    _, which, count = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True, return_counts=True)
    lone = np.concatenate(([0], np.cumsum(count[which] == 1)))  # pairs found once, before each place
    known, found = _Known(), []
    again: set[int] | None = None
    before = 0
    for size, ranges in scales(n, least):
        numbers = np.arange(n // size)
        numbers = numbers[lone[numbers * size + size - 1] == lone[numbers * size]]
        if again is not None and size == 2 * before:
            halves = np.zeros(2 * (n // size) + 2, bool)
            halves[[b for b in again if b < len(halves)]] = True
            numbers = numbers[halves[2 * numbers] & halves[2 * numbers + 1]]
        # in a run of no longer period a block's distances are multiples of it: only blocks that see beyond its end tell more
        fresh = known.outside(numbers * size, ranges[-1][1] + size, lambda p: p <= size) // size  # noqa: B023
        before, again = size, set(np.setdiff1d(numbers, fresh).tolist())
        if not len(fresh):
            continue
        at, far, more = _seeds(ids, whole, size, ranges, fresh)
        again |= more
        order = np.lexsort((at, far))
        at, far = at[order], far[order]
        turn = np.flatnonzero(np.diff(far, prepend=-1, append=-1)).tolist()
        for x, y in zip(turn[:-1], turn[1:], strict=True):
            d = int(far[x])
            done = -1
            for a in known.outside(at[x:y], d + size, lambda p: d % p == 0).tolist():  # noqa: B023
                if a + d + size <= done:
                    continue
                start = a - (_reach(ids, a - 1, d, -1) if a else 0)
                done = a + size + _reach(ids, a + size, d, 1) + d
                if done - start < 2 * d:
                    continue
                period = _smallest_period(ids[start:done], d)
                if done - start >= max(least, 2 * period) and known.add(start, done, period):
                    found.append((start, done - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds behind its first period."""
    stay, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if a > at:
            stay += words[at:a]
        at = max(at, b)
    return stay + words[at:]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, least: int = LEAST, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs with n_words, runs (array of start, length, period: word numbers, by start, then period) and kept_text.

    docs: text and any other columns (doc_id too, if rewrite is given); columns
    of the new names are replaced. kept_text has each run's first period and
    all words outside, joined by one space. Null and empty texts have no words
    and no runs. Repeated rows give repeated rows. rewrite(doc_id, words) gives
    the words to look at instead.
    """
    small_batches(docs.sparkSession)
    base = without(docs, ["n_words", "runs", "kept_text"])
    own = base.columns
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in _RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, runs, kept = [], [], []
            ids = batch.column("doc_id").to_pylist() if rewrite else [None] * batch.num_rows
            for doc_id, text in zip(ids, as_bytes(batch.column("text")), strict=True):
                words = text.split() if text else []
                if rewrite:
                    words = rewrite(doc_id, words)
                mine = find_runs(words, least)
                total.append(len(words))
                runs.append([dict(zip(_RUN.names, r, strict=True)) for r in mine])
                kept.append(b" ".join(collapsed(words, mine) if mine else words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=[*own, "n_words", "runs", "kept_text"])

    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("kept_text", T.StringType())])
    return base.mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: one in ten documents repeats a stretch of its own to its end; without doc_id nothing is changed."""
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def query(spark, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    # the longest, then the first, then that of the smallest period
    top = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS later, -r.period AS larger, r)))").getField("r")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"), lines.alias("lines"), "kept_text").select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
