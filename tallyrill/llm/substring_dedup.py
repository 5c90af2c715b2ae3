"""Substring dedup with prefix-partitioned suffix trees.

A run of WINDOW words that also starts earlier in the corpus is a repeat. Not
every suffix of the corpus can be shipped, so each window of words names one of
its own word grams, the one with the least hash, as its anchor: equal windows
have equal anchors. A window can only repeat where its anchor's gram occurs
again, so suffixes are kept at such anchors only; this loses no repeat.

The gram is the first prefix by which suffixes are partitioned. Where a gram
has few enough occurrences, the suffixes of all windows around them form one
group that fits in memory. Its subtree is kept as a suffix array with the
lengths of common prefixes; each interval of suffixes that agree in WINDOW words
or more is a deep internal node, whose depth is the length of a repeat that
cannot be made longer to the right. For grams with more occurrences equal runs of anchors, and then equal surroundings of an
anchor, are told by a digest and reduced to their first occurrence, and the
prefix grows to all WINDOW words: such a group is one deep node, whose first
occurrence is a pre-aggregated minimum. So a passage in any share of the
documents is never in one task.

Documents whose word sequence is the same are told by a digest first; only the
first of them takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, checkpointed, keeps_own, release, sha256_hex, stored, table, without

WINDOW = 20
GRAM = 6
#: Occurrences of a gram whose windows form one subtree in memory.
GROUP = 4_000
#: Rows without doc_id come after all others.
NO_ID = (1 << 63) - 1
CHUNK_BYTES = 1 << 20
#: Later copies (16 bytes each) up to which their keys are broadcast; beyond, they are joined by a shuffle.
BROADCAST_COPIES = 500_000
_LOW = np.uint64((1 << 22) - 1)

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


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


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def segments(text: bytes, window: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(number of its first word, bytes) of pieces of a text such that each window of words lies whole in just one."""
    if len(text) <= limit:
        yield 0, text
        return
    words = text.split()
    first = size = at = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size > limit and i + 1 - first >= window:
            yield first, b" ".join(words[first : i + 1])
            first = i + 2 - window
            size = sum(map(len, words[first : i + 1])) + i + 1 - first
            at = i + 1
    if at < len(words):
        yield first, b" ".join(words[first:])


def find_anchors(pieces: list[bytes], powers: _Powers, window: int, gram: int):
    """For the anchors of all windows in pieces: gram hash, piece, word in the piece, first window, windows; and the byte range of each word."""
    buffer = b"\n".join(pieces) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    offsets = np.cumsum([0] + [len(p) + 1 for p in pieces])
    piece = np.searchsorted(offsets, starts, "right") - 1
    first_word = np.searchsorted(starts, offsets)
    nothing = np.zeros(0, np.int64)
    if n < window:
        return buffer, starts, ends, first_word, nothing.view(np.uint64), nothing, nothing, nothing, nothing
    up, down = powers.upto(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    grams = words[: n - gram + 1].copy()
    for i in range(1, gram):
        grams *= np.uint64(0xC2B2AE3D27D4EB4F)
        grams += words[i : n - gram + 1 + i]
    grams = _mix(grams)
    # the least of the upper bits wins, the first among equals; its place is in the lower bits
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    at = np.flatnonzero(piece[: n - window + 1] == piece[window - 1 :])
    if not len(at):
        return buffer, starts, ends, first_word, nothing.view(np.uint64), nothing, nothing, nothing, nothing
    anchor = (least[at] & _LOW).astype(np.int64)
    turn = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[at[1:]] != piece[at[:-1]]))))
    count = np.diff(np.concatenate((turn, [len(at)])))
    anchor, begin = anchor[turn], at[turn]
    return buffer, starts, ends, first_word, grams[anchor], piece[begin], anchor, begin, count


def _chunks(batches: Iterator[pa.RecordBatch], window: int, names: tuple[str, ...]):
    """Lists of (row, number of the piece's first word, piece), of about CHUNK_BYTES; row: the values of the named columns."""
    held, size = [], 0
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        for row, text in zip(rows, as_bytes(batch.column("text")), strict=True):
            for base, piece in segments(text or b"", window):
                held.append((row, base, piece))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


_ANCHOR = "k bigint, h bigint, pos int, gram bigint"


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for held in _chunks(batches, window, ("k", "h")):
            _, _, _, first_word, grams, piece, anchor, _, _ = find_anchors([x[2] for x in held], powers, window, gram)
            k, h = (np.fromiter((x[0][i] for x in held), np.int64, len(held)) for i in (0, 1))
            base = np.fromiter((x[1] for x in held), np.int64, len(held))
            pos = anchor - first_word[piece] + base[piece]
            columns = [pa.array(k[piece]), pa.array(h[piece]), pa.array(pos.astype(np.int32)), pa.array(grams.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "h", "pos", "gram"])

    return run


_CONTEXT = "gram bigint, k bigint, h bigint, start int, windows int, words binary"
_BLOCK = "block binary, k bigint, h bigint, start int, windows int, parts array<struct<context: binary, off: int, windows: int, digests: binary>>"
#: On average so many neighbouring anchors of hot grams make a block.
BLOCK_ANCHORS = 8


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\t".join(words), digest_size=16).digest()


def _flagged(held: list, powers: _Powers, window: int, gram: int, hot: bool):
    """Of the anchors in held whose flag (2 * position, odd where the gram is hot) fits: gram hash, place in held, first window in the document, windows, bytes of the words around."""
    buffer, starts, ends, first_word, grams, piece, anchor, begin, count = find_anchors([x[2] for x in held], powers, window, gram)
    wanted = [{p >> 1 for p in x[0][2] if (p & 1) == hot} for x in held]
    for g, p, a, b, n in zip(grams.view(np.int64).tolist(), piece.tolist(), anchor.tolist(), begin.tolist(), count.tolist(), strict=True):
        shift = held[p][1] - int(first_word[p])
        if a + shift in wanted[p]:
            yield g, p, b + shift, n, buffer[starts[b] : ends[b + n + window - 2]]


def _contexts(window: int, gram: int):
    """The words around each flagged anchor whose gram is not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for held in _chunks(batches, window, ("k", "h", "flags")):
            rows = [(g, *held[p][0][:2], start, n, b"\t".join(words.split())) for g, p, start, n, words in _flagged(held, powers, window, gram, False)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "k", "h", "start", "windows", "words"])

    return run


def _blocks(window: int, gram: int):
    """Runs of neighbouring hot anchors, cut where a gram's hash says so: digests of the run, of each anchor's words, of each window.

    Anchors whose words the same document has further up are late whatever
    other documents hold; they come as rows without a block.
    """
    part = pa.struct([("context", pa.binary()), ("off", pa.int32()), ("windows", pa.int32()), ("digests", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(part))
        for held in _chunks(batches, window, ("k", "h", "flags")):
            rows, block, end = [], [], None
            place, seen, late = -1, set(), None

            def close() -> None:
                if block:
                    p, start = block[0][0], block[0][1]
                    parts = [{"context": c, "off": s - start, "windows": n, "digests": d} for _, s, n, c, d in block]
                    whole = hashlib.blake2b(b"".join(c for *_, c, _ in block), digest_size=16).digest()
                    rows.append((whole, *held[p][0][:2], start, sum(n for _, _, n, _, _ in block), parts))
                    block.clear()

            for g, p, start, n, text in _flagged(held, powers, window, gram, True):
                if p != place:
                    place, seen, late = p, set(), None
                if (p, start) != end:
                    close()
                end = (p, start + n)
                words = text.split()
                context = _digest(words)
                if context in seen:
                    close()
                    if late and late[3] + late[4] == start:
                        late[4] += n
                    else:
                        late = [None, *held[p][0][:2], start, n, None]
                        rows.append(late)
                    continue
                seen.add(context)
                block.append((p, start, n, context, b"".join(_digest(words[i : i + window]) for i in range(n))))
                if g % BLOCK_ANCHORS == 0:
                    close()
            close()
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "k", "h", "start", "windows", "parts"])

    return run


def deep_nodes(texts: list[list[bytes]], counts: list[int], least: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """The internal nodes of depth `least` or more, next to the root, of the tree over the first counts[i] suffixes of each text: leaves (text, word) and depth.

    The suffixes are sorted (a tab, which is less than any byte of a word, ends
    each word, so that byte order is word order); neighbours whose common
    prefix has `least` words or more are leaves of one node, and the shortest of
    these prefixes is the node's depth.
    """
    suffixes = []
    for i, words in enumerate(texts):
        joined = b"\t".join(words) + b"\t"
        at = 0
        for j in range(counts[i]):
            suffixes.append((joined[at:], i, j))
            at += len(words[j]) + 1
    suffixes.sort()
    node, depth = [suffixes[0][1:]] if suffixes else [], 0
    for (_, i, j), (_, x, y) in pairwise(suffixes):
        a, b = texts[i], texts[x]
        if a[j : j + least] == b[y : y + least]:
            common, most = least, min(len(a) - j, len(b) - y)
            while common < most and a[j + common] == b[y + common]:
                common += 1
            depth = min(depth, common) if len(node) > 1 else common
            node.append((x, y))
        else:
            if len(node) > 1:
                yield node, depth
            node = [(x, y)]
    if len(node) > 1:
        yield node, depth


_REPEAT = "k bigint, h bigint, first int, last int"


def _subtree_repeats(window: int):
    """Over contexts sorted by gram: the ranges of words in windows that start earlier too."""

    def repeats(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        texts = [words.split(b"\t") for *_, words in group]
        later: dict[int, list[tuple[int, int]]] = {}
        for leaves, depth in deep_nodes(texts, [g[3] for g in group], window):
            places = [(group[i][0], group[i][1], group[i][2] + j, i, j) for i, j in leaves]
            first = min(p[:3] for p in places)
            for p in places:
                if p[:3] != first:
                    later.setdefault(p[3], []).append((p[4], p[4] + depth - 1))
        for i, found in later.items():
            k, h, start, _, _ = group[i]
            found.sort()
            a, b = found[0]
            for j, end in found[1:]:
                if j > b + 1:
                    yield k, h, start + a, start + b
                    a = j
                b = max(b, end)
            yield k, h, start + a, start + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        of = None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for g, *row in zip(*columns, strict=True):
                if g != of:
                    if len(group) > 1 or group and group[0][3] > 1:
                        out += repeats(group)
                    group, of = [], g
                group.append(tuple(row))
            yield _ranges(out)
        if group:
            yield _ranges(list(repeats(group)))

    def _ranges(rows: list[tuple]) -> pa.RecordBatch:
        k, h, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["k", "h", "first", "last"])

    return run


def _sequence_digest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for text in as_bytes(batch.column("text")):
            words = text.split() if text else []
            sums.append(_digest(words) if len(words) >= window else None)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(sums, pa.binary())], names=["k", "h", "digest"])


def _first_and_late(rows: DataFrame, key: str, content: str | None, window: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, k, h, start, windows, content, the same for equal keys): the first of each key, and the word ranges of the others."""
    place = F.struct("k", "h", "start")
    kept = [F.any_value(content).alias(content)] if content else []
    first = rows.groupBy(key).agg(F.min(place).alias("one"), F.max("windows").alias("windows"), F.count("*").alias("n"), *kept)
    late = rows.select(key, "k", "h", "start").join(first.where("n > 1").select(key, "one", "windows"), key).where(place != F.col("one"))
    late = late.select("k", "h", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (window - 2)).alias("last"))
    return first.select("one.*", "windows", key, *([content] if content else [])), late


def repeated_ranges(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Of rows (k, h, text and others): (k, h) of later copies of a word sequence, and (k, h, first, last) of repeated words in the others."""
    spark = rows.sparkSession
    texts = rows.select("k", "h", "text")
    digests = checkpointed(texts.mapInArrow(lambda b: _sequence_digest(b, window), "k bigint, h bigint, digest binary").where("digest is not null").distinct())
    firsts = digests.groupBy("digest").agg(F.min("k").alias("k"))
    # among equal k (one doc_id, or none) the hash of the text decides; equal texts are then the same document
    firsts = digests.join(firsts, ["digest", "k"]).groupBy("digest", "k").agg(F.min("h").alias("h")).withColumnsRenamed({"k": "k1", "h": "h1"})
    copies = checkpointed(digests.join(firsts, "digest").where("k <> k1 or h <> h1").select("k", "h").distinct())
    few = copies.count() <= BROADCAST_COPIES
    anchors = texts.join(F.broadcast(copies) if few else copies, ["k", "h"], "left_anti").mapInArrow(_anchor_rows(window, gram), _ANCHOR)
    again = checkpointed(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    release(spark)
    flags = anchors.join(again, "gram").select("k", "h", (F.col("pos").cast("bigint") * 2 + (F.col("n") > group).cast("int")).alias("flag"))
    flags = checkpointed(flags.groupBy("k", "h").agg(F.collect_set("flag").alias("flags")))
    release(spark)
    # all columns go on, so that this is the exchange of the texts that the result is made from, too
    flagged = rows.join(flags, ["k", "h"])
    contexts = flagged.mapInArrow(_contexts(window, gram), _CONTEXT)
    contexts = contexts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram").sortWithinPartitions("gram")
    repeats = contexts.mapInArrow(_subtree_repeats(window), _REPEAT)
    if not again.where(F.col("n") > group).isEmpty():
        blocks = stored(flagged.where(F.exists("flags", lambda f: f % 2 == 1)).mapInArrow(_blocks(window, gram), _BLOCK), "blocks")
        release(spark)
        again_inside = blocks.where("block is null").select("k", "h", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (window - 2)).alias("last"))
        # equal blocks, then equal contexts in the blocks that are left, then equal windows in the contexts that are left
        first, late = _first_and_late(blocks.where("block is not null"), "block", "parts", window)
        inner = first.select("k", "h", F.col("start").alias("_start"), F.inline("parts")).select("k", "h", (F.col("_start") + F.col("off")).alias("start"), "windows", "context", "digests")
        first, late_inner = _first_and_late(inner, "context", "digests", window)
        each = first.select("k", "h", "start", "digests", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("j"))
        each = each.select("k", "h", (F.col("start") + F.col("j")).alias("start"), F.lit(1).alias("windows"), F.expr("substring(digests, j * 16 + 1, 16)").alias("digest"))
        _, late_windows = _first_and_late(each, "digest", None, window)
        repeats = repeats.unionByName(again_inside).unionByName(late).unionByName(late_inner).unionByName(late_windows)
    return copies, repeats


@keeps_own("k", "h", "_copy", "_ranges", "flags")
def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, text_too: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_text (or kept_sha256 instead, if not text_too).

    docs: doc_id (a whole number), text and any other columns; columns of these
    names are replaced. Each word in a window of `window` words that also
    starts earlier (smaller doc_id, or the same document further up) goes; the
    others are joined by one space. Null and empty texts have no words. Rows
    without doc_id come last; among rows of one doc_id the hash of the text
    decides, and rows equal in both are one document with one result.
    """
    names = ["n_words", "n_removed", "kept_text" if text_too else "kept_sha256"]
    base = without(docs, names)
    rows = base.withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))
    copies, repeats = repeated_ranges(rows, window, gram, group)
    repeats = repeats.groupBy("k", "h").agg(F.collect_list(F.struct("first", "last")).alias("_ranges"))
    joined = rows.join(copies.withColumn("_copy", F.lit(True)), ["k", "h"], "left").join(repeats, ["k", "h"], "left")
    own = base.columns
    out_names = [*own, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, copy, ranges in zip(as_bytes(batch.column("text")), batch.column("_copy").to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
                words = text.split() if text else []
                total.append(len(words))
                if copy:
                    words = []
                elif ranges:
                    stay, at = [], 0
                    for r in sorted(ranges, key=lambda r: r["first"]):
                        if r["first"] > at:
                            stay += words[at : r["first"]]
                        at = max(at, r["last"] + 1)
                    words = stay + words[at:]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            last = pa.array(kept, pa.binary()).cast(pa.string()) if text_too else pa.array([sha256_hex(x) for x in kept])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), last], names=out_names)

    long = T.LongType()
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], long), T.StructField(names[1], long), T.StructField(names[2], T.StringType())])
    return joined.select(*own, "_copy", "_ranges").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), text_too=False).drop("text")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - {WINDOW - 2} AS BIGINT))) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + {WINDOW} AS BIGINT))) AS p FROM r WHERE n > 1),
p AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM d)),
k AS (SELECT p.doc_id, count(*) FILTER (x.p IS NOT NULL) AS n_removed, string_agg(p.word, ' ' ORDER BY p.p) FILTER (x.p IS NULL) AS kept FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.p = x.p GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
