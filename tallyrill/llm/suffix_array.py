"""Exact substring dedup by a distributed difference-cover suffix array.

Each byte goes that lies in a string of WINDOW bytes which also starts anywhere
else. What may be such a string is found first, and loses nothing:

* Equal texts are told by two hashes; one of each takes part, the others go whole.
* Of each window the place with the least hash of the next bytes is its anchor;
  equal windows have equal anchors at equal distances. The distances are cut
  into SHARES ranges; windows of one anchor and range have bytes in common, and
  can only be repeated if this core occurs again. They and their bytes are a
  context. Equal contexts are counted before the shuffle and become one; a core
  that is left with one context needs no sorting.

The contexts that are left are sorted as suffixes. Letters are LETTER bytes at
places that the bytes themselves choose (the least hash in a window of REACH),
so that a letter also says where the next one begins, and order by letters is
order by bytes. Over the strings of letters runs the difference-cover
algorithm: triples that start at two of three places are sorted and named, the
strings of names are sorted by recursion until names differ or are WINDOW bytes
deep, and the places of the third kind are merged in by their letter and the
rank behind it. All byte positions are then dealt by a digest of the bytes up to
the letter they meet next and the first KEY bytes of it, and sorted by this and
the rank of that letter's suffix. Neighbours in this order whose first WINDOW
bytes are the same (told by a 64-bit digest) are repeats. Of equal windows in
one run of contexts only the first is compared, so that no text of one byte over
and over fills a task; the sorted rows are read as a stream.

No text, gram or name is looked up by a broadcast of unknown size. What the
steps write is deleted when it has been used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, brief_shuffles, checkpointed, fresh_path, keeps_own, mix_bits, release, remove_path, sha256_hex, small_batches, stored, table, without

WINDOW = 200
#: An anchor and GRAM bytes from it on lie in its window.
GRAM = 64
SHARES = 4
#: Letters begin at most REACH bytes apart; where is told by hashes of TOLD bytes.
REACH, TOLD = 96, 8
LETTER = REACH + TOLD + 1
KEY = 64
#: Bytes of a text handled at once; longer texts overlap by WINDOW - 1, so that each window is whole in one part.
PART_BYTES = 1 << 19
#: Texts with copies (24 bytes each) that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_COPIES = 500_000
#: The end of a string is beyond all depths.
ENDLESS = 1 << 40
_PLACE = np.uint64((1 << 20) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_BYTES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _place_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the TOLD bytes at each place of data that has so many; lower bits are free for the place."""
    x = data.astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    x = x[:-4] << np.uint64(32) | x[4:]
    return mix_bits(x * _TURN) & ~_PLACE


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of span hashes the place of the least, the last among equals."""
    least = hashes | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    return (_PLACE - (least & _PLACE)).astype(np.int64)


class _Sums:
    """Digests of any stretch of data, from running sums in two bases."""

    def __init__(self):
        size = PART_BYTES + 1
        power = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))))
        self.lanes = [(power(b), power(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def __call__(self, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        values = _BYTES[data]
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(data)]))) for up, _ in self.lanes]

        def digest(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            one, two = (mix_bits((s[stop] - s[start]) * down[start]) for s, (_, down) in zip(sums, self.lanes, strict=True))
            return mix_bits(one * _STEP + two)

        return digest


def parts(text: bytes, window: int = WINDOW, limit: int = PART_BYTES) -> Iterator[tuple[int, bytes]]:
    """(place in the text, bytes) of parts such that each window lies whole in just one."""
    for base in range(0, max(1, len(text) - window + 1), limit - window + 1):
        yield base, text[base : base + limit]


def anchors(part: bytes, window: int = WINDOW, gram: int = GRAM, shares: int = SHARES) -> tuple[np.ndarray, ...]:
    """(mark, first window, windows, start and stop of the core, share) of the contexts of part; a mark tells anchor and share.

    All windows with an anchor at a distance in one share have the core in
    common, at the same distance.
    """
    data = np.frombuffer(part, np.uint8)
    at = _least(_place_hashes(data), window - gram + 1)[: len(data) - window + 1]
    turn = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((turn[1:], [len(at)])) - 1
    at = at[turn]
    out = []
    for q in range(shares):
        near, far = ((window - gram + 1) * k // shares for k in (q, q + 1))
        first, most = np.maximum(turn, at - far + 1), np.minimum(last, at - near)
        ok = first <= most
        out.append(np.stack((at * shares + q, first, most - first + 1, at - near, at - far + 1 + window, np.full(len(at), q)))[:, ok])
    return tuple(np.concatenate(out, axis=1))


def _long_texts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, bytes]]:
    for row, text in enumerate(as_bytes(batch.column("text"))):
        if text and len(text) >= window:
            yield row, text


def _batch(columns: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _joined(columns: list[list[np.ndarray]], kinds: list) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, k), *c]) for c, k in zip(columns, kinds, strict=True)]


def _core(part: bytes, a: int, b: int, share: int) -> int:
    key = xxhash.xxh64_intdigest(part[a:b], share)
    return key - (key >> 63 << 64)


def _anchor_rows(window: int, gram: int):
    """(h1, h2, mark, core) of the contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            out = [[], [], [], []]
            for row, text in _long_texts(batch, window):
                for base, part in parts(text, window):
                    mark, _, _, a, b, share = anchors(part, window, gram)
                    cores = np.fromiter((_core(part, *x) for x in zip(a.tolist(), b.tolist(), share.tolist(), strict=True)), np.int64, len(mark))
                    for c, x in zip(out, (np.full(len(mark), h1[row]), np.full(len(mark), h2[row]), mark + base * SHARES, cores), strict=True):
                        c.append(x)
            yield _batch(_joined(out, [np.int64] * 4), [("h1", pa.int64()), ("h2", pa.int64()), ("mark", pa.int64()), ("core", pa.int64())])

    return run, "h1 bigint, h2 bigint, mark bigint, core bigint"


def _context_rows(window: int, gram: int):
    """The flagged contexts of each text, told by their core and a digest of their bytes and of the anchor's place in them."""
    schema = [("core", pa.int64()), ("context", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, flags = (batch.column(c).to_pylist() for c in ("h1", "h2", "marks"))
            rows = []
            for row, text in _long_texts(batch, window):
                wanted = set(flags[row])
                for base, part in parts(text, window):
                    for mark, start, n, a, b, share in zip(*(x.tolist() for x in anchors(part, window, gram)), strict=True):
                        if mark + base * SHARES in wanted:
                            inside = hashlib.blake2b(part[start : start + n + window - 1], digest_size=16, salt=(mark // SHARES - start).to_bytes(8, "little")).digest()
                            rows.append((_core(part, a, b, share), inside, h1[row], h2[row], start + base, n))
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 6, schema)

    return run, "core bigint, context binary, h1 bigint, h2 bigint, start bigint, windows bigint"


def _pieces(window: int):
    """Runs of neighbouring windows of each text, at most PART_BYTES long, with all their bytes."""
    schema = [("h1", pa.int64()), ("h2", pa.int64()), ("base", pa.int64()), ("bytes", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, wanted = (batch.column(c).to_pylist() for c in ("h1", "h2", "wanted"))
            rows = []
            for row, text in _long_texts(batch, window):
                runs = []
                for w in sorted((w["start"], w["windows"]) for w in wanted[row]):
                    if runs and w[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], sum(w))
                    else:
                        runs.append([w[0], sum(w)])
                for a, b in runs:
                    rows += [(h1[row], h2[row], a + base, part) for base, part in parts(text[a : b + window - 1], window)]
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 4, schema)

    return run, "h1 bigint, h2 bigint, base bigint, bytes binary"


def _groups(pieces: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, their bytes one after the other, where each begins and the end) of runs of pieces that are handled at once."""
    first = 0
    while first < len(pieces):
        stop, size = first + 1, len(pieces[first])
        while stop < len(pieces) and size + len(pieces[stop]) <= PART_BYTES:
            size += len(pieces[stop])
            stop += 1
        yield first, stop, np.frombuffer(b"".join(pieces[first:stop]), np.uint8), np.cumsum([0, *map(len, pieces[first:stop])])
        first = stop


def _within(begin: np.ndarray, length: int) -> np.ndarray:
    """The places from which `length` bytes on lie in one piece, in order; pieces are at least so long."""
    n = np.diff(begin) - length + 1
    return np.arange(n.sum()) + np.repeat(begin[:-1] - np.cumsum(n) + n, n)


def letter_places(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where letters begin in data, the piece of each, for each place that sees so far in its piece: the number of the letter it meets first)."""
    seen = _within(begin, REACH + TOLD - 1)
    first = _least(_place_hashes(data), REACH)[seen]
    piece = np.searchsorted(begin, seen, "right") - 1
    turn = np.concatenate(([True], (first[1:] != first[:-1]) | (piece[1:] != piece[:-1])))
    number = np.full(len(data), -1)
    number[seen] = np.cumsum(turn) - 1
    return first[turn], piece[turn], number


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("sid", pa.int64()), ("idx", pa.int64()), ("at", pa.int64()), ("until", pa.int64()), ("letter", pa.binary())]
    for batch in batches:
        sids, pieces = batch.column("sid").to_numpy(), as_bytes(batch.column("bytes"))
        for a, b, data, begin in _groups(pieces):
            places, piece, _ = letter_places(data, begin)
            idx = np.arange(len(places)) - np.searchsorted(piece, piece)
            at, length = places - begin[piece], np.diff(begin)[piece]
            until = np.where(at + LETTER <= length, at + LETTER, ENDLESS)
            letters = [pieces[a + p][x : x + LETTER] for p, x in zip(piece.tolist(), at.tolist(), strict=True)]
            yield _batch([sids[a:b][piece], idx, at, until, letters], schema)


_LETTERS = "sid bigint, idx bigint, at bigint, until bigint, letter binary"


class Folder:
    """Tables that the steps write to the shared folder, each dropped by its name when it has been used."""

    def __init__(self, spark):
        self.spark, self.root, self.paths = spark, fresh_path(spark, "suffix-array"), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = f"{self.root}/{name}"
        with brief_shuffles(self.spark):
            df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def put_in_order(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """df and `place`, which grows with the keys (from 1, with gaps)."""
        ordered = df.repartitionByRange(partitions(self.spark), *keys).sortWithinPartitions(*keys)
        return self.put(ordered.withColumn("place", F.monotonically_increasing_id() + 1), name)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        remove_path(self.spark, self.root)


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _last_rank_before(folder: Folder, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df (keys, r and others) and `lower`, the greatest r of the rows up to each in the order of keys, 0 if none has one."""
    df = folder.put_in_order(df, keys, name).withColumn("_task", F.shiftright("place", 33))
    most = sorted(tuple(r) for r in df.groupBy("_task").agg(F.max("r")).collect())  # a row for each partition
    carry, so_far = [], 0
    for task, r in most:
        carry.append((task, so_far))
        so_far = max(so_far, r or 0)
    before = F.broadcast(df.sparkSession.createDataFrame(carry, "_task bigint, _before bigint"))
    upto = Window.partitionBy("_task").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_own", F.max("r").over(upto)).join(before, "_task").withColumn("lower", F.coalesce("_own", "_before")).drop("_task", "_own", "_before", "place")


def _behind(column: str, steps: int, default: int) -> Column:
    return F.coalesce(F.lead(column, steps).over(Window.partitionBy("sid").orderBy("idx")), F.lit(default))


def suffix_ranks(folder: Folder, strings: DataFrame, depth: int = WINDOW, level: int = 0) -> DataFrame:
    """(sid, idx, rank) of all suffixes of strings (sid, idx from 0, name from 1, at, until), in the order of their first `depth` bytes.

    at and until are where a name's bytes begin and end. The strings' ends are
    less than all names. Suffixes that agree in depth bytes have neighbouring
    ranks. The result is folder's table merged-<level>.
    """
    three = ["name", "name1", "name2"]
    seen = strings.select(
        "sid", "idx", "name", _behind("name", 1, 0).alias("name1"), _behind("name", 2, 0).alias("name2"), "at", _behind("until", 2, ENDLESS).alias("until")
    )
    seen = folder.put(seen, f"suffixes-{level}")
    # triples at two of three places, sorted and named
    sample = seen.where("idx % 3 <> 0")
    names = sample.groupBy(*three).agg(F.count("*").alias("n"), F.min(F.col("until") - F.col("at")).alias("deep"))
    names = folder.put_in_order(names, three, f"names-{level}")
    named = sample.select("sid", "idx", *three, "at", "until").join(names.select(*three, "place"), three)
    if names.where((F.col("n") > 1) & (F.col("deep") < depth)).isEmpty():
        ranks = named.select("sid", "idx", F.col("place").alias("r"))
    else:
        inner = named.select((F.col("sid") * 2 + F.col("idx") % 3 - 1).alias("sid"), F.expr("idx div 3").alias("idx"), F.col("place").alias("name"), "at", "until")
        found = suffix_ranks(folder, inner, depth, level + 1)
        ranks = found.select(F.expr("sid div 2").alias("sid"), (F.col("idx") * 3 + F.col("sid") % 2 + 1).alias("idx"), F.col("rank").alias("r"))
    # the others are merged in: each comes right after the greatest sampled suffix below it
    ranked = seen.join(ranks, ["sid", "idx"], "left")
    ranked = ranked.select("sid", "idx", "name", "name1", "r", _behind("r", 1, 0).alias("r1"), _behind("r", 2, 0).alias("r2"))
    ranked = folder.put(ranked, f"ranked-{level}")
    folder.drop(f"suffixes-{level}", f"names-{level}", f"merged-{level + 1}")
    ones = _last_rank_before(folder, ranked.where("idx % 3 < 2").select("sid", "idx", "name", "r1", "r"), ["name", "r1"], f"ones-{level}")
    twos = _last_rank_before(folder, ranked.where("idx % 3 <> 1").select("sid", "idx", "name", "name1", "r2", "r"), ["name", "name1", "r2"], f"twos-{level}")
    zero = F.col("idx") % 3 == 0
    others = ones.where(zero).select("sid", "idx", "name", "r1", "lower").join(twos.where(zero).select("sid", "idx", F.col("lower").alias("lower2")), ["sid", "idx"])
    others = others.select("sid", "idx", F.greatest("lower", "lower2").alias("r"), F.lit(1).alias("kind"), "name", "r1")
    nothing = F.lit(0).cast("bigint")
    merged = ranked.where(~zero).select("sid", "idx", "r", F.lit(0).alias("kind"), nothing.alias("name"), nothing.alias("r1")).unionByName(others)
    merged = folder.put_in_order(merged, ["r", "kind", "name", "r1"], f"merged-{level}")
    folder.drop(f"ranked-{level}", f"ones-{level}", f"twos-{level}")
    return merged.select("sid", "idx", F.col("place").alias("rank"))


def _window_rows(window: int):
    """Of each piece with the ranks of its letters: for each window a digest of its bytes up to the next letter and KEY bytes on, that letter's rank, its own digest.

    Windows that the piece itself has again are told here; they come with rank
    -1, and the first of equal ones like any other window too.
    """
    names = ("before", "rank", "digest", "sid", "start")
    schema = [(n, pa.int64()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            sids, pieces, ranks = batch.column("sid").to_numpy(), as_bytes(batch.column("bytes")), batch.column("ranks")
            for a, b, data, begin in _groups(pieces):
                places, piece, number = letter_places(data, begin)
                part = ranks.slice(a, b - a)
                of = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                idx, rank = (part.flatten().field(i).to_numpy() for i in (0, 1))
                by_letter = np.zeros(len(places), np.int64)
                by_letter[np.searchsorted(piece, of) + idx] = rank
                digest = sums(data)
                every = _within(begin, window)
                own, home = digest(every, every + window), np.searchsorted(begin, every, "right") - 1
                order = np.lexsort((every, own, home))
                same = (home[order][1:] == home[order][:-1]) & (own[order][1:] == own[order][:-1])
                lead, twice = np.concatenate(([True], ~same)), np.concatenate((same, [False])) | np.concatenate(([False], same))
                first, again = order[lead], order[twice]
                start = every[first]
                meets = places[number[start]]
                before = mix_bits(digest(start, meets + KEY) + (meets - start).astype(np.uint64))
                apart = mix_bits(every[again].astype(np.uint64) * _TURN + sids[a:b][home[again]].astype(np.uint64) * _STEP)
                columns = (
                    (before, apart), (by_letter[number[start]], np.full(len(again), -1)), (own[first], apart),
                    (sids[a:b][home[first]], sids[a:b][home[again]]), (start - begin[home[first]], every[again] - begin[home[again]]),
                )
                yield _batch([np.concatenate([y.view(np.int64) for y in x]) for x in columns], schema)

    return run, ", ".join(f"{n} bigint" for n in names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows in order, those with a neighbour that is the same, and those that are told already."""
    schema = [("sid", pa.int64()), ("start", pa.int64())]
    last = np.zeros((0, 5), np.int64)  # the row before, which is told with the next ones
    told = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate((last, np.stack([c.to_numpy() for c in batch.columns], axis=1)))
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 2] == rows[:-1, 2])
        mark = np.concatenate(([told], same)) | np.concatenate((same, [False])) | (rows[:, 1] < 0)
        found = rows[:-1][mark[:-1]]
        yield _batch([found[:, 3], found[:, 4]], schema)
        last, told = rows[-1:], bool(mark[-1])
    if told:
        yield _batch([last[:, 3], last[:, 4]], schema)


def _merged_ranges(window: int):
    """The windows of each piece that are repeats, as ranges of bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h1, h2, base, starts in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "base", "starts")), strict=True):
                s = np.unique(np.array(starts, np.int64))
                cut = np.flatnonzero(np.diff(s) > window)
                for a, b in zip(s[np.concatenate(([0], cut + 1))].tolist(), s[np.concatenate((cut, [len(s) - 1]))].tolist(), strict=True):
                    rows.append((h1, h2, base + a, base + b + window))
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 4, [(n, pa.int64()) for n in ("h1", "h2", "first", "stop")])

    return run, "h1 bigint, h2 bigint, first bigint, stop bigint"


def repeated_windows(folder: Folder, pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sid, start) of the windows of pieces (sid, bytes) whose bytes also start elsewhere in them; of equal windows in a piece some may come twice."""
    letters = folder.put(pieces.select("sid", "bytes").mapInArrow(_letters, _LETTERS), "letters")
    names = folder.put_in_order(letters.select("letter").distinct(), ["letter"], "alphabet").withColumnRenamed("place", "name")
    ranks = suffix_ranks(folder, letters.join(names, "letter").select("sid", "idx", "name", "at", "until"), window)
    folder.drop("letters", "alphabet")
    ranks = ranks.groupBy("sid").agg(F.collect_list(F.struct("idx", "rank")).alias("ranks"))
    rows, schema = _window_rows(window)
    windows = pieces.select("sid", "bytes").join(ranks, "sid").mapInArrow(rows, schema)
    ordered = windows.repartition(partitions(folder.spark), "before").sortWithinPartitions("before", "rank")
    return ordered.mapInArrow(_repeats, "sid bigint, start bigint")


def repeated_ranges(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h1, h2, ranges) of the bytes of texts (h1, h2, text) that repeats cover; ranges: array of (first, stop)."""
    folder = Folder(texts.sparkSession)
    run, schema = _anchor_rows(window, gram)
    found = folder.put(texts.mapInArrow(run, schema), "anchors")
    again = folder.put(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "again")
    flags = folder.put(found.join(again, "core").groupBy("h1", "h2").agg(F.collect_list("mark").alias("marks")), "flags")
    run, schema = _context_rows(window, gram)
    each = folder.put(texts.join(flags, ["h1", "h2"]).mapInArrow(run, schema), "contexts")
    folder.drop("anchors", "again", "flags")
    one = F.min(F.struct("h1", "h2", "start", "windows")).alias("one")
    contexts = folder.put(each.groupBy("core", "context").agg(F.count("*").alias("n"), one), "distinct")
    unsure = contexts.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
    wanted = contexts.join(unsure, "core").select("one.*").groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "windows")).alias("wanted"))
    run, schema = _pieces(window)
    pieces = folder.put(texts.join(wanted, ["h1", "h2"]).mapInArrow(run, schema).withColumn("sid", F.monotonically_increasing_id()), "pieces")
    marks = repeated_windows(folder, pieces, window).groupBy("sid").agg(F.collect_list("start").alias("starts"))
    run, schema = _merged_ranges(window)
    inside = folder.put(pieces.select("sid", "h1", "h2", "base").join(marks, "sid").select("h1", "h2", "base", "starts").mapInArrow(run, schema), "inside")
    folder.drop("merged-0", "pieces")
    whole = each.join(contexts.where("n > 1").select("core", "context"), ["core", "context"])
    whole = whole.select("h1", "h2", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (window - 1)).alias("stop"))
    ranges = stored(inside.unionByName(whole).groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "stop")).alias("ranges")), "ranges")
    folder.close()
    release(texts.sparkSession)
    return ranges


def _cut(text: bytes, ranges: list[dict]) -> tuple[bytes, int]:
    """(what is left, number of maximal runs removed)."""
    stay, at, spans = [], 0, 0
    for r in sorted((r["first"], r["stop"]) for r in ranges):
        if not spans or r[0] > at:
            stay.append(text[at : r[0]])
            spans += 1
        at = max(at, r[1])
    return b"".join([*stay, text[at:]]), spans


@keeps_own("h1", "h2", "_copy", "_ranges", "_id", "_first")
def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text_too: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary: what is left may not be UTF-8; kept_sha256 instead, if not text_too).

    docs: text and any other columns; columns of these names are replaced. Each
    byte goes that is covered by `window` bytes that also start at another place
    of the same or another row's text. Null and empty texts have no bytes;
    texts shorter than the window keep all. Each row is a document of its own,
    so equal rows repeat each other; doc_id is not looked at, but to choose
    which of equal texts takes part. gram: at least 8, at most window.
    """
    if not TOLD <= gram <= window or window < REACH + KEY:
        raise ValueError("window must be at least REACH + KEY bytes, and gram between TOLD and window")
    names = ["n_bytes", "n_removed", "n_spans", "kept" if text_too else "kept_sha256"]
    base = without(docs, names)
    small_batches(docs.sparkSession)
    rows = base.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), F.col("text")))
    long = rows.where(F.octet_length("text") >= window)
    row_id = F.xxhash64(*[F.col("doc_id")] if "doc_id" in docs.columns else [F.col("text")])
    copies = long.select("h1", "h2", row_id.alias("_id")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("_id").alias("_first")).where("n > 1").drop("n")
    copies = checkpointed(copies)
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    told = rows.join(copies, ["h1", "h2"], "left")
    texts = told.where(F.octet_length("text") >= window).where(F.col("_first").isNull() | (F.col("_first") == row_id)).select("h1", "h2", "text")
    ranges = repeated_ranges(texts, window, gram)
    own = base.columns
    alone = told.where("_first is null").where(F.octet_length("text") >= window).join(ranges, ["h1", "h2"], "left").select(*own, F.lit(False).alias("_copy"), F.col("ranges").alias("_ranges"))
    rest = told.where((F.octet_length("text") < window) | F.col("text").isNull() | F.col("_first").isNotNull())
    rest = rest.select(*own, F.col("_first").isNotNull().alias("_copy"), F.lit(None).cast(ranges.schema["ranges"].dataType).alias("_ranges"))
    out_names = [*own, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, kept = [], [], [], []
            for text, copy, ranges in zip(as_bytes(batch.column("text")), batch.column("_copy").to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
                text = text or b""
                left, n = (b"", 1) if copy else _cut(text, ranges or [])
                total.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(n)
                kept.append(left)
            last = pa.array(kept, pa.binary()) if text_too else pa.array([sha256_hex(x) for x in kept])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(c, pa.int64()) for c in (total, removed, spans)), last], names=out_names)

    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.LongType()) for n in names[:3]), T.StructField(names[3], T.BinaryType() if text_too else T.StringType())])
    return alone.unionByName(rest).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), text_too=False).drop("text")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT k, i, md5_number(b[i:i + {WINDOW - 1}]) AS s FROM (SELECT k, b, unnest(range(1, CAST(octet_length(b) - {WINDOW - 2} AS BIGINT))) AS i FROM d WHERE octet_length(b) >= {WINDOW})),
t AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
w AS (SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + {WINDOW}, true) AS fresh FROM g SEMI JOIN t ON g.s = t.s),
r AS (SELECT k, n, min(i) AS a, max(i) + {WINDOW} AS z FROM (SELECT k, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY k ORDER BY i) AS n FROM w) GROUP BY k, n),
x AS (SELECT k, b, a, z, lag(z, 1, 1) OVER (PARTITION BY k ORDER BY n) AS y, n FROM r JOIN d USING (k)),
e AS (SELECT k, count(*) AS spans, sum(z - a) AS gone, string_agg(hex(b[y:a - 1]), '' ORDER BY n) AS kept, max(z) AS z FROM x GROUP BY k)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(CASE WHEN spans IS NULL THEN d.b ELSE unhex(kept || hex(d.b[e.z:])) END) AS kept_sha256
FROM d LEFT JOIN e USING (k)
"""
