"""LM scoring with a probabilistic suffix tree over words.

The symbols are lower-cased words and the end of a text. A state is a context
of up to two tokens (at the start of a text the end of the one before stands
in). A context s that occurs twice or more in the training texts is retained if
its next symbols diverge from those of its suffix u by MIN_GAIN nats or more
over all its occurrences:

    sum over symbols x of n(sx) ln(n(sx) n(u) / (n(s) n(ux)))

The distribution of a retained state is smoothed by absolute discounts (for
symbols found once, twice, more often; from the counts of counts),

    P(x | s) = (n(sx) - D) / n(s) + (sum of all D) / n(s) P(x | u)

and is that of its suffix where s is not retained, so each token is scored in
its longest retained suffix state. The root is the discounted unigram; its
discounted mass goes to a second suffix tree, over the bytes of a word and its
end, that spells the word from up to DEPTH bytes before. That tree is learned
from each distinct training word once and retained by BYTE_GAIN. So every
text, whatever its words, has a proper probability.

Texts are dealt to batches of bounded size. A batch sends its distinct words,
pairs, triples and byte contexts, with their training counts, as packed sorted
arrays to shards of the key space; a shard adds them up over all batches and
answers with arrays in the same order, so no key travels back. A symbol, however
frequent, costs a shard one entry a batch. Triples are only sent under pairs
that may be states, by a bound on their gain. Keys are 64-bit hashes (within a
shard their lower 48 bits): words of one hash would count as one. Nothing that
grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, as_bytes, brief_shuffles, checkpointed, fresh_path, keeps_own, mix_bits, remove_path, shared_root, stored, table, without, word_hashes

MIN_GAIN = 3.0
BYTE_GAIN = 12.0
#: Bytes of context of the spelling tree; with the symbol they fill the 48 bits of a key.
DEPTH = 5
FOLDS, HELD_OUT = 7, 2
#: Characters of the texts of one batch.
BATCH_CHARS = 6_000_000
#: Batches for which there is one shard.
SHARD_BATCHES = 3
_CHUNK = 1 << 20
_SLICE = 1 << 21
_END_HASH = np.uint64(0x5851F42D4C957F2D)
_SPACE = 32
_LOW = np.uint64((1 << 48) - 1)
#: What a packed message or answer is about.
WORDS, PAIRS, TRIPLES, AFTER_WORDS, AFTER_PAIRS, SPELLING, SPELLED = range(7)
_MESSAGE = "kind int, shard int, _batch int, keys binary, n binary, x binary"
_ANSWER = "kind int, shard int, _batch int, answer binary, stats array<bigint>"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the place of one of each, which of them each key is)."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    which = np.empty(len(keys), np.int32 if len(keys) < 1 << 31 else np.int64)
    which[order] = np.cumsum(new, dtype=which.dtype) - 1
    return held[new], order[new], which


class Batch:
    """The tokens of some texts: hashes, distinct words, pairs and triples in the order of their hashes, and training counts."""

    def __init__(self, texts: list[bytes | None], train: np.ndarray, with_pairs: bool = True):
        texts = [(t or b"").translate(LOWER) for t in texts]
        self.sizes = np.zeros(len(texts), np.int64)
        hashes, starts, ends = [], [], []
        at = 0
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < _CHUNK):
                size += len(texts[j]) + 1
                j += 1
            found, s, e = word_hashes(b"\n".join(texts[i:j]) + b"\n")
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
            upto = np.searchsorted(s, offsets[1:])  # words before the end of each text
            hashes.append(np.insert(found, upto, _END_HASH))
            starts.append(np.insert(s + at, upto, 0))
            ends.append(np.insert(e + at, upto, 0))
            self.sizes[i:j] = np.diff(np.concatenate(([0], upto))) + 1
            at += int(offsets[-1])
            i = j
        self.buffer = b"\n".join(texts) + b"\n"
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(train.astype(bool), self.sizes)
        self.words, one, self.word = _distinct(h)
        self.spans = (np.concatenate(starts)[one], np.concatenate(ends)[one]) if hashes else (one, one)
        if not with_pairs:
            return
        end = np.searchsorted(self.words, _END_HASH)
        before = np.concatenate(([end], self.word[:-1])).astype(self.word.dtype) if len(h) else self.word
        # a text's first token follows the end of the one before
        self.pairs, one, self.pair = _distinct(_pair(self.words[before], h))
        self.pair_words = before[one], self.word[one]
        self.word_n, self.pair_n = self._count(self.word, len(self.words)), self._count(self.pair, len(self.pairs))

    def _count(self, which: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(which[self.train], minlength=size)

    def grow(self, c: np.ndarray, n: np.ndarray, min_gain: float) -> None:
        """Triples under the pairs that may be states, by the training counts of words and pairs; a token that ends none has -1.

        A state occurs twice or more. As no symbol is rarer after the last word
        than after both, n ln(c / n) bounds what the pair can gain on that word.
        """
        last = c[self.pair_words[1]]
        self.may = (n >= 2) & (n * np.log(np.maximum(last, 1) / np.maximum(n, 1)) >= min_gain)
        inside = np.ones(len(self.word), bool)
        inside[self.first] = False
        before = np.concatenate(([0], self.pair[:-1])) if len(self.pair) else self.pair
        some = inside & self.may[before]
        self.triple = np.full(len(self.word), -1, self.word.dtype)
        context, symbol = before[some], self.word[some]
        keys = _pair(self.pairs[context], self.words[symbol] ^ np.uint64(0x2545F4914F6CDD1D))
        self.triples, one, which = _distinct(keys)
        self.triple[some] = which
        self.triple_context, self.triple_end = context[one], self.pair[some][one]
        self.triple_n = np.bincount(which[self.train[some]], minlength=len(self.triples))

    def byte_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words at some places: distinct byte contexts with their symbols (spread over the shards), which of them each symbol has, and the first symbol of each word."""
        starts, ends = self.spans
        keys, first = symbol_keys(np.frombuffer(self.buffer, np.uint8), starts[which], ends[which])
        distinct, _, at = _distinct(_spread(keys))
        return distinct, at, first


def symbol_keys(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first key of each word) of words in buffer: each byte of each word and the space after it, with the DEPTH bytes before it, back to the space before the word.

    A key has the symbol in its lowest byte and the context above. A word of no
    bytes (the end of a text) has the one symbol 10, which is in no word.
    """
    empty = ends == starts
    lengths = ends - starts + 1 + empty
    marks = np.cumsum(lengths) - lengths  # the space before each word
    data = np.full(int(lengths.sum()) + 1, _SPACE, np.uint8)
    data[marks[empty] + 1] = 10
    seen = np.arange(len(data) - 1) - np.repeat(marks, lengths)  # symbols between the mark and the byte before a key's, the mark not included
    inside = (seen > 0) & ~np.repeat(empty, lengths)
    data[:-1][inside] = buffer[(np.repeat(starts - 1, lengths) + seen)[inside]]
    keys = data[1:].astype(np.uint64)
    for t in range(1, DEPTH + 1):
        part = data[: len(keys) + 1 - t].astype(np.uint64) << np.uint64(8 * t)
        part[seen[t - 1 :] < t - 1] = 0
        keys[t - 1 :] |= part
    if empty.any():  # no space follows the end of a text
        keys = np.delete(keys, marks[empty] + 1)
    sizes = lengths - empty
    return keys, np.cumsum(sizes) - sizes


def context_length(keys: np.ndarray) -> np.ndarray:
    """Bytes of the contexts: up to the space before the word, or DEPTH."""
    out = np.full(len(keys), DEPTH, np.int64)
    for t in range(DEPTH, 0, -1):
        out[(keys >> np.uint64(8 * t)) & np.uint64(255) == _SPACE] = t
    return out


def _spread(keys: np.ndarray) -> np.ndarray:
    """Keys of 48 bits below 16 bits of their hash, so that ranges of them are shards of like size."""
    return mix_bits(keys * np.uint64(0x9E3779B97F4A7C15)) & ~_LOW | keys


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, size, n) of the symbols of words, n weighted by the words' counts."""
    held_keys, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        words = batch.column("word").to_pylist()
        n = batch.column("c").to_numpy()
        if not words:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        keys, first = symbol_keys(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])), ends)
        weights = np.repeat(n, np.diff(np.concatenate((first, [len(keys)]))))
        held_keys, at = np.unique(np.concatenate((held_keys, keys)), return_inverse=True)
        held_n = np.bincount(at, np.concatenate((held_n, weights)).astype(np.float64), len(held_keys)).astype(np.int64)
        if len(held_keys) > _SLICE:
            yield _context_rows(held_keys, held_n)
            held_keys, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield _context_rows(held_keys, held_n)


def _context_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(context_length(keys).astype(np.int32)), pa.array(n)], names=["key", "size", "n"])


def suffix_tree(words: DataFrame, min_gain: float = BYTE_GAIN) -> DataFrame:
    """(key, logp) of words (word, c): log10 probability of each symbol after each context that occurs in them.

    words with c = 0 teach nothing, but their contexts are in the result.
    """
    return byte_tree(checkpointed(words.mapInArrow(_count_contexts, "key bigint, size int, n bigint").groupBy("key", "size").agg(F.sum("n").alias("n"))), min_gain)


def byte_tree(counts: DataFrame, min_gain: float = BYTE_GAIN) -> DataFrame:
    """(key, logp, and other columns of counts) for counts (key, size, n), where a key is a symbol below its context of size bytes.

    The contexts of no and one byte are one table of 256 * 256 counts. All
    longer ones of a key end in the same two bytes, so groups by these hold
    whole branches of the tree.
    """
    spark = counts.sparkSession
    few = np.zeros(1 << 16)
    for r in counts.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << 16) - 1).alias("low")).agg(F.sum("n").alias("n")).collect():  # 65536 rows at most
        few[r["low"]] = r["n"]
    few = few.reshape(256, 256)
    p = np.full(256, 1 / 256)
    none = few.sum(axis=0)
    if none.any():
        p = (none + (none > 0).sum() * p) / (none.sum() + (none > 0).sum())
    total, kinds = few.sum(axis=1, keepdims=True), (few > 0).sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nansum(few * np.log(few / total * none.sum() / none), axis=1, keepdims=True)
    p = np.where((gain >= min_gain) & (total > 0), (few + kinds * p) / np.maximum(total + kinds, 1), p)
    shared = spark.sparkContext.broadcast((few, p))
    names = [c for c in counts.columns if c not in ("size", "n")]

    def branches(group: pa.Table) -> pa.Table:
        few, p = shared.value
        logp = np.log10(byte_probabilities(group.column("key").to_numpy().view(np.uint64), group.column("n").to_numpy(), few, p, min_gain))
        return pa.table([*(group.column(c) for c in names), pa.array(logp)], names=[*names, "logp"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    grouped = counts.withColumn("_part", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND((1 << 16) - 1)), F.lit(parts)))
    schema = T.StructType([*(counts.schema[c] for c in names), T.StructField("logp", T.DoubleType())])
    return grouped.groupBy("_part").applyInArrow(branches, schema)


def byte_probabilities(keys: np.ndarray, n: np.ndarray, few: np.ndarray, p: np.ndarray, min_gain: float) -> np.ndarray:
    """Probabilities of keys (all that end in the same bytes) from the counts and probabilities after one byte."""
    size = context_length(keys)
    low = (keys & np.uint64((1 << 16) - 1)).astype(np.int64)
    up_keys, up_n, up_total = np.arange(1 << 16).astype(np.uint64), few.reshape(-1), np.repeat(few.sum(axis=1), 256)
    p = p.reshape(-1)[low]
    for d in range(2, DEPTH + 1):
        mask = np.uint64((1 << 8 * (d + 1)) - 1)
        held, _, which = _distinct(keys[(size >= d) & (n > 0)] & mask)
        if not len(held):
            break
        counts = np.bincount(which, n[(size >= d) & (n > 0)], len(held))
        contexts, _, of = _distinct(held >> np.uint64(8))
        total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
        up = np.searchsorted(up_keys, held & np.uint64((1 << 8 * d) - 1))
        gain = np.bincount(of, counts * np.log(counts / total[of] * up_total[up] / up_n[up]), len(contexts))
        mine = keys & mask
        at = np.minimum(np.searchsorted(held, mine), len(held) - 1)
        here = np.minimum(np.searchsorted(contexts, mine >> np.uint64(8)), len(contexts) - 1)
        state = (contexts[here] == mine >> np.uint64(8)) & (size >= d) & (gain[here] >= min_gain)
        found = np.where(held[at] == mine, counts[at], 0)
        p = np.where(state, (found + kinds[here] * p) / (total[here] + kinds[here]), p)
        up_keys, up_n, up_total = held, counts, total[of]
    return p


def discounts(of: list[int]) -> np.ndarray:
    """Absolute discounts for symbols found 0, 1, 2 and more times, from the numbers of those found 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = of
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _press(values: np.ndarray) -> bytes:
    """The bytes of values, compressed, after their number."""
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpress(packed: bytes, kind) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(memoryview(packed)[8:], size, codec="zstd", asbytes=True), kind)


def _packed(kind: int, batch: int, shards: int, hashes: np.ndarray, n: np.ndarray, x: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of _MESSAGE: hashes (sorted) and their values, cut where the shard changes."""
    bounds = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    cuts = [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]
    low = hashes & _LOW
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        if b > a:
            keys = (low[a:b] >> np.uint64(32)).astype(np.uint16).tobytes() + low[a:b].astype(np.uint32).tobytes()
            yield kind, s, batch, keys, _press(n[a:b].astype(np.int64)), None if x is None else _press(np.concatenate([np.ascontiguousarray(x[0, a:b]).view(np.uint32), *(y[a:b].astype(np.float32).view(np.uint32) for y in x[1:])]))


def _keys_of(packed: bytes) -> np.ndarray:
    size = len(packed) // 6
    return np.frombuffer(packed, np.uint16, size).astype(np.uint64) << np.uint64(32) | np.frombuffer(packed, np.uint32, size, 2 * size).astype(np.uint64)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _gathered(group: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """Of the messages in a group, by batch: batches, sizes, distinct keys, one place of each, which of them each key is, n, packed x."""
    batches = group.column("_batch").to_pylist()
    order = sorted(range(len(batches)), key=batches.__getitem__)
    packed, n, x = (group.column(c).to_pylist() for c in ("keys", "n", "x"))
    keys = [_keys_of(packed[i]) for i in order]
    distinct, own, which = _distinct(np.concatenate(keys))
    counts = np.concatenate([_unpress(n[i], np.int64) for i in order])
    return [batches[i] for i in order], [len(k) for k in keys], distinct, own, which, counts, [x[i] for i in order]


def _cut(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [_press(values[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def add_up(group: pa.Table, min_gain: float) -> pa.Table:
    """The answers of one shard and kind: to each batch its keys' values, in the order it sent them.

    Of words, pairs and triples twice the count, odd for one of the batches that
    have the key; of contexts the discounted mass of those retained, else 0; of
    words also how they are spelled.
    """
    kind, shard = group.column("kind")[0].as_py(), group.column("shard")[0].as_py()
    batches, sizes, distinct, own, which, n, x = _gathered(group)
    if kind in (AFTER_WORDS, AFTER_PAIRS):
        times = np.zeros(len(distinct))
        times[which] = n  # the same in every batch
        planes = [_unpress(p, np.uint32) for p in x]
        mass = np.bincount(which, np.concatenate([p[: 2 * k].view(np.float64) for p, k in zip(planes, sizes, strict=True)]), len(distinct))
        gain, *more = (np.bincount(which, np.concatenate([p[i * k : (i + 1) * k].view(np.float32) for p, k in zip(planes, sizes, strict=True)]), len(distinct)) for i in range(2, 4 if kind == AFTER_WORDS else 3))
        gain -= times * np.log(np.maximum(times, 1))
        held = np.where((times >= 2) & (gain >= min_gain), mass, 0.0)
        rows = [(kind, shard, b, a, None) for b, a in zip(batches, _cut(held[which], sizes), strict=True)]
        if more:  # sent by one batch, 0 from the others
            rows += [(SPELLED, shard, b, a, None) for b, a in zip(batches, _cut(more[0][which].astype(np.float32), sizes), strict=True)]
        return _rows(rows, _ANSWER)
    total = np.bincount(which, n, len(distinct)).astype(np.int64)  # exact below 2 ** 53
    answer = total[which] * 2
    answer[own] += 1
    stats = [int(total.sum()), int((total > 0).sum()), *(int((total == k).sum()) for k in (1, 2, 3, 4))]
    return _rows([*((kind, shard, b, a, None) for b, a in zip(batches, _cut(answer, sizes), strict=True)), (kind, shard, -1, None, stats)], _ANSWER)


def count_bytes(group: pa.Table) -> pa.Table:
    """The counts of a shard's byte contexts."""
    _, _, distinct, _, which, n, _ = _gathered(group)
    total = np.bincount(which, n, len(distinct)).astype(np.int64)
    shard = pa.array(np.full(len(distinct), group.column("shard")[0].as_py(), np.int32))
    return pa.table({"shard": shard, "key": distinct.view(np.int64), "size": context_length(distinct).astype(np.int32), "n": total})


def tell_bytes(group: pa.Table, tree: pa.Table) -> pa.Table:
    """The answers of a shard of the spelling tree: log10 probabilities in the order of each batch's keys."""
    batches, sizes, _, _, which, _, _ = _gathered(group)
    key, logp = tree.column("key").to_numpy(), tree.column("logp").to_numpy()
    told = logp[np.argsort(key)].astype(np.float32)
    return _rows([(SPELLING, group.column("shard")[0].as_py(), b, a, None) for b, a in zip(batches, _cut(told[which], sizes), strict=True)], _ANSWER)


def _answers(found: pa.Table) -> dict[int, np.ndarray]:
    """Of each kind the values in the order of the batch's hashes."""
    held: dict[int, list] = {}
    for kind, shard, answer in zip(*(found.column(c).to_pylist() for c in ("kind", "shard", "answer")), strict=True):
        held.setdefault(kind, []).append((shard, answer))
    kind = lambda k: np.int64 if k in (WORDS, PAIRS, TRIPLES) else np.float32 if k in (SPELLING, SPELLED) else np.float64
    return {k: np.concatenate([np.zeros(0, kind(k)), *(_unpress(a, kind(k)) for _, a in sorted(held.get(k, [])))]) for k in range(7)}


def _batch_of(group: pa.Table, with_pairs: bool = True) -> tuple[int, Batch]:
    texts = [t for chunk in group.column("text").chunks for t in as_bytes(chunk)]
    return group.column("_batch")[0].as_py(), Batch(texts, np.concatenate([c.to_numpy(zero_copy_only=False) for c in group.column("_train").chunks]), with_pairs)


def _after(n: np.ndarray, of: np.ndarray, suffix: np.ndarray, own: np.ndarray, size: int, discount: np.ndarray) -> np.ndarray:
    """For contexts 0..size-1 two rows: discounted mass, and sum of n ln(n / suffix probability), over the symbols this batch counts."""
    some = own & (n > 0)
    of, n = of[some], n[some]
    return np.stack([np.bincount(of, discount[np.minimum(n, 3)], size), np.bincount(of, n * np.log(n / suffix[some]), size)])


def count_groups(group: pa.Table, shards: int) -> pa.Table:
    """First round: words and pairs."""
    number, b = _batch_of(group)
    return _rows([*_packed(WORDS, number, shards, b.words, b.word_n), *_packed(PAIRS, number, shards, b.pairs, b.pair_n)], _MESSAGE)


def count_contexts(group: pa.Table, found: pa.Table, shards: int, tokens: int, discount: np.ndarray, min_gain: float) -> pa.Table:
    """Second round: what follows each word, how those are spelled that this batch owns, and triples."""
    number, b = _batch_of(group)
    got = _answers(found)
    c, n = got[WORDS] >> 1, got[PAIRS] >> 1
    before, after = b.pair_words
    follows = _after(n, before, c[after] / max(tokens, 1), got[PAIRS] & 1 == 1, len(b.words), discount)
    own = np.flatnonzero(got[WORDS] & 1)
    spelled = np.zeros(len(b.words))
    if len(own):
        _, at, first = b.byte_keys(own)
        spelled[own] = np.add.reduceat(got[SPELLING].astype(np.float64)[at], first)
    b.grow(c, n, min_gain)
    rows = [*_packed(AFTER_WORDS, number, shards, b.words, c, np.stack([*follows, spelled])), *_packed(TRIPLES, number, shards, b.triples, b.triple_n)]
    return _rows(rows, _MESSAGE)


def count_pair_contexts(group: pa.Table, found: pa.Table, shards: int, discount: np.ndarray, min_gain: float) -> pa.Table:
    """Third round: what follows each pair that may be a state."""
    number, b = _batch_of(group)
    got = _answers(found)
    c, n = got[WORDS] >> 1, got[PAIRS] >> 1
    b.grow(c, n, min_gain)
    may = np.flatnonzero(b.may)
    end = b.triple_end
    suffix = n[end] / np.maximum(c[b.pair_words[0][end]], 1)
    after = _after(got[TRIPLES] >> 1, b.triple_context, suffix, got[TRIPLES] & 1 == 1, len(b.pairs), discount)
    return _rows([*_packed(AFTER_PAIRS, number, shards, b.pairs[may], n[may], after[:, may])], _MESSAGE)


def count_spelling(group: pa.Table, found: pa.Table, shards: int) -> pa.Table:
    """The byte contexts of the words that this batch owns, counted in those that occur in training."""
    number, b = _batch_of(group, with_pairs=False)
    words = _answers(found)[WORDS]
    own = np.flatnonzero(words & 1)
    if not len(own):
        return _rows([], _MESSAGE)
    keys, at, first = b.byte_keys(own)
    times = np.repeat(words[own] > 1, np.diff(np.append(first, len(at))))
    return _rows([*_packed(SPELLING, number, shards, keys, np.bincount(at, times, len(keys)))], _MESSAGE)


def _step(n: np.ndarray, times: np.ndarray, mass: np.ndarray, low: tuple[np.ndarray, np.ndarray], discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, its log10) of symbols after a context, from those after its suffix; mass is 0 where the context is no state."""
    times = np.maximum(times, 1)
    own = np.where(mass > 0, (n - discount[np.minimum(n, 3)]) / times, 0.0)
    rest = np.where(mass > 0, mass / times, 1.0)
    p = own + rest * low[0]
    # what only the suffix knows may be too little for a double
    return p, np.where(own > 0, np.log10(np.maximum(p, 1e-300)), np.log10(rest) + low[1])


def batch_scores(b: Batch, got: dict[int, np.ndarray], totals: dict[int, list[int]], discount: dict[int, np.ndarray], min_gain: float) -> dict[str, np.ndarray]:
    """Per text: n_tokens, n_known, and the log10 sums _base (base_score but for its constant), unigram_score and score."""
    c, n = got[WORDS] >> 1, got[PAIRS] >> 1
    b.grow(c, n, min_gain)
    spelled = got[SPELLED].astype(np.float64)
    tokens, kinds, once, twice = totals[WORDS][:4]
    if tokens:
        d = discount[WORDS]
        mass = np.array([d[1] * once + d[2] * twice + d[3] * (kinds - once - twice)])
        root = _step(c, np.array([tokens]), mass, (10.0**spelled, spelled), d)
    else:
        root = 10.0**spelled, spelled
    before, after = b.pair_words
    pairs = _step(n, c[before], got[AFTER_WORDS][before], (root[0][after], root[1][after]), discount[PAIRS])
    score = pairs[1][b.pair]
    if len(b.triples):
        states = np.zeros(len(b.pairs))
        states[b.may] = got[AFTER_PAIRS]
        context, end = b.triple_context, b.triple_end
        triples = _step(got[TRIPLES] >> 1, n[context], states[context], (pairs[0][end], pairs[1][end]), discount[TRIPLES])
        score = np.where(b.triple >= 0, triples[1][b.triple], score)
    sums = {"n_known": (c > 0).astype(np.int64)[b.word], "_base": np.log10(c + 1.0)[b.word], "unigram_score": root[1][b.word], "score": score}
    return {"n_tokens": b.sizes, **{k: np.add.reduceat(v, b.first) for k, v in sums.items()}}


_SUMS = [T.StructField(n, t()) for n, t in (("n_tokens", T.LongType), ("n_known", T.LongType), ("_base", T.DoubleType), ("unigram_score", T.DoubleType), ("score", T.DoubleType))]
_NAMES = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "unigram_score"]


@keeps_own("_batch", "_base", "_train", "_row")
def score_texts(docs: DataFrame, min_gain: float = MIN_GAIN, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """docs with held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (by the tree) and unigram_score (by its root alone), all log10.

    docs: doc_id, text and any other columns; columns of these names are
    replaced. Rows with crc32(doc_id as text) mod 7 = 2 are held out, the
    others teach; a row without doc_id counts as id ''. A null or empty text
    is its end alone. Repeated rows teach and are scored as often as they are
    there. Without training rows scores are those of uniform bytes.
    """
    spark = docs.sparkSession
    base = without(docs, _NAMES)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    shared_root(spark)
    # rows are numbered once, so that equal rows may go to different batches
    first = fresh_path(spark, "numbered")
    base.withColumn("_row", F.monotonically_increasing_id()).withColumn("_train", ~held_out).write.parquet(first)
    numbered = spark.read.parquet(first)
    size = numbered.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("rows")).first()
    batches = max(1, -(-(size["chars"] + 8 * size["rows"]) // batch_chars))
    shards = -(-batches // SHARD_BATCHES)
    dealt = numbered.withColumn("_batch", F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int")).drop("_row")
    # bucketed by batch, so that no round has to move texts again
    buckets = min(batches, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"dealt_{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        dealt.repartition(buckets, "_batch").write.option("compression", "zstd").bucketBy(buckets, "_batch").option("path", fresh_path(spark, "dealt")).saveAsTable(name)
    remove_path(spark, first)
    rows = spark.table(name)
    texts = rows.select("_batch", "_train", "text")

    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def answered(messages: DataFrame, label: str) -> DataFrame:
        return stored(messages.repartition(parts, "kind", "shard").groupBy("kind", "shard").applyInArrow(lambda g: add_up(g, min_gain), _ANSWER), label)

    totals: dict[int, list[int]] = {}
    discount: dict[int, np.ndarray] = {}

    def take_totals(found: DataFrame) -> None:
        each = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(6)]
        for kind, *sums in found.where("_batch = -1").groupBy("kind").agg(*each).collect():  # three rows at most
            totals[kind], discount[kind] = sums, discounts(sums[2:])

    asked = lambda f: f.where("_batch >= 0").select("_batch", "kind", "shard", "answer").groupBy("_batch")
    found = answered(texts.groupBy("_batch").applyInArrow(lambda g: count_groups(g, shards), _MESSAGE), "counts")
    totals[WORDS], discount[PAIRS], discount[TRIPLES] = [0] * 6, discounts([0] * 4), discounts([0] * 4)
    take_totals(found)
    tokens = totals[WORDS][0]
    cogroup = lambda found, *kinds: texts.groupBy("_batch").cogroup(asked(found.where(F.col("kind").isin(*kinds))))
    sent = fresh_path(spark, "bytes")
    with brief_shuffles(spark):
        cogroup(found, WORDS).applyInArrow(lambda g, f: count_spelling(g, f, shards), _MESSAGE).write.parquet(sent)
    spelling = spark.read.schema(_MESSAGE).parquet(sent).groupBy("shard")
    tree = byte_tree(checkpointed(spelling.applyInArrow(count_bytes, "shard int, key bigint, size int, n bigint")))
    told = fresh_path(spark, "spelling")
    with brief_shuffles(spark):
        spelling.cogroup(tree.groupBy("shard")).applyInArrow(tell_bytes, _ANSWER).write.parquet(told)
    remove_path(spark, sent)
    spelled = spark.read.schema(_ANSWER).parquet(told)
    found = found.unionByName(answered(cogroup(found.unionByName(spelled), WORDS, PAIRS, SPELLING).applyInArrow(lambda g, f: count_contexts(g, f, shards, tokens, discount[PAIRS], min_gain), _MESSAGE), "answers"))
    remove_path(spark, told)
    take_totals(found)
    found = found.unionByName(answered(cogroup(found, WORDS, PAIRS, TRIPLES).applyInArrow(lambda g, f: count_pair_contexts(g, f, shards, discount[TRIPLES], min_gain), _MESSAGE), "pair-answers"))
    own = base.columns

    def score(group: pa.Table, found: pa.Table) -> pa.Table:
        _, b = _batch_of(group)
        sums = batch_scores(b, _answers(found), totals, discount, min_gain)
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}
        return pa.table([group.column(k) for k in own] + [pa.array(sums[f.name], kinds[f.dataType]) for f in _SUMS], names=[*own, *(f.name for f in _SUMS)])

    summed = rows.groupBy("_batch").cogroup(asked(found)).applyInArrow(score, T.StructType([*base.schema.fields, *_SUMS]))
    n, v = totals[WORDS][:2]
    each = F.log10(F.lit(float(n + v + 1)))
    return summed.select(
        *own,
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * each).alias("base_score"),
        "score",
        "unigram_score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
