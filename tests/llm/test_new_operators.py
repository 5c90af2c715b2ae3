"""Suffix-array dedup, periodic runs and vector codes against brute force, on small fixtures."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill.llm import periodic, registry, sharding, substring_dedup, suffix_array, vector_codes
from tests.llm.test_operators import KINDS, sha
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_suffix_array", "op13_vector_codes"])
def test_against_sql(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    assert same(rows, connect(SF), registry.ORACLES[name])


# ---- suffix array ---------------------------------------------------------------------------------------------------


def brute_bytes(texts, window):
    places = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            places.setdefault(t[i : i + window], []).append((k, i))
    gone = [set() for _ in texts]
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + window))
    out = []
    for t, g in zip(texts, gone, strict=True):
        kept = bytes(b for i, b in enumerate(t) if i not in g)
        out.append((len(t), len(g), sum(i - 1 not in g for i in g), kept))
    return out


def ragged_texts(seed):
    r = random.Random(seed)
    alphabet = "ab é\n\0" if seed % 2 else "abcdefghij klmn日"
    make = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [make(r.choice([150, 199, 200, 201, 260, 420])) for _ in range(6)]
    texts = [make(r.choice([0, 50, 199, 200, 300])) + r.choice(passages)[r.choice([0, 0, 1, 30]) :] + make(r.choice([0, 1, 40, 300])) + r.choice(["", *passages]) for _ in range(40)]
    texts += ["x" * 900, "x" * 700 + "y", "xy" * 300, "abcdefg" * 90, "", texts[3], texts[3], passages[-1], "z" * 199]
    texts += [passages[4] * 3, make(50) + passages[5] + make(3) + passages[5][:250]]
    return [*texts, None]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_bytes(spark, seed):
    texts = ragged_texts(seed)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], KINDS).repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array.dedup_bytes(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_bytes([(t or "").encode() for t in texts], 200)


def test_parts_of_long_texts(spark, monkeypatch):
    """Texts longer than a part: windows over the seams are found."""
    monkeypatch.setattr(suffix_array, "PART_BYTES", 700)
    r = random.Random(9)
    make = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n)).decode()
    passage = make(1500)
    texts = [make(650) + passage + make(10), passage[100:] + make(3000), make(5000), make(20) + passage[400:900] + make(600)]
    for t in texts:
        pieces = list(suffix_array.parts(t.encode(), 200, 700))
        assert sorted(b + i for b, p in pieces for i in range(len(p) - 199)) == list(range(len(t) - 199))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_array.dedup_bytes(docs).collect()}
    assert [found[i] for i in range(4)] == brute_bytes([t.encode() for t in texts], 200)


@pytest.mark.parametrize("alphabet", [2, 5])
def test_suffix_ranks(spark, alphabet):
    """The ranks of all suffixes of several strings, over more than one recursion."""
    r = random.Random(alphabet)
    strings = [[r.randrange(1, alphabet + 1) for _ in range(n)] for n in (0, 1, 2, 3, 4, 50, 121)] + [[1] * 40, [1, 2] * 33]
    rows = [(s, i, c, i, i + 1) for s, x in enumerate(strings) for i, c in enumerate(x)]
    folder = suffix_array.Folder(spark)
    frame = spark.createDataFrame(rows, "sid bigint, idx bigint, name bigint, at bigint, until bigint")
    found = suffix_array.suffix_ranks(folder, frame, depth=1000).collect()
    folder.close()
    ranked = [strings[x.sid][x.idx :] for x in sorted(found, key=lambda x: x["rank"])]
    assert ranked == sorted(ranked) and len(ranked) == len(rows)


def test_bytes_edges(spark):
    same_text = "one and the same text " * 12
    rows = [(None, None), (None, same_text), (1, same_text), (1, same_text), (2, ""), (None, None), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(["h1", "h2", "kept", "n_spans", "_copy", "_ranges", "sid", "gram"])))
    out = suffix_array.dedup_bytes(docs)
    assert {"h1", "h2", "_copy", "sid"} <= set(out.columns) and out.columns.count("n_spans") == 1
    rows = out.collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.h1) for x in rows) == [(0, 0, 0, 0)] * 3 + [(5, 0, 0, 0)] + [(264, 264, 1, 0)] * 3
    assert suffix_array.dedup_bytes(docs.limit(0)).count() == 0
    assert "one" not in suffix_array.dedup_bytes(docs, text_too=False).columns


# ---- periodic runs --------------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stop = j + q
            if j > i and stop - i >= max(least, 2 * q) and next(p for p in range(1, q + 1) if all(w[x] == w[x + p] for x in range(i, stop - p))) == q:
                out.add((i, stop - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 2, 3, 5, 40])) for _ in range(r.choice([0, 1, 5, 11, 12, 13, 20, 40, 80, 150]))]
        if w and r.random() < 0.6:
            a = r.randrange(len(w))
            p = r.randrange(1, len(w) - a + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            if r.random() < 0.5:
                w[r.randrange(len(w))] = 0
        least = r.choice([12, 12, 12, 2, 4, 7, 20])
        assert periodic.find_runs(w, least) == brute_runs(w, least), (w, least)


def test_runs_of_whole_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for w in ["a" * 500, "ab" * 300, fib[-1], "".join(str(bin(i).count("1") % 2) for i in range(300)), "abc" * 7 + "abd" * 9 + "abc" * 20]:
        assert periodic.find_runs(list(w)) == brute_runs(w)


def contract_row(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(lines), hashlib.sha256(kept).hexdigest())


def test_runs_query(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("a b c dd eé".split()) for _ in range(r.choice([0, 3, 20, 60, 120])))) for i in range(150)]
    rows += [(1000, None), (1001, " \n\t"), (1002, "one two " * 90), (1003, "x" * 9000), (1004, "a\x1fb a\x1fb " * 10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {x.doc_id: tuple(x[c] for c in names) for x in found.collect()}
    assert {zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows} == {True, False}
    assert [got[i] for i, _ in rows] == [contract_row(*x) for x in rows]
    assert dict(found.dtypes)["exponent_milli"] == "bigint" and set(found.columns) == set(names)


def test_runs_edges(spark):
    docs = spark.createDataFrame([(None, None), (None, "a " * 30), (1, "a " * 30), (1, "a " * 30), (2, "")], "doc_id bigint, text string").selectExpr("*", "1 as runs", "2 as Kept_Text", "3 as start", "4 as n_words")
    out = periodic.collapse_runs(docs)
    assert sorted((x.n_words, x.kept_text, len(x.runs), x.start) for x in out.collect()) == [(0, "", 0, 3)] * 2 + [(30, "a", 1, 3)] * 3
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


# ---- vector codes ---------------------------------------------------------------------------------------------------


def brute_codes(vectors, parts=16, entries=64, rounds=2):
    """Of (vec_id, integers): codebooks, codes and errors, all by exact distances in Python integers."""
    rows = sorted(vectors)
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((distance(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v in rows:
                groups.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)) if i in groups else c for i, c in enumerate(book)]
    best = {k: [nearest(cut(v, p), books[p]) for p in range(parts)] for k, v in rows}
    return books, {k: [i for _, i in b] for k, b in best.items()}, {k: sum(d for d, _ in b) for k, b in best.items()}


@pytest.mark.parametrize("width,spread", [(1, 3.0), (4, 0.02), (5, 1000.0)])
def test_codes_against_brute_force(spark, width, spread):
    r = random.Random(width)
    vectors = [(i * 3 % 211, [float(r.choice([r.gauss(0, spread), 0.25, -1.5])) for _ in range(16 * width)]) for i in range(211)]
    vectors += [(500 + i, vectors[i][1]) for i in range(20)]
    rows = [(i, v, i % 4 or None) for i, v in vectors]
    out = vector_codes.compress_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)).collect()
    books, codes, errors = brute_codes([(i, tuple(math.floor(256 * x) for x in v)) for i, v in vectors])
    assert {x.vec_id: x.code for x in out} == codes and {x.vec_id: x.error for x in out} == errors
    assert {x.codebooks_sha256 for x in out} == {sha(",".join(str(c) for book in books for e in book for c in e))}


def test_bounds_rule_out_most_entries():
    """Half of the entries or more are ruled out, and what was ruled out is never nearer."""
    r = np.random.default_rng(1)
    book = vector_codes.Codebook(r.integers(-5000, 5000, (64, 8)))
    x = r.integers(-5000, 5000, (3000, 8))
    entry, distance, taken = book.nearest(x)
    every = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    assert (every.argmin(axis=1) == entry).all() and (every.min(axis=1) == distance).all()
    assert taken < 0.5 * every.size  # components without any structure
    big = r.integers(-(1 << 27), 1 << 27, (500, 8))
    entry, distance, _ = vector_codes.Codebook(big[:64]).nearest(big)
    every = ((big[:, None] - big[None, :64]) ** 2).sum(axis=2)
    assert (every.argmin(axis=1) == entry).all() and (every.min(axis=1) == distance).all()


def test_codes_edges(spark, monkeypatch):
    v = [float(i % 7) for i in range(20)]
    rows = [(1, v, 1), (1, v, 1), (2, None, 1), (3, [*v[:19], None], 1), (4, [*v[:19], math.nan], 1), (5, [*v[:19], math.inf], None), (6, v[:3], 1), (7, [*v[:19], 1e30], 1), (None, v, None), (8, [-x for x in v], None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as code", "2 as _ints", "3 as Error", "4 as place")
    out = vector_codes.compress_vectors(vectors)
    found = out.collect()
    assert sorted(x.vec_id or 0 for x in found) == [0, 1, 1, 8] and {(x._ints, x.place, x.error) for x in found} == {(2, 4, 0)}
    assert len({tuple(x.code) for x in found if x.vec_id != 8}) == 1
    assert vector_codes.compress_vectors(vectors.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<float>")
    assert [(x.code, x.error) for x in vector_codes.compress_vectors(empty).collect()] == [([0] * 16, 0)]
    few = {r.vec_id: r.total for r in vector_codes.with_label_sums(out.withColumn("error", F.col("vec_id") + 1), "total").collect()}
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    salted = {r.vec_id: r.total for r in vector_codes.with_label_sums(out.withColumn("error", F.col("vec_id") + 1), "total").collect()}
    assert few == salted == {1: 4, 8: 9, None: 9}


# ---- clashing names of earlier operators ----------------------------------------------------------------------------


def test_columns_named_like_inner_ones(spark):
    docs = spark.createDataFrame([(i, "one two three four five " * 8) for i in range(3)], "doc_id bigint, text string").selectExpr("*", "7 as flags", "8 as _metadata")
    out = substring_dedup.dedup_substrings(docs).collect()
    assert {(r.flags, r._metadata) for r in out} == {(7, 8)} and sorted(r.n_removed for r in out)[1:] == [40, 40]
    out = sharding.shard_documents(docs).collect()
    assert len(out) == 3 and {(r.flags, r._metadata) for r in out} == {(7, 8)}
