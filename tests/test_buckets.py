"""Stored tables by bucket: what a merge writes, rival writers, replays, old versions."""

import threading

import pytest
from pyspark.sql import functions as F

from tallyrill.operators import merge as M
from tallyrill.operators.search import at
from tallyrill.sources import buckets as B
from tallyrill.sources import commit, schema

KINDS = "source_id bigint, external_id string, n bigint"
KEY = ("source_id", "external_id")


def rows(spark, pairs):
    return spark.createDataFrame([(1, k, n) for k, n in pairs], KINDS)


def put(new):
    """Incoming rows replace those of their key."""
    return lambda old: M.merge(old, new, KEY, {"n": F.col("n.n")})


def content(table, version=None):
    return {r.external_id: r.n for r in table.read(version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return B.BucketTable(spark, str(tmp_path / "t"), KINDS, KEY, buckets=32)


def test_only_touched_buckets(spark, table):
    assert content(table) == {} and table.version() == 0
    first = rows(spark, [(f"k{i}", i) for i in range(2000)])
    assert table.merge(first, put(first)).buckets == 32
    before = table.manifest().buckets
    some = rows(spark, [(f"k{i}", -i) for i in range(5)] + [(f"new{i}", i) for i in range(5)])
    done = table.merge(some, put(some))
    after = table.manifest().buckets
    changed = {b for b in after if after[b] != before.get(b)}
    assert done.buckets == len(changed) <= 10
    assert content(table) == {f"k{i}": i for i in range(2000)} | {f"k{i}": -i for i in range(5)} | {f"new{i}": i for i in range(5)}
    assert content(table, 1) == {f"k{i}": i for i in range(2000)}
    assert {r.n for r in table.lookup(some).collect()} == {0, -1, -2, -3, -4, 1, 2, 3, 4}
    # a bucket that is touched holds the rows it held, and no file of the others is read
    scanned = {f.split("_bucket=")[1].split("/")[0] for f in table.lookup(rows(spark, [("k7", 0)])).inputFiles() if "_bucket=" in f}
    assert len(scanned) == 1


def test_batches_and_counts(spark, table):
    a = rows(spark, [("a", 1)])
    assert table.merge(a, put(a), "w", 5, {"rows": 1}) == B.Merged(1, 1, {"rows": 1})
    b = rows(spark, [("a", 2)])
    assert table.merge(b, put(b), "w", 5, {"rows": 9}) == B.Merged(1, 0, {"rows": 1}, again=True)
    assert table.merge(b, put(b), "w", 4).again and content(table) == {"a": 1}
    assert not table.merge(b, put(b), "other", 5).again and content(table) == {"a": 2}
    assert table.done("w", 5).counts == {"rows": 1} and table.done("w", 6) is None
    # nothing came in: the batch is noted all the same
    none = a.limit(0)
    assert table.merge(none, put(none), "w", 6).buckets == 0 and table.done("w", 6) is not None and content(table) == {"a": 2}


def rival(table, monkeypatch, theirs):
    """Another writer commits theirs just before the first commit of this one."""
    real, turn = B.put_new, []

    def late(spark, path, text):
        if not turn:
            turn.append(1)
            table.merge(theirs, put(theirs))
        real(spark, path, text)

    monkeypatch.setattr(B, "put_new", late)


@pytest.mark.parametrize("same", [True, False])
def test_the_loser_merges_again(spark, table, monkeypatch, same):
    first = rows(spark, [(f"k{i}", 0) for i in range(200)])
    table.merge(first, put(first))
    number = {r.external_id: r.b for r in first.select("external_id", table.bucket().alias("b")).collect()}
    others = [k for k in number if (number[k] == number["k0"]) == same and k != "k0"]
    theirs = rows(spark, [(others[0], 7)])
    rival(table, monkeypatch, theirs)
    seen = []
    mine = rows(spark, [("k0", 1)])

    def make(old):
        seen.append(old)
        return put(mine)(old)

    assert table.merge(mine, make).version == 3
    assert content(table)["k0"] == 1 and content(table)[others[0]] == 7 and len(content(table)) == 200
    # a rival in other buckets costs only another commit
    assert len(seen) == (2 if same else 1)


def test_two_writers_lose_nothing(spark, table):
    errors = []

    def write(name):
        try:
            for i in range(3):
                new = rows(spark, [(f"{name}{i}-{j}", i) for j in range(4)] + [(f"shared{j}", i) for j in range(3)])
                table.merge(new, put(new), name, i)
        except Exception as e:  # noqa: BLE001  told below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join(240) for t in threads]
    assert not errors and table.version() == 6
    assert set(content(table)) == {f"{n}{i}-{j}" for n in "ab" for i in range(3) for j in range(4)} | {f"shared{j}" for j in range(3)}


def test_vacuum(spark, table):
    for n in range(4):
        new = rows(spark, [(f"k{i}", n) for i in range(3)])
        table.merge(new, put(new))
    rows(spark, [("x", 1)]).write.parquet(f"{table.path}/data/left-behind")
    assert table.vacuum(keep=2) == 0 and len(table.versions()) == 4
    assert table.vacuum(keep=2, older_than=-1) > 0
    assert table.versions() == [3, 4] and content(table) == {f"k{i}": 3 for i in range(3)} and content(table, 3) == {f"k{i}": 2 for i in range(3)}
    assert "left-behind" not in commit.names(spark, f"{table.path}/data")


def test_replace_and_wrong_rows(spark, table):
    new = rows(spark, [(f"k{i}", i) for i in range(50)])
    assert table.replace(new, "w", 0).version == 1 and table.replace(new.limit(1), "w", 0).again
    table.replace(table.read().where("n > 40"))
    assert sorted(content(table).values()) == list(range(41, 50))
    with pytest.raises(ValueError, match="does not touch"):
        table.merge(rows(spark, [("k41", 0)]), lambda old: table.read())
    assert table.version() == 2


def test_upserts_on_a_stored_table(spark, tmp_path):
    """Each upsert on the buckets it touches is the upsert on the whole table."""
    from tallyrill.sources.fixtures import view

    sf = "/root/testdata/sf0.001"
    listings, reviews = view(spark, sf, "listings"), view(spark, sf, "reviews")
    table = B.BucketTable(spark, str(tmp_path / "l"), schema.LISTINGS, M.KEY, buckets=16)
    whole = listings.select(*[f.name for f in spark.createDataFrame([], schema.LISTINGS).schema if f.name in listings.columns])
    missing = [f for f in spark.createDataFrame([], schema.LISTINGS).schema if f.name not in listings.columns]
    whole = whole.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(*[f.name for f in spark.createDataFrame([], schema.LISTINGS).schema])
    table.replace(whole)
    stored = table.read()
    now = at("2001-11-05")
    some = whole.where("id % 97 = 0").select(*M.KEY, "title", F.lit("Tudor").alias("brand"), "reference", (F.col("price_cents") + 1).alias("price_cents"), F.lit("USD").alias("currency"), "condition", "watch_type", "listing_url", "image_url", "region", "is_bundle", F.lit(True).alias("is_sold"), F.lit(None).cast("bigint").alias("price_min_cents"), F.lit(None).cast("bigint").alias("price_max_cents"), F.lit(1).alias("pos"), "description")
    some = spark.createDataFrame(some.collect(), some.schema)
    order = [F.col(c).cast("string") for c in stored.columns]
    same = lambda a, b: a.select(*order).exceptAll(b.select(*order)).count() == 0 and b.select(*order).exceptAll(a.select(*order)).count() == 0
    for step in (lambda old: M.upsert_forum(old, some, reviews, now), lambda old: M.upsert_overwriting(old, some, M.MARKET_TAKEN, now), lambda old: M.upsert_overwriting(old, some, M.CATALOG_TAKEN, now)):
        before = spark.createDataFrame(table.read().collect(), table.read().schema)
        table.merge(some, step)
        assert same(table.read(), step(before))
