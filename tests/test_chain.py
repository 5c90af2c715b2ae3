"""The ingest chain: all steps on stored tables, replays, crashes between steps, counters against SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyrill.operators import merge as M
from tallyrill.operators.search import at
from tallyrill.sources import feeds, paged, schema
from tallyrill.sources.buckets import BucketTable
from tallyrill.streaming.chain import Chain

CONTEXTS = "post_id string, ok boolean, self_text string, op_comment string, flair string"
LABELS = "id bigint, condition string, condition_confidence double, watch_type string, watch_type_confidence double"


def post(i, title, body="", **more):
    return {"id": i, "title": title, "selftext": body, "permalink": f"/{i}", "author": f"by-{i}", "created_utc": float(int(i[1:])), "link_flair_text": "WTS"} | more


POSTS = [
    post("p1", "[WTS] [CA] Omega Speedmaster 145.022 $4,500", "Excellent condition"),
    post("p2", "[WTS] Omega Seamaster", "very nice"),
    post("p3", "[WTS] Seiko SARB033", "no price here"),
    post("p4", "[WTB] looking for a Rolex", "pay well", link_flair_text="WTB"),
    post("p5", "[WTS] watch without a name", "asking $300", link_flair_text="Under $500"),
    post("p6", "[WTS] Tudor Pelagos $2,900", "worn twice"),
    post("p7", "[WTS] removed", removed_by_category="moderator"),
    post("p2", "[WTS] Omega Seamaster 166.0168", "very nice", created_utc=99.0),
]
COMMENTS = [("p2", True, None, "Asking $1,200, BNIB", None), ("p3", True, None, "thanks for looking", None), ("p5", False, None, "Rolex", None)]
LOCAL = {"p6": ("good", 0.91), "p3": ("fair", 0.40)}
SAID = {"SARB033": '{"condition": "fair", "watch_type": null, "confidence": 0.8}', "without a name": '{"condition": "good", "confidence": 0.5}'}


@pytest.fixture
def parts(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), schema.LISTINGS, M.KEY, buckets=8)
    asked = []

    def contexts(due):
        asked.append(sorted(r.external_id for r in due.collect()))
        return spark.createDataFrame(COMMENTS, CONTEXTS)

    def local(rows):
        found = [(r.id, *LOCAL.get(k, (None, None)), None, None) for r in rows.collect() for k in [next((p["id"] for p in POSTS if p["title"] == r.title), "")]]
        return spark.createDataFrame(found, LABELS)

    def ask(texts):
        return [next((v for k, v in SAID.items() if k in t), None) for t in texts]

    chain = Chain(table, str(tmp_path / "s"), 7, lambda: spark.createDataFrame([], schema.REVIEWS), lambda: at("2024-01-01"), contexts, local, ask)
    raw = lambda posts: spark.read.schema(schema.POSTS).json(spark.sparkContext.parallelize([json.dumps(p) for p in posts]))
    return table, chain, raw, asked


def stored(table):
    return {r.external_id: r for r in table.read().collect()}


def test_all_steps(spark, parts):
    table, chain, raw, asked = parts
    counts = chain.run(raw(POSTS), 0)
    got = stored(table)
    assert set(got) == {"p1", "p2", "p3", "p5", "p6"} and asked == [["p2", "p3", "p5", "p6"]]
    # comments give a price and a condition, and what the last version of a post says counts
    assert (got["p2"].price_cents, got["p2"].condition, got["p2"].condition_source, got["p2"].reference) == (120000, "unworn", "regex", "166.0168")
    assert got["p3"].description.endswith("thanks for looking") and got["p5"].brand is None
    # local labels from the thresholds on, then the outside model for the rest
    assert (got["p6"].condition, got["p6"].condition_source, float(got["p6"].condition_confidence), float(got["p6"].local_confidence)) == ("good", "local", 0.91, 0.91)
    assert (got["p3"].condition, got["p3"].condition_source, got["p3"].classifier_source) == ("fair", "ai", "ai")
    assert got["p5"].condition is None and got["p1"].classifier_source == "regex"
    assert counts["rescue"] == {"attempted": 4, "read": 2, "patched": 2, "priced": 1, "sold": 0}
    assert counts["local"] == {"calls": 4, "labelled": 1} and counts["outside"] == {"calls": 3, "labelled": 1}


def test_counters_equal_sql(spark, parts):
    table, chain, raw, _ = parts
    counts = chain.run(raw(POSTS), 0)["merge"]
    posts = duckdb.connect()
    posts.execute("create table posts as select unnest(from_json(?, '[{\"title\": \"VARCHAR\", \"selftext\": \"VARCHAR\", \"link_flair_text\": \"VARCHAR\", \"removed_by_category\": \"VARCHAR\"}]'), recursive := true)", [json.dumps(POSTS)])
    offer = "removed_by_category IS NULL AND (link_flair_text ILIKE 'wts%' OR title ILIKE '[wts]%')"
    sql = f"""SELECT count(*), count(*) FILTER ({offer}), count(*) FILTER ({offer} AND (title || ' ' || selftext LIKE '%$%' OR link_flair_text LIKE '%$%')), count(*) FILTER ({offer} AND regexp_matches(title, 'Omega|Seiko|Tudor|Rolex')) FROM posts"""
    assert tuple(counts[k] for k in ("fetched", "offers", "priced", "branded")) == posts.sql(sql).fetchall()[0]


def test_replay_changes_nothing(spark, parts):
    table, chain, raw, asked = parts
    counts = chain.run(raw(POSTS), 0)
    before, version = stored(table), table.version()
    assert chain.run(raw(POSTS), 0) == counts and table.version() == version and stored(table) == before and len(asked) == 1


@pytest.mark.parametrize("step", ["rescue", "local", "outside"])
def test_crash_between_steps(spark, parts, monkeypatch, step):
    """A batch that dies in a step takes up there: what was committed is not done again, and the result is that of one run."""
    table, chain, raw, asked = parts
    real = BucketTable.merge

    def dies(self, incoming, make, writer=None, batch=None, counts=None):
        if writer == f"7-{step}":
            raise RuntimeError("lost")
        return real(self, incoming, make, writer, batch, counts)

    monkeypatch.setattr(BucketTable, "merge", dies)
    with pytest.raises(RuntimeError, match="lost"):
        chain.run(raw(POSTS), 0)
    middle = table.version()
    monkeypatch.setattr(BucketTable, "merge", real)
    counts = chain.run(raw(POSTS), 0)
    assert middle == {"rescue": 1, "local": 2, "outside": 3}[step] and table.version() == 4 and counts["outside"] == {"calls": 3, "labelled": 1}
    got = stored(table)
    assert (got["p2"].price_cents, got["p6"].condition, got["p3"].condition) == (120000, "good", "fair")
    assert len(asked) == (2 if step == "rescue" else 1)


def test_stream_from_forum_to_table(spark, parts, tmp_path):
    """Pages of a forum through the log and the chain, two starts; labels that are there stay."""
    table, chain, _, _ = parts
    pages = {None: (POSTS[:4], "p4"), "p4": (POSTS[4:], None)}

    def get(url, _headers):
        items, after = next(v for k, v in pages.items() if (f"after={k}" in url) == (k is not None))
        return paged.Answer(200, json.dumps({"data": {"children": [{"kind": "t3", "data": p} for p in items], "after": after}}))

    spark.dataSource.register(paged.paged_source("chain_forum", paged.ForumApi("http://forum", "w"), str(tmp_path / "log"), get=get, sleep=lambda s: None))
    reports = []
    for _ in range(2):
        q = chain.start(paged.stream_items(spark, "chain_forum", schema.POSTS), str(tmp_path / "c"), report=lambda n, c: reports.append((n, c)))
        q.awaitTermination(240)
        assert q.exception() is None
    assert [n for n, _ in reports] == [0] and reports[0][1]["merge"]["fetched"] == 8
    assert stored(table)["p2"].price_cents == 120000
    assert feeds.health(spark).first().ok == 1 and table.read().where(F.col("id").isNull()).count() == 0


def test_empty_batch(spark, parts):
    table, chain, raw, _ = parts
    counts = chain.run(raw([POSTS[3]]), 0)
    assert counts["merge"] == {"fetched": 1, "offers": 0, "priced": 0, "branded": 0} and counts["outside"] == {"calls": 0, "labelled": 0}
    assert table.read().count() == 0
