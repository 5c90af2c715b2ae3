"""The corpus pipeline against the parts' brute force, and what it may not lose."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tallyrill.llm import common, decontaminate, mixing, quality
from tests.llm.test_operators import brute_base, brute_contamination, brute_groups, brute_prints

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    benchmark = [(str(r.item_id), r.text) for r in common.table(spark, SF, "benchmark").collect()]
    names = docs.columns

    kept = pipeline.quality_rules(spark, docs, SF).cache()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept.columns == names and ids <= {i for i, t in texts.items() if not brute_base(t)[-1]}
    verdict = {r.doc_id for r in quality.judge_quality(docs).where("kept").select("doc_id").collect()}
    assert ids == verdict

    single = pipeline.near_dedup(spark, kept, SF).cache()
    groups = {i: i for i in sorted(ids)}
    prints = {i: brute_prints(texts[i], pipeline.NEAR_PRINTS) for i in groups}
    for k in range(pipeline.NEAR_PRINTS):
        # one fingerprint after the other, over what is linked so far
        mine = brute_groups({i: p[k] for i, p in prints.items()}, pipeline.NEAR_BITS)
        for a, b in mine.items():
            x, y = sorted((groups[a], groups[b]))
            groups = {i: x if r == y else r for i, r in groups.items()}
    assert {r.doc_id for r in single.collect()} == set(groups.values()) and single.columns == names

    clean = pipeline.decontamination(spark, single, SF).cache()
    rows = single.collect()
    found = brute_contamination([r.text for r in rows], benchmark)
    stay = {r.doc_id for r, (n, hit, _) in zip(rows, found, strict=True) if hit <= decontaminate.COVERAGE * n}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert set(after) == stay and clean.columns == names
    untouched = {r.doc_id for r, (_, hit, _) in zip(rows, found, strict=True) if not hit}
    assert all(after[i] == texts[i] for i in untouched)
    assert all(hit == 0 for _, hit, _ in brute_contamination(after.values(), benchmark))

    mixed = pipeline.source_mix(spark, clean, SF).cache()
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({i: n for i, n in plan.items() if n}) and mixed.columns == names

    last = pipeline.shards(spark, mixed, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in mixed.collect())
    whole = pipeline.run(spark, SF)
    assert whole.groupBy("doc_id").agg(F.count("*").alias("n")).exceptAll(mixed.groupBy("doc_id").agg(F.count("*").alias("n"))).count() == 0
    assert [n for n, _ in pipeline.STAGES] and len(pipeline.STAGES) == 5
