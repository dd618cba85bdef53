"""The pipeline stage by stage."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from courtflow.session import staged
from tests.llm.test_documents import WORDS, base_counts, check_packing, linked, prints


def test_stages_take_effect(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, held = docs, {}
    for name, stage in pipeline.STAGES:
        held[name] = docs = staged(stage(spark, docs, sf), name)
        assert name == "sequences" or docs.columns == given.columns
    rows = {name: df.collect() for name, df in held.items()}
    good = {r.doc_id for r in rows["quality_rules"]}
    for r in given.collect():
        n, *_, repeated = base_counts(r.text)
        assert not (r.doc_id in good and (n < 20 or 100 * repeated > 30 * n))
    before = rows["quality_rules"]
    names = linked(prints([r.text for r in before]), [r.doc_id for r in before], lambda a, b: (a ^ b).bit_count() <= 4)
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(set(names))
    secret = re.compile(r'(?i)token = "[0-9a-f]{40}"')
    assert len(rows["secrets"]) == len(rows["near_duplicates"])
    assert any(secret.search(r.text) for r in rows["near_duplicates"])
    assert not any(secret.search(r.text) for r in rows["secrets"])
    kept = {r.doc_id: r for r in rows["secrets"]}
    assert all(kept[r.doc_id] == r for r in rows["source_mix"])
    words = Counter()
    for r in rows["source_mix"]:
        words["mix"] += len(WORDS.findall(r.text))
    for r in rows["secrets"]:
        words["all"] += len(WORDS.findall(r.text))
    assert 1.3 < words["mix"] / words["all"] < 1.6
    covered, ids = check_packing(rows["sequences"], {r.doc_id: r.text for r in rows["source_mix"]})
    times = Counter(r.doc_id for r in rows["source_mix"])
    assert covered == {i: times[i] * len(x) for i, x in ids.items()}


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
