"""K-d shards against a recursion over sorted rows."""

import zlib
from collections import Counter, defaultdict

import pytest

from courtflow.llm import kdshards
from courtflow.llm.queries import QUERIES

DIMS = 3


def plainly(rows, shards, first=0, whole=None):
    """{row: shard} by sorting every node along its widest dimension and cutting it at the row nearest the median."""
    value = lambda r, k: r[f"v{k}"]
    spread = [max(value(r, k) for r in rows) - min(value(r, k) for r in rows) for k in range(DIMS)] if rows else []
    whole = whole or [max(1, s) for s in spread]
    if shards == 1 or not rows:
        return {r.t3: first for r in rows}
    dim = max(range(DIMS), key=lambda k: (spread[k] / whole[k], -k))
    rows = sorted(rows, key=lambda r: (value(r, dim), r.t1, r.t2, r.t3))
    half = shards // 2
    goal = max(1, sum(r.size for r in rows) * half // shards)
    before = at = 0
    while before + rows[at].size < goal:
        before += rows[at].size
        at += 1
    if goal - before > before + rows[at].size - goal:
        at += 1
    return plainly(rows[:at], half, first, whole) | plainly(rows[at:], shards - half, first + half, whole)


@pytest.mark.parametrize("shards", [1, 2, 7, 8])
def test_cuts_are_weighted_medians(spark, sf, shards):
    rows = kdshards.points(spark.read.parquet(f"{sf}/documents.parquet"))
    want = plainly(rows.collect(), shards)
    routed = rows.withColumn("node", kdshards.F.lit(0 if shards > 1 else -1).cast("long"))
    for cuts in kdshards.kd_tree(rows, shards, DIMS, fine=10**9):
        routed = kdshards._route(routed, cuts, DIMS)
    assert {r.t3: -1 - r.node for r in routed.collect()} == want


def check(rows, docs, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards))
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return [held[k] for k in range(shards)]


def test_op12_all_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op12_kd_shards"](spark, sf).collect()
    held = check(rows, docs, 8)
    most = max(r.size for r in rows)
    assert max(held) - min(held) <= 3 * most
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert Counter(map(tuple, rows)) == Counter(map(tuple, QUERIES["op12_kd_shards"](spark, sf).collect()))


def test_copies_and_hot_values_are_split(spark):
    rows = [(i % 50 if i % 7 else None, "same text" if i % 3 else f"own {i}", "en", "hot") for i in range(4000)]
    rows += [(1, "alike", None, None)] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    held = check(kdshards.shard(docs, 8).collect(), [r[:2] for r in rows], 8)
    assert max(held) - min(held) <= 0.01 * sum(held) / 8


def test_strings_keep_their_order(spark):
    names = ["src-", "src-a", "src-ab", "src-b", "src-é", "src-中文中文", "src-中文中文x", None]
    docs = spark.createDataFrame([(i, "x", "en", s) for i, s in enumerate(names)],
                                 "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.v2 for r in kdshards.points(docs).collect()}
    assert found[7] == -1 and [found[i] for i in range(6)] == sorted(found[i] for i in range(6))
    assert len({found[i] for i in range(6)}) == 6


def test_kdshards_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clash = odd_docs.withColumnsRenamed({"row": "shard", "key": "node"})
    for shards in (1, 3, 40):
        check(kdshards.shard(clash, shards).collect(), docs, shards)
    assert kdshards.shard(no_docs).count() == 0
    check(kdshards.shard(odd_docs, 4, dims=()).collect(), docs, 4)
