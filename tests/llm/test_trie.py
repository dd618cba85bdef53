"""The conversation trie against a trie of dictionaries."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from courtflow.llm import trie
from courtflow.llm.queries import QUERIES

TURN = "conv_id long, turn long, role string, text string"


def plainly(rows):
    """Nodes of the trie by following every rebuilt conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, convs in members.items():
        up = min(members[p[:-1]]) if p else None
        said = ",".join(map(str, sorted(ends.get(p, [])))).encode()
        digest = hashlib.sha256(said).hexdigest()
        out[(min(convs), len(p), up, len(convs), children[p], leaves[p], saved[p], digest)] += 1
    return out


def some_talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(3 * n), n):
        length = rng.choice([1, 2, 5, 9, 30]) if rng.random() < 0.9 else 80
        same = rng.random() < 0.3
        for turn in range(length):
            said = f"t{turn}" if same else rng.choice(["a", "é", "", None])
            rows.append((conv, turn, rng.choice(["user", None]) if not same else "user", said))
    rng.shuffle(rows)
    return rows


def test_op11_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = QUERIES["op11_conversation_trie"](spark, sf)
    assert Counter(map(tuple, got.collect())) == plainly(rows)


@pytest.mark.parametrize("cut", [{}, {"fragment": 5, "shards": 10**9, "band": 3, "limit": 7}, {"fragment": 1, "shards": 10**9}])
def test_fragments_change_nothing(spark, cut):
    rows = some_talks(len(cut), 150)
    got = trie.conversation_trie(spark.createDataFrame(rows, TURN).repartition(4), **cut)
    assert Counter(map(tuple, got.collect())) == plainly(rows)


def test_trie_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, None, None), (0, None, "x", "first"), (1, 0, "user", "hi"), (1, 0, "user", "hi"),
        (5, 7, "", ""), (6, 7, "", ""), (7, 5, None, None), (8, 1, "user", "y" * 300_000), (None, 1, "user", "lost"),
        (10, None, None, None), (11, 1, "user", "z"), (1 << 40, 2, "user", "far"),
    ]
    talks = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], f"{TURN}, pos string, h1 long, depth long")
    got = trie.conversation_trie(talks.repartition(3))
    assert Counter(map(tuple, got.collect())) == plainly(rows)
    assert trie.conversation_trie(spark.createDataFrame([], TURN)).count() == 0


def test_a_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(10_000)] + [(5, t, "user", f"turn {t}") for t in range(3)]
    rows += [(9, t, "user", f"turn {t}") for t in range(50)]
    got = trie.conversation_trie(spark.createDataFrame(rows, TURN).repartition(4), fragment=64, shards=10**9, band=256)
    one = sorted(t for c, t, *_ in rows if c == 5)
    h = zlib.crc32(b"9") % 9
    two = one[:h] + list(range(50))[h:]
    shared = next(i for i, (a, b) in enumerate(zip(one, two)) if a != b)
    top = got.where("depth = 0").first()
    assert (got.count(), top.n_leaves, top.n_convs) == (1 + len(one) + len(two) - shared, 2, 2)
    assert top.saved_tokens == sum(len(f"turn {t}") for t in one[:shared])


@pytest.mark.parametrize("limit", [1, 3, 50, 10_000])
def test_spilling_queue_gives_everything_in_order(limit):
    rng = random.Random(limit)
    queue, held, out = trie.SpillingQueue(limit, runs=4), [], []
    for step in range(3000):
        item = ((step + rng.randrange(1, 500),), step)
        queue.push(item)
        held.append(item)
        while (got := queue.pop_below((step,))) is not None:
            out.append(got)
    while (got := queue.pop_below((10**9,))) is not None:
        out.append(got)
    assert out == sorted(held)
