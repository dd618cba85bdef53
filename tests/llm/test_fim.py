"""Fill-in-middle documents against a plain loop over code points."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from courtflow.llm import fim
from courtflow.llm.queries import QUERIES

MARKS = ("<P>", "<S>", "<M>")


def plainly(doc_id, text):
    text = text or ""
    n = len(text)
    said = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(said[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text


def test_op13_all_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in rows:
        *said, output, restored = plainly(r.doc_id, r.text)
        want[(*said, digest(output), digest(restored))] += 1
    assert Counter(map(tuple, QUERIES["op13_fill_in_middle"](spark, sf).collect())) == want


@pytest.mark.parametrize("alphabet", ["ab<", "aé中😀<PSM>", "中😀"])
def test_random_texts(spark, alphabet):
    rng = random.Random(len(alphabet))
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    got = fim.restore(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert Counter(map(tuple, got.collect())) == Counter(plainly(*r) for r in rows)


def test_index_converts_both_ways():
    text = "a中bé😀c" * 50 + "zz"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions(data, block=7)
    points = np.arange(len(text) + 1)
    places = index.to_bytes(points)
    assert places.tolist() == [len(text[:i].encode()) for i in points]
    assert index.to_points(places).tolist() == points.tolist()
    assert len(fim.Exceptions(np.frombuffer(b"plain", np.uint8)).places) == 0


def test_fim_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    made = fim.restore(fim.fill_in_middle(odd_docs.withColumnRenamed("row", "output").withColumnRenamed("key", "form")))
    assert Counter(map(tuple, made.collect())) == Counter(plainly(*r) for r in rows)
    assert fim.restore(fim.fill_in_middle(no_docs)).count() == 0
