"""Burdens against plain loops over words."""

import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from courtflow.llm import toxicity

FOLDED = lambda t: toxicity.fold(t).strip()
LEXICON = {FOLDED(w): x for w, x in (("idiot", 5.0), ("idiota", 5.5), ("clown", 3.0), ("shit", 4.0), ("的", 1.0), ("傻逼", 4.5))}
LEXICON |= {"xy ": 2.0, FOLDED("le"): 1.25, FOLDED("que"): 1.5, FOLDED("the"): 1.0, FOLDED("then"): 0.0}


def of_word(word):
    """The longest entry at each place of a word where one may begin; those that overlap an earlier one don't count."""
    found, upto = 0.0, 0
    for at in range(len(word)):
        unspaced = bool(re.match("[㐀-鿿]", word[at]))
        if at < upto or (at and not unspaced):
            continue
        held = [t for t in LEXICON if (word + " ").startswith(t, at) and (not unspaced or re.match("[㐀-鿿]", t))]
        if held:
            best = max(held, key=len)
            found, upto = found + LEXICON[best], at + len(best)
    return found


def plainly(text):
    words = FOLDED(text or "").split()
    total = sum(map(of_word, words))
    for i, (a, b) in enumerate(zip(words, words[1:])):
        if [a, b] == [FOLDED("idiot"), FOLDED("proof")]:
            total -= of_word(a)
    for chunk in re.findall(r"\S+", text or ""):
        core = chunk.strip("@$!|€£¡")
        if core != chunk and re.fullmatch(r"[^\W_]+", core):
            signs = re.fullmatch(r"([@$!|€£¡]*)[^\W_]+([@$!|€£¡]*)", chunk)
            whole = toxicity._folded(signs[0]).strip()
            total += max(0.0, sum(map(of_word, whole.split())) - of_word(FOLDED(core)))
    return total / math.log2(len(words) + 2)


@pytest.mark.parametrize("text", [
    "¡idiota!", "!idiot", "$idiot", "idiota", "$hit happens", "a$$", "你这个傻逼东西", "傻逼的的", "an xy z", "xyz", "!!! ??", "",
    "an idiot proof lock, idiot", "then the theory", "le la les queue", None, "1d10t", "\U0001d422diot", "clown! clown",
])
def test_burden_of_a_text(text):
    found = toxicity._automaton(LEXICON, ("idiot proof",))
    assert toxicity.burden(text, found) == pytest.approx(plainly(text))


def test_border_signs_change_no_score():
    found = toxicity._automaton(LEXICON, ())
    same = {round(toxicity.burden(t, found), 9) for t in ("idiota", "¡idiota!", "idiota!", "!idiota", "$idiota", "|idiota|")}
    assert len(same) == 1 and same != {0.0}
    assert toxicity.burden("$hit", found) == toxicity.burden("shit", found) > toxicity.burden("hit", found) == 0
    assert toxicity.burden("你这个傻逼东西", found) > 0


def test_burdens_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = toxicity.burdens(F.col("text"), F.lit(0), LEXICON, [{}], ("idiot proof",))
    rows = docs.select("text", both.alias("b")).collect()
    plain = [r for r in rows if not re.search(r"[@$!|€£¡]", r.text or "")]
    assert len(plain) > 50 and any(r.b.burden for r in plain)
    assert all(r.b.burden == pytest.approx(plainly(r.text)) and r.b.unseen == 0 for r in plain)


def test_short_words_and_unspaced_runs_are_learned(spark):
    rows = [("the zq", 1)] * 60 + [(a + "傻逼" + b, 1) for a in "这个你我他" for b in "东西是说吗的"] * 4
    rows += [("the zqx " + "".join(p), 0) for p in itertools.permutations("这个你我他东西", 3)] * 3
    lexicon = toxicity.learn(spark.createDataFrame(rows, "words string, toxic int").repartition(3))
    found = toxicity._automaton(lexicon, ())
    assert toxicity.burden("zq", found) > 0 and toxicity.burden("你是傻逼吗", found) > 0
    assert toxicity.burden("zqx the", found) == 0 == toxicity.burden("这个东西", found)


def test_long_words_share_no_entry():
    assert len([t for t in toxicity.terms("a" * 100)]) == toxicity.LONGEST - toxicity.SHORTEST + 1
    assert "x" * 13 + "y" in toxicity.terms("x" * 13 + "yz")
