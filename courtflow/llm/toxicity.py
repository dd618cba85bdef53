"""Toxicity by a weighted lexicon.

Texts are folded: case, accents, look-alike letters of other scripts and digits or signs that stand for letters are
undone, invisible characters dropped, everything else between words becomes a space. Letters that one sign can
stand for alike share one form (i, l and 1 are all i). A sign such as ! or $ is a letter only inside a word; a word with such signs at its
border is read without them and with them, and counts as what weighs more.

The lexicon holds word beginnings of three letters or more, whole shorter words, and in scripts without spaces any run of characters,
with weights learned from labelled documents: the logarithm of how much more often a toxic document has them. An
Aho-Corasick automaton finds them in whole texts; in each word the longest entry counts. Entries inside an exception
phrase, given or learned, do not count. The sum of weights is normalised by length, and a logistic curve turns it into a score. The
curve is fitted on training rows too, but on burdens by lexicons learned without them.
"""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from courtflow.session import staged

#: word beginnings go up to LONGEST letters; words of fewer than SHORTEST letters are entries as a whole
SHORTEST, LONGEST = 3, 32
UNSPACED_LONGEST = 6
#: fixed values: look-alikes of Latin letters in Greek and Cyrillic, after lower-casing
_HOMOGLYPHS = dict(
    zip(
        "αβγεζηικνορτυχωасԁеһіјӏмոорԛѕтυѵԝхуґвкнгзбп",
        "abyezniknoptuxwacdehijlmnopqstuvwxyrbkhr3bn",
        strict=True,
    )
)
#: fixed values: signs and digits that stand for letters
_SIGNS = dict(zip("01345789@$!|€£¡ıł", "oieastbgasiielil" + "i", strict=True))
_SAME = {"l": "i", "j": "i"}
#: fixed values: those of them that are punctuation at the border of a word
_BORDER = "@$!|€£¡"
#: fixed values: scripts written without spaces (Thai, Lao, Burmese, Khmer, kana and Han)
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
_GONE, _SPACE = 0, 32
_TABLE = []


def _fold_one(code):
    """The folded form of one character: a code point, a space, or none."""
    c = chr(code)
    kind = unicodedata.category(c)
    if kind in ("Mn", "Me", "Cf"):
        return _GONE
    c = unicodedata.normalize("NFKD", c)[:1].lower()[:1]
    c = _HOMOGLYPHS.get(c, c)
    c = _SIGNS.get(c, c)
    c = _SAME.get(c, c)
    return ord(c) if unicodedata.category(c)[0] == "L" else _SPACE


_BORDERS = re.compile(f"[{_BORDER}]+")


def _inner(run):
    """What a run of border signs stands for: itself between letters or digits, else a space."""
    low, high, text = run.start(), run.end(), run.string
    return run[0] if text[low - 1 : low].isalnum() and text[high : high + 1].isalnum() else " "


def fold(text):
    """Letters and spaces only; starts and ends with a space. Signs at the border of a word are none of its letters."""
    return _folded(_BORDERS.sub(_inner, text))


def edged(text):
    """Words with signs at their border, as (folded without them, folded with them)."""
    upto = 0
    for m in _BORDERS.finditer(text):
        if m.start() < upto:
            continue
        low, upto = m.start(), m.end()
        while low and text[low - 1].isalnum():
            low -= 1
        while upto < len(text) and (text[upto].isalnum() or text[upto] in _BORDER):
            upto += 1
        word = text[low:upto]
        without = word.strip(_BORDER)
        if without and without != word:
            yield _folded(without).strip(), _folded(word).strip()


def _folded(text):
    if not _TABLE:
        table = np.arange(0x110000, dtype=np.uint32)
        for low, high in ((0, 0x3400), (0xFB00, 0xFFFE), (0x1D400, 0x1D800), (0xE0000, 0xE0200)):
            table[low:high] = [_fold_one(c) for c in range(low, high)]
        _TABLE.append(table)
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    return " " + codes[codes != _GONE].tobytes().decode("utf-32-le") + " "


def _word_sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([" ".join(sorted(_words(t or ""))) for t in column.to_pylist()], pa.string())


def _words(text):
    return set(fold(text).split()) | {w for _, with_signs in edged(text) for w in with_signs.split()}


def terms(word):
    """What an entry can be in a word: beginnings, a short word with a space behind it, runs of unspaced characters."""
    out = [word + " "] if len(word) < SHORTEST else [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]
    for m in () if word.isascii() else _UNSPACED.finditer(word):
        out += [word[m.start() : m.start() + k] for k in range(1, min(UNSPACED_LONGEST, len(word) - m.start()) + 1)]
    return out


def _count_rows(batches):
    """Documents per entry, label and fold, summed per task; ``words`` holds a document's distinct folded words."""
    found = Counter()

    def rows():
        keys = list(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([found[k] for k in keys], pa.int64()),
            ],
            ["term", "toxic", "fold", "n"],
        )

    for batch in batches:
        for words, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("words", "toxic", "fold")), strict=True):
            found.update((t, toxic, part) for t in {t for w in words.split() for t in terms(w)})
            if len(found) > 500_000:
                yield rows()
                found.clear()
    yield rows()


def _counted(rows, folds):
    """term, and how many toxic (n0, n1 ...) and clean documents (c0, c1 ...) of each fold have it; counted once for all lexicons."""
    counts = rows.select("words", "toxic", "fold").mapInArrow(_count_rows, "term string, toxic int, fold int, n long")
    of = lambda t, k: F.when((F.col("toxic") == t) & (F.col("fold") == k), F.col("n")).otherwise(0)
    sums = [F.sum(of(t, k)).alias(f"{name}{k}") for t, name in ((1, "n"), (0, "c")) for k in range(folds)]
    return counts.groupBy("term").agg(*sums)


#: log-likelihood gained by giving a word beginning its own toxic share, n of n + c, over the base share
_EVIDENCE = (
    "if(n > 0, n * ln(n / ((n + c) * {base}D)), 0D) + if(c > 0, c * ln(c / ((n + c) * (1 - {base}D))), 0D)"
)


def learn(rows, weight=3.0, evidence=14.0):
    """Lexicon {word beginning: weight} from ``rows`` (words, toxic), words distinct and folded; weight 0 marks a learned exception.

    All rows are counted and all beginnings tested, in Spark: what is taken gains ``evidence`` in log-likelihood, however
    small its part of the toxic documents, and weighs ``weight`` or more. A beginning is taken as long as it can be
    without losing a twentieth of its toxic documents; longer ones are added where they weigh clearly more. Exceptions
    are beginnings with as much evidence for clean documents, under an entry. Only what passes reaches the driver.
    """
    rows = rows.withColumn("fold", F.lit(0))
    return _learned(_counted(rows, 1), _sizes(rows), [0], weight, evidence)


def _sizes(rows):
    return {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}


def _learned(counted, sizes, folds, weight=3.0, evidence=14.0):
    """The lexicon of ``learn`` from the counts of some folds."""
    n_toxic, n_clean = (sum(sizes.get((t, k), 0) for k in folds) for t in (1, 0))
    if not n_toxic or not n_clean:
        return {}
    n, c = (sum((F.col(f"{name}{k}") for k in folds[1:]), F.col(f"{name}{folds[0]}")) for name in "nc")
    counted = counted.select("term", n.alias("n"), c.alias("c")).where("n + c > 0")
    base = n_toxic / (n_toxic + n_clean)
    weighed = F.expr(f"ln((n + 0.5D) / {n_toxic + 1}D) - ln((c + 0.5D) / {n_clean + 1}D)")
    passed = counted.withColumn("w", weighed).where(F.expr(_EVIDENCE.format(base=base)) >= evidence)
    passed = staged(passed.where((F.col("w") >= weight) | (F.col("w") < 0)).select("term", "n", "w"), "beginnings")
    heavy = passed.where(F.col("w") >= weight)
    longer = heavy.groupBy(F.expr("left(term, length(term) - 1)").alias("stem")).agg(F.max("n").alias("most"))
    kept = heavy.join(longer, F.col("term") == F.col("stem"), "left").where("most is null or most < 0.95D * n")
    kept = staged(kept.select("term", "w"), "entries")
    light = passed.where("w < 0 and length(term) > 1")
    shorter = F.expr("transform(sequence(1, length(term) - 1), k -> left(term, k))")
    light = light.select("term", "w", F.explode(shorter).alias("stem")).join(kept.select(F.col("term").alias("stem")), "stem")
    weights = {r.term: r.w for r in kept.union(light.select("term", "w").distinct()).collect()}
    out = {}
    for term in sorted(weights, key=lambda t: (len(t), t)):
        w = weights[term]
        stem = next((out[term[:k]] for k in range(len(term) - 1, 0, -1) if term[:k] in out), None)
        if w < 0:
            if stem:
                out[term] = 0.0
        elif stem is None or w >= stem + 0.7:
            out[term] = w
    return out


def _automaton(lexicon, phrases):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, w in lexicon.items():
        if _UNSPACED.match(term):
            found.add_word(term, (len(term) - 1, w))
        else:
            found.add_word(" " + term, (len(term), w))
    for phrase in phrases:
        folded = " ".join(fold(phrase).split())
        if folded:
            found.add_word(f" {folded} ", (len(folded) + 1, None))
    if len(found):
        found.make_automaton()
        return found
    return None


def _weight(folded, automaton):
    """Sum of the weights of the entries in folded words with a space before, between and after them."""
    best, spared = {}, []
    for end, (length, w) in automaton.iter(folded):
        if w is None:
            spared.append((end - length, end))
        else:
            best[end - length] = (end, w)  # a longer entry of the same place comes later
    for low, high in spared:
        for at in [at for at in best if low <= at < high]:
            del best[at]
    total, upto = 0.0, -1
    for at in sorted(best):
        if at >= upto:  # entries of scripts without spaces may overlap: the first counts
            total += best[at][1]
            upto = best[at][0]
    return total


def burden(text, *automata):
    """Sum of the weights in a text, normalised by the logarithm of its length in words; a list of them for several automata."""
    words = fold(text or "").split()
    line, signs = f" {' '.join(words)} ", list(edged(text or ""))
    out = []
    for automaton in automata:
        total = _weight(line, automaton) if automaton is not None and words else 0.0
        if automaton is not None:
            for without, whole in signs:
                total += max(0.0, _weight(f" {whole} ", automaton) - _weight(f" {without} ", automaton))
        out.append(total / math.log2(len(words) + 2))
    return out[0] if len(out) == 1 else out


def burdens(text, fold_of, lexicon, parts, phrases):
    """burden of a text column by ``lexicon``, and unseen, that by the lexicon among ``parts`` that ``fold_of`` names."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        whole, automata = _automaton(lexicon, phrases), [_automaton(part, phrases) for part in parts]
        for texts, folds in columns:
            found = [
                (burden(t, whole), None) if k is None else burden(t, whole, automata[k])
                for t, k in zip(texts.to_pylist(), folds.to_pylist(), strict=True)
            ]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
            yield pa.StructArray.from_arrays(columns, ["burden", "unseen"])

    return F.arrow_udf(run, "struct<burden:double,unseen:double>")(text, fold_of)


_BINS = 200  # of a burden's logarithm, to the fortieth


def calibrate(counts):
    """Logistic curve (a, b) over log1p of the burden from {(bin, toxic): documents}; the slope is not negative."""
    x = np.array([k / 40 for k, _ in counts])
    y = np.array([t for _, t in counts], float)
    n = np.array(list(counts.values()), float)
    if len(set(y)) < 2:
        return (-1.0, 0.0) if not y.any() else (1.0, 0.0)
    w = np.zeros(2)
    A = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(A @ w, -30, 30)))
        grad = A.T @ (n * (p - y)) + 1e-2 * w
        hess = (A * (n * p * (1 - p))[:, None]).T @ A + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


#: ordinary phrases with a word that is an insult elsewhere
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "pond scum")


def score(docs, labels, phrases=EXCEPTIONS, folds=2):
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic (1 or 0; other values are ignored, repeated labels count once with the greatest).
    Learned from are labelled rows whose crc32 of the doc_id's text, modulo 3, is not 1; a null doc_id is never held out
    and has no label. Null and empty texts have no burden and get the least score. Without labels of both kinds
    every score is the same. Repeated rows are scored each. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.expr("crc32(cast(cast(doc_id as bigint) as string)) % 3 = 1"), F.lit(False)).alias("held_out"),
    )
    marks = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    # one shuffle of the distinct words, none of the texts; the same join at every size
    words = rows.where("not held_out").select("doc_id", F.arrow_udf(_word_sets, "string")("text").alias("words"))
    fold_of = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    known = staged(words.join(marks.hint("merge"), "doc_id").select("words", "toxic", fold_of.alias("fold")), "words")
    counted, sizes = staged(_counted(known, folds), "counts"), _sizes(known)
    lexicon = _learned(counted, sizes, list(range(folds)))
    parts = [_learned(counted, sizes, [j for j in range(folds) if j != k]) for k in range(folds)]  # what the other folds teach
    both = burdens(F.col("text"), F.when(~F.col("held_out"), fold_of), lexicon, parts, phrases)
    found = staged(rows.select("doc_id", "held_out", both.alias("b")).select("doc_id", "held_out", "b.*"), "burdens")
    at = F.least(F.round(F.log1p("unseen") * 40).cast("int"), F.lit(_BINS)).alias("bin")
    binned = found.where("not held_out").join(marks, "doc_id").select("toxic", at).groupBy("bin", "toxic").count()
    counts = {(r.bin, r.toxic): r["count"] for r in binned.collect()}
    a, b = calibrate(counts) if counts else (-1.0, 0.0)
    chance = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p(F.col("burden")))))
    return (
        found.withColumn("score", chance)
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
        .select("doc_id", "held_out", "score", "predicted", "burden")
    )
