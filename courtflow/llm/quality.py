"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic lies above a cutoff. The cutoffs come from labelled documents, per stratum
(language, null being one): one half of them proposes, for every rule, the cutoff that gains most; the other half, the holdout,
certifies the stratum's cutoffs together. They are certified when the exact (Clopper-Pearson) upper bound on the
share of good documents that any of them rejects is at most ``risk``. They are tested from much looser ones
on, all cutoffs times a common slack, and testing stops at the first failure, which keeps the error of the
whole sequence; all strata with labels share ``error`` by Bonferroni. A stratum in which nothing is certified, or that has no
labels, rejects nothing. So with probability 1 - error, the rules reject at most the share ``risk`` of good documents
in every stratum.
"""

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from courtflow.llm.batches import staged_texts
from courtflow.llm.words import IN_WORD, PIECE, STARTS_CHARACTER, Text, cut, give_back, mix, windows
from courtflow.session import staged

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_SHOUTS = np.isin(np.arange(256), list(b"!?"))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))
_FIELDS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_shouts",
    "n_digits",
]
_STRUCT = "struct<" + ",".join(f"{f}:bigint" for f in _FIELDS) + ">"
REPEAT_WINDOW = 8


def _repeated(text):
    """Per row, the words in windows that stand in the row twice or more."""
    keys = windows(text.hashes(), REPEAT_WINDOW)
    at = np.flatnonzero(text.left() >= REPEAT_WINDOW)
    row = text.rows()[at]
    keys = keys[at] ^ mix(row.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(text.starts) + 1, np.int64)
    if len(again):
        near = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        at = at[again[near] == keys]
        cover[at] += 1
        cover[at + REPEAT_WINDOW] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return inside[text.first[1:]] - inside[text.first[:-1]]


def measure(column, limit=PIECE):
    """The fields above for a text column, as an Arrow struct array."""
    parts = {f: [np.empty(0, np.int64)] for f in _FIELDS}
    for part in cut(column, limit):
        text = Text(part)

        def count(mask, text=text):
            upto = np.concatenate([[0], np.cumsum(mask)])
            return upto[text.bounds[1:]] - upto[text.bounds[:-1]]

        dup, lines = [], []
        for row in range(text.n):
            said = [x for x in text.row_bytes(row).split(b"\n") if x.strip()]
            lines.append(len(said))
            dup.append(len(said) - len(set(said)))
        parts["n_words"].append(text.counts())
        parts["word_chars"].append(count(STARTS_CHARACTER[text.data] & IN_WORD[text.data]))
        parts["n_symbols"].append(count(_SYMBOLS[text.data]))
        parts["n_dup_lines"].append(np.array(dup, np.int64))
        parts["n_repeat_words"].append(_repeated(text))
        parts["n_lines"].append(np.array(lines, np.int64))
        parts["n_upper"].append(count(_UPPER[text.data]))
        parts["n_shouts"].append(count(_SHOUTS[text.data]))
        parts["n_digits"].append(count(_DIGITS[text.data]))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(parts[f]).astype(np.int64)) for f in _FIELDS], _FIELDS)


def _statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield measure(column)
    give_back()


def statistics(column):
    """Counts of whole texts as a struct column; null counts as empty."""
    return F.arrow_udf(_statistics, _STRUCT)(column)


#: statistics that a rule bounds from above, as SQL over the fields
RULES = {
    "symbols_per_word": "n_symbols / n_words",
    "shouts_per_word": "n_shouts / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
}
#: cutoffs tried, from loose to tight
CUTOFFS = [round(4.0 * 0.88**i, 6) for i in range(60)]
#: factors on the proposed cutoffs, in the order of testing
SLACKS = [8.0, 4.0, 2.0, 1.5, 1.25, 1.1, 1.0]


def upper_bound(bad, n, error):
    """Exact upper confidence bound of a share after ``bad`` of ``n``."""
    if bad >= n:
        return 1.0

    def tail(p):
        logs = [
            math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            for k in range(bad + 1)
        ]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = bad / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if tail(middle) > error:
            low = middle
        else:
            high = middle
    return high


def _beyond(counts):
    """Documents beyond each cutoff, loosest first, from counts by the number of cutoffs exceeded.

    Cutoffs fall, so a document that exceeds k of them exceeds the last k.
    """
    every = np.array([counts.get(k, 0) for k in range(len(CUTOFFS), 0, -1)])
    return every.cumsum()


def propose(table, cost=100.0):
    """Cutoffs of a stratum, {rule: cutoff}, from {(rule, quality): {bin: documents}}.

    A good document lost weighs ``cost`` times a bad one caught.
    """
    found = {}
    for rule in RULES:
        good, bad = (table.get((rule, q), {}) for q in (1, 0))
        n_good, n_bad = sum(good.values()), sum(bad.values())
        if n_good and n_bad:
            gain = _beyond(bad) / n_bad - cost * _beyond(good) / n_good
            if gain.max() > 0:
                found[rule] = CUTOFFS[int(gain.argmax())]
    return found


def certify(n, lost, risk, error):
    """The tightest certified slack, or None; ``lost`` has the good documents lost, of n, at each of ``SLACKS``."""
    out = None
    for slack, bad in zip(SLACKS, lost, strict=True):
        if not n or upper_bound(bad, n, error) > risk:
            break
        out = slack
    return out


def _measured(docs):
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        statistics(F.col("text").cast("string")).alias("q"),
    )
    return base.select("doc_id", "lang", "q.*")


_LIMITS = pa.list_(pa.float64())


def _proposed_rows(batches):
    for batch in batches:
        found = []
        for every in batch.column("counts").to_pylist():
            table = defaultdict(dict)
            for x in every:
                table[x["rule"], x["quality"]][x["bin"]] = x["count"]
            chosen = propose(table)
            found.append([chosen.get(rule) for rule in RULES])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, _LIMITS)], ["stratum", "limits"])


def _certified_rows(risk, error):
    def run(batches):
        for batch in batches:
            found = []
            for limits, n, lost in zip(*(batch.column(c).to_pylist() for c in ("limits", "n", "lost")), strict=True):
                slack = certify(n, lost, risk, error)
                found.append(None if slack is None else [None if x is None else slack * x for x in limits])
            yield pa.RecordBatch.from_arrays([batch.column("stratum"), pa.array(found, _LIMITS)], ["stratum", "limits"])

    return run


def cutoffs(measured, labels, risk=0.02, error=0.05):
    """Certified cutoffs: stratum and limits, one number (or null) per rule, for each stratum with any.

    Every language with labels is a stratum, and so is null. They stay in Spark; what reaches the driver is their number.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = measured.join(known.where("doc_id is not null and quality in (0, 1)"), "doc_id")
    rows = rows.where("n_words > 0").withColumn("half", F.expr("crc32(cast(doc_id as string)) % 2"))
    rows = staged(rows, "labelled")
    strata = rows.select("lang").distinct().count()
    bins = [
        F.expr(f"size(filter(array({','.join(f'{c}D' for c in CUTOFFS)}), c -> coalesce({sql}, 0) > c))").alias(rule)
        for rule, sql in RULES.items()
    ]
    binned = rows.where("half = 0").select("lang", "quality", *bins)
    binned = binned.unpivot(["lang", "quality"], list(RULES), "rule", "bin")
    counts = binned.groupBy("lang", "quality", "rule", "bin").count()
    counts = counts.groupBy("lang").agg(F.collect_list(F.struct("rule", "quality", "bin", "count")).alias("counts"))
    proposed = staged(counts.mapInArrow(_proposed_rows, "stratum string, limits array<double>"), "proposed")
    held = _with_limits(rows.where("half = 1 and quality = 1"), proposed, "inner")
    losses = [F.sum(_rejected(slack).cast("long")) for slack in SLACKS]
    tested = held.groupBy("stratum", "limits").agg(F.count("*").alias("n"), F.array(*losses).alias("lost"))
    certified = tested.mapInArrow(_certified_rows(risk, error / max(1, strata)), "stratum string, limits array<double>")
    return staged(certified.where("limits is not null"), "cutoffs")


def _with_limits(rows, limits, how="left"):
    """``rows`` with stratum and limits of their language, null being one."""
    return rows.join(limits, rows["lang"].eqNullSafe(limits["stratum"]), how)


def _rejected(slack=1.0):
    """SQL condition under which some rule rejects a row with ``limits``, times a slack."""
    terms = [
        F.coalesce(F.expr(sql), F.lit(0.0)) > F.coalesce(F.col("limits")[i] * slack, F.lit(math.inf))
        for i, sql in enumerate(RULES.values())
    ]
    out = terms[0]
    for term in terms[1:]:
        out = out | term
    return out


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def verdicts(docs, labels, risk=0.02, error=0.05):
    """One row per row of ``docs`` (doc_id, text, lang): the counts, base_failed and kept.

    ``labels`` has doc_id and quality (1 good, 0 bad; null and other values are ignored, repeated labels count once with
    the least). Null and empty texts have no words and fail the base. Too few labels certify nothing and
    then only the base rejects, as it does in a language without labels. Null ids are judged like any other row. Other columns are not read.
    """
    measured = staged_texts(_measured(docs), "quality")
    judged = _with_limits(measured, cutoffs(measured, labels, risk, error))
    judged = judged.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn(
        "kept", ~F.col("base_failed") & ~_rejected()
    )
    return judged.drop("stratum", "limits")


def keep_good(docs, labels, risk=0.02, error=0.05):
    """The rows of ``docs`` that the rules keep, all columns unchanged; the text is measured once and not shuffled."""
    measured = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        statistics(F.col("text").cast("string")).alias("q"),
    ).select("row", "doc_id", "lang", "q.*")
    measured = staged_texts(measured, "quality")
    found = cutoffs(measured.drop("row"), labels, risk, error)
    judged = _with_limits(measured.where(~F.expr(BASE_FAILED)), found)
    return judged.where(~_rejected()).select("row.*")
