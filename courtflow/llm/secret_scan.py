"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of characters that secrets are made of, long enough and with a digit, or very long; any value that
is assigned to a credential name, whatever its length and characters; a key of a known format; the password in a URL. The
forest sees its length, character classes and transitions (also against the letter pairs of the corpus), how much of it
dictionary words of the corpus cover, the path it comes from and the words beside it. It is trained from labelled findings;
where none are given they come from the candidates themselves: assignments to a credential name, known formats and
passwords in URLs are secrets and stay so, addresses, numbers and words are none, the rest is left to the forest. Half of the findings are shown without their
neighbours, so that the forest also learns what a secret by itself looks like.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from courtflow.llm.batches import staged_texts
from courtflow.llm.words import give_back, pieces, tidy
from courtflow.session import staged

SHORTEST, LONG = 12, 24
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=.~@:%-])[A-Za-z0-9_+/=.~@:%-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_EDGES = ".=:~%-/"
_WORD = re.compile(r"[a-z]{4,12}")
_CREDENTIAL = re.compile(
    r"(?:^|[^a-z])(?:\w*_)?(token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|key|auth|authorization|bearer|"
    r"credentials?)[\"']?\s*(?:[:=]|\s)\s*[\"']?$"
)
_ASSIGNED = re.compile(r"[:=]\s*[\"']?$")
_PLACEHOLDER = re.compile(r"example|sample|dummy|test|your|placeholder|changeme|xxxx")
_ADDRESS = re.compile(r"[^@]+@[^@]+\.[A-Za-z]{2,}|(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?|[a-z]+://.*|[\d+().:/-]+")
_VALUE = re.compile(
    r"(?<![A-Za-z])(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|key|auth|authorization|bearer|credentials?)"
    r"[\"']?[ \t]*[:=][ \t]*(?:(?:bearer|basic)[ \t]+)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|(?!//)([^\s\"'<>]+))",
    re.I,
)
#: names to which nothing but secrets are assigned
_SURE = re.compile(r"(?:secret|passw(?:or)?d|pwd|api_?key|access_?key|private_?key)[\"']?\s*[:=]\s*[\"']$")
#: fixed values: formats of keys
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|"
    r"glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|"
    r"npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])"
)
_USER = re.compile(r"(?i)(?<![a-z0-9+.-])[a-z0-9+.-]+://[^\s/:@\"'<>]*:([^\s/\"'<>]+)@")
_USER_BEFORE = re.compile(r"(?i)[a-z0-9]://[^\s/:@\"'<>]*:$")
_PATH_TOKEN = re.compile(r"[/=](?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}(?:[/=:%]|$)")
FEATURES = [
    "length",
    "digits",
    "uppers",
    "lowers",
    "signs",
    "hex_share",
    "entropy",
    "distinct",
    "switches",
    "pair_score",
    "dictionary",
    "path_depth",
    "path_test",
    "credential",
    "assigned",
    "quoted",
    "placeholder",
    "near_words",
]
_NEAR = ["credential", "assigned", "quoted", "placeholder", "near_words"]
_CONTEXT = 40


def _corpus_rows(batches):
    """Letter pairs and words of a task's texts: kind, key, n."""
    pairs, words = np.zeros(1 << 16, np.int64), Counter()

    def rows(kind, found):
        keys = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([found[k] for k in keys], pa.int64())],
            ["kind", "key", "n"],
        )

    for batch in batches:
        for part in pieces(batch, "text"):
            column = pa.compute.utf8_lower(pa.compute.fill_null(part.column("text"), ""))
            text = " ".join(column.to_pylist())
            raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.int64)
            letter = (raw >= 97) & (raw <= 122)
            both = letter[1:] & letter[:-1]
            pairs += np.bincount((raw[:-1] * 256 + raw[1:])[both], minlength=1 << 16)
            tokens = pa.array(_WORD.findall(text)).value_counts() if text else []
            for x in tokens:
                words[x["values"].as_py()] += x["counts"].as_py()
            if len(words) > 100_000:
                yield rows("word", words)
                words.clear()
    yield rows("word", words)
    at = np.flatnonzero(pairs)
    yield rows("pair", {chr(k >> 8) + chr(k & 255): int(pairs[k]) for k in at})


def corpus(docs, share=2e-5):
    """(letter-pair log odds, dictionary) counted over all documents.

    Every word that makes up ``share`` of all words or more is in the dictionary, so 1 / ``share`` words at most.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(_corpus_rows), "kind string, key string, n long"
    )
    counted = staged_texts(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "corpus")
    pairs = {r.key: r.n for r in counted.where("kind = 'pair'").collect()}
    words = counted.where("kind = 'word'")
    least = share * (words.agg(F.sum("n")).first()[0] or 0)
    common = words.where(F.col("n") >= least).select("key")
    total = sum(pairs.values()) or 1
    odds = {k: math.log(n / total * 676) for k, n in pairs.items()}
    return odds, {r.key for r in common.collect()}


def _coverage(word, dictionary):
    """Share of the characters that dictionary words cover, longest first from each place."""
    at = covered = 0
    while at < len(word):
        for k in range(min(12, len(word) - at), 3, -1):
            if word[at : at + k] in dictionary:
                covered += k
                at += k
                break
        else:
            at += 1
    return covered / len(word)


def features(value, before, after, path, odds, dictionary):
    """The values of ``FEATURES`` for one candidate."""
    n = len(value)
    lower, counts = value.lower(), Counter(value)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    kinds = Counter(classes)
    pairs = [odds.get(a + b, -6.0) for a, b in zip(lower, lower[1:], strict=False) if a.isalpha() and b.isalpha()]
    head = before.lower()
    beside = (before[-24:] + " " + after[:24]).lower()
    words = [w for w in _WORD.findall(beside) if w in dictionary]
    return [
        float(n),
        kinds["d"] / n,
        kinds["u"] / n,
        kinds["l"] / n,
        kinds["s"] / n,
        sum(c in "0123456789abcdef" for c in lower) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / n,
        sum(pairs) / len(pairs) if pairs else 0.0,
        _coverage(lower, dictionary),
        float((path or "").count("/")),
        float(bool(_PLACEHOLDER.search((path or "").lower()))),
        float(bool(_CREDENTIAL.search(head))),
        float(bool(_ASSIGNED.search(head))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before and after)),
        float(bool(_PLACEHOLDER.search(beside))),
        float(len(words)),
    ]


def _label(value, row, before, after):
    """1 or 0 where the candidate itself settles it, else None."""
    at = dict(zip(FEATURES, row, strict=True))
    if not at["placeholder"] and not _PLACEHOLDER.search(value.lower()):
        if _FORMAT.fullmatch(value) or (after[:1] == "@" and _USER_BEFORE.search(before)):
            return 1
        if at["quoted"] and _SURE.search(before.lower()):
            return 1
    if at["credential"] and at["entropy"] >= 3.0 and at["digits"] > 0 and not at["placeholder"] and at["dictionary"] < 0.5:
        return 1
    if at["credential"] and at["assigned"]:
        return None
    if "://" in value and (_USER.search(value) or _PATH_TOKEN.search(value.partition("://")[2])):
        return None
    if _ADDRESS.fullmatch(value) or (value.isalpha() and not at["assigned"]) or at["dictionary"] >= 0.5:
        return 0
    return None


def _named_spans(text):
    """Spans that a credential name, a known format or the shape of a URL points out, none inside another."""
    found = [m.span() for m in _FORMAT.finditer(text)] + [m.span(1) for m in _USER.finditer(text)]
    for m in _VALUE.finditer(text):
        low, high = m.span(m.lastindex)
        if m[3]:
            high -= len(m[3]) - len(m[3].rstrip(".,;:)]}"))
            if _USER.search(text, low, high) or "://" in m[3]:
                continue  # a run or the part of a URL
        if text[low:high].strip():
            found.append((low, high))
    end = -1
    for low, high in sorted(found, key=lambda x: (x[0], -x[1])):
        if low >= end:
            yield low, high
            end = high


def candidates(text):
    """(start, end) of the candidates of a text, in characters; they do not overlap."""
    named = list(_named_spans(text))
    yield from named
    at = 0
    for m in _RUN.finditer(text):
        low, high = m.span()
        while at < len(named) and named[at][1] <= low:
            at += 1
        if at < len(named) and named[at][0] < high:
            continue
        value = m[0]
        high -= len(value) - len(value.rstrip(_EDGES))
        low += len(value) - len(value.lstrip(_EDGES))
        name, mark, rest = text[low:high].partition("=")
        if mark and rest.strip("=") and _CREDENTIAL.search(name.lower() + "="):  # name=value without a space
            low += len(name) + 1
        if high - low >= SHORTEST and (high - low >= LONG or _DIGIT.search(text, low, high)):
            yield low, high


def _candidate_rows(odds, dictionary):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out = {k: [] for k in ("doc_id", "key", "start", "end", "value", "label")}
                rows = []
                for doc_id, key, path, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for low, high in candidates(text or ""):
                        value = text[low:high]
                        before, after = text[max(0, low - _CONTEXT) : low], text[high : high + _CONTEXT]
                        row = features(value, before, after, path, odds, dictionary)
                        rows.append(row)
                        label = _label(value, row, text[max(0, low - 10 * _CONTEXT) : low], after)
                        for name, x in zip(out, (doc_id, key, low, high, value, label), strict=True):
                            out[name].append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
                columns = np.array(rows, float).reshape(-1, len(FEATURES)).T
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)), *map(pa.array, columns)],
                    [*out, *FEATURES],
                )

    return run


def _sample(findings, most):
    """At most ``most`` findings of each label, those with the least hashes, half of them without their neighbours."""
    mark = F.xxhash64("value", "doc_id", "start")
    some = None
    for label in (0, 1):
        part = findings.where(F.col("label") == label).withColumn("h", mark).orderBy("h", "value", "start").limit(most)
        some = part if some is None else some.unionByName(part)
    hidden = {c: F.when(F.col("h") % 2 == 0, F.col(c)).otherwise(0.0) for c in _NEAR}
    return staged(some.withColumns(hidden).select("label", "h", *FEATURES), "findings")


def assemble(rows):
    """``rows`` with the vector of their features."""
    from pyspark.ml.feature import VectorAssembler  # here, so that workers don't load it

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(findings, most=20_000, trees=40, depth=8, seed=11):
    """A forest from labelled ``findings`` (label, value, doc_id, start and the features), or None without both labels.

    It is fitted on at most ``most`` findings of each label.
    """
    some = _sample(findings, most)
    if some.select("label").distinct().count() < 2:
        return None
    rows = some.withColumn("label", F.col("label").cast("double")).coalesce(1).sortWithinPartitions("h", *FEATURES)
    rows = assemble(rows).select("label", "features")
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3)
    return forest.fit(rows)


def scan(docs, labelled=None, threshold=0.5, path="source", share=2e-5, most=20_000):
    """All candidates of ``docs`` (doc_id, text and the ``path`` column) with the forest's verdict.

    Returns doc_id, key (hash of the row's id and text), start, end (characters), value, probability and is_secret.
    ``labelled`` (doc_id, start, label) gives labels to candidates; without it they label themselves. If
    these are of one kind only, self-labelled secrets are kept and nothing else. Null and empty texts have no
    candidates; rows that repeat are scanned each; a null path is an empty one.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _key().alias("key"),
        F.col(path).cast("string").alias("path"),
        F.col("text").cast("string").alias("text"),
    )
    odds, dictionary = corpus(docs, share)
    schema = "doc_id long, key long, start long, end long, value string, label int, " + ", ".join(
        f"{f} double" for f in FEATURES
    )
    found = staged_texts(rows.mapInArrow(tidy(_candidate_rows(odds, dictionary)), schema), "candidates")
    findings = found
    if labelled is not None:
        given = labelled.select("doc_id", "start", F.col("label").cast("int").alias("label"))
        findings = found.drop("label").join(given.dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
    model = train(findings, most)
    if model is None:
        chance = F.coalesce(F.col("label"), F.lit(0)).cast("double")
        scored = found.withColumn("probability", chance)
    else:
        scored = model.transform(assemble(found))
        from pyspark.ml.functions import vector_to_array

        scored = scored.withColumn("probability", vector_to_array("probability")[1])
        if labelled is None:
            scored = scored.withColumn("probability", F.when(F.col("label") == 1, 1.0).otherwise(F.col("probability")))
    return scored.select("doc_id", "key", "start", "end", "value", "probability").withColumn(
        "is_secret", F.col("probability") >= threshold
    )


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _replaced(mark):
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, every in columns:
            out = []
            for text, spans in zip(texts.to_pylist(), every.to_pylist(), strict=True):
                for span in sorted(spans or (), key=lambda s: -s["start"]):
                    text = text[: span["start"]] + mark + text[span["end"] :]
                out.append(text)
            yield pa.array(out, pa.string())
        give_back()

    return F.arrow_udf(run, "string")


def redact(docs, mark="<SECRET>", **options):
    """``docs`` with every secret of its texts replaced by ``mark``; all rows and columns stay, n_chars follows the text."""
    secrets = scan(docs, **options).where("is_secret")
    spans = secrets.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _key().alias("key"))
    said = F.col("row").getField("text").cast("string")
    rows = rows.join(spans, "key", "left")
    # only texts with secrets go through Python
    text = _replaced(mark)(F.when(F.col("spans").isNotNull(), said), F.coalesce("spans", F.array()))
    text = F.when(F.col("spans").isNull(), said).otherwise(text)
    rows = rows.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])
