"""Substring dedup with repeated-phrase automata.

A passage is a window of ``length`` consecutive words. The words of a document that lie in a window whose word
sequence also starts in a document with a smaller id are removed, judged on the input.

1. The documents are laid out in blocks of a few megabytes (a bucketed table in the shared folder), so that text is
   written once and never shuffled.
2. Every window has an anchor: the least hash among its runs of ``ANCHOR`` words. Anchors, one row per block, are
   compared over the corpus; equal windows have equal anchors, so only windows whose anchor occurs in two documents
   can recur.
3. Those windows are compared over the corpus by a 96-bit hash: the recurring passages are confirmed and get
   the smallest document id they start in.
4. Each block compiles Aho-Corasick automata of the confirmed passages that concern it, sharded by ``SHARD``
   patterns, and streams all its documents through them to locate every occurrence.

A passage that a third of all documents share costs one row per block in each shuffle, not one per document.
"""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.llm.words import Text, pieces, signed, sliding_min, windows
from courtflow.session import work_folder

ANCHOR = 6
SHARD = 50_000
BLOCK_BYTES = 4 << 20

_KEPT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def _blocks(batches):
    """Number the documents of a task by block and by place in the block."""
    task = TaskContext.get().partitionId() << 24
    number = 0
    for batch in batches:
        for part in pieces(batch, "text", BLOCK_BYTES):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task + number)), pa.array(np.arange(n)), *part.columns],
                ["block", "place", "doc_id", "text"],
            )
            number += 1


def _layout(docs):
    """The documents as a table bucketed by block, text compressed once and not shuffled."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _blocks, "block long, place long, doc_id long, text string"
    )
    name = f"passages_{uuid.uuid4().hex}"
    (
        laid.write.format("parquet")
        .option("compression", "zstd")
        .option("path", work_folder(spark, "passages"))
        .bucketBy(parts, "block")
        .sortBy("block")
        .saveAsTable(name)
    )
    return spark.table(name)


def _anchored(table, length):
    """Text, ids and, for each window that lies in one document with an id, its first word and anchor."""
    text = Text(table.column("text"))
    column = table.column("doc_id")
    known = pc.is_valid(column).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    hashes = text.hashes()
    anchors = sliding_min(windows(hashes, ANCHOR), length - ANCHOR + 1)
    at = np.flatnonzero((text.left() >= length) & np.repeat(known, text.counts()))
    return text, ids, hashes, at, anchors[at]


def _extent(keys, ids):
    """Order by key, and where each distinct key begins; least and greatest id per key."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return order, begin, ids[:0], ids[:0]
    return order, begin, np.minimum.reduceat(ids[order], begin), np.maximum.reduceat(ids[order], begin)


def _anchor_rows(length):
    def run(batches):
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop == start:
                    continue
                text, ids, _, at, anchors = _anchored(batch.slice(start, stop - start), length)
                owner = ids[text.rows()[at]]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
                anchors, owner = anchors[fresh], owner[fresh]
                order, begin, low, high = _extent([anchors], owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(begin), blocks[start])),
                        pa.array(signed(anchors[order][begin])),
                        pa.array(low),
                        pa.array(high - low),
                    ],
                    ["block", "anchor", "low", "span"],
                )

    return run


def _placed(table):
    return table.sort_by("place")


def _window_rows(length):
    """Windows of a block whose anchor recurs: hash, ids, and where one of them stands."""
    names = ["block", "h1", "h2", "low", "span", "word", "repeated"]

    def run(key, texts, anchors):
        text, ids, hashes, at, own = _anchored(_placed(texts), length)
        at = at[np.isin(signed(own), anchors.column("anchor").to_numpy())]
        h1 = windows(hashes, length)[at]
        h2 = windows(text.hashes(1), length, 1)[at].view(np.int32)[::2].copy()
        order, begin, low, high = _extent([h1, h2], ids[text.rows()[at]])
        pick = order[begin]
        return pa.table(
            [
                pa.array(np.full(len(pick), key[0].as_py())),
                pa.array(signed(h1[pick])),
                pa.array(h2[pick]),
                pa.array(low),
                pa.array(high - low),
                pa.array(at[pick]),
                pa.array(np.diff(np.append(begin, len(order))) > 1),
            ],
            names,
        )

    return run


def _characters(codes, bits):
    """Two characters per code, each digit from an alphabet of its own; code 0 is a word of no pattern.

    An automaton looks a character up among the children of a node one by one, so the alphabet is
    small; the separate alphabets let no match begin inside a word.
    """
    digits = np.empty((len(codes), 2), np.uint32)
    digits[:, 0] = (codes >> bits) + (1 << bits) + 1
    digits[:, 1] = (codes & (1 << bits) - 1) + 1
    digits[codes == 0] = 0
    return digits.tobytes().decode("utf-32-le")


def _needed(words, repeated, length):
    """Which patterns, ordered by word, to compile.

    Of a run of passages that begin one word after another and stand only there in the block, those that
    cover the run's words suffice; passages with more places in the block are all compiled.
    """
    single = ~repeated
    joined = np.zeros(len(words), bool)
    joined[1:] = single[1:] & single[:-1] & (np.diff(words) == 1)
    heads = np.flatnonzero(~joined)
    offset = np.arange(len(words)) - np.repeat(heads, np.diff(np.append(heads, len(words))))
    last = np.append(~joined[1:], True)[: len(words)]
    return repeated | last | (offset % length == 0)


def _locate(codes, stops, words, owners, length):
    """Start and owner of every occurrence of the patterns that start at ``words``.

    ``codes`` number the words of the block from 0, ``stops`` are the rows' ends in it.
    """
    import ahocorasick

    # a character of no word between the documents, so that no match crosses their border
    spaced = np.arange(len(codes)) + np.searchsorted(stops, np.arange(len(codes)), side="right")
    starts, owned = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(0, len(words), SHARD):
        heads, own = words[low : low + SHARD], owners[low : low + SHARD]
        vocabulary = np.unique(codes[(heads[:, None] + np.arange(length)).ravel()])
        bits = (len(vocabulary).bit_length() + 1) // 2
        renamed = np.zeros(codes.max() + 1, np.int64)
        renamed[vocabulary] = np.arange(len(vocabulary)) + 1
        renamed = renamed[codes]
        stream = _characters(renamed, bits)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, head in enumerate((heads * 2).tolist()):
            automaton.add_word(stream[head : head + 2 * length], i)
        automaton.make_automaton()
        apart = np.zeros(len(codes) + len(stops), np.int64)
        apart[spaced] = renamed
        pairs = automaton.iter(_characters(apart, bits))
        found = np.fromiter((x for pair in pairs for x in pair), np.int64).reshape(-1, 2)
        last = found[:, 0] // 2
        row = np.searchsorted(stops + np.arange(len(stops)), last, side="right")
        starts.append(last - row - length + 1)
        owned.append(own[found[:, 1]])
    return np.concatenate(starts), np.concatenate(owned)


def _strip(length):
    def run(key, texts, patterns):
        texts = _placed(texts)
        text = Text(texts.column("text"))
        ids = texts.column("doc_id")
        covered = np.zeros(len(text.starts) + 1, np.int64)
        if patterns.num_rows:
            patterns = patterns.sort_by("word")
            need = _needed(patterns.column("word").to_numpy(), patterns.column("repeated").to_numpy(), length)
            patterns = patterns.filter(pa.array(need))
            codes = text.tokens().dictionary_encode().indices.to_numpy().astype(np.int64)
            starts, owners = _locate(
                codes,
                text.first[1:],
                patterns.column("word").to_numpy(),
                patterns.column("owner").to_numpy(),
                length,
            )
            reader = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            starts = starts[owners < reader[text.rows()[starts]]]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + length, -1)
        gone = np.cumsum(covered)[:-1] > 0
        kept, spans = [], []
        removed = np.zeros(text.n, np.int64)
        for row in range(text.n):
            low, high = text.first[row], text.first[row + 1]
            words = text.row_bytes(row).split()
            lost = gone[low:high]
            if lost.any():
                removed[row] = lost.sum()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge])
                words = [w for w, off in zip(words, lost.tolist(), strict=True) if not off]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            [ids, pa.array(text.counts().astype(np.int64)), pa.array(removed), pa.array(kept), pa.array(spans, span)],
            ["doc_id", "n_words", "n_removed", "kept_text", "removed"],
        )

    return run


def strip_passages(docs, length=13):
    """Remove from ``docs`` (doc_id, text) every repeated passage of ``length`` words but its first owner's.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) and removed (word
    ranges, end excluded), one row per input row. A null text has no words. Rows with a null
    id own nothing and lose nothing; rows that repeat an id take nothing from each other. Texts shorter than a
    passage are kept whole. Other columns are not read. One document has to fit in a task's memory.
    """
    if length <= ANCHOR:
        raise ValueError(f"a passage has more than {ANCHOR} words")
    laid = _layout(docs)
    anchors = laid.mapInArrow(_anchor_rows(length), "block long, anchor long, low long, span long")
    same = Window.partitionBy("anchor")
    recurring = (
        anchors.withColumn("least", F.min("low").over(same))
        .withColumn("most", F.max(F.expr("low + span")).over(same))
        .where("least < most")
        .select("block", "anchor")
    )
    candidates = (
        laid.groupBy("block")
        .cogroup(recurring.groupBy("block"))
        .applyInArrow(
            _window_rows(length), "block long, h1 long, h2 int, low long, span long, word long, repeated boolean"
        )
    )
    confirmed = (
        candidates.withColumn("owner", F.min("low").over(Window.partitionBy("h1", "h2")))
        .where("low + span > owner")
        .select("block", "word", "owner", "repeated")
    )
    return laid.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(_strip(length), _KEPT)
