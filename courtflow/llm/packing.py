"""Packing documents into windows by non-negative least squares over length combinations.

Documents are tokenized and cut into whole windows and a rest. The histogram of piece lengths, at most one count per length, is
all that the plan needs: shallow combinations of up to three lengths that fill a window are enumerated, their repeat
counts are solved against the histogram by non-negative least squares and rounded down to what is there, and what
remains is packed greedily, longest first, as templates with repeats. The plan has at most some thousand
templates, whatever the corpus. Each piece then finds its sequence and offset from its rank among the pieces of its length;
ranks are counted in parts, so a length that a third of all pieces have is no single task.
"""

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

from courtflow.llm.batches import staged_texts
from courtflow.llm.words import Text, pieces, tidy
from courtflow.session import staged

WINDOW = 4096
END = 2
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
_KNOWN = 24 << 20  # bytes of units and ids that a worker remembers
_AT_ONCE = 2000  # units in one call of the tokenizer


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 letter, 2 digit, 3 other sign; 0 for what is not split off: other than ASCII, and the apostrophe of contractions
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 0
_PROBES = ["Abc", "a.b", "x1y22z", "a--b!?c", "Don't. stop'S", "é.a1É-"]


def _separable(tokenizer):
    """Whether ids stay the same when letters are lower-cased and letters, digits and signs are taken apart."""

    def ids(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    for probe in _PROBES:
        parts = _units(Text(pa.array([probe])), True)[0].to_pylist()
        if ids(probe) != [i for part in parts for i in ids(part)]:
            return False
    return True


def _units(text, separable):
    """What is looked up, as an Arrow array, and the place of each row's first unit."""
    if not separable or b"<|" in text.data.tobytes():  # special tokens are matched as they are written
        return text.tokens(), text.first
    kind = _CLASS[text.data]
    apart = text.inside.copy()
    apart[1:] &= (kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & text.inside[:-1]
    if len(apart):
        apart[0] = False
    apart[text.starts] = True
    data = _LOWER[text.data[text.inside]]
    bounds = np.append(np.flatnonzero(apart[text.inside]), len(data)).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    return units, np.searchsorted(np.flatnonzero(apart), text.bounds)


def _last(model):
    """For each id whether it ends a word, where the model says so of every byte's sign; else None."""
    if not isinstance(model, BPE) or not model.end_of_word_suffix:
        return None
    vocabulary, suffix = Tokenizer(model).get_vocab(), model.end_of_word_suffix
    if any(sign + suffix not in vocabulary for sign in ByteLevel.alphabet()):
        return None
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return last


def _joined(tokenizer, units, last=None):
    """Ids of ``units`` in one text, flat, and the place of the unit that each id comes from.

    ``last`` tells the ids that end a word. Units have a word at least, so as many words as units are a word each.
    """
    said = tokenizer.encode(" ".join(units), add_special_tokens=False)
    ids = np.array(said.ids, np.uint32)
    if last is not None and ids.max(initial=0) < len(last):
        ends = last[ids]
        if np.count_nonzero(ends) == len(units):
            return ids, np.cumsum(ends) - ends
    sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
    begin = np.fromiter((at for at, _ in said.offsets), np.int64, len(said))
    return ids, np.searchsorted(np.cumsum(sizes), begin, side="right")


def _plain(tokenizer):
    """The tokenizer's model behind a split at spaces, where it says of lower-case ASCII words what the tokenizer says."""
    words = re.findall("[a-z]+", " ".join(_PROBES).lower())
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = WhitespaceSplit()
    same = all(np.array_equal(a, b) for a, b in zip(_joined(model, words), _joined(tokenizer, words), strict=True))
    return model if same else tokenizer


class _Known:
    """Ids of the units that a worker has met, in flat arrays; units not met before are encoded many at a time.

    A unit is found by its hash and compared by its text. That takes some 50 bytes a unit, so many more are held than in a dictionary.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.plain, self.last = tokenizer, _plain(tokenizer), _last(tokenizer.model)
        self._hold()

    def _hold(self, units=(), hashes=(), flat=(), ends=(0,)):
        """Hold ``units`` and nothing else; none of them has been met again so far."""
        hashes = np.array(hashes, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], order.astype(np.int32)
        self.units = pa.array(units, pa.large_string())
        self.flat, self.ends = np.array(flat, np.uint32), np.array(ends, np.int64)
        self.again = np.zeros(len(self.units), bool)

    def _held(self):
        return sum(x.nbytes for x in (self.hashes, self.places, self.units, self.flat, self.ends, self.again))

    def _lists(self):
        return pa.LargeListArray.from_arrays(self.ends, self.flat)

    def _forget(self):
        """Forget the units that were met only once, and all if that does not free half of the memory."""
        kept = np.flatnonzero(self.again)
        hashes = np.empty_like(self.hashes)
        hashes[self.places] = self.hashes
        said = self._lists().take(pa.array(kept))
        self._hold(self.units.take(pa.array(kept)), hashes[kept], said.values, said.offsets)
        if 2 * self._held() > _KNOWN:
            self._hold()

    def _find(self, units, hashes):
        """The place of each unit, -1 if it is not held."""
        at = np.full(len(units), -1, np.int64)
        near = np.searchsorted(self.hashes, hashes)
        hit = np.flatnonzero(near < len(self.hashes))
        hit = hit[self.hashes[near[hit]] == hashes[hit]]
        places = self.places[near[hit]]
        same = pc.equal(self.units.take(pa.array(places)), units.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        at[hit[same]] = places[same]
        return at

    def _encode(self, units):
        """Ids of ``units``, flat, and their counts."""
        simple = pc.and_(pc.ascii_is_alpha(units), pc.ascii_is_lower(units)).to_numpy(zero_copy_only=False)
        letters = pc.utf8_is_alpha(units).to_numpy(zero_copy_only=False) & ~simple
        words = units.to_numpy(zero_copy_only=False)
        ids, rows = [], []
        for tokenizer, last, which in (
            (self.plain, self.last, simple),
            (self.tokenizer, self.last, letters),
            (self.tokenizer, None, ~(simple | letters)),
        ):
            places = np.flatnonzero(which)
            for at in range(0, len(places), _AT_ONCE):
                some = places[at : at + _AT_ONCE]
                flat, of = _joined(tokenizer, words[some].tolist(), last)
                ids.append(flat)
                rows.append(some[of])
        rows = np.concatenate(rows)
        return np.concatenate(ids)[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(units))

    def ids(self, units):
        """The ids of each of the distinct ``units``, an Arrow array, as an Arrow list array."""
        hashes = Text(units).hashes()
        order = np.argsort(hashes)
        at = np.empty(len(units), np.int64)
        at[order] = self._find(units.take(pa.array(order)), hashes[order])
        self.again[at[at >= 0]] = True
        new = order[at[order] < 0]
        if len(new):
            unknown = units.take(pa.array(new))
            flat, lengths = self._encode(unknown)
            at[new] = np.arange(len(self.units), len(self.units) + len(new))
            self.units = pa.concat_arrays([self.units, unknown])
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.again = np.append(self.again, np.zeros(len(new), bool))
            where = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, where, hashes[new])
            self.places = np.insert(self.places, where, at[new])
        said = self._lists().take(pa.array(at))
        if self._held() > _KNOWN:
            self._forget()
        return said


@functools.lru_cache(maxsize=1)
def _loaded(path, changed):
    """Whether the tokenizer of ``path``, as ``changed`` then, is separable, and its ids that the worker knows; kept from task to task."""
    tokenizer = Tokenizer.from_file(path)
    return _separable(tokenizer), _Known(tokenizer)


def _token_rows(path, window):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        separable, known = _loaded(path, os.stat(path).st_mtime_ns)
        for batch in batches:
            for part in pieces(batch, "text"):
                units, first = _units(Text(part.column("text")), separable)
                coded = units.dictionary_encode()
                said = known.ids(coded.dictionary).take(coded.indices)
                upto, tokens = said.offsets.to_numpy()[first], said.values.to_numpy()
                columns = {name: [] for name in ("doc_id", "start", "length", "doc_tokens", "ids")}
                for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    ids = np.append(tokens[upto[row] : upto[row + 1]], np.uint32(END)).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        columns["doc_id"].append(doc_id)
                        columns["start"].append(at)
                        columns["length"].append(len(piece))
                        columns["doc_tokens"].append(len(ids))
                        columns["ids"].append(piece.tobytes())
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], list(columns)
                )

    return run


def tokenize(docs, path, window=WINDOW):
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit).

    ``path`` is a tokenizer file that drops white space: words apart by ASCII white space have the ids that they have in
    the text. Each document ends in id 2; a null text is empty and one piece long. A document longer than the window
    is cut into whole windows and a rest.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_token_rows(path, window)), _PIECES)


def combinations(lengths, window, nearest=4, common=64):
    """Shallow combinations (ascending tuples) of two or three of ``lengths`` that fill the window or nearly so.

    Each length is paired with the ``nearest`` longest that fit beside it; the ``common`` lengths, given first in
    ``lengths``, are tried in threes in the same way.
    """
    present = np.sort(np.asarray(lengths))
    out = set()

    def fill(parts, tries):
        at = int(np.searchsorted(present, window - sum(parts), side="right"))
        for other in present[max(0, at - tries) : at]:
            if sum(parts) + other >= 0.98 * window:
                out.add(tuple(sorted((*parts, int(other)))))

    for a in present.tolist():
        fill((a,), nearest)
    some = [int(x) for x in lengths[:common]]
    for i, a in enumerate(some):
        for b in some[i:]:
            if a + b < window:
                fill((a, b), 1)
    return sorted(out)


def solve(combos, histogram, rounds=400):
    """Non-negative least squares: repeat counts whose lengths sum to the histogram, by accelerated projected gradients."""
    lengths = sorted({x for c in combos for x in c} | set(histogram))
    place = {x: i for i, x in enumerate(lengths)}
    rows = np.array([place[x] for c in combos for x in c])
    columns = np.array([k for k, c in enumerate(combos) for _ in c])
    goal = np.array([histogram.get(x, 0) for x in lengths], float)
    scale = max(goal.max(), 1.0)
    goal = goal / scale

    def forward(x):
        return np.bincount(rows, x[columns], len(lengths))

    def back(y):
        return np.bincount(columns, y[rows], len(combos))

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(forward(y) - goal) / (1.01 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x * scale


def plan(histogram, window=WINDOW):
    """Templates [({length: pieces}, repeats)] that use every piece of {length: count} once."""
    left = {x: n for x, n in histogram.items() if n > 0 and x < window}
    templates = [({window: 1}, histogram[window])] if histogram.get(window) else []
    if left:
        often = sorted(left, key=lambda x: (-left[x] * x, x))
        combos = combinations(often, window)
        repeats = solve(combos, left) if combos else []
        for k in sorted(range(len(combos)), key=lambda k: (-repeats[k], combos[k])):
            used = {x: combos[k].count(x) for x in combos[k]}
            times = min(int(repeats[k] + 1e-6), *(left[x] // n for x, n in used.items()))
            if times > 0:
                templates.append((used, times))
                for x, n in used.items():
                    left[x] -= n * times
    while left := {x: n for x, n in left.items() if n}:
        used, room = {}, window
        for x in sorted(left, reverse=True):
            n = min(left[x], room // x)
            if n:
                used[x] = n
                room -= n * x
        times = min(left[x] // n for x, n in used.items())
        templates.append((used, times))
        for x, n in used.items():
            left[x] -= n * times
    return templates


def _places(templates):
    """For each length: first rank, first sequence, pieces per sequence and offset of the runs of ranks it is dealt out in."""
    places, ranks, sequence = {}, {}, 0
    for used, times in templates:
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            first = ranks.get(x, 0)
            places.setdefault(x, []).append((first, sequence, n, offset))
            ranks[x] = first + n * times
            offset += n * x
        sequence += times
    return {x: np.array(rows, np.int64).T for x, rows in places.items()}


def _place_rows(places):
    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for x in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == x)
                first, begin, per, where = places[x]
                row = np.searchsorted(first, ranks[at], side="right") - 1
                nth = ranks[at] - first[row]
                sequence[at] = begin[row] + nth // per[row]
                offset[at] = where[row] + nth % per[row] * x
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return run


def pack(rows, window=WINDOW):
    """Add sequence_id and offset to the pieces ``rows`` (doc_id, start, length; other columns are carried along).

    Lengths lie between 1 and the window. Sequences are numbered from 0 and their pieces leave no gap. The pieces are written
    once in the shared folder. An empty table stays empty.
    """
    rows = staged_texts(rows, "pieces")
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    counts = staged(rows.groupBy("length", "deal").count(), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "start")) - 1
    ranked = rows.withColumn("rank", rank.cast("long")).join(shifts, ["length", "deal"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("deal", "before")
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ranked.columns if c != "rank")
    places = _places(plan(histogram, window))
    return ranked.mapInArrow(tidy(_place_rows(places)), f"{schema}, sequence_id long, offset long")


def padding(packed, window=WINDOW):
    """Sequences, tokens and padding: sequences are filled up to the window, but for lengths that are a power of two."""
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count(F.col("n")) == 1
    return full.agg(
        F.count("*").alias("sequences"),
        F.sum("n").alias("tokens"),
        F.sum(F.when(power, 0).otherwise(window - F.col("n"))).alias("padding"),
    )


def sequences(packed):
    """sequence_id and the ids of each sequence, its pieces joined by offset; ``packed`` has ids."""
    pieces_of = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(pieces_of.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x.ids)).alias("ids")
    )
