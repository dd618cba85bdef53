"""Words, word hashes and window hashes of whole Arrow columns of text, in numpy.

A word is a run of bytes other than ASCII white space, taken unchanged. Memory is about 60 bytes per
byte of text at hand, so callers cut batches with ``pieces`` first, and workers that live on keep little.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
IN_WORD = np.ones(256, bool)
IN_WORD[list(SPACES)] = False
STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80  # bytes that are not UTF-8 continuations

_DRAWN = np.random.Generator(np.random.PCG64(20240607))
_TABLES = [_DRAWN.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_powers = {}
PIECE = 1 << 19  # bytes of text at hand


def _power(which, n):
    """The first n powers of a base and of its inverse modulo 2**64; those that a piece needs are kept per process."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = tuple(out)
        if size == PIECE:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def mix(h):
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def give_back():
    """Return freed memory to the system, where the C library and Arrow can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not that C library


def tidy(rows):
    """``rows`` from batches to batches for a worker that lives on: when a task ends, freed memory goes back to the system."""

    @functools.wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def _cuts(column, limit):
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to - at
        at = to


def pieces(batch, column, limit=PIECE):
    """Cut a record batch into slices of about ``limit`` bytes of text, one row at least."""
    for at, n in _cuts(batch.column(column), limit):
        yield batch.slice(at, n)


def cut(column, limit=PIECE):
    """Cut a text column in the same way."""
    for at, n in _cuts(column, limit):
        yield column.slice(at, n)


class Text:
    """The bytes of a text column (null: empty) and where its words begin and end."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = n = len(column)
        if n:
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
            self.data = data[bounds[0] : bounds[-1]]
            self.bounds = bounds - bounds[0]
        else:
            self.data, self.bounds = np.empty(0, np.uint8), np.zeros(1, np.int64)
        inside = IN_WORD[self.data]
        starts, ends = inside.copy(), inside.copy()
        cuts = self.bounds[1:-1]
        if len(inside):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            at = cuts[cuts < len(inside)]
            starts[at] = inside[at]
            at = cuts[cuts > 0] - 1
            ends[at] = inside[at]
        self.inside = inside
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        #: index of each row's first word, and one past the last row's last word
        self.first = np.searchsorted(self.starts, self.bounds)

    def counts(self):
        return np.diff(self.first)

    def rows(self):
        """The row of each word."""
        return np.repeat(np.arange(self.n), self.counts())

    def left(self):
        """How many words of the same row there are from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.starts))

    def hashes(self, which=0):
        """A 64-bit hash of each word."""
        up, down = _power(which, len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLES[which][self.data] * up, out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def tokens(self):
        """The words as an Arrow array."""
        lengths = self.ends - self.starts
        bounds = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        return pa.LargeStringArray.from_buffers(
            len(lengths), pa.py_buffer(bounds), pa.py_buffer(self.data[self.inside])
        )

    def row_bytes(self, row):
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()


def windows(hashes, k, which=0):
    """Hash of the k words from each word on; the last k - 1 places are missing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(_BASES[which])
    total = hashes[:n].copy()
    for step in range(1, k):
        total = total * base + hashes[step : step + n]
    return mix(total)


def sliding_min(values, k):
    """Least of the k values from each place on; the last k - 1 places are missing."""
    out, width = values, 1
    while width < k:
        step = min(width, k - width)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


def signed(hashes):
    return hashes.view(np.int64)
