"""Fill-in-middle documents, cut by code points through a sparse index of multibyte characters.

Cuts are given in code points, texts are UTF-8 bytes. The index of a column of texts holds only its exceptions: where
characters of several bytes begin and how many bytes they have beyond the first, summed up. A cut is converted by a binary search
for the exceptions before it and a sum; text in ASCII has no exceptions and needs nothing else.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from courtflow.llm.words import pieces

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _bytes_of(column):
    """The bytes of a text column (null: empty) and where its rows begin and end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Exceptions:
    """Characters of more than one byte in ``data``: their places and the excess bytes before each of them."""

    def __init__(self, data, block=1 << 20):
        found = [np.flatnonzero(data[at : at + block] >= 0xC0) + at for at in range(0, len(data), block)]
        self.places = np.concatenate(found) if found else np.empty(0, np.int64)
        lead = data[self.places]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.points = self.places - self.before[:-1]

    def to_bytes(self, points):
        """Byte places of code-point places."""
        return points + self.before[np.searchsorted(self.points, points)]

    def to_points(self, places):
        """Code-point places of byte places that lie between characters."""
        return places - self.before[np.searchsorted(self.places, places)]


def _draws(doc_id, seed):
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[at : at + 8], 16) for at in (0, 8, 16, 24)]


def _make_rows(plain, spm, seed):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, bounds = _bytes_of(part.column("text"))
                index = Exceptions(data)
                starts = index.to_points(bounds)
                n = np.diff(starts)
                ids = part.column("doc_id").to_pylist()
                draws = np.array([_draws(i, seed) for i in ids], np.int64).reshape(len(ids), 4)
                cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
                at = index.to_bytes(starts[:-1, None] + cuts)
                raw, forms, lengths, outputs = data.tobytes(), [], [], []
                for row in range(len(ids)):
                    lo, hi = bounds[row], bounds[row + 1]
                    text = raw[lo:hi]
                    marked = PREFIX in text or SUFFIX in text or MIDDLE in text
                    if not text or marked or draws[row, 2] % 100 >= 100 - plain:
                        forms.append("plain")
                        lengths.append((None, None))
                        outputs.append(text)
                        continue
                    a, b = at[row]
                    first, middle, last = raw[lo:a], raw[a:b], raw[b:hi]
                    swapped = draws[row, 3] % 100 < spm
                    forms.append("spm" if swapped else "psm")
                    lengths.append((int(cuts[row, 0]), int(cuts[row, 1] - cuts[row, 0])))
                    head = (SUFFIX, last, PREFIX, first) if swapped else (PREFIX, first, SUFFIX, last)
                    outputs.append(b"".join((*head, MIDDLE, middle)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array([x for x, _ in lengths], pa.int64()),
                        pa.array([x for _, x in lengths], pa.int64()),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs, plain=10, spm=20, seed=1):
    """Each document of ``docs`` (doc_id, text) rearranged for filling in its middle.

    Gives doc_id, n (code points), form, prefix_chars and middle_chars (code points, null where plain) and output. Both cuts,
    the form and the order come from the SHA-256 of seed and doc_id, so reruns agree. ``plain`` of 100 documents stay as they are,
    as do empty ones and those that hold a mark themselves; ``spm`` of 100 others begin with their suffix.

    A null text is empty; a null doc_id draws like an empty one; repeated rows give repeated rows. Other columns are
    left out. A row is worked on by itself, whatever its length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_make_rows(plain, spm, seed), _MADE)


def _rebuilt(form, output):
    if form == "plain":
        return output
    between, last = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    one = output.index(between, 3)
    two = output.index(last, one + 3)
    head, tail, middle = output[3:one], output[one + 3 : two], output[two + 3 :]
    return head + middle + tail if form == "psm" else tail + middle + head


def _restore_rows(batches):
    for batch in batches:
        for part in pieces(batch, "output"):
            forms = part.column("form").to_pylist()
            outputs = part.column("output").cast(pa.binary()).to_pylist()
            texts = [_rebuilt(f, o) for f, o in zip(forms, outputs, strict=True)]
            yield part.append_column("restored", pa.array(texts, pa.binary()).cast(pa.string()))


def restore(made):
    """Add restored, the text that form and output of ``fill_in_middle`` came from.

    No part of a text holds a mark, and a mark cannot begin in one part and end in the next, so the first place of
    each mark is the one that was set.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in made.dtypes)
    return made.mapInArrow(_restore_rows, f"{schema}, restored string")
