"""Rows that wait in the state store, as Arrow columns, and are walked in blocks.

A key may hold millions of rows of one micro-batch. They stay columns (8 bytes a number) from the
batches they come in until the block that is walked; only that block becomes Python objects.
"""

import itertools
from collections import namedtuple

import numpy as np
import pandas as pd
import pyarrow as pa

BLOCK = 4096


def packed(pdf):
    """Rows as the bytes of Arrow columns."""
    return _bytes(pa.Table.from_pandas(pdf, preserve_index=False))


def _bytes(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(part):
    return pa.ipc.open_stream(part).read_pandas()


def packs(keys, names, size=500_000):
    """For ``mapInArrow``: the rows of each key in a stretch of a partition as one row of keys, ``upto``, ``least``, bytes.

    Rows must have ``event_time`` and its milliseconds ``at``; the bytes hold the columns ``names``.
    """

    def packed_rows(table):
        code = np.zeros(len(table), dtype=np.int64)
        for key in keys:
            coded = table[key].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        table, code = table.take(pa.array(order)), code[order]
        found = []
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]):
            part = table.slice(lo, hi - lo)
            at = part["at"].to_numpy()
            found.append({k: part[k][0].as_py() for k in keys} | {
                "event_time": part["event_time"][int(at.argmax())].as_py(), "upto": int(at.max()), "least": int(at.min()),
                "rows": _bytes(part.select(names).combine_chunks()),
            })
        kinds = [table.schema.field(c) for c in (*keys, "event_time")]
        kinds += [pa.field("upto", pa.int64()), pa.field("least", pa.int64()), pa.field("rows", pa.binary())]
        return pa.RecordBatch.from_pylist(found, schema=pa.schema(kinds))

    def run(batches):
        some = []
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
            if sum(b.num_rows for b in some) >= size:
                yield packed_rows(pa.Table.from_batches(some))
                some = []
        if some:
            yield packed_rows(pa.Table.from_batches(some))

    return run


def hold(waiting, frames, names):
    """Append rows to a list state, an entry per batch they come in; returns the least and greatest ``at``."""
    least = most = None
    for pdf in frames:
        if len(pdf):
            waiting.appendValue((packed(pdf[names]),))
            lo, hi = int(pdf["at"].min()), int(pdf["at"].max())
            least, most = (lo, hi) if least is None else (min(least, lo), max(most, hi))
    return least, most


def held(waiting):
    """All rows of a list state as one frame, None if there are none."""
    if not waiting.exists():
        return None
    return pd.concat([unpacked(part) for (part,) in waiting.get()], ignore_index=True)


def split(waiting, mark):
    """The rows due at ``mark``; those after it stay in the state. Returns (rows due, least ``at`` of the rest)."""
    rows = held(waiting)
    if rows is None:
        return None, None
    late = rows["at"] > mark
    if late.all():
        return rows[:0], int(rows["at"].min())
    rest = rows[late]
    waiting.clear()
    hold(waiting, [rest[k : k + 10_000] for k in range(0, len(rest), 10_000)], list(rows.columns))
    return rows[~late], int(rest["at"].min()) if len(rest) else None


def in_order(pdf, order, names, size=BLOCK):
    """Blocks of rows (named tuples) along the columns ``order``; equal ones stay as they came."""
    row = namedtuple("Row", names)
    at = np.lexsort([pdf[c].to_numpy() for c in reversed(order)])
    columns = [pdf[c].to_numpy() for c in names]
    for k in range(0, len(at), size):
        part = at[k : k + size]
        yield [row(*r) for r in zip(*(c[part].tolist() for c in columns))]


def in_frames(rows, columns, size=10_000):
    """Output rows as frames of a bounded size."""
    for k in range(0, len(rows), size):
        yield pd.DataFrame(rows[k : k + size], columns=columns)
