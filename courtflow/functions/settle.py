"""Sequential operators over slices: guess, verify, repair.

Some operators carry state from row to row for as long as a game lasts.  Each slice is
first walked on its own after warming up on the end of the one before it, and reports the state
it started from and the one it ended with.  Where the start is what the slice before
really ended with, the guess is proven right; the other slices are walked again from that
state, until all of them agree.  The result equals one walk over the whole game, while
no task ever holds more than two slices of it.
"""

import itertools
import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import staged
from .slices import SLICE, halo

WARM_UP = 512  # frames walked before a slice to guess its first state
STATES = "is_state boolean, slice bigint, started string, ended string, aged string"


def settle(rows, blank, step, age, columns, order, size=SLICE):
    """Walk every game frame by frame; returns the rows that ``step`` gives out.

    ``step(state, frame, rows) -> (state, output tuples)`` on JSON-like state,
    ``age(state, frame)`` is the state as it looks before ``frame`` with everything that
    no longer matters removed, ``columns`` the DDL of the output.
    """
    names = [c.strip().split()[0] for c in columns.split(",")]
    schema = f"{columns}, {STATES}"

    def walk(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        part = int(pdf.slice.iloc[0])
        border, seed = part * size, pdf.seed.iloc[0]
        state = json.loads(seed) if isinstance(seed, str) else blank()
        started, out = seed if isinstance(seed, str) else None, []
        for frame, same in itertools.groupby(pdf.itertuples(index=False), key=lambda r: r.frame):
            frame = int(frame)
            if frame < border and isinstance(seed, str):
                continue
            if frame >= border and started is None:
                state = age(state, border)
                started = json.dumps(state, sort_keys=True)
            state, given = step(state, frame, list(same))
            if frame >= border:
                out += given
        if started is None:
            state = age(state, border)
            started = json.dumps(state, sort_keys=True)
        ended, aged = (json.dumps(age(state, border + k * size), sort_keys=True) for k in (1, 2))
        kept = pd.DataFrame(out, columns=names).assign(is_state=False, slice=part)
        own = pd.DataFrame([{n: None for n in names} | {
            "game": pdf.game.iloc[0], "is_state": True, "slice": part,
            "started": started, "ended": ended, "aged": aged}])
        return pd.concat([kept, own]).reindex(columns=[*names, "is_state", "slice", "started", "ended", "aged"]).astype(object)

    sliced = halo(rows, before=min(size, WARM_UP), size=size).drop("own")
    first = sliced.withColumn("seed", F.lit(None).cast("string"))
    done = staged(first.groupBy("game", "slice").applyInPandas(walk, schema), "walked").withColumn("round", F.lit(0))
    w = Window.partitionBy("game").orderBy("slice")
    turn = 0
    while True:
        newest = F.max(F.struct("round", "started", "ended", "aged")).alias("s")
        states = done.where("is_state").groupBy("game", "slice").agg(newest).select("game", "slice", "s.*")
        near = F.lag("slice").over(w) == F.col("slice") - 1
        truth = F.when(near, F.lag("ended").over(w)).otherwise(F.lag("aged").over(w))
        wrong = states.withColumn("seed", truth).where("seed <> started").select("game", "slice", "seed")
        if wrong.isEmpty():
            rows = done.where("NOT is_state")
            if turn:  # of a repaired slice, the last walk counts
                rows = rows.join(states.select("game", "slice", "round"), ["game", "slice", "round"], "left_semi")
            return rows.select(*names)
        turn += 1
        redo = sliced.join(wrong, ["game", "slice"]).groupBy("game", "slice").applyInPandas(walk, schema)
        done = done.unionByName(staged(redo, "walked").withColumn("round", F.lit(turn)))
