"""Keyed state machines on streams, and the native streaming aggregations.

Every step is ``step(state, rows) -> (state, output rows)`` on plain values; ``Walk`` runs
it under a key with the state in the state store.  Keys are (game, track) or (game, slice)
wherever the look-back is bounded: a slice also receives the few rows before it (``halo``),
so a long game is spread over many keys.  Rows wait until the watermark has passed them and are
walked in order then, however they arrived; later ones are dropped by the watermark.
"""

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions import steps
from ..functions.geometry import FRAME_H, FRAME_W
from ..functions.slices import halo
from ..operators import ball
from .held import hold, in_frames, in_order, packed, packs, split, unpacked
from .relay import SLICE, relay
from .runner import frame_of

#: frames without a row after which the state of a key is given up: two hours of 30 frames per second
FORGET = 216_000


class Walk(StatefulProcessor):
    """Runs a step function per key, in order of event time.

    ``waiting`` holds the rows that the watermark has not passed, as columns, and ``state`` the
    step's state (JSON) with the time of its last row. A timer at the last row of a batch
    wakes the key when its rows are due; another one clears it once it has been silent for ``forget``, or never.
    Rows are walked block by block, and what a block gives is handed on before the next one.
    """

    def __init__(self, step, order, names, columns, forget):
        self.step, self.order, self.names, self.columns, self.forget = step, order, names, columns, forget

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "at long, data string")
        self.waiting = handle.getListState("waiting", "data binary")

    def handleInputRows(self, key, rows, timerValues):
        _, last = hold(self.waiting, rows, self.names)
        if last is not None:
            self.handle.registerTimer(last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        due, _ = split(self.waiting, mark)
        at, data = self.state.get() if self.state.exists() else (None, "null")
        if due is not None and len(due):
            state = json.loads(data)
            for last, block in self.blocks(due):
                state, out = self.step(state, block)
                at = last
                yield from self.given(out)
            self.state.update((at, json.dumps(state)))
            if self.forget is not None:
                self.handle.registerTimer(max(at + self.forget, mark + 1))
        elif self.forget is not None and at is not None and due is None and at + self.forget <= mark:
            self.state.clear()

    def blocks(self, due):
        return ((block[-1].at, block) for block in in_order(due, self.order, self.names))

    def given(self, out):
        return in_frames(out, self.columns)

    def close(self):
        pass


class ColumnWalk(Walk):
    """``Walk`` for steps on columns, ``step(state, columns) -> (state, output columns)``, over rows that come packed by key.

    What goes through a stateful step costs by the row; packed rows go into its state as they are.
    """

    def handleInputRows(self, key, rows, timerValues):
        mark, last = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            for upto, least, data in zip(pdf["upto"].tolist(), pdf["least"].tolist(), pdf["rows"]):
                if least <= mark:  # some are later than the watermark
                    some = unpacked(data)
                    data = packed(some[some["at"] > mark])
                if upto > mark:
                    self.waiting.appendValue((data,))
                    last = upto if last is None else max(last, upto)
        if last is not None:
            self.handle.registerTimer(last)
        return iter(())

    def blocks(self, due, size=100_000):
        due = due.iloc[np.lexsort([due[c].to_numpy() for c in reversed(self.order)])]
        for k in range(0, len(due), size):
            block = {c: v.to_numpy()[k : k + size] for c, v in due.items()}
            yield int(block["at"][-1]), block

    def given(self, out):
        yield pd.DataFrame(out, columns=self.columns)


def walk(stream, keys, step, schema, order=("frame",), forget=FORGET):
    """``step`` per key over a stream with ``event_time``.

    ``forget`` counts frames (a second of event time each) after which a silent key starts anew; None: it never does.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]
    rows = stream.withColumn("at", F.unix_millis("event_time"))
    names = [c for c in rows.columns if c != "event_time"]
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Walk(step, list(order), names, columns, None if forget is None else forget * 1000),
        outputStructType=schema,
        outputMode="append",
        timeMode="EventTime",
    )


def walk_columns(stream, keys, step, schema, order=("frame",), forget=FORGET):
    """``walk`` for a step on columns."""
    columns = [c.strip().split()[0] for c in schema.split(",")]
    rows = stream.withColumn("at", F.unix_millis("event_time"))
    names = [c for c in rows.columns if c != "event_time"]
    kinds = T.StructType([rows.schema[c] for c in (*keys, "event_time")])  # the watermark is told in the metadata
    kinds = kinds.add("upto", T.LongType()).add("least", T.LongType()).add("rows", T.BinaryType())
    return rows.mapInArrow(packs(list(keys), names), kinds).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=ColumnWalk(step, list(order), names, columns, None if forget is None else forget * 1000),
        outputStructType=schema,
        outputMode="append",
        timeMode="EventTime",
    )


# ---- steps --------------------------------------------------------------------------


def triplet_step(state, rows):
    """Frames that complete three in a row."""
    last, out = list(state or []), []
    for row in rows:
        if last[-2:] == [row.frame - 2, row.frame - 1] and row.own:
            out.append((row.game, row.frame))
        last = (last + [int(row.frame)])[-2:]
    return last, out


def ghost_step(max_age):
    """Ghosts of one track between its sightings; an end marker closes the last one."""

    def step(state, rows):
        out = []
        for row in rows:
            if state is not None:
                frame, box = state
                for at in range(frame + 1, min(row.frame - 1, frame + max_age) + 1):
                    out.append((row.game, at, row.tid, *box, at - frame))
            state = [int(row.frame), [int(v) for v in (row.x1, row.y1, row.x2, row.y2)]]
        return state, out

    return step


def lock_step(confirm):
    def step(state, rows):
        counts, locked = state or [{}, False]
        out = []
        for row in rows:
            if locked:
                break
            counts[row.num] = counts.get(row.num, 0) + 1
            if counts[row.num] >= confirm:
                locked, counts = True, {}
                out.append((row.game, row.tid, row.num, row.frame))
        return [counts, locked], out

    return step


def vote_step(window):
    """On columns: the vote after each row counts the last ``window`` ones, and a tie goes to the oldest of them."""

    def step(votes, rows):
        before = len(votes or [])
        team = np.r_[votes or [], rows["team"]].astype(np.int64)
        ones, at = np.cumsum(team), np.arange(before, len(team))
        oldest = np.maximum(at - window + 1, 0)
        twice, n = 2 * (ones[at] - ones[oldest] + team[oldest]), at - oldest + 1
        voted = np.where(twice > n, 1, np.where(twice < n, 0, team[oldest]))
        return team[-window:].tolist(), {**{c: rows[c] for c in ("game", "frame", "tid")}, "voted": voted}

    return step


def fill_step(teleport, most, linear):
    """Filled frames between a sighting and the next one, released when that arrives."""

    def step(state, rows):
        out = []
        for row in rows:
            box = [int(v) for v in (row.x1, row.y1, row.x2, row.y2)]
            if state is not None and state[2]:
                frame, a, _ = state
                gap = row.frame - frame - 1
                ax, ay = (a[0] + a[2]) / 2.0, (a[1] + a[3]) / 2.0
                bx, by = (box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0
                jump = math.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
                if 1 <= gap <= most and jump <= teleport * (gap + 1):
                    rise = min(abs(bx - ax) * 0.3, gap * 15.0) if gap > linear else 0.0
                    for j in range(1, gap + 1):
                        t = j / (gap + 1)
                        lift = -rise * 4.0 * t * (1.0 - t)
                        at = [p + (q - p) * t + (lift if k % 2 else 0.0) for k, (p, q) in enumerate(zip(a, box))]
                        out.append((row.game, frame + j, *[int(v) for v in at]))
            state = [int(row.frame), box, bool(row.own)]
        return state, out

    return step


# ---- streams ------------------------------------------------------------------------


def frame_summary(stream):
    """``operators.tracks.frame_summary`` over the parts of ``summary_parts``: a window per frame."""
    kinds = ("players", "numbers", "poses", "balls")
    per = stream.groupBy("game", F.window("event_time", "1 second").alias("w")).agg(
        *[F.sum(k).alias(k) for k in kinds]
    )
    frame = frame_of("w.start")
    return per.where("players + numbers + poses + balls > 0").select(
        "game", frame.alias("frame"), "players", "numbers", "poses", (F.col("balls") > 0).alias("ball"),
        (frame % 30 == 0).alias("progress"),
    )


def flight_sessions(stream, gap=10):
    """Ball flights as session windows: a frame gap above ``gap`` starts a new one."""
    per = stream.groupBy("game", F.session_window("event_time", f"{gap * 1000 + 1} milliseconds").alias("w"))
    per = per.agg(F.count("*").alias("points"), F.min("frame").alias("flight"), F.max("frame").alias("last_frame"))
    return per.select("game", "flight", "last_frame", "points")


def sliding_triplet(stream):
    rows = halo(stream.select("game", "frame", "event_time"), before=2)
    return walk(rows, ["game", "slice"], triplet_step, "game bigint, frame bigint")


def kalman(stream, jump, size=SLICE):
    """Smoothing of each game's ball; the filter carries on over gaps of any length.

    Walks from far apart starts forget them after some dozen sightings; they count as met within 1e-9. A start unlike those
    tried (a ball too fast for a filter that has not learnt its speed) may take longer: its slice is walked to the end.
    """

    def step(state, frame, rows):
        out = []
        for row in rows:
            state = steps.kalman_step(state, frame, float(row.cx), float(row.cy), jump)
            out.append((row.game, frame, *state[:4]))
        return state, out

    def starts(_, border):
        """No sighting yet, or one just before or long ago, at either corner, moving, surely or not."""
        some = [None]
        for x, y, v in ((0.0, 0.0, 50.0), (float(FRAME_W), float(FRAME_H), -50.0)):
            for spread in ((5.0, 1.0, 0.5), (100.0, 0.0, 100.0)):
                some += [(x, v, y, v, *spread, border - back) for back in (1, 6, 100_000)]
        return some

    def same(a, b):
        return (a is None) == (b is None) and (a is None or all(abs(p - q) <= 1e-9 for p, q in zip(a, b)))

    rows = stream.select("game", "frame", "cx", "cy", "event_time")
    schema = "game bigint, frame bigint, sx double, svx double, sy double, svy double"
    return relay(rows, step, lambda: None, starts, schema, same=same, size=size, margin=32, sure=False)


def ghosts(stream, max_age):
    schema = "game bigint, frame bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, age bigint"
    rows = stream.select("game", "tid", "frame", "x1", "y1", "x2", "y2", "event_time")
    return walk(rows, ["game", "tid"], ghost_step(max_age), schema)


def jersey_lock(stream, confirm):
    """A track's number, once for all: the few bytes that say so are kept as long as the stream runs."""
    rows = stream.select("game", "tid", "frame", "num", "event_time")
    schema = "game bigint, tid bigint, num string, lock_ord bigint"
    return walk(rows, ["game", "tid"], lock_step(confirm), schema, forget=None)


def team_vote(stream, window):
    """A track's vote over its last ``window`` ones, however long ago they were; no more than those are kept."""
    rows = stream.select("game", "tid", "frame", "team", "event_time")
    schema = "game bigint, frame bigint, tid bigint, voted bigint"
    return walk_columns(rows, ["game", "tid"], vote_step(window), schema, forget=None)


def gap_fill(stream, teleport, most, linear):
    rows = halo(stream.select("game", "frame", "x1", "y1", "x2", "y2", "event_time"), after=most + 1)
    schema = "game bigint, frame bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
    return walk(rows, ["game", "slice"], fill_step(teleport, most, linear), schema)


def cooldown(stream, wait, size=SLICE):
    """Accepted shots; the last one accepted before a slice is any candidate of the last ``wait`` frames, or none."""

    def step(last, frame, rows):
        out = []
        for row in rows:
            ok = last is None or frame - last >= wait
            last = frame if ok else last
            out.append((row.game, frame, ok))
        return last, out

    def age(last, frame):
        return None if last is None or frame - last >= wait else last

    rows = stream.select("game", "frame", "event_time")
    starts = lambda before, border: [None] + [frame for frame, _ in before if border - frame < wait]
    schema = "game bigint, peak_frame bigint, accepted boolean"
    return relay(rows, step, lambda: None, starts, schema, age=age, before=wait, size=size)


def ball_validate(stream, jump, size=SLICE):
    """Candidates (see ``operators.ball.court_candidates``) checked in frame order per game."""

    def starts(before, border):
        """Any candidate of the last frames may have been the last one, with any hoop seen until then."""
        hoops, some = [[None] * 3], [list(steps.NOWHERE)]
        for frame, rows in before:
            mine = [[frame, float(r.hoop_top), float(r.hoop_x)] for r in rows if r.hoop_top == r.hoop_top and r.hoop_top is not None]
            for r in rows:
                own = [[frame, float(r.hoop_top), float(r.hoop_x)]] if r.hoop_top == r.hoop_top and r.hoop_top is not None else hoops
                some += [[float(r.cx), float(r.cy), frame, *h] for h in own]
            hoops = hoops + mine
        aged = [ball.age_core(s, border) for s in some]
        return [s for k, s in enumerate(aged) if s not in aged[:k]]

    rows = stream.select(*ball.CANDIDATE, "event_time")
    return relay(
        rows, ball.export_step(jump), lambda: list(steps.NOWHERE), starts, ball.VALID, age=ball.age_core,
        before=steps.HOOP_MEMORY, order=("frame", "seq"), size=size,
    )
