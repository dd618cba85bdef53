"""Take-over of lost tracks on a stream, in three keyed steps.

1. ``TrackEvents`` per (game, track): waits for the watermark and turns a track's detections and number reads into
   events: new, seen, lost, lost anew. The number a track wears is locked here. All rows due are worked on as columns.
2. ``Meetings`` per (game, grid cell) and (game, bucket of numbers): keeps the open entries of lost tracks that can be met
   there in a map, and gives the first contact of each track with each entry. Entries leave the map when
   they expire, at a timer. (A later contact of the same two changes nothing: at the first one either the track takes
   something over or the entry is gone.)
3. ``Choices`` per game: walks contacts only, in order; each track and each entry is used once. Its maps hold
   the entries taken, until they expire, and the tracks that have taken one, until the game ends.

A track that has met as many entries as there are tracks in its game has taken one over, as each of the other tracks takes
one at most. So that every place knows their number, a track makes itself known to all places when it is first seen, and
there are few of them: cells beyond the frame count as its border, numbers share buckets. What a place has to say about a
track ends there, however long the track goes on, and rows of such tracks are passed over as columns.

A step gives out, at each watermark, everything up to it, so the next one gets all rows of a frame in one micro-batch,
earlier frames in earlier ones, and can walk them at once.
"""

import json
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.geometry import FRAME_H, FRAME_W
from .held import BLOCK, hold, in_frames, in_order, packed, split, unpacked
from .runner import time_of

# order of what happens within one frame: detections see what was open before the frame
NEW, SEEN, ANEW, LOST, OVER = -1, 0, 1, 2, 3
BUCKETS, END = 16, -1  # places that numbers share; the place where a game ends
_TOLD = ["frame", "kind", "seq", "num", "x", "y", "since"]
_EVENTS = "game bigint, place bigint, tid bigint, events binary"  # of one track at one place, columns of ``_TOLD``
_CONTACT = "game bigint, frame bigint, seq bigint, tid bigint, gap double, lost_frame bigint, old_tid bigint, until bigint, over boolean"


def _names(schema):
    return [c.strip().split()[0] for c in schema.split(",")] + ["mark"]


def _stamp(timerValues):
    """Just after the watermark, where later steps will not take rows for late."""
    return pd.Timestamp(timerValues.getCurrentWatermarkInMs() + 1, unit="ms")


def _given(rows, schema, timerValues):
    mark = _stamp(timerValues)
    return in_frames([(*r, mark) for r in rows], _names(schema))


class _Grid:
    """Cells of twice the reach, so an entry can be met in four at most; positions beyond the frame belong to its border."""

    def __init__(self, reach):
        self.reach, self.size = reach, 2 * reach
        self.wide, self.high = math.ceil(FRAME_W / self.size), math.ceil(FRAME_H / self.size)
        self.places = np.arange(self.wide * self.high + BUCKETS)  # cells first

    def _at(self, v, most):
        return np.nan_to_num(np.clip(np.floor(v / self.size), 0, most - 1)).astype(np.int64)

    def cell(self, x, y):
        return self._at(x, self.wide) * self.high + self._at(y, self.high)

    def around(self, x, y):
        """First and last column and row of the cells from which (x, y) is within reach."""
        return [self._at(v + by, most) for v, most in ((x, self.wide), (y, self.high)) for by in (-self.reach, self.reach)]

    def corners(self, box):
        """The cells of ``around`` as (which rows, columns, rows), corner by corner."""
        x0, x1, y0, y1 = box
        for i in (0, 1):
            for j in (0, 1):
                yield (x0 + i <= x1) & (y0 + j <= y1), x0 + i, y0 + j

    def bucket(self, num):
        return self.wide * self.high + zlib.crc32(num.encode()) % BUCKETS


class TrackEvents(StatefulProcessor):
    """Rows: frame, kind (d detection, r read, z end of the game), seq, x, y, num."""

    def __init__(self, reach, keep, confirm):
        self.keep, self.confirm, self.grid = keep, confirm, _Grid(reach)

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "data binary")
        self.track = handle.getValueState("track", "data string")

    def handleInputRows(self, key, rows, timerValues):
        least, _ = hold(self.waiting, rows, ["frame", "kind", "seq", "x", "y", "num", "at"])
        if least is not None:
            self.handle.registerTimer(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        due, rest = split(self.waiting, mark)
        if rest is not None:
            self.handle.registerTimer(rest)
        state = {"counts": {}, "lock": None, "last": None, "open": None, "known": False}
        if self.track.exists():
            state = json.loads(self.track.get()[0])
        some = due is not None and len(due) > 0
        if not some and not state["last"] or None in key:  # no rule looks for a track without a name
            return
        ended, upto = False, time_of(None, mark)
        if some:
            rank = due["kind"].map({"d": 0, "r": 1, "z": 2}).to_numpy()
            order = np.lexsort([due["seq"].to_numpy(), rank, due["frame"].to_numpy()])
            due, rank = due.iloc[order], rank[order]
            ended = bool((rank == 2).any())
            if ended:
                upto = int(due["frame"].iloc[-1]) - 1
        else:
            rank, due = np.zeros(0, dtype=np.int64), pd.DataFrame({c: [] for c in ("frame", "seq", "x", "y", "num")})
        parts = self._events(state, due, rank, upto)
        if ended:
            ends = due["frame"].to_numpy()[rank == 2]
            seqs = due["seq"].to_numpy()[rank == 2]
            parts.append((END, ends, OVER, seqs, "", 0.0, 0.0, 0))
            if state["known"]:
                parts.append((self.grid.places, np.full(len(self.grid.places), ends[0]), OVER, 0, "", 0.0, 0.0, 0))
            self.track.clear()
        else:
            self.track.update((json.dumps(state),))
            if state["last"]:
                self.handle.registerTimer(time_of(state["last"][0] + 1))
        yield from self._frames(key, parts, _stamp(timerValues))

    def _events(self, state, due, rank, upto):
        """Events of the rows due, as (places, frames, kind, seqs, number, xs, ys, sinces); changes the state."""
        grid, dets = self.grid, due[rank == 0]
        frame, seq = dets["frame"].to_numpy(dtype=np.int64), dets["seq"].to_numpy()
        x, y = dets["x"].to_numpy(dtype=float), dets["y"].to_numpy(dtype=float)
        parts, fresh = [], state["lock"] is None
        if fresh:
            self._lock(state, due[rank == 1])
        if len(frame) and not state["known"]:
            state["known"] = True
            parts.append((grid.places, np.full(len(grid.places), frame[0]), NEW, 0, "", 0.0, 0.0, 0))
        parts.append((grid.cell(x, y), frame, SEEN, seq, "", x, y, 0))
        num, since = state["lock"] or (None, None)
        if num is not None:
            worn, place = frame > since, grid.bucket(num)
            parts.append((place, frame[worn], SEEN, seq[worn], num, x[worn], y[worn], 0))
        # a track is lost if it was not seen in the frame after its last one, and that frame lies behind
        if state["last"]:
            was = state["last"]
            frame, x, y = np.r_[was[0], frame].astype(np.int64), np.r_[was[1], x].astype(float), np.r_[was[2], y].astype(float)
        if not len(frame):
            return parts
        gone = np.r_[frame[1:], upto + 1] > frame + 1
        state["last"] = None if gone[-1] else [int(frame[-1]), float(x[-1]), float(y[-1])]
        lost, x, y = frame[gone] + 1, x[gone], y[gone]
        # of entries open when the number was locked only the last one is met by it, from then on
        if fresh and num is not None:
            before = [state["open"]] if state["open"] else []
            before += [[int(a), b, c] for a, b, c in zip(lost[lost < since][-1:], x[lost < since][-1:], y[lost < since][-1:])]
            if before and since <= before[-1][0] + self.keep:
                at, ex, ey = before[-1]
                parts.append((place, np.array([since]), LOST, 0, num, ex, ey, at))
        if not len(lost):
            return parts
        box = grid.around(x, y)
        for some, i, j in grid.corners(box):
            parts.append(((i * grid.high + j)[some], lost[some], LOST, 0, "", x[some], y[some], lost[some]))
        if num is not None:
            own = lost >= since
            parts.append((place, lost[own], LOST, 0, num, x[own], y[own], lost[own]))
        # an entry takes the place of the one before; where that cannot be met any more, it is told to go
        then, kept = (x, y), slice(1, None)
        if state["open"]:
            then, kept = (np.r_[state["open"][1], x], np.r_[state["open"][2], y]), slice(0, None)
        was = [v[:-1] for v in grid.around(*then)]
        x0, x1, y0, y1 = (v[kept] for v in box)
        for some, i, j in grid.corners(was):
            some = some & ~((i >= x0) & (i <= x1) & (j >= y0) & (j <= y1))
            parts.append(((i * grid.high + j)[some], lost[kept][some], ANEW, 0, "", 0.0, 0.0, 0))
        state["open"] = [int(lost[-1]), float(x[-1]), float(y[-1])]
        return parts

    def _lock(self, state, reads):
        for frame, num in zip(reads["frame"].tolist(), reads["num"].tolist()):
            state["counts"][num] = state["counts"].get(num, 0) + 1
            if state["counts"][num] >= self.confirm:
                state["lock"], state["counts"] = [num, int(frame)], {}
                break

    def _frames(self, key, parts, mark, size=100_000):
        """Events packed by place: what goes through a stateful step costs by the row."""
        names = ["place", *_TOLD]
        parts = [{c: np.broadcast_to(v, len(part[1])) for c, v in zip(names, part)} for part in parts]
        told = pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in names}) if parts else pd.DataFrame(columns=names)
        rows = []
        for place, some in told.groupby("place", sort=False):
            for k in range(0, len(some), size):
                rows.append((key[0], int(place), key[1], packed(some[_TOLD][k : k + size]), mark))
        if rows:
            yield pd.DataFrame(rows, columns=_names(_EVENTS))

    def close(self):
        pass


class Meetings(StatefulProcessor):
    """First contacts of tracks with the open entries of one grid cell or one bucket of numbers."""

    def __init__(self, reach, keep):
        self.reach, self.keep = reach, keep

    def init(self, handle):
        self.handle = handle
        self.open = handle.getMapState("open", "tid long", "lost long, x double, y double, num string")
        self.known = handle.getValueState("known", "data string")

    def handleInputRows(self, key, rows, timerValues):
        names = ["tid", *_TOLD]
        given = ((tid, unpacked(events)) for pdf in rows for tid, events in zip(pdf["tid"].tolist(), pdf["events"]))
        if key[1] == END:
            over = [(key[0], frame, 0, tid, 0.0, 0, 0, 0, True) for tid, told in given for frame in told["frame"].tolist()]
            yield from _given(over, _CONTACT, timerValues)
            return
        before = self._held()
        held, tracks, over, met, full = dict(before), 0, 0, {}, {}
        if self.known.exists():
            told = json.loads(self.known.get()[0])
            tracks, over, full = told["tracks"], told["over"], dict.fromkeys(told["full"], -1)
            met = {t: [n, dict(entries)] for t, n, entries in told["met"]}
        # what tracks have seen that have taken one over goes before it takes up any memory
        columns = {c: [] for c in names}
        for tid, told in given:
            told = told[told["kind"] != SEEN] if tid in full else told
            for c, parts in columns.items():
                parts.append(told[c].to_numpy() if c != "tid" else np.full(len(told), tid))
        columns = {c: np.concatenate(parts) for c, parts in columns.items()}
        order = np.lexsort([columns["since"], columns["kind"], columns["frame"]])
        for k in range(0, len(order), BLOCK):
            part = {c: v[order[k : k + BLOCK]] for c, v in columns.items()}
            passed = np.isin(part["tid"], [t for t, frame in full.items() if frame < part["frame"][0]])
            asked = (part["kind"] == SEEN) & ~passed
            if not asked.any() and not (part["kind"] == OVER).any():
                tracks += int((part["kind"] == NEW).sum())
                self._entered(part, held)
                continue
            out = []
            wanted = asked | (part["kind"] != SEEN)
            for tid, frame, kind, seq, num, x, y, since in zip(*(part[c][wanted].tolist() for c in names)):
                if kind == NEW:
                    tracks += 1
                elif kind == SEEN:
                    if full.get(tid, frame) < frame:
                        continue
                    mine = met.setdefault(tid, [0, {}])
                    for old, (lost, ex, ey, worn) in held.items():
                        if frame > lost + self.keep or worn != num or mine[1].get(old) == lost:
                            continue
                        gap = -1.0 if num else math.sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey))
                        if gap < self.reach:
                            mine[1][old] = lost
                            mine[0] += 1
                            out.append((key[0], frame, int(seq), tid, gap, lost, old, lost + self.keep, False))
                    if mine[0] >= tracks:
                        full.setdefault(tid, frame)
                elif kind == ANEW:
                    held.pop(tid, None)
                elif kind == LOST:
                    held[tid] = (since, x, y, num)
                else:
                    over += 1
                    met.pop(tid, None)
                    full.pop(tid, None)
            yield from _given(out, _CONTACT, timerValues)
        top = time_of(None, timerValues.getCurrentWatermarkInMs())
        self._keep(before, {t: e for t, e in held.items() if e[0] + self.keep >= top})
        if over >= tracks:
            self.known.clear()
            return
        met = [[t, n, [e for e in m.items() if e[1] + self.keep >= top]] for t, (n, m) in met.items() if t not in full]
        self.known.update((json.dumps({"tracks": tracks, "over": over, "full": list(full), "met": met}),))

    def _entered(self, part, held):
        """Entries after a block of rows that nobody asks about: the last word on each track."""
        some = np.flatnonzero((part["kind"] == ANEW) | (part["kind"] == LOST))[::-1]
        for k in some[np.unique(part["tid"][some], return_index=True)[1]].tolist():
            if part["kind"][k] == LOST:
                held[int(part["tid"][k])] = (int(part["since"][k]), float(part["x"][k]), float(part["y"][k]), part["num"][k])
            else:
                held.pop(int(part["tid"][k]), None)

    def _held(self):
        return {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}

    def _keep(self, before, held):
        for tid in before.keys() - held.keys():
            self.open.removeKey((tid,))
        for tid, entry in held.items():
            if before.get(tid) != entry:
                self.open.updateValue((tid,), entry)
        if held:
            self.handle.registerTimer(time_of(min(e[0] for e in held.values()) + self.keep + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        top, held = time_of(None, timerValues.getCurrentWatermarkInMs()), self._held()
        self._keep(held, {t: e for t, e in held.items() if e[0] + self.keep >= top})
        return iter(())

    def close(self):
        pass


class Choices(StatefulProcessor):
    """Each track and each entry is used once; a known equal number beats any distance."""

    def init(self, handle):
        self.handle = handle
        self.done = handle.getMapState("done", "tid long", "frame long")
        self.taken = handle.getMapState("taken", "old long, lost long", "until long")

    def handleInputRows(self, key, rows, timerValues):
        names = ["over", "frame", "seq", "tid", "gap", "lost_frame", "old_tid", "until"]
        asked = {"done": {}, "taken": {}}  # each key is looked up once

        def used(name, item):
            if item not in asked[name]:
                asked[name][item] = getattr(self, name).containsKey(item)
            return asked[name][item]

        parts, out, over = [], [], False
        for pdf in rows:
            over = over or bool(pdf["over"].any())
            # contacts of a track that has taken an entry go before they take up any memory
            open_ = [t for t in pdf["tid"].unique().tolist() if not used("done", (t,))]
            parts.append(pdf.loc[~pdf["over"].astype(bool) & pdf["tid"].isin(open_), names[1:]])
        pdf = pd.concat(parts, ignore_index=True)
        left = set(pdf["tid"].unique().tolist())
        for block in in_order(pdf, ["frame", "seq", "tid", "gap", "lost_frame", "old_tid", "until"], names[1:]):
            for frame, _, tid, _, lost, old, until in block:
                if not used("done", (tid,)) and not used("taken", (old, lost)):
                    asked["done"][tid,] = asked["taken"][old, lost] = True
                    left.discard(tid)
                    self.done.updateValue((tid,), (frame,))
                    self.taken.updateValue((old, lost), (until,))
                    self.handle.registerTimer(time_of(until + 1))
                    out.append((key[0], tid, frame, old, lost))
            if not left:
                break
        if over:
            self.done.clear()
            self.taken.clear()
        if out:
            yield pd.DataFrame(out, columns=["game", "tid", "frame", "old_tid", "lost_frame"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        top = time_of(None, timerValues.getCurrentWatermarkInMs())
        for entry in [tuple(k) for k, v in self.taken.iterator() if v[0] < top] if self.taken.exists() else []:
            self.taken.removeKey(entry)
        return iter(())

    def close(self):
        pass


def events(dets, reads, ends):
    """One stream of what ``reid`` looks at: detections, number reads and the end of each game."""
    none = {"seq": F.lit(0).cast("bigint"), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}
    parts = [
        dets.withColumns({"kind": F.lit("d"), "num": F.lit(None).cast("string"),
                          "x": (F.col("x1") + F.col("x2")) / 2.0, "y": (F.col("y1") + F.col("y2")) / 2.0}),
        reads.withColumns({"kind": F.lit("r"), **none}),
        ends.withColumns({"kind": F.lit("z"), "num": F.lit(None).cast("string"), **none}),
    ]
    names = ["game", "tid", "frame", "kind", "seq", "x", "y", "num"]
    rows = parts[0].select(*names)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*names))
    return rows


def reid(stream, reach, keep, confirm):
    """Who takes over which lost track: (game, tid, frame, old_tid, lost_frame), from a stream of ``events``."""
    rows = stream.withColumn("at", F.unix_millis("event_time"))
    step = {"outputMode": "append", "timeMode": "EventTime"}
    seen = rows.groupBy("game", "tid").transformWithStateInPandas(
        TrackEvents(reach, keep, confirm), f"{_EVENTS}, mark timestamp", **step, eventTimeColumnName="mark"
    )
    contacts = seen.groupBy("game", "place").transformWithStateInPandas(
        Meetings(reach, keep), f"{_CONTACT}, mark timestamp", **step, eventTimeColumnName="mark"
    )
    schema = "game bigint, tid bigint, frame bigint, old_tid bigint, lost_frame bigint"
    return contacts.groupBy("game").transformWithStateInPandas(Choices(), schema, **step)
