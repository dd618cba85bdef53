"""Small state machines for the few operators whose next row depends on the last result.

Each is written once as a step on (state, input) and used both by the batch operators
(bounded groups) and by the streaming ones (keyed state).  State is a plain tuple.
"""

import math

KALMAN_R, KALMAN_Q, KALMAN_P0, KALMAN_RESET = 15.0, 0.5, 100.0, 5


def kalman_ahead(state, k, q=KALMAN_Q):
    """``k`` predictions of a constant-velocity filter in closed form.

    x and y share one covariance because nothing in the model tells them apart.
    """
    x, vx, y, vy, p00, p01, p11, frame = state
    if k <= 0:
        return state
    return (
        x + k * vx,
        vx,
        y + k * vy,
        vy,
        p00 + 2 * k * p01 + k * k * p11 + q * (k * (k - 1) * (k - 2) / 3 + k * (k - 1) / 2 + k),
        p01 + k * p11 + q * k * (k - 1) / 2,
        p11 + k * q,
        frame,
    )


def kalman_step(state, frame, cx, cy, jump, r=KALMAN_R, q=KALMAN_Q):
    """Take in one sighting; returns the new state, whose x and y are the smoothed centre."""
    fresh = (cx, 0.0, cy, 0.0, KALMAN_P0, 0.0, KALMAN_P0, frame)
    if state is None:
        return fresh
    gap = frame - state[7]
    before = kalman_ahead(state, gap - 1, q)
    if gap <= KALMAN_RESET and math.sqrt((cx - before[0]) ** 2 + (cy - before[2]) ** 2) > jump:
        return fresh
    x, vx, y, vy, p00, p01, p11, _ = kalman_ahead(before, 1, q)
    s = p00 + r
    k0, k1 = p00 / s, p01 / s
    ex, ey = cx - x, cy - y
    return (
        x + k0 * ex,
        vx + k1 * ex,
        y + k0 * ey,
        vy + k1 * ey,
        (1 - k0) * p00,
        (1 - k0) * p01,
        p11 - k1 * p01,
        frame,
    )


GRACE, HOOP_MEMORY, HOOP_RISE = 10, 30, 0.03
NOWHERE = (None, None, None, None, None, None)


def plausible(state, frame, cx, cy, jump, frame_w, frame_h):
    """Teleport and backboard checks against (x, y, frame, hoop frame, hoop top, hoop x)."""
    x, y, last, hoop_frame, hoop_top, hoop_x = state
    if x is not None and 0 < frame - last <= GRACE:
        if math.sqrt((cx - x) ** 2 + (cy - y) ** 2) > jump * (frame - last):
            return False
    if hoop_frame is not None and frame - hoop_frame <= HOOP_MEMORY:
        if cy < hoop_top - frame_h * HOOP_RISE:
            left = hoop_x < frame_w / 2.0
            if (left and cx < hoop_x) or (not left and cx > hoop_x):
                return False
    return True


def accept(state, frame, cand):
    """State after ``cand`` = (cx, cy, hoop top or None, hoop x) became the ball."""
    cx, cy, top, hoop_x = cand
    if top is None:
        return (cx, cy, frame) + state[3:]
    return (cx, cy, frame, frame, top, hoop_x)


RECENT_SLOTS, RECENT_LEAST = 5, 3
LOCK_ROWS = 20


def supported(recent, cx, cy, radius):
    near = [1 for r in recent if r is not None and math.sqrt((cx - r[0]) ** 2 + (cy - r[1]) ** 2) <= radius]
    return len(near) >= RECENT_LEAST


def head_locked(history, offsets, limit):
    """Add this call's head offsets {player: (dx, dy)}; true when one stayed constant.

    Players that are not near the ball in a call lose their history.
    """
    for tid in list(history):
        if tid not in offsets:
            del history[tid]
    for tid, offset in offsets.items():
        rows = history.setdefault(tid, [])
        rows.append(offset)
        del rows[:-LOCK_ROWS]
        if len(rows) == LOCK_ROWS:
            spread = 0.0
            for axis in (0, 1):
                mean = sum(o[axis] for o in rows) / LOCK_ROWS
                spread += sum((o[axis] - mean) ** 2 for o in rows) / LOCK_ROWS
            if math.sqrt(spread) < limit:
                return True
    return False
