"""A small evaluator over Python lists: events are (ts, seq, key, value), values may be None."""

from __future__ import annotations

from itertools import groupby


def by_key(events):
    ordered = sorted(events, key=lambda e: (e[2], e[0], e[1]))
    return {k: list(g) for k, g in groupby(ordered, key=lambda e: e[2])}


def running(events, step, zero=None):
    out = []
    for key, group in by_key(events).items():
        state = zero
        for ts, seq, _, v in group:
            state = step(state, v)
            out.append((ts, seq, key, state))
    return out


def left_join(left, right):
    """Merge by time, right before left; each left value with the latest right value."""
    out = []
    rights = by_key(right)
    for key, group in by_key(left).items():
        merged = sorted([(t, 0, s, v) for t, s, _, v in rights.get(key, [])] + [(t, 1, s, v) for t, s, _, v in group], key=lambda e: e[:3])
        now = None
        for ts, side, seq, v in merged:
            if side == 0:
                now = v if v is not None else now
            elif v is not None:
                out.append((ts, seq, key, v, now))
    return out


def debounced(left, right, latency):
    """The timer rule: each event re-arms the key's timer at ts + latency + 1; firing emits the latest pair."""
    out = []
    keys = {e[2] for e in [*left, *right]}
    for key in keys:
        merged = sorted([(t, 0, s, v) for t, s, k, v in right if k == key] + [(t, 1, s, v) for t, s, k, v in left if k == key], key=lambda e: e[:3])
        timer, state = None, [None, None]
        for ts, side, _, v in merged:
            if timer is not None and ts >= timer:
                if state[0] is not None:
                    out.append((timer, key, *state))
            if v is not None:
                state[0 if side else 1] = v
            timer = ts + latency + 1
        if timer is not None and state[0] is not None:
            out.append((timer, key, *state))
    return out


def trailing(events, size, body):
    """For each event, ``body`` of the values in [ts - size, ts] that arrived up to it."""
    out = []
    for key, group in by_key(events).items():
        for i, (ts, seq, _, _) in enumerate(group):
            found = body([v for t, _, _, v in group[: i + 1] if t >= ts - size])
            if found is not None:
                out.append((ts, seq, key, found))
    return out


def trailing_peers(events, size, body):
    """The same, with all events of the same time seeing each other."""
    return [(ts, seq, key, body([v for t, _, _, v in group if ts - size <= t <= ts])) for key, group in by_key(events).items() for ts, seq, _, _ in group]


def adjusted(rows, caught_up=False):
    """(event time, now) in order of arrival to adjusted times."""
    out, last = [], 0
    for event, now in rows:
        if caught_up:
            last = max(last + 1, now)
            out.append(last)
        elif now - event > 10_000:
            out.append(event)
        else:
            caught_up, last = True, now
            out.append(now)
    return out
