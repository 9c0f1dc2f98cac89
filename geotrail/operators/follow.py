"""The rules for one fix after another, over arrays: whole stretches at once, single fixes only where a rule says no.

A fix at the last accepted place is a repeat (as is a day's first at exactly 0, 0); one that would need more than
the greatest speed from there is rejected and moves nothing; others are accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geotrail.functions.geo import EARTH_M, metres


@dataclass
class Last:
    """The last accepted fix of a day, and the way up to it; nothing has moved before the first."""

    moved: bool = False
    lon: float = 0.0
    lat: float = 0.0
    t: int = 0
    total: float = 0.0


def _metres(lon0: np.ndarray, lat0: np.ndarray, lon1: np.ndarray, lat1: np.ndarray) -> np.ndarray:
    lat0, lat1 = np.radians(lat0), np.radians(lat1)
    a = np.sin((lat1 - lat0) / 2) ** 2 + np.cos(lat0) * np.cos(lat1) * np.sin(np.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def follow(opens: np.ndarray, t: np.ndarray, lon: np.ndarray, lat: np.ndarray, last: Last, max_mps: float, sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(taken, fast, step, walked) of fixes in order; ``opens`` marks a day's first, ``last`` is carried in and out, its total aside.

    t is in microseconds.  A stretch in which each new place is slow enough from the one before is accepted as a whole;
    from a fix that isn't, fixes are walked one by one (``walked`` of them) until the last accepted one is again the
    first at its place.  A day's first that is ``sure`` has been accepted before, at 0, 0 too.
    """
    n = len(t)
    sure = np.zeros(n, bool) if sure is None else sure
    taken, fast, step, walked = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n), 0
    if not n:
        return taken, fast, step, walked
    moves = opens.copy()
    moves[0] = True
    moves[1:] |= (lon[1:] != lon[:-1]) | (lat[1:] != lat[:-1])
    at = np.flatnonzero(moves)
    away = np.zeros(len(at))
    away[1:] = _metres(lon[at[:-1]], lat[at[:-1]], lon[at[1:]], lat[at[1:]])
    since = np.diff(t[at], prepend=t[at[0]]) / 1e6
    day = opens[at]
    away[day] = 0.0
    stops = np.where(day, (lon[at] == 0) & (lat[at] == 0) & ~sure[at], away > max_mps * since)
    stops[0] |= not day[0]  # what was before the first is only known to ``last``
    stops = np.append(np.flatnonzero(stops), len(at))
    k = 0
    while k < len(at):
        stop = int(stops[np.searchsorted(stops, k)])
        taken[at[k:stop]], step[at[k:stop]] = True, away[k:stop]
        if stop > k:
            i = at[stop - 1]
            last.moved, last.lon, last.lat, last.t = True, float(lon[i]), float(lat[i]), int(t[i])
        if stop == len(at):
            break
        i, k = int(at[stop]), len(at)
        while i < n:
            walked += 1
            if opens[i]:
                last.moved, last.lon, last.lat = False, 0.0, 0.0
            x, y, now = float(lon[i]), float(lat[i]), int(t[i])
            if x == last.lon and y == last.lat and not (opens[i] and sure[i]):
                i += 1
                continue
            far = metres(last.lon, last.lat, x, y) if last.moved else 0.0
            if last.moved and far > max_mps * ((now - last.t) / 1e6):
                fast[i] = True
                i += 1
                continue
            taken[i], step[i] = True, far
            last.moved, last.lon, last.lat, last.t = True, x, y, now
            after = int(np.searchsorted(at, i, "right"))
            if moves[i]:
                k = after
                break
            i = int(at[after]) if after < len(at) else n  # the others at this place are repeats
    return taken, fast, step, walked
