"""The fold over arrays against the rules fix by fix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.functions.geo import metres
from geotrail.operators import fixes as fx
from geotrail.operators.follow import Last, follow


def plain(opens, t, lon, lat):
    moved, lon0, lat0, t0, out = False, 0.0, 0.0, 0, []
    for o, at, x, y in zip(opens, t, lon, lat, strict=True):
        if o:
            moved, lon0, lat0 = False, 0.0, 0.0
        if x == lon0 and y == lat0:
            out.append((False, False, 0.0))
            continue
        away = metres(lon0, lat0, x, y) if moved else 0.0
        if moved and away > 100 * ((at - t0) / 1e6):
            out.append((False, True, 0.0))
            continue
        moved, lon0, lat0, t0 = True, x, y, at
        out.append((True, False, away))
    return out


def days(rng, n, jumps, stays):
    """Fixes a second apart; some far off, some standing still, some at 0, 0."""
    opens = rng.random(n) < 0.03
    opens[0] = True
    lon, lat = 127 + np.cumsum(rng.random(n)) * 1e-4, 37 + np.cumsum(rng.random(n)) * 1e-4
    for k in np.flatnonzero(rng.random(n) < jumps):
        lon[k : k + rng.integers(1, 6)] += rng.choice([0.002, 0.5])
    for k in np.flatnonzero(rng.random(n) < stays):
        m = rng.integers(1, 7)
        lon[k : k + m], lat[k : k + m] = lon[k], lat[k]
    for k in np.flatnonzero(rng.random(n) < 0.01):
        lon[k], lat[k] = 0.0, 0.0
    lon[opens & (rng.random(n) < 0.3)] = 0.0
    lat[lon == 0] = 0.0
    return opens, np.arange(n) * 1_000_000 + rng.integers(0, 400_000, n), lon, lat


@pytest.mark.parametrize("seed", range(8))
def test_equals_the_rules_in_any_batches(seed):
    rng = np.random.default_rng(seed)
    opens, t, lon, lat = days(rng, 2000, jumps=[0, 0.02, 0.2][seed % 3], stays=[0, 0.05, 0.3][seed // 3 % 3])
    want = plain(opens, t, lon, lat)
    for size in (2000, 701, 37, 1):
        last, got = Last(), []
        for k in range(0, 2000, size):
            own = slice(k, k + size)
            taken, fast, step, _ = follow(opens[own], t[own], lon[own], lat[own], last, 100.0)
            got += zip(taken.tolist(), fast.tolist(), step.tolist(), strict=True)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)


def test_clean_days_are_hardly_walked():
    rng = np.random.default_rng(1)
    moves = rng.random(20000) * 1e-4
    moves[5000:9000] = 0  # parked
    opens, lon = np.arange(20000) % 700 == 0, 127 + np.cumsum(moves)
    t, lat = np.arange(20000) * 1_000_000, np.full(20000, 37.0)
    lon[12000] += 1
    taken, fast, _, walked = follow(opens, t, lon, lat, Last(), 100.0)
    assert walked < 5 and fast.sum() == 1 and taken.sum() > 15000
    assert follow(*(x[:0] for x in (opens, t, lon, lat)), Last(), 100.0)[3] == 0


def test_batches_of_a_day_in_spark(spark):
    """Days cut into many Arrow batches, with fixes that lack a time or place at their ends."""
    rows = [(u, k, k if k % 11 else None, 127 + k * 1e-4 + (0.5 if k % 13 == 0 else 0) if k % 7 else None, 37.0) for u in (None, 1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, lon double, lat double").withColumn("ts", F.timestamp_seconds("s"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = []
    try:
        for size in ("10000", "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            told.append(sorted(((r.user_id or 0, r.event_id, r.fast, r.inside, round(r.way, 6), r.first) for r in fx._followed(df, 100.0, fx.BOX, []).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert told[0] == told[1] == told[2] and len(told[0]) == 900 and any(r[2] for r in told[0])
    for u in (0, 1, 2):
        own = [r for r in rows if (r[0] or 0) == u and r[2] is not None and r[3] is not None]
        want = plain([k == 0 for k in range(len(own))], [r[2] * 1_000_000 for r in own], [r[3] for r in own], [r[4] for r in own])
        got = {r[1]: r for r in told[0] if r[0] == u}
        assert [got[r[1]][2] for r in own] == [w[1] for w in want]
        assert np.allclose([got[r[1]][4] for r in own], np.cumsum([w[2] for w in want]), atol=1e-5)
