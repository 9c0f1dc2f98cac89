"""The join of points to near segments against all pairs, with cells as coarse as can be, small ones, and dealt ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.functions.geo import EQUATOR_M, UNITS
from geotrail.operators import fixes as fx
from geotrail.operators import match

X, Y = 893990.0, 626000.0


def scenes(name):
    rng = np.random.default_rng(4)
    rows = []
    if name == "streets":
        rows = [(f, k, X + k * 0.7 + rng.random(), Y + f * 0.9 + rng.random() * 3) for f in range(8) for k in range(60)]
        rows += [(20, 0, X - 40, Y + 1), (20, 1, X + 90, Y + 9), (21, 0, X + 5, Y - 30), (21, 1, X + 5, Y + 50)]
    elif name == "parked":
        rows = [(0, k, X + 10 + rng.random() * 0.2, Y + rng.random() * 0.2) for k in range(1500)]  # a vehicle that stands among others
        rows += [(f, k, X + k * 1.1, Y - 1 + f * 0.15) for f in range(1, 13) for k in range(20)]
        rows += [(30, k, X + 10.0, Y) for k in range(300)]  # another, at one place
    elif name == "far":
        rows = [(f, k, X + f * 5000 + k, Y - f * 7000) for f in range(4) for k in range(5)] + [(9, 0, 5.0, 6.0)]
    return [(f, k, float(x), float(y)) for f, k, x, y in rows]


def plain(rows, limit=30.0, own=None, by_track=True):
    """The nearest by (file, line, track), or by (file, line) of segments that don't touch own[file, line]."""
    at = np.array(rows)
    a, b = at[:-1], at[1:]
    fine = a[:, 0] == b[:, 0]
    a, b = a[fine], b[fine]
    out = {}
    for f, k, x, y in rows:
        dx, dy = b[:, 2] - a[:, 2], b[:, 3] - a[:, 3]
        t = np.clip(((x - a[:, 2]) * dx + (y - a[:, 3]) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
        unit = 2 * math.pi * EQUATOR_M / UNITS * math.cos(2 * math.atan(math.exp((y / UNITS - 0.5) * 2 * math.pi)) - math.pi / 2)
        away = np.hypot(x - a[:, 2] - t * dx, y - a[:, 3] - t * dy) * unit
        for s in np.flatnonzero(away <= limit):
            track = int(a[s, 0])
            if by_track and track == f or not by_track and own.get((f, k)) in (track, int(a[s, 1])):
                continue
            told = (round(float(away[s]), 6), track, int(a[s, 1]))
            key = (f, k, track) if by_track else (f, k)
            out[key] = min(out.get(key, told), told)
    return out


def same(got, want):
    """The same keys and distances; the same segments but where rounding parts two that meet in a point."""
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 for k in want)
    assert sum(got[k][1:] == want[k][1:] for k in want) >= 0.99 * len(want)


LIMITS = {"coarse": {}, "small": {"PAIRS": 3000, "BLOCK": 50}, "dealt": {"PAIRS": 0, "BLOCK": 7}}


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("scene", ["streets", "parked", "far"])
def test_nearest_of_each_track(spark, monkeypatch, scene, limits):
    for name, v in LIMITS[limits].items():
        monkeypatch.setattr(match, name, v)
    rows = scenes(scene)
    if limits == "dealt":
        rows = rows[::5] if scene == "parked" else rows
        rows = [(f, k, x, y) for k, (f, _, x, y) in enumerate(rows)]
    points = spark.createDataFrame(rows, "file long, line long, x double, y double").repartition(3)
    got = {(r.file, r.line, r.seg_file): (r.distance, r.seg_file, r.seg_line) for r in match.nearest_segments(points, fx.segments(points)).collect()}
    same(got, plain(rows))


@pytest.mark.parametrize("limits", ["coarse", "dealt"])
def test_nearest_edge_but_some(spark, monkeypatch, limits):
    for name, v in LIMITS[limits].items():
        monkeypatch.setattr(match, name, v)
    rows = scenes("streets")
    own = {(f, k): (None if k % 3 == 0 else f if k % 3 == 1 else k % 60) for f, k, *_ in rows}
    points = spark.createDataFrame([(*r, own[r[:2]]) for r in rows], "file long, line long, x double, y double, except_id long")
    edges = fx.segments(points).select(F.col("file").alias("src"), F.col("line").alias("dst"), "x0", "y0", "x1", "y1")
    got = {(r.file, r.line): (r.distance, r.src, r.dst) for r in match.near_edge(points, edges, 30.0).collect()}
    same(got, plain(rows, own=own, by_track=False))


def test_a_crowd_is_spread_and_pairs_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(match, "PAIRS", 100_000)
    monkeypatch.setattr(match, "BLOCK", 200)
    rows = scenes("parked")
    points = spark.createDataFrame(rows, "file long, line long, x double, y double")
    met = []
    monkeypatch.setattr(match, "_blocks", lambda df, owner, f=match._blocks: met.append(f(df, owner)) or met[-1])
    assert match.nearest_segments(points, fx.segments(points)).count() == len(plain(rows))
    for dealt, blocks in met:
        sizes = [r["count"] for r in dealt.groupBy("cx", "cy", "track", "part").count().collect()]
        assert len(sizes) > 8 and max(sizes) < 400 and blocks.count() >= len(sizes)


def test_no_rows(spark):
    points = spark.createDataFrame(scenes("far"), "file long, line long, x double, y double")
    assert match.nearest_segments(points, fx.segments(points)).count() == 0
    assert match.nearest_segments(points.limit(0), fx.segments(points)).count() == 0
    assert match.nearest_segments(points, fx.segments(points.limit(0))).count() == 0
    told = match.integrate_paths(points, fx.segments(points))
    assert told.count() == len(scenes("far")) and told.select("run").distinct().count() == 1


def in_order(rows, limit=30.0):
    """(file, line) kept when each track is held against the kept segments of those before it."""
    kept, segments = set(), np.zeros((0, 4))
    for f in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == f)
        fine = []
        for _, _, x, y in own:
            a, b = segments[:, :2], segments[:, 2:]
            d = b - a
            t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
            unit = 2 * math.pi * EQUATOR_M / UNITS * math.cos(2 * math.atan(math.exp((y / UNITS - 0.5) * 2 * math.pi)) - math.pi / 2)
            away = np.hypot(x - a[:, 0] - t * d[:, 0], y - a[:, 1] - t * d[:, 1]) * unit
            fine.append(not (away <= limit).any())
        kept |= {r[:2] for r, ok in zip(own, fine, strict=True) if ok}
        new = [(*p[2:], *q[2:]) for p, q, i, j in zip(own, own[1:], fine, fine[1:], strict=False) if i and j]
        segments = np.concatenate([segments, np.array(new).reshape(-1, 4)])
    return kept


@pytest.mark.parametrize("limits", ["coarse", "dealt"])
@pytest.mark.parametrize("scene", ["streets", "parked"])
def test_integration_in_order(spark, monkeypatch, scene, limits):
    for name, v in LIMITS[limits].items():
        monkeypatch.setattr(match, name, v)
    rows = [(f, k * 3 + 1, x, y) for f, k, x, y in scenes(scene)[:: 1 if scene == "streets" else 4]]
    points = spark.createDataFrame(rows, "file long, line long, x double, y double")
    got = {(r.file, r.line) for r in match.integrate_in_order(points, fx.segments(points)).collect()}
    assert got == in_order(rows) and 0 < len(got) < len(rows)


def test_integration_of_given_tracks_in_order(spark):
    from geotrail.plans import adapters as ad
    from geotrail.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    want = in_order([tuple(r) for r in ad.tracks(spark, sf).select("file", "line", "x", "y").collect()])
    got = {(r.file, r.line) for r in QUERIES["w5_integrate_in_order"](spark, sf).collect()}
    assert got == want and len(want) > 3000
    print("kept", len(want))


def test_tracks_with_names(spark):
    """Tracks are told apart and ordered by names as by numbers."""
    rows = scenes("streets")
    number = spark.createDataFrame(rows, "file long, line long, x double, y double")
    name = number.withColumn("file", F.format_string("track é %03d.txt", "file"))
    of = lambda f: int(f[8:11])
    told = lambda df, file: {(file(r.file), r.line, file(r.seg_file)): r.seg_line for r in match.nearest_segments(df, fx.segments(df)).collect()}
    assert told(name, of) == told(number, int)
    for f in (match.integrate_paths, match.integrate_in_order):
        kept = [{(of(str(r.file)) if isinstance(r.file, str) else r.file, r.line, r.run) for r in f(df, fx.segments(df)).collect()} for df in (name, number)]
        assert kept[0] == kept[1] and kept[0]


def test_a_place_that_is_no_number_hides_no_neighbour():
    r = np.random.default_rng(3)
    x, y = r.uniform(0, 60, 700), r.uniform(0, 60, 700)
    x[::50] = np.nan
    x0, y0 = r.uniform(0, 60, 300), r.uniform(0, 60, 300)
    group, unit = np.repeat(np.arange(30), 10), np.full(700, 38.0)
    parts = match.compared((x, y, unit), (x0, y0, x0 + 1, y0), group, 30.0, lambda p, s: np.ones(len(p), bool))
    got = sorted((int(p), int(s)) for part in parts for p, s in zip(part[0], part[1], strict=True))
    near = np.hypot(x[:, None] - np.clip(x[:, None], x0, x0 + 1), y[:, None] - y0) * 38.0 <= 30.0
    assert got == [(int(p), int(s)) for p, s in zip(*np.nonzero(near), strict=True)]


def test_short_segments_are_copied_to_few_cells(spark):
    """Tracks with a point each 20 m: a segment is written to fewer than two cells on the average (more than three with cells of 3 units)."""
    rows = [(k * 0.6, f * 0.9, k * 0.6 + 0.6, f * 0.9 + 0.1, 1.0) for f in range(50) for k in range(50)]
    s = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, grow double")
    assert match._celled(s).count() < 2 * len(rows)
