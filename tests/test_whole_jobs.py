"""Queries that must cover whole tables, against brute force on the smallest ones."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from geotrail.functions.geo import EQUATOR_M, UNITS
from geotrail.plans import adapters as ad
from geotrail.plans.catalog import QUERIES
from geotrail.sources import text

SF = "/root/testdata/sf0.001"


def tracks(spark):
    """Points of each track in order, as arrays (file, line, x, y)."""
    return np.array(sorted((r.file, r.line, r.x, r.y) for r in ad.tracks(spark, SF).collect()))


def test_near_edge_takes_every_segment(spark):
    at = tracks(spark)
    a, b = at[:-1], at[1:]
    a, b = a[a[:, 0] == b[:, 0]], b[a[:, 0] == b[:, 0]]
    dx, dy = b[:, 2] - a[:, 2], b[:, 3] - a[:, 3]
    want = {}
    for file, line, x, y in at:
        t = np.clip(((x - a[:, 2]) * dx + (y - a[:, 3]) * dy) / (dx * dx + dy * dy), 0, 1)
        lat = 2 * math.atan(math.exp((y / UNITS - 0.5) * 2 * math.pi)) - math.pi / 2
        away = np.hypot(x - a[:, 2] - t * dx, y - a[:, 3] - t * dy) * (2 * math.pi * EQUATOR_M / UNITS * math.cos(lat))
        least = away[a[:, 0] != file].min()
        if least <= 30:
            want[int(file), int(line)] = least
    got = {(r.file, r.line): r.distance for r in QUERIES["j9_near_edge"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 4000
    worst = max(abs(got[k] - want[k]) for k in got)
    assert worst < 0.00051, worst


def test_fetch_plan_asks_for_every_tile(spark):
    stock = ad.inventory(spark, SF)
    key = ("layer", "level", "x", "y")
    small = F.when(F.col("layer") == "image", 3000).otherwise(200)
    status = F.when(F.isnull("bytes"), "missing").when((F.col("bytes") < small) & (F.col("level") < 15), "refetch")
    told = stock.groupBy(*key).agg(F.max("bytes").alias("bytes")).select(*key, status.alias("status")).filter("status is not null")
    want = {tuple(r)[:4]: r.status for r in told.collect()}
    got = {tuple(r)[:4]: r.status for r in QUERIES["j6_fetch_plan"](spark, SF).collect()}
    assert want.items() <= got.items() and "refetch" in want.values() and any(y % 3 for *_, y in want)


def test_area_takes_whole_tracks(spark):
    at = tracks(spark)
    want = {}
    for file in np.unique(at[:, 0]):
        p = [(Fraction(float(x)), Fraction(float(y))) for x, y in at[at[:, 0] == file][:, 2:]]
        want[int(file)] = float(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2)
    got = {r.file: r.area for r in QUERIES["m23_polygon_area"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.0501 for k in got)


def test_edges_of_every_track(spark):
    cells = [(file, int(x // 0.5), int(y // 0.5)) for file, _, x, y in tracks(spark)]
    want = {frozenset((a[1:], b[1:])) for a, b in zip(cells, cells[1:], strict=False) if a[0] == b[0] and a != b}
    got = QUERIES["j7_edge_geometry"](spark, SF).collect()
    assert len(got) == len(want) and sum(r.cnt for r in got) >= len(want) > 5000


def test_landmarks_pass_through_text(spark, monkeypatch):
    read = []
    monkeypatch.setattr(text, "read_landmarks", lambda s, path, f=text.read_landmarks: read.append(f(s, path)) or read[0])
    told = QUERIES["s5_landmarks"](spark, SF)
    assert len(read) == 1 and read[0].inputFiles() and read[0].count() == ad.landmarks(spark, SF).count() >= told.count() > 0
