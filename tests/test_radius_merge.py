"""Merging within a radius against electing leaders one by one, and listing by tasks."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from geotrail.operators import graph
from geotrail.sources.tables import list_files, read_tile_inventory


def elected(rows, radius):
    """{leader: [(x, y) of its points]}, and each point's leader."""
    leaders, of = [], {}
    for p in sorted({r[2:] for r in rows}):
        near = [(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), q) for q in leaders]
        if not any(d <= radius * radius for d, _ in near):
            leaders.append(p)
    for p in {r[2:] for r in rows}:
        of[p] = p if p in leaders else min((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), q) for q in leaders if q < p and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= radius * radius)[1]
    return leaders, of


@pytest.mark.parametrize("shift", [0.0, 0.25, 17.125])
def test_equals_one_by_one_wherever_the_grid_lies(spark, shift):
    rng = np.random.default_rng(6)
    rows = [(f, k, round(k * 0.22 + rng.random() * 0.2, 3) + shift, round(rng.random() * 0.6, 3) - shift) for f in range(6) for k in range(50)]
    rows += [(9, k, 3.0 + shift, -shift) for k in range(30)] + [(10, 0, 3.5 + shift, -shift), (10, 1, 500.0, 500.0)]
    leaders, of = elected(rows, 0.5)
    vertices, members = graph.merge_by_radius(spark.createDataFrame(rows, "file long, line long, x double, y double").repartition(3))
    got = {(r.id.x, r.id.y): (r.px, r.pz, r.acc_cnt) for r in vertices.collect()}
    assert set(got) == set(leaders) and 20 < len(got) < len(rows) / 3
    sums = Counter(of[r[2:]] for r in rows)
    assert {k: v[2] for k, v in got.items()} == dict(sums)
    for q in leaders:
        own = [r[2:] for r in rows if of[r[2:]] == q]
        assert np.allclose(got[q][:2], np.mean(own, axis=0))
    assert {(r.file, r.line): (r.id.x, r.id.y) for r in members.collect()} == {r[:2]: of[r[2:]] for r in rows}
    steps = Counter()
    for f in {r[0] for r in rows}:
        own = [of[r[2:]] for r in sorted(x for x in rows if x[0] == f)]
        steps.update(tuple(sorted(p)) for p in zip(own, own[1:], strict=False) if p[0] != p[1])
    assert {((r.a.x, r.a.y), (r.b.x, r.b.y)): r.cnt for r in graph.member_edges(members).collect()} == steps


def test_points_on_both_sides_of_a_cell_edge_merge(spark):
    df = spark.createDataFrame([(1, 0, 9.99, 5.0), (2, 0, 10.01, 5.0), (3, 0, 30.0, 5.0)], "file long, line long, x double, y double")
    assert graph.merge_points(df).count() == 3 and graph.merge_by_radius(df)[0].count() == 2
    assert graph.merge_by_radius(df.limit(0))[0].count() == 0


def test_query_equals_one_by_one(spark):
    from geotrail.plans import adapters as ad
    from geotrail.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in ad.roads(spark, sf).filter("line <= 120").select("file", "line", "x", "y").collect()]
    vertices, _ = graph.merge_by_radius(ad.roads(spark, sf).filter("line <= 120"))
    assert {(r.id.x, r.id.y) for r in vertices.collect()} == set(elected(rows, 0.5)[0])
    told = QUERIES["a5_a6_merge_by_radius"](spark, sf).collect()
    assert sum(r.acc_cnt for r in told) == ad.roads(spark, sf).count() > len(told) > 100


def test_files_are_listed_by_tasks(spark, tmp_path):
    for k in range(60):
        folder = tmp_path / f"{k % 4}" / f"{k % 7:04d}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k % 7:04d}_{k:04d}.dem").write_bytes(b"x" * k)
    (tmp_path / "_aside").mkdir()
    (tmp_path / "_aside" / "0000_0000.dem").write_bytes(b"x")
    (tmp_path / "0" / "empty").mkdir()
    told = list_files(spark, str(tmp_path))
    assert sorted((r.path, r.length) for r in told.collect()) == sorted((str(p), p.stat().st_size) for p in tmp_path.rglob("*.dem") if "_aside" not in str(p))
    assert read_tile_inventory(spark, f"file://{tmp_path}", "height", False, "dem").count() == 60
    assert read_tile_inventory(spark, str(tmp_path), "height", False, "jpg").count() == 0
    new = tmp_path / "1" / "0001" / "0001_0099.dem"
    new.write_bytes(b"late")
    import os

    later = datetime.now() + timedelta(hours=1)
    os.utime(new, (later.timestamp(), later.timestamp()))
    since = read_tile_inventory(spark, str(tmp_path), "height", False, "dem", since=later - timedelta(minutes=1))
    assert [(r.level, r.x, r.y, r.bytes) for r in since.collect()] == [(1, 99, 1, 4)]
    assert list_files(spark, str(tmp_path / "0" / "empty")).count() == 0


def test_chains_over_small_tiles_go_on_in_rounds_with_few_rows(spark, monkeypatch):
    """Dense places, tiles of 16 radii: what waits goes on over edges; the pairs of near places are never rows."""
    dealt = []
    monkeypatch.setattr(graph, "TILE", 16)
    monkeypatch.setattr(graph, "_dealt", lambda rows, radius, f=graph._dealt: dealt.append(f(rows, radius).count()) or f(rows, radius))
    rng = np.random.default_rng(3)
    rows = [(f, k, float(x), float(y)) for f in range(8) for k, (x, y) in enumerate((rng.random((100, 2)) * [12, 1.5] - 3).round(2).tolist())]
    rows += [(20, k, -0.25, -2.5) for k in range(500)] + [(21, 0, -0.0, 0.0), (21, 1, 0.0, -0.0)]
    leaders, of = elected(rows, 0.5)
    df = spark.createDataFrame([*rows, (22, 0, None, 1.0)], "file long, line long, x double, y double")
    vertices, members = graph.merge_by_radius(df.repartition(5))
    assert {(r.id.x, r.id.y): r.acc_cnt for r in vertices.collect()} == dict(Counter(of[r[2:]] for r in rows))
    assert {(r.file, r.line): (r.id.x, r.id.y) for r in members.collect()} == {r[:2]: of[r[2:]] for r in rows}
    pairs = sum((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 0.25 for p in rows for q in rows if p[2:] > q[2:])
    assert len(dealt) > 2 and max(dealt) < 2 * len(rows) < pairs / 5
