"""Heights on the ground: how height maps travel, and where they are missing."""

import re

import pytest

from geotrail.operators import terrain
from geotrail.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["m19_j5_elevation", "u3_tracks_to_3d"])
def test_height_maps_are_not_broadcast(spark, name):
    """A map has more bytes than a plan can tell: the join that brings them must be shuffled at any size."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    joins = [line.strip(" :+-") for line in plan.splitlines() if re.search(r"Join \[__f", line) and "LeftOuter" in line]
    assert len(joins) == 1 and joins[0].startswith("SortMergeJoin"), joins


@pytest.mark.parametrize("name", ["m19_j5_elevation", "u3_tracks_to_3d", "j3_fallback_tile"])
def test_tile_inventories_are_not_broadcast(spark, name):
    """The keys of all tiles are as many as the table has; small files don't say how many that is."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    joins = [line.strip(" :+-") for line in plan.splitlines() if re.search(r"Join \[key#", line)]
    assert joins and all(j.startswith("SortMergeJoin") for j in joins), joins


def test_points_without_a_map_and_with_one(spark):
    dem = spark.createDataFrame([(1, 0, 0, 1, 1, [7.0]), (2, 3, 3, 1, 1, [9.0])], "level int, x long, y long, width int, height int, z array<float>")
    half, top = 1 << 19, 1 << 20
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, half + 5.0, 5.0), (3, top - 5.0, top - 5.0)], "id int, x double, y double")
    got = {r.id: r.elevation for r in terrain.elevation(points, dem, 4).collect()}
    assert got[2] is None and got[1] == pytest.approx(0.35) and got[3] == pytest.approx(0.45)
