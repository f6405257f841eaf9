"""The road service as a data source, on saved responses."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pipewright.sources.road_service import RoadReader, area_km2, read_roads

TILE = 0.02


def way(key, highway, *points):
    return {"type": "way", "id": key, "tags": {"highway": highway, "name": f"w{key}"}, "geometry": [{"lon": x, "lat": y} for x, y in points]}


WAYS = [
    way(1, "residential", (37.005, 55.005), (37.015, 55.006)), way(2, "primary", (37.01, 55.01), (37.05, 55.01)),  # the second through three tiles
    way(3, "footway", (37.001, 55.001), (37.002, 55.002)), way(4, "service", (37.045, 55.025), (37.05, 55.03)), way(5, "tertiary", (36.99, 55.035), (37.03, 55.025)),
]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Two endpoints: the first misses a tile and has an incomplete one."""
    one, two = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("two")
    reader = RoadReader({"endpoints": str(one), "box": "37.0,55.0,37.06,55.04"})
    for i, t in enumerate(reader.partitions()):
        w, s, e, n = t.box
        inside = [x for x in WAYS if any(min(p["lon"] for p in x["geometry"]) <= e and max(p["lon"] for p in x["geometry"]) >= w and min(p["lat"] for p in x["geometry"]) <= n and max(p["lat"] for p in x["geometry"]) >= s for _ in [0])]
        whole = json.dumps({"elements": [*inside, {"type": "node", "id": 9}]})
        (two / t.name()).write_text(whole)
        if i != 1:
            (one / t.name()).write_text(json.dumps({"elements": [], "remark": "timed out"}) if i == 2 else whole)
    return f"{one},{two}"


def load(spark, endpoints, box=(37.0, 55.0, 37.06, 55.04)):
    return read_roads(spark, endpoints.split(","), box, TILE)


def test_each_way_once_and_the_second_endpoint(spark, folders):
    df = load(spark, folders)
    got = {r["id"]: r for r in df.collect()}
    assert df.count() == len(got) == 4 and set(got) == {1, 2, 4, 5}
    assert got[2]["tags"]["name"] == "w2" and [tuple(p) for p in got[2]["geometry"]] == [(37.01, 55.01), (37.05, 55.01)]
    assert df.rdd.getNumPartitions() == 6
    with pytest.raises(Exception, match="no endpoint gave the tile"):
        load(spark, folders.split(",")[0]).collect()


def test_filters_reach_the_source(spark, folders):
    df = load(spark, folders).where(F.col("highway").isin("primary", "service") & (F.col("east") >= 37.041) & (F.col("south") <= 55.015))
    assert [r["id"] for r in df.collect()] == [2]
    assert df.rdd.getNumPartitions() == 1  # of six tiles one is asked for
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "IN (primary,service)" not in plan


def test_boxes_that_are_refused(spark, folders):
    assert area_km2((37.0, 55.0, 37.06, 55.04)) == pytest.approx(0.06 * 0.04 * 111.32**2 * 0.573, rel=1e-3)
    for box, text in (((37.0, 55.0, 38.0, 56.0), "more than 100 km2"), ((37.0, 55.0, 37.0, 55.01), "no area")):
        with pytest.raises(Exception, match=text):
            load(spark, folders, box).collect()
    with pytest.raises(ValueError, match="box of four"):
        RoadReader({"endpoints": "x", "box": "1,2,3"})
