"""GeoJSON and road sources, projection, and the streaming inbox."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pipewright.functions import geometry as geo
from pipewright.plans.planner import plan
from pipewright.sources import geojson, roads
from pipewright.streaming import inbox


def point(x, y):
    return {"type": "Point", "coordinates": [x, y]}


def feature(ident, kind, geometry, **props):
    return {"type": "Feature", "geometry": geometry, "properties": {"id": ident, "object_type": kind, **props}}


GOOD = [
    feature("src", "source", point(37.6, 55.7)),
    feature(1, "heat_network", {"type": "LineString", "coordinates": [[37.6297409928, 55.7490473172], [37.6300595183, 55.7490508689]]}, diameter=100),
    feature("c", "heat_chamber", point(37.6299002555, 55.7490490931)),
    feature("t", "oks_connection_point", point(37.6298687690, 55.7499473673), flow_tph=20),
    feature("r", "restriction", {"type": "Polygon", "coordinates": [[[37.7, 55.7], [37.71, 55.7], [37.71, 55.71], [37.7, 55.7]]]}, restriction_type="road"),
]
OPEN_RING = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 2]]]}
NESTED = {"type": "GeometryCollection", "geometries": [point(1, 2), {"type": "GeometryCollection", "geometries": [point(1, 99)]}]}
CASES = {
    "good": (GOOD, None),
    "twice": ([*GOOD, feature("1", "source", point(1, 2))], "feature 6: ID_DUPLICATE"),
    "bare": ([*GOOD[:2], {"type": "Feature", "properties": {"id": "q", "object_type": "source"}}], "feature 3: GEOMETRY_MISSING"),
    "north": ([feature("z", "source", point(1, 92))], "feature 1: GEOMETRY_INVALID"),
    "text": ([feature("z", "source", {"type": "Point", "coordinates": ["1", 2]})], "feature 1: GEOMETRY_INVALID"),
    "ring": ([feature("z", "restriction", OPEN_RING, restriction_type="oks")], "feature 1: GEOMETRY_INVALID"),
    "nested": ([feature("z", "restriction", NESTED, restriction_type="oks")], "feature 1: GEOMETRY_INVALID"),
    "kind": ([feature("z", "restriction", point(1, 2))], "feature 1: RESTRICTION_TYPE_MISSING"),
    "blank": ([feature("  ", "source", point(1, 2))], "feature 1: ID_INVALID"),
    "none": ([], None),
}
TEXTS = {"array": "[1]", "trail": '{"type":"FeatureCollection","features":[]} {}', "keys": '{"type":"FeatureCollection","type":"x","features":[]}', "broken": '{"type":'}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("territories")
    for name, (features, _) in CASES.items():
        (d / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    for name, text in TEXTS.items():
        (d / f"{name}.geojson").write_text(text)
    return d


def test_inspection(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1].removesuffix(".geojson"): r for r in geojson.inspect(geojson.read(spark, str(folder))).collect()}
    for name, (features, error) in CASES.items():
        assert rows[name]["error"] == error, name
        assert rows[name]["total_objects"] == len(features)
    assert all(rows[name]["error"] == "NOT_JSON_OBJECT" for name in TEXTS)
    assert rows["good"]["type_counts"] == {"heat_chamber": 1, "heat_network": 1, "oks_connection_point": 1, "restriction": 1, "source": 1}
    assert rows["good"]["restriction_counts"] == {"road": 1}
    assert rows["good"]["file_size_bytes"] == (folder / "good.geojson").stat().st_size


def test_ids_keep_their_kind(spark):
    texts = spark.createDataFrame([("1",), ("1.0",), ('"1"',), ("10",)], "t string")
    keys = [r[0] for r in texts.select(geojson.id_key(F.parse_json("t"))).collect()]
    assert keys[0] == keys[1] == "n:1" and keys[2] == "s:1" and keys[3] == "n:10"


def test_plan_from_file_and_back(spark, folder, tmp_path):
    found = geojson.planning_features(geojson.features(geojson.read(spark, str(folder / "good.geojson"))))
    planned = plan(found)
    summary = planned.where("object_type = 'variant_summary' AND variant = 1").collect()[0]
    assert summary["cost"] == pytest.approx(13_974_800, abs=10)
    geojson.write_variants(planned, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").rglob("part-*.txt")
    whole = json.loads(file.read_text())
    assert whole["type"] == "FeatureCollection" and whole["validation_status"] == "VALID" and whole["description"] == "verified: 1 tie-ins, 0 shared branches, 1 consumers connected, 0 left out"
    features = whole["features"]
    pipe = next(f for f in features if f["properties"]["object_type"] == "heat_network")
    assert pipe["properties"]["depth_start"] is None and "depth_end" in pipe["properties"]
    assert pipe["geometry"]["coordinates"][0] == pytest.approx([37.6299002555, 55.7490490931], abs=1e-9)
    stated = next(f for f in features if f["properties"]["object_type"] == "variant_summary")
    assert stated["geometry"] is None and stated["properties"]["calculated_cost"] == pytest.approx(stated["properties"]["construction_cost"])


def test_requests(spark, folder):
    from pipewright import api

    with pytest.raises(ValueError):
        api.plan(spark, str(folder / "good.geojson"), "no id")
    assert api.plan(spark, str(folder / "good.geojson"), "request-0001").where("object_type = 'variant_summary'").count() >= 1
    assert api.cancel(spark, "request-0002") is False
    assert api.inspect(spark, str(folder / "good.geojson")).first()["error"] is None


def test_projection(spark):
    df = spark.createDataFrame([(37.6, 55.75, 412125.4592, 6179143.3236), (37.602, 55.751, 412253.2299, 6179252.0703), (39.0, 0.0, 500000.0, 0.0)], "lon double, lat double, x double, y double")
    x, y = geo.utm(F.col("lon"), F.col("lat"))
    back = df.withColumns({"ux": x, "uy": y})
    lon, lat = geo.lonlat(F.col("ux"), F.col("uy"))
    for r in back.withColumns({"blon": lon, "blat": lat}).collect():
        assert (r["ux"], r["uy"]) == pytest.approx((r["x"], r["y"]), abs=1e-3)
        assert (r["blon"], r["blat"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)


def test_files_that_are_refused(spark, tmp_path):
    from pipewright import api

    good = '{"type":"FeatureCollection","features":[]}'
    for name, text in (("a.geojson", good), ("b.JSON", good), ("c.csv", "x,y"), ("d.json", ""), ("json", good)):
        (tmp_path / name).write_text(text)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in api.inspect(spark, str(tmp_path)).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"a.geojson": None, "b.JSON": None, "c.csv": "WRONG_TYPE", "d.json": "EMPTY_FILE", "json": "WRONG_TYPE"}
    assert rows["c.csv"]["file_size_bytes"] == 3 and rows["c.csv"]["total_objects"] == 0


def test_roads(spark):
    ways = spark.createDataFrame(
        [
            (7, {"highway": "residential", "width": "7.5 m"}, [(0.0, 1.0), (3.0, 1.0)]),
            (7, {"highway": "residential", "width": "7.5 m"}, [(0.0, 1.0), (3.0, 1.0)]),
            (8, {"highway": "footway"}, [(0.0, 1.0), (1.0, 1.0)]),
            (9, {"highway": "service", "width": "2 lanes"}, [(0.5, 0.5), (0.5, 3.0), (1.0, 3.0), (1.0, 1.0)]),
            (10, {"highway": "service"}, [(0.0, 1.0), (1.0, 1.0)]),
        ],
        "id long, tags map<string,string>, geometry array<struct<lon:double,lat:double>>",
    )
    existing = spark.createDataFrame([("external:osm:way:7", "park", None), ("external:osm:way:7:import", "park", None), ("x", "road", "way/10")], "id string, restriction_type string, osm_id string")
    rows = {r["id"]: r for r in roads.convert(ways, (0.0, 0.0, 2.0, 2.0), existing).collect()}
    assert set(rows) == {"external:osm:way:7:import:import", "external:osm:way:9"}
    seven, nine = rows["external:osm:way:7:import:import"], rows["external:osm:way:9"]
    assert seven["width_m"] == 7.5 and nine["width_m"] is None and nine["width_source"] == "unknown" and seven["bridge"] == "no"
    assert [[tuple(p) for p in line] for line in seven["lines"]] == [[(0.0, 1.0), (2.0, 1.0)]]
    assert [[tuple(p) for p in line] for line in nine["lines"]] == [[(0.5, 0.5), (0.5, 2.0)], [(1.0, 2.0), (1.0, 1.0)]]


def test_inbox(spark, folder, tmp_path):
    q = inbox.inspect_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(CASES) + len(TEXTS)


def test_collections_of_any_depth(spark):
    def nested(depth, inner):
        return inner if not depth else {"type": "GeometryCollection", "geometries": [nested(depth - 1, inner)]}

    made = [{"type": "Feature", "geometry": nested(n, point(1, y)), "properties": {"id": f"{n}.{y}", "object_type": "x"}} for n in (7, 8, 12) for y in (2, 99)]
    text = json.dumps({"type": "FeatureCollection", "features": made})
    docs = geojson.parse(spark.createDataFrame([("a", len(text), text)], "path string, file_size long, value string"))
    assert {r["pos"] for r in geojson.violations(geojson.features(docs)).collect()} == {1, 3, 5}


def test_ids_with_many_digits(spark):
    texts = ["1", "1.0", "1e0", "10", "0.12345678901234", "0.12345678901235", "123456789012345678901234567890", '"1"']
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", geojson.id_key(F.parse_json("t")).alias("k"))
    keys = {r["t"]: r["k"] for r in made.collect()}
    assert keys["1"] == keys["1.0"] == keys["1e0"] == "n:1" and keys["10"] == "n:10" and keys['"1"'] == "s:1"
    assert len({*keys.values()}) == 6 and None not in keys.values()


def test_latitudes_beyond_the_projection(spark):
    for kind, coords in (("LineString", [[37.0, 55.0], [37.0, 85.0]]), ("Polygon", [[[37, -1], [38, 0], [38, 1], [37, -1]]])):
        text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": {"id": 1, "object_type": "x"}}]})
        docs = geojson.parse(spark.createDataFrame([("a", len(text), text)], "path string, file_size long, value string"))
        with pytest.raises(Exception, match="latitude"):
            geojson.planning_features(geojson.features(docs)).collect()
