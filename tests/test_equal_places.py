"""What many rows share is searched once, and comes out for each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipewright.functions import geometry as geo
from pipewright.operators import spatial
from pipewright.plans import demo

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_detours_are_searched_once(spark):
    plan = _plan(demo.route_detour(spark, SF))
    assert "Aggregate" in plan[plan.index("MapInPandas"):]


def test_lists_of_a_place_are_bounded_and_whole(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 6.0)], "ckey long, x double")
    found = spark.range(3 * spatial.LIST).select(F.lit(5.0).alias("x"), F.col("id").alias("b"))
    assert spatial.listed(found, ["x"], "b", "b").count() > 2
    rows = spatial.expanded(points, ["x"], found, "b", ("b",)).select("ckey", "b").collect()
    assert sorted(map(tuple, rows)) == [(c, b) for c in (1, 2) for b in range(3 * spatial.LIST)]


def test_nearest_of_equal_shapes_and_places(spark):
    points = spark.createDataFrame([(i, 0.0, 0.0) for i in range(30)], "ckey long, x double, y double")
    shapes = spark.createDataFrame([(i, 3.0, -1.0, 3.0, 1.0) for i in range(9, 40)] + [(1, 9.0, 0.0, 9.0, 5.0)], "pkey long, x1 double, y1 double, x2 double, y2 double")
    extent = ("x1", "y1", "x2", "y2")
    found = spatial.nearest(points, "ckey", "x", "y", shapes, extent, geo.point_segment_distance(*map(F.col, ("x", "y", *extent))), "pkey", 2)
    assert sorted((r["ckey"], r["pkey"], r["rn"]) for r in found.collect()) == [(i, 8 + n, n) for i in range(30) for n in (1, 2)]


def test_groups_have_the_digest_of_all_their_keys_in_order(spark):
    import hashlib

    from pipewright.plans.queries import QUERIES

    top = spark.read.parquet(f"{SF}/customer.parquet").agg(F.max("c_custkey")).first()[0]
    want: dict = {}
    for node in range(16, top + 1):
        if node * 2 > top:
            want.setdefault(node >> (node.bit_length() - 4), []).append(str(node))
    got = {r["root"]: (r["n"], r["digest"]) for r in QUERIES["consumer_groups"](spark, SF).collect()}
    assert got == {root: (len(keys), hashlib.md5(",".join(keys).encode()).hexdigest()) for root, keys in want.items()}
