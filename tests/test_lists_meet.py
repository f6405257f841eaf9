"""What many rows share meets once, as lists, and rows are made where it met."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pipewright.operators import polygons, spatial
from pipewright.plans import network_queries, queries


def test_ways_and_forms_meet_once_for_stretches(spark, tmp_path, monkeypatch):
    # routes of one way and plots of one form, two of eleven of them roads or tram tracks
    spark.createDataFrame([(1 + 1800 * k, 0) for k in range(40)] + [(None, 0), (1, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(84000 * k,) for k in range(33)] + [(None,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    seen, own = [], spatial.extent_join

    def spied(left, a, right, *rest, **named):
        seen.append((left.count(), right.count()))
        return own(left, a, right, *rest, **named)

    monkeypatch.setattr(network_queries.spatial, "extent_join", spied)
    found = network_queries.plot_intervals(spark, str(tmp_path)).collect()
    assert seen == [(1, 1)]
    assert len(found) == 40 * 6 and len({(r["okey"], r["bkey"]) for r in found}) == len(found)
    assert {(r["from_m"], r["to_m"]) for r in found} == {(found[0]["from_m"], found[0]["to_m"])}


def test_stretches_in_columns_are_those_in_rows(spark):
    corners = [(f"x{i}", f"y{i}") for i in range(5)]
    legs = spark.range(400).selectExpr("id AS leg", *(f"CAST(abs(hash(id, {n})) % 21 AS DOUBLE) AS {c}" for n, c in enumerate(polygons.LEG))).where("ax <> bx OR ay <> by")
    shapes = spark.range(12).selectExpr("id AS shape", *(f"CAST(abs(hash(id, 'c', {n})) % 21 AS DOUBLE) AS {c}" for n, c in enumerate(sum(corners, ()))))
    sides = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    rows = shapes.select("shape", F.explode(F.array(*(F.struct(*(F.col(c).alias(e) for c, e in zip(s, polygons.EDGE, strict=True))) for s in sides))).alias("s")).select("shape", "s.*")
    formed = polygons.with_edges(rows, "shape")
    pairs = legs.crossJoin(formed)
    want = {(r["leg"], r["shape"], r["low"], r["high"]) for r in polygons.inside_stretches(pairs, ["leg", "shape"], formed, "shape").collect()}
    got = polygons.stretches(pairs.join(shapes, "shape"), ["leg", "shape"], [tuple(map(F.col, s)) for s in sides]).collect()
    assert want and len(got) == len(want) and {(r["leg"], r["shape"], r["low"], r["high"]) for r in got} == want


def test_consumers_of_a_line_meet_a_road_as_a_list(spark, tmp_path):
    # 50 consumers of one x, and 20 roads over it
    x = 6 * 6007 % 4000 + 1
    first = next(k for k in range(4000) if k * 7919 % 4000 == x)
    spark.createDataFrame([(first + 4000 * k,) for k in range(50)] + [(None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(6 + 11 * 4000 * k,) for k in range(20)] + [(None,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    rows = queries.road_intervals(spark, str(tmp_path))
    found = rows.collect()
    assert len({(r["ckey"], r["bkey"]) for r in found}) == len(found) == 50 * 20
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of lists and roads: rows come after it, and none is dealt
    assert "Generate" in plan[: plan.index("Join")] and "Repartition" not in plan[: plan.index("Join")]


SF = "/root/testdata/sf0.001"
VIOLATIONS = [queries.hard_violations, network_queries.plot_violations]


@pytest.mark.parametrize("query", VIOLATIONS)
def test_what_small_files_make_is_not_sent_through_the_driver(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("query", VIOLATIONS)
def test_distances_are_rounded_before_rows_come_out_of_lists(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: plan.index("Generate")]
    assert "round(" not in last and "Filter" not in last
