"""What a task of the verification and of the forest roll-ups sorts doesn't grow with the tables."""

from __future__ import annotations

from pipewright import session
from pipewright.operators import forest
from pipewright.plans import tampered

SF = "/root/testdata/sf0.001"


def test_many_states_are_dealt_in_as_many_partitions_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(session, "PORTION", 100, raising=False)
    found = tampered.verify_tampered(spark, SF)
    codes = [codes for _, _, codes in tampered.cases()]
    keys = [r["c_custkey"] for r in session.table(spark, SF, "customer").select("c_custkey").collect()]
    rows = found.collect()
    assert sorted((r["territory"], r["variant"], r["code"]) for r in rows) == sorted((str(k), 1, code) for k in keys for code in codes[k % len(codes)])
    assert found.rdd.getNumPartitions() * 100 >= 5 * len(keys)  # Spark alone merges them into one


def test_ended_pointers_dont_meet_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(session, "PORTION", 100, raising=False)
    edges = [(f"n{i}", f"m{i}", 1.0, i) for i in range(2000)] + [("a", "b", 1.0, -1), ("b", "c", 2.0, -1), ("c", "d", 3.0, -1)]
    found = forest.longest_run(spark.createDataFrame(edges, "node string, up string, length double, dn int"), "dn")
    sizes = found.rdd.glom().map(len).collect()
    runs = {r["node"]: r["run"] for r in found.collect()}
    assert len(runs) == len(edges) and (runs["a"], runs["b"], runs["c"], runs["n5"]) == (1.0, 3.0, 6.0, 1.0)
    assert max(sizes) < len(edges) / 4
