"""Roll-ups hand on from the lowest nodes up before pointers are doubled, with the results of doubling alone."""

from __future__ import annotations

import random

import pytest

from pipewright import session
from pipewright.operators import forest

EDGE = "node string, up string, length double, size int, demand double"


def _forest(n: int, chain: int, seed: int = 5) -> list[tuple]:
    """A bushy forest of n edges, and a chain below one of them."""
    r = random.Random(seed)
    rows = [(f"n{k}", "root" if k < 3 else f"n{r.randrange(k)}", float(r.randint(1, 9)), r.randrange(2), float(r.randrange(5))) for k in range(n)]
    return rows + [(f"c{k}", f"c{k - 1}" if k else "n5", 2.0, 1, 1.0) for k in range(chain)] + [("a", None, 1.0, 0, 3.0), (None, "n7", 1.0, 1, 8.0), (None, "n7", 2.0, 1, 16.0)]


def _totals(rows: list[tuple]) -> list[tuple]:
    below: dict = {}
    for i, row in enumerate(rows):
        below.setdefault(row[1], []).append(i)

    def total(i: int) -> float:
        node = rows[i][0]
        return rows[i][4] + (sum(total(c) for c in below.get(node, [])) if node is not None else 0.0)

    return sorted(((row[0] or "", total(i)) for i, row in enumerate(rows)))


def _doubled(monkeypatch) -> list[int]:
    """Gets how many rows each call hands to the doubling of pointers."""
    found, own = [], forest._rounds
    monkeypatch.setattr(forest, "_rounds", lambda state, *a: found.append(state.count()) or own(state, *a))
    return found


def test_sums_of_a_bushy_forest_double_few_pointers(spark, monkeypatch):
    monkeypatch.setattr(session, "PORTION", 40)
    doubled, rows = _doubled(monkeypatch), _forest(300, 25)
    got = forest.subtree_sum(spark.createDataFrame(rows, EDGE), "demand").collect()
    assert sorted((r["node"] or "", r["total"]) for r in got) == _totals(rows)
    assert len(doubled) == 1 and doubled[0] < 100


def test_columns_come_along_as_if_joined(spark, monkeypatch):
    rows = _forest(300, 25)
    edges = spark.createDataFrame(rows, EDGE)
    for portion in (40, 50_000):
        monkeypatch.setattr(session, "PORTION", portion)
        got = forest.subtree_sum(edges, "demand", kept=["length", "up"])
        assert got.columns == ["node", "length", "up", "total"]
        own = {row[0]: row for row in rows}
        assert sorted((r["node"], r["total"]) for r in got.collect()) == [x for x in _totals(rows) if x[0]]
        assert all((r["length"], r["up"]) == (own[r["node"]][2], own[r["node"]][1]) for r in got.collect())


@pytest.mark.parametrize("odd", ["twice", "null"])
def test_sums_over_odd_rows_are_those_of_doubling(spark, monkeypatch, odd):
    rows = [(f"n{k}", f"n{(k - 1) // 3}" if k else "root", 1.0, 0, float(k % 4)) for k in range(100)]
    rows += [("n2", "n0", 1.0, 0, 5.0), ("n99", "n32", 1.0, 0, 7.0)] if odd == "twice" else []
    if odd == "null":
        rows[2], rows[99] = (*rows[2][:4], None), (*rows[99][:4], None)
    edges, found = spark.createDataFrame(rows, EDGE), []
    for portion in (5, 50_000):
        monkeypatch.setattr(session, "PORTION", portion)
        found.append([sorted(map(str, forest.subtree_sum(edges, "demand", kept=kept).collect())) for kept in ([], ["length"])])
    assert found[0] == found[1]
    n2, n99 = (sorted({x for x in found[0][0] if f"'{n}'" in x}) for n in ("n2", "n99"))
    assert len(found[0][0]) > 100 if odd == "twice" else (n2, n99) == (["Row(node='n2', total=None)"], ["Row(node='n99', total=None)"])


def test_a_cycle_below_bushy_trees_is_told(spark, monkeypatch):
    monkeypatch.setattr(session, "PORTION", 20)
    rows = [*_forest(100, 0), ("x", "y", 1.0, 0, 1.0), ("y", "x", 1.0, 0, 1.0), *((f"x{k}", "x", 1.0, 0, 1.0) for k in range(20))]
    with pytest.raises(ValueError, match="cycle"):
        forest.subtree_sum(spark.createDataFrame(rows, EDGE), "demand")


def test_no_edges(spark, monkeypatch):
    monkeypatch.setattr(session, "PORTION", 0)
    assert forest.subtree_sum(spark.createDataFrame([], EDGE), "demand", kept=["up"]).collect() == []


@pytest.mark.parametrize("odd", ["", "twice", "null"])
def test_runs_of_a_bushy_forest_double_few_pointers(spark, monkeypatch, odd):
    rows, doubled, found = _forest(150, 12), _doubled(monkeypatch), []
    rows += [("n2", "n0", 4.0, 1, 0.0)] if odd == "twice" else []
    if odd == "null":
        rows[3], rows[4] = (*rows[3][:2], None, *rows[3][3:]), (*rows[4][:3], None, rows[4][4])
    edges = spark.createDataFrame(rows, EDGE)
    for portion in (40, 50_000):
        monkeypatch.setattr(session, "PORTION", portion)
        found.append(forest.longest_run(edges, "size", kept=["size"]))
    few, all_ = (sorted(map(str, x.collect())) for x in found)
    assert few == all_ and found[0].columns == ["node", "size", "run"]
    assert doubled[1] >= len(rows) and (doubled[0] == doubled[1] if odd == "twice" else doubled[0] < 80)


def test_chamber_cost_doubles_few_pointers(spark, monkeypatch, tmp_path):
    from pipewright.plans.queries import chamber_cost

    spark.range(0, 400).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    doubled, found = _doubled(monkeypatch), []
    for portion in (60, 50_000):
        monkeypatch.setattr(session, "PORTION", portion)
        found.append({r["node"]: (r["children"], r["price"]) for r in chamber_cost(spark, str(tmp_path)).collect()})
    assert found[0] == found[1]
    assert {k: n for k, (n, _) in found[0].items()} == {k: 2 for k in range(8, 200)}
    assert doubled[0] <= 60 and doubled[1] == 384
