"""Trees that are sized a few levels at a time come out as those that are sized whole."""

from __future__ import annotations

import pytest

from pipewright.operators.sizing import Edge, size_forest, size_tree


@pytest.mark.parametrize("levels", [2])
def test_forest_in_bands_equals_whole_trees(spark, levels):
    edges = [(2 if k // 2 >= 2 and bin(k)[2:4] == "10" else 3, k, k // 2, 10.0 + k * 13 % 150) for k in range(4, 24)]
    flow = {k: 1 + k * 31 % 400 / 10 if k >= 12 else 0.0 for _, k, _, _ in edges}
    for k in range(23, 7, -1):
        flow[k // 2] = flow.get(k // 2, 0.0) + flow[k]
    rows = [(r, k, u, x, round(flow[k], 6)) for r, k, u, x in edges] + [(90, 91, 90, 50.0, 1e9)]  # the last tree has no size that carries it
    got = {(r["root"], r["node"], r["dn_idx"], r["tree_cost"]) for r in size_forest(spark.createDataFrame(rows, "root long, node long, up long, length double, flow double"), 3, False, levels).collect()}
    want = set()
    for root in (2, 3, 90):
        tree = [Edge(str(k), str(u), x, x, f) for r, k, u, x, f in rows if r == root]
        best = size_tree(str(root), tree, 3, False)
        want |= {(root, int(e.node), best[1][e.node] if best else None, best[0] if best else None) for e in tree}
    assert got == want
