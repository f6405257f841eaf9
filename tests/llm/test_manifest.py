"""The Merkle manifest against a plain version, and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pipewright.llm import manifest

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, fanout):
    """(root, of each node the list of (left, right) up to the root)."""
    ways, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, own in enumerate(at):
            run = runs[i // fanout]
            for leaf in own:
                ways[leaf].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        nodes = [h("".join(r)) for r in runs]
        at = [sum(at[i : i + fanout], []) for i in range(0, len(at), fanout)]
    return nodes[0], ways


def plain_manifest(rows, fanout=8):
    """(key, group, leaf) rows: (key, group, leaf, subroot, root, way)."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key is not None, key if key is not None else 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        subroot, ways = trees[g]
        out += [(k if there else None, g, leaf, subroot, root, tuple(way + top)) for (there, k, leaf), way in zip(sorted(groups[g]), ways, strict=True)]
    return out


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, fanout):
    rows = [(i, g, h(f"{g}{i}")) for g, n in (("en", 30), ("de", 9), ("fr", 8), ("é", 1), ("Z", 3), ("a", 2), (None, 5), ("", 1), ("x", 1), ("y", 1)) for i in range(n)]
    rows += [(3, "en", h("again")), (3, "en", h("again")), (3, "en", h("en3")), (None, "en", h("no key")), (None, "en", h("no key"))]
    df = spark.createDataFrame(rows, "key long, g string, leaf string").withColumns({c: F.lit("own") for c in ("i", "n", "node", "way", "root", "_tie", "name", "all", "_range")}).repartition(3)
    got = manifest.build_manifest(df, "g", ["key"], fanout=fanout)
    assert sorted(got.columns) == sorted([*df.columns, "subroot"])
    found = Counter((r["key"], r["g"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["way"])) for r in got.collect())
    assert found == Counter(plain_manifest(rows, fanout))
    assert all(r["folded"] == r["root"] for r in got.withColumn("folded", manifest.folded(F.col("leaf"), F.col("way"))).collect())


def test_manifest_small_tables(spark):
    empty = spark.createDataFrame([], "key long, g string, leaf string")
    assert manifest.build_manifest(empty, "g", ["key"]).count() == 0
    [one] = manifest.build_manifest(spark.createDataFrame([(1, None, h("x"))], "key long, g string, leaf string"), "g", ["key"]).collect()
    assert one["root"] == one["subroot"] == one["leaf"] and one["way"] == []


def test_many_equal_rows(spark):
    rows = [(7, "en", h("same"))] * 700 + [(8, "en", h("other"))] * 20
    got = manifest.build_manifest(spark.createDataFrame(rows, "key long, g string, leaf string").repartition(4), "g", ["key"]).collect()
    assert Counter((r["key"], r["leaf"], tuple(map(tuple, r["way"]))) for r in got) == Counter((k, leaf, way) for k, _, leaf, _, _, way in plain_manifest(rows))


def test_op12_columns(spark, tmp_path):
    texts = [None, "", "Ab Ä", "no capitals", "X" * 50_000, "ÀÉ UPPER"] * 9
    rows = [(i if i % 11 else None, t, ["en", "de", None, "zh"][i % 4] if i else "alone", ["web", None][i % 2], i % 5 or None) for i, t in enumerate(texts)] + [(5, "twice", "en", "web", 1)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    leaves = [(d, lang, h("".join(map(field, (d, source, lang, n, t)))), d, source, n, t) for d, t, lang, source, n in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    used = {x[2]: h("".join(map(field, (x[3], x[4], x[1], x[5], x[6].translate(lower) if x[6] is not None else None)))) if zlib.crc32(str(x[0] if x[0] is not None else "").encode()) % 3 == 0 else x[2] for x in leaves}
    want = Counter()
    for key, _, leaf, subroot, root, way in plain_manifest([x[:3] for x in leaves]):
        node = used[leaf]
        for left, right in way:
            node = h(left + node + right)
        want[key, leaf, subroot, root, h("".join(a + b for a, b in way)), node, node == root] += 1
    got = manifest.op12_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == want
    assert {v for *_, v in want} == {True, False}
