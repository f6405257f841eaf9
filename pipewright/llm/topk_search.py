"""Exact top-k by inner product with cover trees over queries and data.

Vectors are turned to integers, equal vectors are kept only with their k + 1 least ids (no other copy
can be among the k best beside a query's own), and queries with equal vectors are searched once.

Data and queries are dealt into blocks by region: the nearest of at most ``PIVOTS`` vectors (a bounded
sample, which decides about speed alone), and within a region by hash where it has more than a block
holds. A cover tree is built once for each block and kept as one row. Each query block first meets the
data blocks of the region nearest to it, which gives every query a k-th score to beat. Then pairs of
blocks are given up before anything is shuffled where even the bound

    <q, x> <= <cq, cx> + |cq| rx + |cx| rq + rq rx

(c: centre, r: covering radius) is below the worst k-th score of the block's queries, and each pair
that is left is one task that walks both trees together and gives up pairs of nodes by the same bound.
What the blocks find is merged by window limits that start before the shuffle.

Where vectors have no clusters, in many dimensions, no bound is below a k-th score: then every pair of
blocks is compared, as a matrix product of the trees' bags. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.llm._arrow import arrow_schema, record_batch
from pipewright.llm._tables import cut, table

TOP = 5
LEAF = 32
DATA_BLOCK, QUERY_BLOCK = 2048, 2048
PIVOTS = 1024
_EXACT = 2.0**53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: in doubles where those are exact, else in Python's integers."""
    if np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


class CoverTree:
    """Centres are members; those of a node's children are more than half its radius apart, and each member is within that of one.

    Children of ``leaf`` members or less are the node's bag. Nodes are rows: begin, end of the bag, end
    of the node (places in ``points``), place of the centre; and the radii of the node and of its bag."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radii: np.ndarray, children: list[list[int]]):
        self.points, self.order, self.nodes, self.radii, self.children = points, order, nodes, radii, children
        self.centres = points[nodes[:, 3]].astype(np.float64)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    @classmethod
    def built(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        real = points.astype(np.float64)
        square = (real**2).sum(axis=1)
        apart = square[:, None] + square[None] - 2 * (real @ real.T)
        apart += 1e-14 * real.shape[1] * (square[:, None] + square[None])  # rounding never makes a radius too small
        apart = np.sqrt(np.maximum(apart, 0))
        np.fill_diagonal(apart, 0)
        order: list[int] = []
        rows: list[list[int]] = []
        radii: list[tuple[float, float]] = []
        children: list[list[int]] = []

        def build(own: np.ndarray) -> int:
            centre = int(own[((real[own] - real[own].mean(axis=0)) ** 2).sum(axis=1).argmin()])
            radius = float(apart[centre, own].max())
            at, begin = len(rows), len(order)
            rows.append([begin, 0, 0, centre])
            radii.append((radius, 0.0))
            children.append([])
            parts = []
            if len(own) > leaf and radius > 0:
                left = np.concatenate(([centre], own[own != centre]))
                while len(left):
                    near = apart[left[0], left] <= radius / 2
                    parts.append(left[near])
                    left = left[~near]
            bag = np.concatenate([p for p in parts if len(p) <= leaf] or [own[:0]]) if parts else own
            order.extend(bag.tolist())
            rows[at][1] = len(order)
            radii[at] = (radius, float(apart[centre, bag].max(initial=0)))
            children[at] = [build(p) for p in parts if len(p) > leaf]
            rows[at][2] = len(order)
            return at

        build(np.arange(len(points)))
        place = np.empty(len(points), dtype=np.int64)
        place[order] = np.arange(len(points))
        nodes = np.array(rows, dtype=np.int64)
        nodes[:, 3] = place[nodes[:, 3]]
        return cls(points[order], np.array(order), nodes, np.array(radii), children)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """points in the smallest integer type, nodes with their parents, radii."""
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(self.points).max(initial=0) <= np.iinfo(t).max)
        parent = np.zeros(len(self.nodes), dtype=np.int64)
        for at, own in enumerate(self.children):
            parent[own] = at
        return self.points.astype(kind).tobytes(), np.column_stack((self.nodes, parent)).tobytes(), self.radii.tobytes()

    @classmethod
    def unpacked(cls, n: int, dim: int, points: bytes, nodes: bytes, radii: bytes) -> CoverTree:
        kind = {2: np.int16, 4: np.int32}.get(len(points) // max(1, n * dim), np.int64)
        rows = np.frombuffer(nodes, dtype=np.int64).reshape(-1, 5)
        children: list[list[int]] = [[] for _ in rows]
        for at in range(1, len(rows)):
            children[rows[at, 4]].append(at)
        return cls(np.frombuffer(points, dtype=kind).reshape(n, dim).astype(np.int64), np.arange(n), rows[:, :4], np.frombuffer(radii).reshape(-1, 2), children)


class DualSearch:
    """The ``top`` best (score, id) of each query; ties go to the smaller id. worst: scores below which nothing is wanted."""

    def __init__(self, queries: CoverTree, data: CoverTree, ids: np.ndarray, top: int, worst: np.ndarray | None = None):
        self.q, self.d, self.ids, self.top = queries, data, ids, top
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries.points))]
        self.worst = np.full(len(queries.points), -np.inf) if worst is None else worst.astype(np.float64)
        self.real = queries.points.astype(np.float64)
        self.lengths = np.sqrt((self.real**2).sum(axis=1))
        self.compared = 0
        if len(queries.points) and len(data.points):
            self._visit(0, False, [(0, False)])

    def _parts(self, tree: CoverTree, node: int) -> list[tuple[int, bool]]:
        return [(node, True)] * bool(tree.nodes[node, 1] > tree.nodes[node, 0]) + [(c, False) for c in tree.children[node]]

    def _range(self, tree: CoverTree, node: int, bag: bool) -> np.ndarray:
        return np.arange(tree.nodes[node, 0], tree.nodes[node, 1 if bag else 2])

    def _radii(self, nodes: list[tuple[int, bool]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([n for n, _ in nodes])
        return at, self.d.radii[at, np.array([int(bag) for _, bag in nodes])]

    def _visit(self, q: int, q_bag: bool, nodes: list[tuple[int, bool]]) -> None:
        """Data nodes (or their bags) against a query node, best bounds first, down to its bags."""
        own = self._range(self.q, q, q_bag)
        if q_bag:
            self._search(own, nodes)
            return
        at, radius = self._radii(nodes)
        apart = self.q.radii[q, 0]
        bounds = self.d.centres[at] @ self.q.centres[q] + self.q.norms[q] * radius + self.d.norms[at] * apart + apart * radius
        bounds = bounds * (1 + np.sign(bounds) * 1e-9) + 1e-6
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] < self.worst[own].min():
                return
            x, x_bag = nodes[k]
            if not x_bag and self.d.radii[x, 0] >= apart:
                self._visit(q, q_bag, self._parts(self.d, x))
            else:
                for part, bag in self._parts(self.q, q):
                    self._visit(part, bag, [nodes[k]])

    def _search(self, own: np.ndarray, nodes: list[tuple[int, bool]]) -> None:
        """Data nodes against the queries of a bag, each of which is a group of its own here: its radius is 0."""
        at, radius = self._radii(nodes)
        bounds = self.real[own] @ self.d.centres[at].T + self.lengths[own][:, None] * radius
        bounds = bounds * (1 + np.sign(bounds) * 1e-9) + 1e-6
        for k in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
            left = own[bounds[:, k] >= self.worst[own]]
            if len(left):
                x, x_bag = nodes[k]
                if x_bag:
                    self._compare(left, self._range(self.d, x, True))
                else:
                    self._search(left, self._parts(self.d, x))

    def _compare(self, own: np.ndarray, other: np.ndarray) -> None:
        scores = products(self.q.points[own], self.d.points[other])
        self.compared += scores.size
        ids = self.ids[other]
        for i in np.flatnonzero(scores.max(axis=1) >= self.worst[own]):
            at = int(own[i])
            hit = np.flatnonzero(scores[i] >= self.worst[at])
            if len(hit) > self.top:
                hit = hit[np.lexsort((ids[hit], -scores[i][hit]))[: self.top]]
            found = ((-int(s), int(v)) for s, v in zip(scores[i][hit], ids[hit], strict=True))
            best = self.best[at] = sorted([*self.best[at], *found])[: self.top]
            if len(best) == self.top:
                self.worst[at] = max(self.worst[at], -best[-1][0])

    def results(self) -> Iterator[tuple[int, int, int]]:
        """(query, id, score)."""
        for at, best in enumerate(self.best):
            for score, v in best:
                yield int(self.q.order[at]), v, -score


def integer_vector(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(embedding: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, odd), F.lit(False))


def _regions(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows(dim, v, ..) with ``region``: the nearest pivot of its dimension."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, region = batch.column("dim").to_numpy(), np.zeros(len(batch), dtype=np.int32)
            values = batch.column("v")
            for d in np.unique(dim).tolist():
                at, own = np.flatnonzero(dim == d), pivots.get(d)
                if own is not None and d:
                    points = np.array(values.take(pa.array(at)).flatten().to_numpy(), dtype=np.float64).reshape(len(at), d)
                    region[at] = ((own**2).sum(axis=1)[None] - 2 * points @ own.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*names, "region"])

    return rows.mapInArrow(run, rows.withColumn("region", F.lit(0)).schema)


TREE = "dim int, block long, region int, n int, keys array<long>, points binary, nodes binary, radii binary, centre array<double>, norm double, radius double"


def _trees(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """One row for each block of rows(dim, region, v, *key), with its cover tree; keys: those of its vectors, one after the other."""
    counts = rows.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    dealt = rows.join(counts, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64(*key, F.lit("part")), "parts").cast("int"))
    dealt = dealt.withColumn("block", F.xxhash64("dim", "region", "part"))
    shape = arrow_schema(TREE)

    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        points = np.array(group.column("v").combine_chunks().flatten().to_numpy(), dtype=np.int64).reshape(len(group), dim)
        tree = CoverTree.built(points)
        keys = np.column_stack([group.column(c).to_numpy()[tree.order] for c in key]).reshape(-1)
        first = [dim, group.column("block")[0].as_py(), group.column("region")[0].as_py(), len(group), keys.tolist()]
        row = [*first, *tree.packed(), tree.centres[0].tolist(), float(tree.norms[0]), float(tree.radii[0, 0])]
        return pa.Table.from_batches([record_batch([[x] for x in row], shape)])

    return cut(dealt.select("dim", "block", "region", "v", *key).groupBy("dim", "block").applyInArrow(run, TREE))


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, top: int) -> DataFrame:
    """h1, h2, id, score of the best of each pair(dim, query_block, block); queries with ``worst`` scores by query."""
    left = pairs.join(data.select("dim", "block", "n", "keys", "points", "nodes", "radii"), ["dim", "block"])
    again = pairs.select(*(F.col(c).alias(c) for c in pairs.columns))
    right = again.join(queries.select("dim", F.col("block").alias("query_block"), "n", "keys", "points", "nodes", "radii", "worst"), ["dim", "query_block"])
    schema = "h1 long, h2 long, id long, score long"
    shape = arrow_schema(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, q = a.to_pylist()[0], b.to_pylist()[0]
        tree = lambda r: CoverTree.unpacked(r["n"], r["dim"], r["points"], r["nodes"], r["radii"])
        keys = np.array(q["keys"], dtype=np.int64).reshape(-1, 2)
        worst = np.array([-np.inf if w is None else w for w in q["worst"]])
        search = DualSearch(tree(q), tree(x), np.array(x["keys"], dtype=np.int64), top, worst)
        found = [(*keys[i].tolist(), v, s) for i, v, s in search.results()]
        return pa.Table.from_batches([record_batch(zip(*found, strict=True) if found else [[]] * 4, shape)])

    key = ["dim", "query_block", "block"]
    return cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def top_products(
    vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "vector", top: int = TOP, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, id_column, score: for each row that ``queries`` is true for, its ``top`` best other rows.

    vector holds integers. Rows whose id or vector is null take no part; rows equal in id and vector
    are one; rows with the query's id are its own and no candidates; vectors of different lengths
    aren't compared. Scores are exact; one beyond 64 bits raises an error. Ties go to the smaller id;
    with fewer candidates than ``top`` all are returned; an empty table gives an empty result.
    """
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"),
    ).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v"), "dim": F.size("v")})
    few = Window.partitionBy("h1", "h2").orderBy("id")
    distinct = rows.groupBy("h1", "h2", "dim", "id").agg(F.first("v").alias("v"), F.max("is_query").alias("is_query"))
    data = cut(distinct.withColumn("n", F.row_number().over(few)).where(F.col("n") <= top + 1).select("h1", "h2", "dim", "id", "v"))
    asked = distinct.where("is_query").select("id", "h1", "h2")
    wanted = cut(distinct.where("is_query").groupBy("h1", "h2", "dim").agg(F.first("v").alias("v")))

    def dealt(some: DataFrame, key: list[str], size: int) -> DataFrame:
        wish = min(pivots, -(-some.count() // size))
        sample: dict[int, list] = {}
        for r in some.select("dim", "v").orderBy(F.xxhash64("h1", "h2"), *key).limit(wish).collect():
            sample.setdefault(r["dim"], []).append(r["v"])
        return _trees(_regions(some.select("dim", "v", *key), {d: np.array(v, dtype=np.float64) for d, v in sample.items()}), key, size)

    trees, asking = dealt(data, ["id"], data_block), dealt(wanted, ["h1", "h2"], query_block)
    asking = asking.withColumn("worst", F.array_repeat(F.lit(None).cast("double"), F.col("n")))
    ends = lambda t, block, suffix: t.select("dim", F.col("block").alias(block), *(F.col(c).alias(c + suffix) for c in ("centre", "norm", "radius")))
    both = ends(trees, "block", "_x").join(ends(asking, "query_block", "_q"), "dim")  # blocks against blocks of the stated queries
    bound = _dot(F.col("centre_q"), F.col("centre_x")) + F.col("norm_q") * F.col("radius_x") + F.col("norm_x") * F.col("radius_q") + F.col("radius_q") * F.col("radius_x")
    both = both.withColumn("bound", bound + F.abs(bound) * 1e-9 + 1e-6).select("dim", "query_block", "block", "bound")
    best = Window.partitionBy("dim", "query_block").orderBy(F.col("bound").desc(), "block")
    pairs = cut(both.withColumn("first", F.row_number().over(best) == 1))
    found = _searched(pairs.where("first").select("dim", "query_block", "block"), asking, trees, top + 1)
    # the score that each query has reached, in the order of its block
    reached = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("h1", "h2", F.try_element_at("s", F.lit(top + 1)).cast("double").alias("score"))
    keyed = asking.select("dim", "block", F.posexplode(F.expr("transform(sequence(0, n - 1), i -> struct(keys[2 * i] as h1, keys[2 * i + 1] as h2))")).alias("place", "key"))
    listed = keyed.select("dim", "block", "place", "key.h1", "key.h2").join(reached, ["h1", "h2"], "left").groupBy("dim", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("worst"), F.min(F.coalesce("score", F.lit(float("-inf")))).alias("least")
    )
    known = cut(listed)
    left = pairs.where("NOT first").join(known.select("dim", F.col("block").alias("query_block"), "least"), ["dim", "query_block"]).where("bound >= least")
    rest = _searched(left.select("dim", "query_block", "block"), asking.drop("worst").join(known.select("dim", "block", "worst"), ["dim", "block"]), trees, top + 1)

    order = [F.col("score").desc(), F.col("id")]
    merged = found.unionByName(rest).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(F.col("n") <= top + 1)
    answers = asked.withColumnRenamed("id", "query_id").join(merged.drop("n"), ["h1", "h2"]).where("id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(id_column), "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth. Vectors that are null or hold nulls or values that aren't finite take no
    part, nor do rows without a vec_id; rows equal in vec_id and vector are one; ties go to the smaller vec_id; an empty table gives an empty result."""
    vectors = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", integer_vector(F.col("embedding")).alias("vector"))
    return top_products(vectors, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
