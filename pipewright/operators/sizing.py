"""Pipe sizes of a rooted tree: cheapest choice by dynamic programming over Pareto states."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.functions import catalog as cat
from pipewright.session import cut


@dataclass
class Edge:
    """An edge to ``node`` from its parent; weighted is the length times its price factors."""

    node: str
    parent: str
    length: float
    weighted: float
    flow: float = 0.0


@dataclass
class State:
    dn: int
    run: float  # length with this size from here down
    cost: float
    node: str = ""
    below: State | None = None  # of the children that are settled, the last one's state
    before: State | None = None  # and the choice for those before it
    place: int = -1  # of a state that was handed up: its number among those of its edge


def _pareto(states: list[State]) -> list[State]:
    """For each size, states that no other beats in cost and run."""
    out: list[State] = []
    for dn in {s.dn for s in states}:
        least = float("inf")
        for s in sorted((s for s in states if s.dn == dn), key=lambda s: (s.cost, s.run)):
            if s.run < least - 1e-7:
                out.append(s)
                least = s.run
    return out


def _downwards(children: dict[str, list[Edge]], tops: list[Edge]) -> list[Edge]:
    """The edges below (and with) tops, parents first; a cycle raises."""
    out, seen = list(tops), {e.node for e in tops}
    for e in out:
        for c in children.get(e.node, []):
            if c.node in seen:
                raise ValueError("the network has a cycle")
            seen.add(c.node)
            out.append(c)
    return out


def _by_parent(edges: list[Edge]) -> dict[str, list[Edge]]:
    children: dict[str, list[Edge]] = {}
    for e in edges:
        children.setdefault(e.parent, []).append(e)
    return children


def _states(e: Edge, options: list[list[State]]) -> list[State]:
    """Choices for an edge, given those for the edges below it."""
    out: list[State] = []
    for dn, (size, capacity, longest, price, _) in enumerate(cat.PIPES):
        if capacity < e.flow:
            continue
        partial = [State(dn, 0.0, cat.chamber_price(size) if len(options) > 1 else 0.0)]
        for choices in options:
            fit = [s for s in choices if s.dn <= dn and (len(options) > 1 or s.dn == dn)]
            partial = _pareto([State(dn, max(p.run, s.run if s.dn == dn else 0.0), p.cost + s.cost, "", s, p) for p in partial for s in fit])
        out += [State(dn, p.run + e.length, p.cost + e.weighted * price, e.node, None, p) for p in partial if p.run + e.length <= longest]
    return _pareto(out)


def _chosen(states: list[State]) -> dict[str, int]:
    """Size by node of the states and all that they rest on."""
    out, left = {}, list(states)
    while left:
        s = left.pop()
        if s.node:
            out[s.node] = s.dn
        left += [x for x in (s.below, s.before) if x is not None]
    return out


def size_tree(root: str, edges: list[Edge], existing_dn: int, on_chamber: bool) -> tuple[float, dict[str, int]] | None:
    """(cost with chambers, size of each edge by node), or None if no choice obeys capacity, run length and falling sizes.

    Sizes never grow downstream, stay the same where there is no branch, and a run of one size is at
    most as long as the catalogue allows. A branch needs a chamber for its largest pipe; a root on a
    bare pipe one for the larger of the old and the new pipe; a root in a chamber a price per edge. The
    largest size at the root is tried for all its edges at once, so their order doesn't matter."""
    children = _by_parent(edges)
    below = children.get(root, [])
    found = settled(edges, below, {})
    best = cheapest_top([found[e.node] for e in below], existing_dn, on_chamber)
    return best and (best[0], _chosen(best[1]))


def settled(edges: list[Edge], tops: list[Edge], known: dict[str, list[State]]) -> dict[str, list[State]]:
    """States of the top edges by node, from the lowest edges up; known: those of edges that are settled already."""
    children, found = _by_parent(edges), {}
    for e in reversed(_downwards(children, tops)):
        found[e.node] = known[e.node] if e.node in known else _states(e, [found.pop(c.node) for c in children.get(e.node, [])])
    return found


def cheapest_top(below: list[list[State]], existing_dn: int, on_chamber: bool) -> tuple[float, list[State]] | None:
    """(cost, states) of all edges at a root, from the choices of each."""
    best: tuple[float, list[State]] | None = None
    for top in range(existing_dn, len(cat.PIPES)):
        fit = [[s for s in states if s.dn <= top] for states in below]
        if not all(fit):
            continue
        own = [min(states, key=lambda s: (s.cost, s.dn)) for states in fit]
        total = sum(s.cost for s in own) + (cat.TIE_IN_PRICE * len(below) if on_chamber else cat.chamber_price(cat.PIPES[top][0]))
        if best is None or total < best[0]:
            best = (total, own)
    return best


def size_forest(edges: DataFrame, existing_dn: int, on_chamber: bool, levels: int = 9) -> DataFrame:
    """edges(root, node, up, length, flow) -> root, node, dn_idx, tree_cost: ``size_tree`` of every tree, a few levels at a time.

    A tree is cut into bands of ``levels`` levels, and each band into the parts below one edge. Parts are settled from the lowest band
    up: what a part hands on are the states of its top edge, some dozens of rows. At the root the cheapest are taken, and from there
    down each part says which states that choice rests on. So a group holds one part, however large the tree; nulls: no choice obeys."""
    banded, bands = _bands(edges, levels)
    handed = None
    given: dict[int, DataFrame | None] = {}
    for b in range(bands, -1, -1):
        given[b] = handed
        handed = cut(_grouped(banded, b, handed, None, lambda part, key, pdf: part.states(), STATES))
    tops = handed.withColumn("up", F.col("root"))

    def rooted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["node"]))
        states = {n: [State(r.dn, r.run, r.cost, str(n), None, None, r.place) for r in pdf[(pdf["node"] == n) & (pdf["dn"] >= 0)].sort_values("place").itertuples()] for n in nodes}
        best = cheapest_top([states[n] for n in nodes], existing_dn, on_chamber)
        rows = [(key[0], n, best[1][i].place if best else -1, best[0] if best else None) for i, n in enumerate(nodes)]
        return pd.DataFrame(rows, columns=["root", "node", "place", "tree_cost"])

    picked = cut(tops.groupBy("root").applyInPandas(rooted, "root long, node long, place int, tree_cost double"))
    costs, out = picked.select("root", "tree_cost").distinct(), []
    for b in range(bands + 1):
        rows = cut(_grouped(banded, b, given[b], picked, lambda part, key, pdf: part.choice(pdf), CHOICE))
        out.append(rows.where("NOT below").select("root", "node", F.col("dn").alias("dn_idx")))
        picked = rows.where("below").select("root", "node", "place")
    return reduce(DataFrame.unionByName, out).join(costs, "root").select("root", "node", F.when(F.col("dn_idx") >= 0, F.col("dn_idx")).alias("dn_idx"), "tree_cost")


STATES = "root long, node long, top long, place int, dn int, run double, cost double"
CHOICE = "root long, node long, dn int, below boolean, place int"


class _Part:
    """The edges below one edge, down to the end of a band, and the states handed up from the next band."""

    def __init__(self, pdf: pd.DataFrame):
        own, states = pdf[pdf["kind"] == 0].sort_values("node"), pdf[pdf["kind"] == 1].sort_values(["node", "place"])
        self.root, self.top, self.above = int(own["root"].iloc[0]), int(own["part"].iloc[0]), int(own["above"].iloc[0])
        self.own = [int(n) for n in own["node"]]
        self.edges = [Edge(str(n), str(u), x, x, f) for n, u, x, f in zip(own["node"], own["up"], own["length"], own["flow"], strict=True)]
        self.known: dict[str, list[State]] = {}
        for r in states.itertuples():
            node = str(int(r.node))
            if node not in self.known:
                self.known[node] = []
                self.edges.append(Edge(node, str(int(r.up)), 0.0, 0.0))
            if r.dn >= 0:
                self.known[node].append(State(int(r.dn), r.run, r.cost, node, None, None, int(r.place)))
        self.edges.sort(key=lambda e: int(e.node))
        top = next(e for e in self.edges if e.node == str(self.top))
        self.found = settled(self.edges, [top], self.known)[top.node]

    def states(self) -> list[tuple]:
        """Its top edge's states; one row of no size, if there are none."""
        rows = [(self.root, self.top, self.above, i, s.dn, s.run, s.cost) for i, s in enumerate(self.found)]
        return rows or [(self.root, self.top, self.above, -1, -1, 0.0, 0.0)]

    def choice(self, pdf: pd.DataFrame) -> list[tuple]:
        """Sizes of its edges, and which of the states handed up were taken, for the state that was picked of its top edge."""
        at = int(pdf[pdf["kind"] == 2]["place"].iloc[0])
        if at < 0:
            return [(self.root, n, -1, False, -1) for n in self.own] + [(self.root, int(n), -1, True, -1) for n in self.known]
        dn: dict[str, int] = {}
        place: dict[str, int] = {}
        left = [self.found[at]]
        while left:
            s = left.pop()
            if s.node:
                dn[s.node] = s.dn
                if s.place >= 0:
                    place[s.node] = s.place
            left += [x for x in (s.below, s.before) if x is not None]
        return [(self.root, n, dn[str(n)], False, -1) for n in self.own] + [(self.root, int(n), dn[n], True, place[n]) for n in self.known]


def _bands(edges: DataFrame, levels: int) -> tuple[DataFrame, int]:
    """edges with band, part (the node of the part's top edge) and above (the part over it), and the last band; a step per level.

    Bands are counted from the lowest level, where most edges are, so that the many parts there are whole ones."""
    kept = edges.select("root", "node", "up", "length", "flow")
    by_depth = [cut(kept.where("up = root"))]
    while not by_depth[-1].isEmpty():
        by_depth.append(cut(kept.join(by_depth[-1].select(F.col("node").alias("up")), "up").select(*kept.columns)))
    shift = levels - 1 - (len(by_depth) - 2) % levels
    at = by_depth[0].withColumns({"band": F.lit(0), "part": F.col("node"), "above": F.col("root")})
    found = [at]
    for depth, rows in enumerate(by_depth[1:-1], 1):
        band, fresh = divmod(depth + shift, levels)
        last = at.select(F.col("node").alias("up"), F.col("part").alias("_part"), F.col("above").alias("_above"))
        part, above = (F.col("node"), F.col("_part")) if not fresh else (F.col("_part"), F.col("_above"))
        at = cut(rows.join(last, "up").select(*kept.columns, F.lit(band).alias("band"), part.alias("part"), above.alias("above")))
        found.append(at)
    return cut(reduce(DataFrame.unionByName, found)), max(0, len(by_depth) - 2 + shift) // levels


def _grouped(banded: DataFrame, band: int, handed: DataFrame | None, picked: DataFrame | None, rows_of, schema: str) -> DataFrame:
    """rows_of each part of a band, with the states handed up to it and the place that was picked of its top edge."""
    own = banded.where(F.col("band") == band)
    none = lambda t: F.lit(0 if t == "long" else None).cast(t)  # noqa: E731  nulls would make keys floating in pandas
    columns = {"kind": "int", "root": "long", "part": "long", "above": "long", "node": "long", "up": "long", "length": "double", "flow": "double", "place": "int", "dn": "int", "run": "double", "cost": "double"}
    shaped = lambda df, kind, **have: df.select(*((F.lit(kind) if c == "kind" else F.col(have.get(c, c)) if have.get(c, c) in df.columns else none(t)).cast(t).alias(c) for c, t in columns.items()))
    rows = shaped(own, 0)
    if handed is not None:
        up = banded.where(F.col("band") == band + 1).select("node", "up")
        rows = rows.unionByName(shaped(handed.join(up, "node"), 1, part="top"))
    if picked is not None:
        rows = rows.unionByName(shaped(picked.select("root", "node", "place"), 2, part="node"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rows_of(_Part(pdf), key, pdf), columns=[c.split()[0] for c in schema.split(", ")])

    n = 3 * banded.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n, "part").groupBy("part").applyInPandas(one, schema)


def flows(edges: list[Edge], demand: dict[str, float]) -> None:
    """Set each edge's flow to the demand of its node and all below; a cycle raises."""
    children = _by_parent(edges)
    ends = {e.node for e in edges}
    order = _downwards(children, [e for e in edges if e.parent not in ends])
    if len(order) < len(edges):
        raise ValueError("the network has a cycle")
    for e in reversed(order):
        e.flow = demand.get(e.node, 0.0) + sum(c.flow for c in children.get(e.node, []))
