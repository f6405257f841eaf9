"""Planning of territories: consumers are connected to the existing pipes, territory by territory.

A territory (the features of one dataset) is what one search sees whole, so territories are the unit of
distribution: plan() groups features by territory and runs the search for each in a grouped function.
Inside, states are forests; a beam for each objective and order of consumers attaches one consumer per
round, by a route to a tie-in on an existing pipe or to a point of a new pipe (which makes a shared
stem). Each state is sized, priced and validated; the best three that differ are returned as rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.functions import catalog as cat
from pipewright.functions.planar import Point, Shape, band, dist, last_contact, length_within, line_length, measure, nearest_on, sub_line
from pipewright.operators.routing import Route, blocked, counted_search, objective
from pipewright.operators.rules import HARD, SPECIAL, Judge, check, sweep
from pipewright.operators.sizing import Edge, flows, size_tree
from pipewright.session import cut

PROFILES = ("economic", "compact", "balanced")
REPAIRS = 5
SNAP = 10.0 + 1e-3  # m; coordinates come from degrees with ten decimals


@dataclass(frozen=True)
class Options:
    """Knobs of the search; values outside their ranges raise."""

    beam_width: int = 4
    initial_tie_ins: int = 4
    max_tie_ins: int = 16
    neighbours: int = 16
    refinements: int = 3
    local_search: int = 3
    expansions_per_route: int = 1500
    total_expansions: int = 250_000
    seed: int = 17
    sampling_step: float = 40.0
    similarity_tolerance: float = 5.0
    max_overlap: float = 0.85
    max_deterioration: float = 0.35

    def __post_init__(self) -> None:
        ranges = {
            "beam_width": (1, 32), "initial_tie_ins": (1, 128), "max_tie_ins": (self.initial_tie_ins, 128), "neighbours": (2, 256), "refinements": (1, 6), "local_search": (0, 50),
            "expansions_per_route": (1, math.inf), "total_expansions": (1, 10_000_000), "sampling_step": (1, 1e9), "similarity_tolerance": (1e-9, 1e9),
            "max_overlap": (1e-9, 1), "max_deterioration": (0, 1e9),
        }
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class RoadData:
    """Whether road data had to be loaded, whether they were, and the box in metres (x1, y1, x2, y2) that they cover."""

    required: bool = False
    status: str = "disabled"
    box: tuple[float, float, float, float] | None = None


COVER, NEED = 12.0, 15.0  # m around a route that road data must cover; and that are asked for beyond it


@dataclass
class Target:
    key: str
    point: Point
    flow: float


@dataclass
class Territory:
    pipes: list[tuple[str, list[Point], int]] = field(default_factory=list)  # key, line, catalogue index
    chambers: list[tuple[str, Point]] = field(default_factory=list)
    targets: list[Target] = field(default_factory=list)
    obstacles: list[Shape] = field(default_factory=list)
    unknown_width: set[str] = field(default_factory=set)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)  # code, object
    invalid: bool = False
    roads: RoadData = field(default_factory=RoadData)
    needed: tuple[float, float, float, float] | None = None

    def covered(self, line: list[Point]) -> bool:
        """Whether road data cover a route; if not, the box that would have to be covered grows by it."""
        if not self.roads.required or self.roads.box is None:
            return True
        xs, ys = [p[0] for p in line], [p[1] for p in line]
        x1, y1, x2, y2 = self.roads.box
        if min(xs) - COVER >= x1 and min(ys) - COVER >= y1 and max(xs) + COVER <= x2 and max(ys) + COVER <= y2:
            return True
        old = self.needed or (math.inf, math.inf, -math.inf, -math.inf)
        self.needed = (min(old[0], min(xs) - NEED), min(old[1], min(ys) - NEED), max(old[2], max(xs) + NEED), max(old[3], max(ys) + NEED))
        return False


def load(rows: Iterator[dict], roads: RoadData | None = None) -> Territory:
    """Typed layers of features(id_key, object_type, restriction_type, flow, diameter, width, shape, coords); coords is JSON in metres.

    An existing pipe is an obstacle as well. Roads and tram tracks drawn as lines become bands of their
    width. A kind that planning doesn't know makes the territory invalid; a bad value raises."""
    t = Territory(roads=roads or RoadData())
    if t.roads.required and (t.roads.status != "ready" or t.roads.box is None):
        t.diagnostics.append(("OSM_DATA_UNAVAILABLE" if t.roads.status != "ready" else "OSM_COVERAGE_INCOMPLETE", ""))
        t.invalid = True
    seen: set[str] = set()
    for r in sorted(rows, key=lambda r: r["id_key"]):
        if r["id_key"] in seen:
            raise ValueError(f"duplicate id {r['id_key']}")
        seen.add(r["id_key"])
        kind = r["restriction_type"] if r["object_type"] == "restriction" else "oks" if r["object_type"] == "oks_existing" else r["object_type"]
        coords, shape, key = json.loads(r["coords"]), r["shape"], r["id_key"]
        points = lambda c: [(float(p[0]), float(p[1])) for p in c]
        if kind == "source":
            continue
        if kind == "oks_connection_point":
            if shape != "Point" or not r["flow"] or not math.isfinite(r["flow"]) or r["flow"] <= 0:
                raise ValueError(f"{key}: a connection point needs a point and a flow")
            t.targets.append(Target(key, (float(coords[0]), float(coords[1])), float(r["flow"])))
            continue
        if kind == "heat_chamber":
            t.chambers.append((key, (float(coords[0]), float(coords[1]))))
            continue
        polygons = [[points(ring) for ring in coords]] if shape == "Polygon" else [[points(ring) for ring in p] for p in coords] if shape == "MultiPolygon" else []
        lines = [points(coords)] if shape in ("LineString", "MultiPoint") else [points(c) for c in coords] if shape == "MultiLineString" else [points([coords])] if shape == "Point" else []
        width = 0.0
        if kind == "heat_network":
            index = next((i for i, p in enumerate(cat.PIPES) if p[0] == r["diameter"]), None)
            if shape != "LineString" or index is None:
                raise ValueError(f"{key}: a pipe needs a line and a diameter of the catalogue")
            t.pipes.append((key, lines[0], index))
            width = cat.PIPES[index][4]
        elif kind not in HARD and kind not in SPECIAL:
            t.diagnostics.append(("UNSUPPORTED_RESTRICTION", key))
            t.invalid = True
        if kind == "oks" and not polygons:
            raise ValueError(f"{key}: a building needs an area")
        if kind in ("road", "tram_tracks") and not polygons:
            w = r["width"]
            if w and w > 0:
                polygons, lines = [p for line in lines for p in band(line, w / 2)], []
            else:
                t.unknown_width.add(key)
                t.diagnostics.append(("ROAD_WIDTH_REQUIRED", key))
        t.obstacles.append(Shape(key, kind, polygons, lines, width))
    return t


@dataclass
class Root:
    key: str
    point: Point
    pipe: str
    dn: int
    chamber: bool


@dataclass
class Piece:
    """A new pipe between two nodes, from the root's side."""

    start: str
    end: str
    line: list[Point]


@dataclass
class Network:
    roots: dict[str, Root] = field(default_factory=dict)
    points: dict[str, Point] = field(default_factory=dict)
    pieces: list[Piece] = field(default_factory=list)
    served: frozenset[str] = frozenset()
    sizes: dict[str, int] = field(default_factory=dict)  # by end node
    flow: dict[str, float] = field(default_factory=dict)
    cost: float = 0.0
    chambers: float = 0.0
    penalty: float = 0.0
    length: float = 0.0
    tie_ins: int = 0

    @property
    def score(self) -> float:
        return cat.COST_SHARE * (self.cost + self.penalty) / cat.COST_UNIT + cat.LENGTH_SHARE * self.length / cat.LENGTH_UNIT

    def signature(self) -> str:
        return ";".join(sorted(f"{p.start}>{p.end}:{self.sizes.get(p.end)}:" + ",".join(f"{x:.3f} {y:.3f}" for x, y in p.line) for p in self.pieces))


def roots(t: Territory, target: Target, options: Options, level: int = 0) -> list[Root]:
    """The nearest tie-ins of a consumer: samples, ends and feet on existing pipes, moved into chambers within 10 m."""
    found: dict[str, tuple[float, Root]] = {}
    step = options.sampling_step / 2**level
    for key, line, dn in t.pipes:
        total = line_length(line)
        places = {0.0, total, measure(line, target.point), *(i * step for i in range(1, int(total / step) + 1))}
        for m in places:
            p = sub_line(line, m, m)[0] if 0 < m < total else line[0] if m <= 0 else line[-1]
            near = [(c, q) for c, q in t.chambers if dist(p, q) <= SNAP]
            options_here = [Root(f"chamber:{c}", q, key, dn, True) for c, q in near] or [Root(f"pipe:{key}:{math.floor(p[0] * 1000 + 0.5)}:{math.floor(p[1] * 1000 + 0.5)}", p, key, max(i for _, _, i in _pipes_at(t, p)), False)]
            for r in options_here:
                if _degree(t, r.point) < 4:
                    found.setdefault(r.key, (dist(r.point, target.point), r))
    most = min(options.max_tie_ins, options.initial_tie_ins * 2**level)
    return [r for _, r in sorted(found.values(), key=lambda x: (x[0], x[1].key))[:most]]


def _pipes_at(t: Territory, p: Point) -> list[tuple[str, list[Point], int]]:
    """The existing pipes that a point is on."""
    return [x for x in t.pipes if min(dist(p, nearest_on(p, a, b)[1]) for a, b in zip(x[1], x[1][1:])) <= 0.01]


def _degree(t: Territory, p: Point) -> int:
    """How many pipe ends meet in a point; a pipe that passes counts twice."""
    n = 0
    for _, line, _ in t.pipes:
        if min(dist(p, line[0]), dist(p, line[-1])) <= 0.01:
            n += 1
        elif min(dist(p, nearest_on(p, a, b)[1]) for a, b in zip(line, line[1:])) <= 0.01:
            n += 2
    return n


class Planner:
    def __init__(self, t: Territory, options: Options):
        self.t, self.options, self.spent, self.candidates = t, options, 0, 0
        self.most = options.total_expansions  # what may be spent at present
        self.routes: dict[tuple, Route | None] = {}
        self.by_key = {x.key: x for x in t.targets}
        self.check = Judge(t.obstacles, frozenset(t.unknown_width))

    @contextmanager
    def within(self, expansions: int):
        """A slice of the budget: at most so many expansions inside; what isn't used stays in the budget around it."""
        around = self.most
        self.most = min(around, self.spent + expansions)
        try:
            yield
        finally:
            self.most = around

    @property
    def exhausted(self) -> bool:
        return self.spent >= self.most

    def route(self, start: Point, goal: Point, pipe: str | None, dn: int, profile: str, levels: int | None = None, avoid: list[Point] | None = None) -> Route | None:
        key = (start, goal, pipe, dn, profile, levels, tuple(avoid) if avoid else None)
        if key not in self.routes:
            left = self.most - self.spent
            if left <= 0:
                return None
            o = self.options
            corridor = ([avoid], o.similarity_tolerance) if avoid else None
            found, used = counted_search(
                start, goal, dn, self.t.obstacles, pipe, profile, levels or o.refinements, o.expansions_per_route, o.neighbours, self.check.unknown_width, left, corridor, self.check
            )
            self.spent += max(1, used)
            if found is None and used >= left:
                return None  # cut off by the budget: another slice may find it
            self.routes[key] = found
        return self.routes[key]

    def widened(self, start: Point, target: Target, pipe: str | None, dn: int, profile: str) -> Route | None:
        """A route at the given size, else at the next ones that may be longer: what is too long or has no way at one size can have one at another."""
        while True:
            found = self.route(start, target.point, pipe, dn, profile)
            further = [i for i in range(dn + 1, len(cat.PIPES)) if cat.PIPES[i][2] > cat.PIPES[dn][2]]
            if found or not further:
                return found
            dn = further[0]

    def evaluate(self, n: Network) -> Network | None:
        """Sized, priced and validated, or None. An edge that its size makes illegal is led another way, up to five times."""
        self.candidates += 1
        demand = {k: self.by_key[k].flow for k in n.served}
        edges = [Edge(p.end, p.start, line_length(p.line), 0.0) for p in n.pieces]
        lines = {p.end: p.line for p in n.pieces}
        try:
            flows(edges, demand)
        except ValueError:
            return None
        sizes: dict[str, int] = {}
        repairs = 0
        for _ in range(5 + REPAIRS):  # weighted lengths depend on clearances, and those on sizes
            for e in edges:
                dn = sizes.get(e.node, self.least(e.flow, e.length))
                judged = self.judge(n, e.parent, e.node, lines[e.node], dn)
                if not judged.legal and repairs < REPAIRS:
                    repairs += 1
                    root = n.roots.get(e.parent)
                    other = self.route(n.points[e.parent], n.points[e.node], root.pipe if root else None, dn, "balanced")
                    if other:
                        lines[e.node], e.length, judged = other.line, line_length(other.line), self.judge(n, e.parent, e.node, other.line, dn)
                if not judged.legal or not self.t.covered(lines[e.node]):
                    return None
                e.weighted = judged.weighted
            total, chosen = 0.0, {}
            for root in n.roots.values():
                below = self.subtree(edges, root.key)
                found = size_tree(root.key, below, root.dn, root.chamber)
                if found is None:
                    return None
                total += found[0]
                chosen |= found[1]
            if chosen == sizes:
                break
            sizes = chosen
        else:
            return None
        pipes = sum(e.weighted * cat.PIPES[sizes[e.node]][3] for e in edges)
        ties = sum(1 for p in n.pieces if p.start in n.roots and n.roots[p.start].chamber)
        missing = [x for x in self.t.targets if x.key not in n.served]
        return replace(
            n, pieces=[replace(p, line=lines[p.end]) for p in n.pieces], sizes=sizes, flow={e.node: e.flow for e in edges}, cost=total, chambers=total - pipes, length=sum(e.length for e in edges), tie_ins=ties,
            penalty=sum(cat.PENDING_BASE + cat.PENDING_PER_FLOW * x.flow for x in missing),
        )

    def subtree(self, edges: list[Edge], root: str) -> list[Edge]:
        out, at = [], {root}
        while at:
            step = [e for e in edges if e.parent in at]
            out += step
            at = {e.node for e in step}
        return out

    def least(self, flow: float, length: float) -> int:
        return next((i for i, p in enumerate(cat.PIPES) if p[1] >= flow and p[2] >= length), len(cat.PIPES) - 1)

    def judge(self, n: Network, start: str, end: str, line: list[Point], dn: int):
        root = n.roots.get(start)
        target = self.by_key.get(end)
        return self.check(line, dn, target.point if target else None, (root.point, root.pipe) if root else None)

    def seed(self) -> Network:
        """One network before any beam: in round r each consumer without a connection offers its r-th tie-in, and offers are
        taken in the order of keys as they come out right. A route that runs into the network joins it as a shared
        stem. Rounds have three quarters of the budget, and search on the coarsest level only."""
        o, n = self.options, self.evaluate(Network())
        order = sorted(self.t.targets, key=lambda x: x.key)
        offers = {x.key: roots(self.t, x, o) for x in order}
        with self.within(o.total_expansions * 3 // 4):
            for r in range(o.initial_tie_ins):
                for target in order:
                    if self.exhausted:
                        return n
                    if target.key in n.served or r >= len(offers[target.key]):
                        continue
                    root = offers[target.key][r]
                    if sum(p.start == root.key for p in n.pieces) + _degree(self.t, root.point) >= 4:
                        continue
                    found = self.route(root.point, target.point, root.pipe, self.least(target.flow, dist(root.point, target.point)), "balanced", levels=1)
                    if found:
                        n = self.accepted(n, root, target, found.line) or n
        return n

    def accepted(self, n: Network, root: Root, target: Target, line: list[Point]) -> Network | None:
        """The network with a route from a tie-in: as it is, or from where it last meets the network."""
        grown = replace(
            n, roots=n.roots | {root.key: root}, points=n.points | {root.key: root.point, target.key: target.point}, pieces=[*n.pieces, Piece(root.key, target.key, line)], served=n.served | {target.key}
        )
        whole = self.evaluate(grown)
        return whole if whole and not self.overlaps(whole) else self.joined(n, target, line)

    def joined(self, n: Network, target: Target, line: list[Point]) -> Network | None:
        """The network with a consumer by what is left of a route after its last contact with a new pipe, which is split there."""
        contacts = [(m, i) for i, p in enumerate(n.pieces) if (m := last_contact(line, p.line)) is not None]
        if not contacts:
            return None
        at, i = max(contacts, key=lambda x: (x[0], -x[1]))
        piece = n.pieces[i]
        rest = sub_line(line, at, line_length(line))
        split = self.split(n, piece, measure(piece.line, rest[0]))
        if split is None:
            return None
        made, node = split
        if sum(p.start == node for p in made.pieces) >= 3:
            return None
        rest[0] = made.points[node]
        made = replace(made, points=made.points | {target.key: target.point}, pieces=[*made.pieces, Piece(node, target.key, rest)], served=made.served | {target.key})
        whole = self.evaluate(made)
        return whole if whole and not self.overlaps(whole) else None

    def attach(self, n: Network, target: Target, profile: str) -> list[Network]:
        """The network with one consumer more, within a slice of the budget: a third of each consumer's share, 100 expansions at least."""
        with self.within(max(100, self.options.total_expansions // max(1, 3 * len(self.t.targets)))):
            return self.attached(n, target, profile)

    def attached(self, n: Network, target: Target, profile: str) -> list[Network]:
        """By each tie-in, and by each near new pipe, that a route is found from."""
        done: list[Network] = []
        for level in range(self.options.refinements):
            for root in roots(self.t, target, self.options, level):
                dn = self.least(target.flow, dist(root.point, target.point))
                if self.exhausted:
                    break
                if sum(p.start == root.key for p in n.pieces) + _degree(self.t, root.point) >= 4:
                    continue
                found = self.widened(root.point, target, root.pipe, dn, profile)
                made = self.accepted(n, root, target, found.line) if found else None
                if made:
                    done.append(made)
            if done:
                break
        near = sorted(n.pieces, key=lambda p: min(dist(target.point, nearest_on(target.point, a, b)[1]) for a, b in zip(p.line, p.line[1:])))
        for piece in near[: self.options.max_tie_ins]:
            total = line_length(piece.line)
            for m in {round(measure(piece.line, target.point), 6), round(total / 2, 6)}:
                split = self.split(n, piece, m)
                if split is None or self.exhausted:
                    continue
                made, node = split
                if sum(p.start == node for p in made.pieces) >= 3:
                    continue
                found = self.widened(made.points[node], target, None, self.least(target.flow, 0.0), profile)
                if found:
                    grown = replace(made, points=made.points | {target.key: target.point}, pieces=[*made.pieces, Piece(node, target.key, found.line)], served=made.served | {target.key})
                    whole = self.evaluate(grown)
                    if whole and not self.overlaps(whole):
                        done.append(whole)
        return done

    def split(self, n: Network, piece: Piece, m: float) -> tuple[Network, str] | None:
        """The network with a node on a piece, and the node; ends within 1 cm are used, but consumers never are."""
        total = line_length(piece.line)
        for node, at in ((piece.start, 0.0), (piece.end, total)):
            if abs(m - at) <= 0.01:
                return None if node in self.by_key or node in n.roots else (n, node)
        p = sub_line(piece.line, m, m)[0]
        node = f"junction:{math.floor(p[0] * 1000 + 0.5)}:{math.floor(p[1] * 1000 + 0.5)}"
        parts = [Piece(piece.start, node, sub_line(piece.line, 0, m)), Piece(node, piece.end, sub_line(piece.line, m, total))]
        return replace(n, points=n.points | {node: p}, pieces=[x for x in n.pieces if x is not piece] + parts), node

    def overlaps(self, n: Network) -> bool:
        """Whether two new pipes meet elsewhere than in a common node."""
        for i, p in enumerate(n.pieces):
            for q in n.pieces[i + 1 :]:
                common = [n.points[k] for k in {p.start, p.end} & {q.start, q.end}]
                gap = Shape("", "", lines=[q.line])
                inner = [x for x in _samples(p.line) if all(dist(x, c) > 0.05 for c in common)]
                if any(gap.gap(x, x) <= 0.01 for x in inner) or not common and gap.gap_line(p.line) <= 1e-6:
                    return True
                if common and any(_crosses_away(p.line, q.line, c) for c in common):
                    return True
        return False

    def below(self, n: Network, node: str) -> set[str]:
        """A node and all that hangs on it."""
        out, at = {node}, {node}
        while at:
            at = {p.end for p in n.pieces if p.start in at} - out
            out |= at
        return out

    def cut_off(self, n: Network, piece: Piece) -> Network:
        """The network without a piece: what it led to hangs loose; nodes that then lead nowhere go, and a junction with one way on is dissolved."""
        pieces, end = [p for p in n.pieces if p is not piece], piece.start
        while not any(p.start == end for p in pieces) and end not in n.roots and end not in self.by_key:
            above = next(p for p in pieces if p.end == end)
            pieces, end = [p for p in pieces if p is not above], above.start
        after, before = [p for p in pieces if p.start == end], [p for p in pieces if p.end == end]
        if len(after) == 1 and before and end not in self.by_key:
            pieces = [p for p in pieces if p is not after[0] and p is not before[0]] + [Piece(before[0].start, after[0].end, [*before[0].line, *after[0].line[1:]])]
        used = {k for p in pieces for k in (p.start, p.end)} | {piece.end}
        return replace(n, roots={k: r for k, r in n.roots.items() if k in used}, points={k: p for k, p in n.points.items() if k in used}, pieces=pieces)

    def detach(self, n: Network, key: str) -> Network:
        """The network without a consumer."""
        left = self.cut_off(n, next(p for p in n.pieces if p.end == key))
        return replace(left, points={k: p for k, p in left.points.items() if k != key}, served=n.served - {key})

    def connected(self, n: Network, start: str, end: str, dn: int, profile: str) -> Network | None:
        """The network with a loose subtree led to from another node; a pipe that is too long at one size is tried at the next."""
        if start == end or sum(p.start == start for p in n.pieces) >= 3 or start in self.by_key:
            return None
        root = n.roots.get(start)
        if root and sum(p.start == start for p in n.pieces) + _degree(self.t, root.point) >= 4:
            return None
        found = self.widened(n.points[start], Target(end, n.points[end], 0.0), root.pipe if root else None, dn, profile)
        if not found:
            return None
        whole = self.evaluate(replace(n, pieces=[*n.pieces, Piece(start, end, found.line)]))
        return whole if whole and not self.overlaps(whole) else None

    def rerouted(self, n: Network, profile: str) -> Iterator[Network]:
        """The network with one piece led by another way, away from its own corridor."""
        for i, p in enumerate(n.pieces):
            root = n.roots.get(p.start)
            found = self.route(n.points[p.start], n.points[p.end], root.pipe if root else None, n.sizes[p.end], profile, avoid=p.line)
            if found and found.line != p.line:
                whole = self.evaluate(replace(n, pieces=[replace(q, line=found.line) if j == i else q for j, q in enumerate(n.pieces)]))
                if whole and not self.overlaps(whole):
                    yield whole

    def moved(self, n: Network, profile: str, level: int) -> Iterator[Network]:
        """The network with one whole subtree on another tie-in or on another branch."""
        for p in n.pieces:
            loose, hanging, dn = self.cut_off(n, p), self.below(n, p.end), n.sizes[p.end]
            flow = sum(x.flow for x in self.t.targets if x.key in hanging)
            for root in roots(self.t, Target(p.end, n.points[p.end], flow), self.options, level):
                if root.key == p.start or self.exhausted:
                    continue
                grown = replace(loose, roots=loose.roots | {root.key: root}, points=loose.points | {root.key: root.point})
                whole = self.connected(grown, root.key, p.end, dn, profile)
                if whole:
                    yield whole
            for q in loose.pieces:
                if q.start in hanging or q.end in hanging or self.exhausted:
                    continue
                split = self.split(loose, q, measure(q.line, n.points[p.end]))
                whole = self.connected(split[0], split[1], p.end, dn, profile) if split else None
                if whole:
                    yield whole

    def nudged(self, n: Network, step: float, profile: str) -> Iterator[Network]:
        """The network with one junction moved by a step, for each junction and direction; the pieces that meet in it are routed anew."""
        for node, (x, y) in n.points.items():
            if not node.startswith("junction:"):
                continue
            for dx, dy in ((step, 0.0), (-step, 0.0), (0.0, step), (0.0, -step)):
                p = (x + dx, y + dy)
                name = f"junction:{math.floor(p[0] * 1000 + 0.5)}:{math.floor(p[1] * 1000 + 0.5)}"
                points = {name if k == node else k: p if k == node else v for k, v in n.points.items()}
                pieces = []
                for q in n.pieces:
                    if node in (q.start, q.end):
                        start, end = (name if k == node else k for k in (q.start, q.end))
                        root = n.roots.get(start)
                        found = self.route(points[start], points[end], root.pipe if root else None, n.sizes[q.end], profile)
                        if not found:
                            break
                        q = Piece(start, end, found.line)
                    pieces.append(q)
                else:
                    whole = self.evaluate(replace(n, points=points, pieces=pieces))
                    if whole and not self.overlaps(whole):
                        yield whole

    def improve(self, n: Network, profile: str) -> Network:
        """Better networks nearby, until there is none: pieces led another way, subtrees moved to other roots or branches, junctions moved."""
        for i in range(self.options.local_search):
            near = [*self.rerouted(n, profile), *self.moved(n, profile, min(i, self.options.refinements - 1)), *self.nudged(n, 5.0 / 2**i, profile)]
            best = min(near, key=lambda x: (-len(x.served), x.score, x.signature()), default=n)
            if (-len(best.served), best.score) >= (-len(n.served), n.score - 1e-12):
                break
            n = best
        return n

    def run(self) -> list[Network]:
        import random

        t, o = self.t, self.options
        if not t.pipes:
            t.diagnostics.append(("NO_EXISTING_NETWORK", ""))
        if not t.targets:
            t.diagnostics.append(("NO_TARGETS", ""))
        if t.invalid or not t.pipes or not t.targets:
            return []
        for x in t.targets:
            if x.flow > max(p[1] for p in cat.PIPES):
                t.diagnostics.append(("NO_SUPPORTED_DIAMETER_FOR_CANDIDATE", x.key))
            elif blocked(x.point, self.least(x.flow, 0.0), t.obstacles):
                t.diagnostics.append(("TERMINAL_APPROACH_BLOCKED", x.key))
        far = lambda x: min(dist(x.point, nearest_on(x.point, a, b)[1]) for _, line, _ in t.pipes for a, b in zip(line, line[1:]))
        by_distance = sorted(t.targets, key=lambda x: (-far(x), x.key))
        by_flow = sorted(t.targets, key=lambda x: (-x.flow, x.key))
        mixed = sorted(t.targets, key=lambda x: x.key)
        random.Random(o.seed).shuffle(mixed)
        empty, seeded = self.evaluate(Network()), self.seed()
        pool: dict[str, Network] = {seeded.signature(): seeded} if seeded.pieces else {}
        for profile in PROFILES:
            weigh = lambda n, profile=profile: objective(profile, (n.cost + n.penalty) / cat.PIPES[0][3], n.length, 0)
            for order in (by_distance, by_flow, mixed):
                beam = [empty]
                for target in order:
                    grown = [x for n in beam if target.key not in n.served for x in self.attach(n, target, profile)] + beam
                    distinct = {x.signature(): x for x in grown}
                    beam = [x for _, x in sorted(distinct.items(), key=lambda kv: (-len(kv[1].served), weigh(kv[1]), kv[0]))[: o.beam_width]]
                pool |= {x.signature(): x for x in beam if x.pieces}
                if beam[0].pieces:
                    better = self.improve(beam[0], profile)
                    pool[better.signature()] = better
        if seeded.pieces:  # what the rounds have connected is completed and improved as well
            pool |= {x.signature(): x for x in [self.improve(self.completed(seeded), "balanced")]}
        for n in sorted(pool.values(), key=lambda n: (-len(n.served), n.score, n.signature()))[: o.beam_width]:
            full = self.completed(n)
            pool[full.signature()] = full
        return self.select(list(pool.values()))

    def completed(self, n: Network) -> Network:
        """What no order has connected is tried once more, each time by the network with the least score."""
        for target in sorted(self.t.targets, key=lambda x: x.key):
            if target.key not in n.served:
                n = min(self.attach(n, target, "balanced"), key=lambda x: (x.score, x.signature()), default=n)
        return n

    def select(self, pool: list[Network]) -> list[Network]:
        """Up to three networks with the most consumers, near the best score, that differ from each other."""
        if not pool:
            return []
        most = max(len(n.served) for n in pool)
        ordered = sorted((n for n in pool if len(n.served) == most), key=lambda n: (n.score, n.signature()))
        out: list[Network] = []
        for n in ordered:
            if n.score <= ordered[0].score * (1 + self.options.max_deterioration) and all(self.different(n, m) for m in out):
                out.append(n)
            if len(out) == 3:
                break
        return out

    def different(self, a: Network, b: Network) -> bool:
        """Another number of roots, other groups of consumers, or other corridors."""
        groups = lambda n: sorted(sorted(e.node for e in self.subtree([Edge(p.end, p.start, 0, 0) for p in n.pieces], r) if e.node in self.by_key) for r in n.roots)
        if len(a.roots) != len(b.roots) or groups(a) != groups(b):
            return True
        share = lambda x, y: sum(length_within(p.line, [q.line for q in y.pieces], self.options.similarity_tolerance) for p in x.pieces) / max(1e-9, sum(line_length(p.line) for p in x.pieces))
        return min(share(a, b), share(b, a)) < self.options.max_overlap


def _samples(line: list[Point], step: float = 1.0) -> list[Point]:
    total = line_length(line)
    return [sub_line(line, m, m)[0] for m in (i * total / max(1, round(total / step)) for i in range(1, max(1, round(total / step))))]


def _crosses_away(p: list[Point], q: list[Point], node: Point) -> bool:
    from pipewright.functions.planar import meeting

    for a, b in zip(p, p[1:]):
        for c, d in zip(q, q[1:]):
            for s in meeting(a, b, c, d):
                if dist((a[0] + s * (b[0] - a[0]), a[1] + s * (b[1] - a[1])), node) > 0.05:
                    return True
    return False


PLAN_SCHEMA = (
    "territory string, variant int, id string, object_type string, start_node string, end_node string, flow double, diameter int, length double, "
    "laying_method string, special_coefficient double, cost double, crossed string, coords string, score double, pending string, tie_ins int, penalty double, existing_object_id string, description string"
)


def known_ids(t: Territory) -> set[str]:
    """Texts of all ids in the territory, without their kind."""
    keys = [k for k, _ in t.chambers] + [x.key for x in t.targets] + [k for k, _, _ in t.pipes] + [s.key for s in t.obstacles]
    return {k.removeprefix("s:").removeprefix("n:") for k in keys}


def export(t: Territory, n: Network, territory: str, variant: int) -> list[dict]:
    """Rows of a variant: new chambers and nodes, pipes cut where the tariff changes, and a summary."""
    blank = dict.fromkeys(c.split()[0] for c in PLAN_SCHEMA.split(", "))
    rows: list[dict] = []
    existing = {k for k, _ in t.chambers} | {x.key for x in t.targets}
    given, serial = known_ids(t), 0

    def new_id() -> str:
        nonlocal serial
        while True:
            serial += 1
            made = f"new:{variant}:{serial}"
            if made not in given:
                return made

    children: dict[str, list[Piece]] = {}
    for p in n.pieces:
        children.setdefault(p.start, []).append(p)
    names: dict[str, str] = {}
    for key, point in n.points.items():
        if key.removeprefix("chamber:") in existing:
            names[key] = key.removeprefix("chamber:")
            continue
        names[key] = new_id()
        root, below = n.roots.get(key), children.get(key, [])
        chamber = root is not None or len(below) > 1
        dn = max([root.dn if root else 0, *(n.sizes[p.end] for p in below), n.sizes.get(key, 0)])
        rows.append(blank | {"id": names[key], "object_type": "heat_chamber" if chamber else "technical_node", "diameter": cat.PIPES[dn][0] if chamber else None, "cost": cat.chamber_price(cat.PIPES[dn][0]) if chamber else None, "coords": json.dumps(point), "existing_object_id": root.pipe if root else None})
    for p in n.pieces:
        dn = n.sizes[p.end]
        root = n.roots.get(p.start)
        target = next((x.point for x in t.targets if x.key == p.end), None)
        judged = check(p.line, dn, t.obstacles, target, (root.point, root.pipe) if root else None, frozenset(t.unknown_width))
        at = names[p.start]
        parts = sweep(line_length(p.line), judged.intervals)
        for i, (low, high, k) in enumerate(parts):
            end = names[p.end] if i == len(parts) - 1 else new_id()
            line = sub_line(p.line, low, high)
            if i < len(parts) - 1:
                rows.append(blank | {"id": end, "object_type": "technical_node", "coords": json.dumps(line[-1])})
            crossed = [key for a, b, _, key in judged.intervals if a <= (low + high) / 2 <= b]
            rows.append(blank | {
                "id": new_id(), "object_type": "heat_network", "start_node": at, "end_node": end, "flow": n.flow[p.end], "diameter": cat.PIPES[dn][0], "length": high - low,
                "laying_method": "special" if k > 1 else "base", "special_coefficient": k, "cost": (high - low) * cat.PIPES[dn][3] * k, "crossed": json.dumps(crossed), "coords": json.dumps(line),
            })
            at = end
    missing = [x.key for x in t.targets if x.key not in n.served]
    branches = sum(1 for key in n.points if key not in n.roots and len(children.get(key, [])) > 1)
    text = f"verified: {len(n.roots)} tie-ins, {branches} shared branches, {len(n.served)} consumers connected, {len(missing)} left out"
    summary = {"cost": n.cost, "length": n.length, "score": n.score, "pending": json.dumps(missing), "tie_ins": n.tie_ins, "penalty": n.penalty, "description": text}
    rows.append(blank | {"id": new_id(), "object_type": "variant_summary"} | summary)
    return [r | {"territory": territory, "variant": variant} for r in rows]


def _near(a: float | None, b: float) -> bool:
    return a is not None and abs(a - b) <= max(0.02, 1e-6 * abs(b))


def _network_errors(t: Territory, rows: list[dict], pipes: list[dict]) -> list[str]:
    """What is wrong with routes, sizes, degrees and chambers of a forest, rebuilt from exported rows."""
    errors: list[str] = []
    index = {p[0]: i for i, p in enumerate(cat.PIPES)}
    if any(r["diameter"] not in index for r in pipes):
        return ["UNKNOWN_DIAMETER"]
    stated = {r["id"]: r for r in rows if r["object_type"] in ("heat_chamber", "technical_node")}
    existing, targets = dict(t.chambers), {x.key: x.point for x in t.targets}
    points = {k: tuple(json.loads(r["coords"])) for k, r in stated.items()} | existing | targets
    chains = {r["end_node"]: [r] for r in pipes}  # by end: a pipe's rows from its start on
    lines = {r["end_node"]: [tuple(p) for p in json.loads(r["coords"])] for r in pipes}
    if any(len(x) < 2 for x in lines.values()):
        return ["INVALID_GEOMETRY:ZERO_LENGTH"]
    if any(dist(lines[r["end_node"]][0], points[r["start_node"]]) > 0.01 or dist(lines[r["end_node"]][-1], points[r["end_node"]]) > 0.01 for r in pipes):
        errors.append("INVALID_NETWORK:GEOMETRY_ENDPOINT")
    below: dict[str, list[str]] = {}
    for r in pipes:
        below.setdefault(r["start_node"], []).append(r["end_node"])
    if set(stated) - set(below) - set(chains):
        errors.append("INVALID_NETWORK:UNREACHABLE_COMPONENT")
    for node in [k for k in chains if len(below.get(k, [])) == 1 and k not in targets]:  # cut where the tariff changes
        end = below.pop(node)[0]
        first, second, a, b = chains.pop(node), chains[end], lines.pop(node), lines[end]
        if first[-1]["diameter"] != second[0]["diameter"] or not _near(first[-1]["flow"], second[0]["flow"]):
            errors.append("CONSTANT_FLOW_CHAIN_CHANGED")
        if node not in stated or stated[node]["object_type"] != "technical_node":
            errors.append("UNNECESSARY_CHAMBER")
        straight = dist(a[-1], nearest_on(a[-1], a[-2], b[1])[1]) <= 1e-6
        chains[end], lines[end] = first + second, [*(a[:-1] if straight else a), *b[1:]]
        start = first[0]["start_node"]
        below[start] = [end if x == node else x for x in below[start]]
    start = {end: chain[0]["start_node"] for end, chain in chains.items()}
    size = {end: max(index[r["diameter"]] for r in chain) for end, chain in chains.items()}
    tops = set(below) - set(chains)
    for root in tops:
        if not _pipes_at(t, points[root]):
            errors.append("CAMERA_NOT_ON_NETWORK" if root in existing else "INVALID_NEW_TIE_IN")
        if root not in existing and any(dist(q, points[root]) <= 10.0 and 0 < _degree(t, q) and _degree(t, q) + len(below.get(c, [])) < 4 for c, q in t.chambers):
            errors.append("INVALID_NETWORK:CAMERA_WITHIN_10M")

    def longest(end: str) -> float:
        return line_length(lines[end]) + max((longest(x) for x in below.get(end, []) if size[x] == size[end]), default=0.0)

    for end, chain in chains.items():
        line, dn, top, offset = lines[end], size[end], start[end], 0.0
        roots_here: list = [(points[top], key) for key, _, _ in _pipes_at(t, points[top])] if top in tops else []
        tries = [check(line, dn, t.obstacles, targets.get(end), root, frozenset(t.unknown_width)) for root in roots_here or [None]]
        judged = next((x for x in tries if x.legal), tries[0])
        if not judged.legal:
            errors.append(f"INVALID_GEOMETRY:{judged.code}")
        elif not t.covered(line):
            errors.append("INVALID_NETWORK:OSM_COVERAGE_INCOMPLETE")
        else:
            tariff = sweep(line_length(line), judged.intervals)
            for r in chain:
                to = offset + line_length([tuple(p) for p in json.loads(r["coords"])])
                due = sum(max(0.0, min(to, high) - max(offset, low)) * k for low, high, k in tariff) * cat.PIPES[dn][3]
                if not _near(r["cost"], due) and abs((r["cost"] or 0.0) - due) > 2e-6 * cat.PIPES[dn][3]:  # crossings are known to the micrometre
                    errors.append("WRONG_SPECIAL_INTERVAL_PRICE")
                offset = to
        if chain[0]["flow"] > cat.PIPES[dn][1] + 1e-6:
            errors.append("INVALID_NETWORK:FLOW_OR_CAPACITY")
        if longest(end) > cat.PIPES[dn][2] + 1e-6:
            errors.append("INVALID_NETWORK:CONTINUOUS_LENGTH")
        if top in size and size[top] < dn:
            errors.append("INVALID_NETWORK:DIAMETER_MONOTONICITY")
        if end in targets and below.get(end):
            errors.append("INVALID_NETWORK:TARGET_NOT_TERMINAL")
    for node in set(below) | set(chains):
        if len(below.get(node, [])) + (node in chains) + (_degree(t, points[node]) if node in tops else 0) > 4:
            errors.append("INVALID_NETWORK:CHAMBER_DEGREE")
        if node not in stated:
            continue
        chamber, r = node in tops or len(below.get(node, [])) > 1, stated[node]
        if (r["object_type"] == "heat_chamber") != chamber:
            errors.append("MISSING_BRANCH_CHAMBER")
        elif chamber:
            dn = max([size.get(node, 0), *(size[x] for x in below.get(node, [])), *(i for _, _, i in _pipes_at(t, points[node]) if node in tops)])
            if r["diameter"] != cat.PIPES[dn][0]:
                errors.append("WRONG_CHAMBER_DIAMETER")
            if not _near(r["cost"], cat.chamber_price(cat.PIPES[dn][0])):
                errors.append("WRONG_CHAMBER_PRICE")
    network = Network(points=points, pieces=[Piece(start[end], end, lines[end]) for end in chains])
    if Planner(t, Options()).overlaps(network):
        errors.append("INVALID_NETWORK:CROSSING_WITHOUT_NODE")
    return errors


def verify(t: Territory, rows: list[dict]) -> list[str]:
    """Everything that is wrong with an exported variant, recomputed from its rows and the territory.

    Pipes that don't make a forest of known nodes are told as that; their routes, sizes and chambers aren't judged."""
    errors: list[str] = []
    ids = [r["id"] for r in rows]
    if len(set(ids)) != len(ids) or known_ids(t) & set(ids):
        errors.append("DUPLICATE_ID")
    known = set(ids) | {k for k, _ in t.chambers} | {x.key for x in t.targets}
    near = _near
    summary = next((r for r in rows if r["object_type"] == "variant_summary"), None)
    if summary is None:
        return [*errors, "MISSING_SUMMARY"]
    if sum(r["object_type"] == "variant_summary" for r in rows) > 1:
        errors.append("INVALID_SUMMARY")
    if any(r["object_type"] not in ("heat_chamber", "technical_node", "heat_network", "variant_summary") for r in rows):
        errors.append("UNSUPPORTED_OUTPUT_OBJECT")
    pipes, total, length = [r for r in rows if r["object_type"] == "heat_network"], 0.0, 0.0
    price = {p[0]: p[3] for p in cat.PIPES}
    for r in pipes:
        line = [tuple(p) for p in json.loads(r["coords"])]
        if r["start_node"] not in known or r["end_node"] not in known:
            errors.append("MISSING_NODE_REFERENCE")
        if not near(r["length"], line_length(line)):
            errors.append("WRONG_LENGTH")
        if not near(r["cost"], line_length(line) * price.get(r["diameter"], 0.0) * r["special_coefficient"]):
            errors.append("WRONG_PIPE_PRICE")
        if not 1 <= r["special_coefficient"] < math.inf:
            errors.append("INVALID_COEFFICIENT")
        if (r["laying_method"] == "special") != (r["special_coefficient"] > 1):
            errors.append("WRONG_LAYING_METHOD")
        total += r["cost"]
        length += r["length"]
    pending = json.loads(summary["pending"])
    if len(set(pending)) != len(pending):
        errors.append("DUPLICATE_PENDING_TARGET")
    if set(pending) - {x.key for x in t.targets}:
        errors.append("UNKNOWN_PENDING_TARGET")
    served = {x.key for x in t.targets} - set(pending)
    edges = [Edge(r["end_node"], r["start_node"], r["length"], 0.0) for r in pipes]
    try:
        flows(edges, {x.key: x.flow for x in t.targets if x.key in served})
        if any(not near(r["flow"], e.flow) for r, e in zip(pipes, edges, strict=True)):
            errors.append("INVALID_FLOW")
    except ValueError:
        errors.append("INVALID_NETWORK:CYCLE")
    if served - {e.node for e in edges} or set(pending) & {e.node for e in edges}:
        errors.append("INVALID_NETWORK:TARGET_ACCOUNTING")
    if len({(e.parent, e.node) for e in edges}) != len(edges):
        errors.append("DUPLICATE_EDGE")
    ends = [e.node for e in edges]
    if len(set(ends)) != len(ends):
        errors.append("INVALID_NETWORK:ROOT_OR_CYCLE")
    if not {"DUPLICATE_ID", "MISSING_NODE_REFERENCE", "INVALID_NETWORK:CYCLE", "INVALID_NETWORK:ROOT_OR_CYCLE"} & set(errors):
        errors += _network_errors(t, rows, pipes)
    chambers = sum(r["cost"] or 0.0 for r in rows if r["object_type"] == "heat_chamber")
    ties = sum(e.parent in {k for k, _ in t.chambers} for e in edges)
    penalty = sum(cat.PENDING_BASE + cat.PENDING_PER_FLOW * x.flow for x in t.targets if x.key not in served)
    cost = total + chambers + ties * cat.TIE_IN_PRICE
    score = cat.COST_SHARE * (cost + penalty) / cat.COST_UNIT + cat.LENGTH_SHARE * length / cat.LENGTH_UNIT
    for code, stated, found in (("CALCULATED_COST", summary["cost"], cost), ("NETWORK_LENGTH", summary["length"], length), ("PENALTY", summary["penalty"], penalty)):
        if not near(stated, found):
            errors.append(code)
    if summary["tie_ins"] != ties:
        errors.append("TIE_IN_COUNT")
    if abs(summary["score"] - score) > 1e-5:
        errors.append("SCORE")
    return list(dict.fromkeys(errors))


def plan_rows(rows: Iterator[dict], territory: str, options: Options, roads: RoadData | None = None) -> list[dict]:
    """Exported rows of the variants of one territory, and its diagnostics."""
    blank = dict.fromkeys(c.split()[0] for c in PLAN_SCHEMA.split(", "))
    t = load(rows, roads)
    planner = Planner(t, options)
    out: list[dict] = []
    variants = planner.run()
    rank = 0
    for n in variants:
        made = export(t, n, territory, rank + 1)
        if verify(t, made):
            t.diagnostics.append(("OUTPUT_VALIDATION_FAILED", ""))
            continue
        rank += 1
        out += made
    served = [n.served for n in variants]
    for x in t.targets:
        if not t.invalid and any(x.key not in s for s in served or [frozenset()]) and t.pipes:
            t.diagnostics.append(("SEARCH_BUDGET_EXHAUSTED" if planner.spent >= options.total_expansions else "NO_ROUTE_FOUND_AFTER_REFINEMENT", x.key))
    counters = {"expansions": planner.spent, "route_calls": len(planner.routes), "candidates": planner.candidates, "variants": rank, "budget_exhausted": planner.spent >= options.total_expansions}
    out.append(blank | {"territory": territory, "id": json.dumps(counters), "object_type": "search_statistics"})  # of the search: no variant
    if t.needed:
        t.diagnostics.append(("OSM_COVERAGE_INCOMPLETE", json.dumps(t.needed)))
    for code, key in dict.fromkeys(t.diagnostics):
        out.append(blank | {"territory": territory, "variant": 0, "id": key, "object_type": f"diagnostic:{code}"})
    return out


FEATURE = ("object_type", "restriction_type", "flow", "diameter", "width", "shape", "coords")


def alike(features: DataFrame) -> DataFrame:
    """territory, ids (in order), as_territory, as_ids: for each territory the first one that is its equal but for the ids, which is planned for both.

    Ids only tell objects apart and put them in order, so equal objects in equal order have equal plans. Where an id begins
    with another one, could be taken for a new one, or has no kind, order in longer texts could differ: such territories stand for themselves."""
    objects = features.groupBy("territory").agg(F.array_sort(F.collect_list(F.struct("id_key", *FEATURE))).alias("_f")).withColumn("ids", F.col("_f.id_key"))
    odd = F.exists("ids", lambda i: i.isNull() | ~i.rlike("^[sn]:") | i.rlike("^[sn]:new:"))
    longer = F.exists(F.arrays_zip(F.col("ids").alias("a"), F.slice("ids", F.lit(2), F.size("ids")).alias("b")), lambda p: F.coalesce(F.startswith(p["b"], p["a"]), F.lit(False)))
    body = F.sha2(F.to_json(F.transform("_f", lambda x: F.struct(F.substring(x["id_key"], 1, 2).alias("k"), *(x[c].alias(c) for c in FEATURE)))), 256)
    keyed = cut(objects.select("territory", "ids", F.when(odd | longer, F.concat(F.lit("own:"), F.col("territory"))).otherwise(body).alias("_key")))
    first = keyed.groupBy("_key").agg(F.min_by(F.struct("territory", "ids"), "territory").alias("_r"))
    return keyed.join(first, "_key").select("territory", "ids", F.col("_r.territory").alias("as_territory"), F.col("_r.ids").alias("as_ids"))


def renamed(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of planned territories for each one that is alike (``alike``), with its own ids."""
    own = lambda c: F.coalesce(F.get("ids", F.array_position("as_ids", F.col(c)).cast("int") - 1), F.col(c))

    @F.udf("string")
    def listed(text: str | None, given: list[str], ids: list[str]) -> str | None:
        if text in (None, "[]"):
            return text
        names = dict(zip(given, ids, strict=True))
        return json.dumps([names.get(x, x) for x in json.loads(text)])

    changed = {"territory": F.col("_t"), **{c: own(c) for c in ("id", "start_node", "end_node", "existing_object_id")}, **{c: listed(c, "as_ids", "ids") for c in ("crossed", "pending")}}
    met = rows.join(members.select(F.col("territory").alias("_t"), F.col("as_territory").alias("territory"), "ids", "as_ids"), "territory")
    return met.select(*(changed.get(c, F.col(c)).alias(c) for c in (x.split()[0] for x in PLAN_SCHEMA.split(", "))))


def plan(features: DataFrame, options: Options | None = None, roads: RoadData | None = None) -> DataFrame:
    """features(territory, id_key, object_type, restriction_type, flow, diameter, width, shape, coords) -> PLAN_SCHEMA rows.

    Territories that are equal but for their ids are planned once."""
    options = options or Options()
    members = cut(alike(features))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clean = pdf.astype(object).where(pdf.notna(), None)
        rows = plan_rows(clean.to_dict("records"), key[0], options, roads)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN_SCHEMA.split(", ")])

    planned = features.join(members.select(F.col("as_territory").alias("territory")).distinct(), "territory", "left_semi")
    return renamed(spread(planned).groupBy("territory").applyInPandas(one, PLAN_SCHEMA), members)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by a key (by default the territory) over more tasks than there are cores: searches cost much more than their few rows tell."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *(key or ("territory",)))
