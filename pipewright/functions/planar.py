"""Plane geometry of one territory in plain Python, for the operators that search (they run inside grouped functions)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

Point = tuple[float, float]
EPS = 1e-4


def dist(a: Point, b: Point) -> float:
    return math.hypot(b[0] - a[0], b[1] - a[1])


def nearest_on(p: Point, a: Point, b: Point) -> tuple[float, Point]:
    """Share of a-b nearest to p, and the point there."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = 0.0 if square == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))
    return t, (a[0] + t * dx, a[1] + t * dy)


def meeting(a: Point, b: Point, c: Point, d: Point) -> list[float]:
    """Shares of a-b at which it meets c-d: none, one, or the two ends of an overlap."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    cross, wx, wy = ux * vy - uy * vx, c[0] - a[0], c[1] - a[1]
    length = math.hypot(ux, uy)
    if length == 0:
        return [0.0] if dist(a, nearest_on(a, c, d)[1]) <= 1e-9 else []
    if abs(cross) > 1e-9 * length * math.hypot(vx, vy):
        t, s = (wx * vy - wy * vx) / cross, (wx * uy - wy * ux) / cross
        return [min(1.0, max(0.0, t))] if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= s <= 1 + 1e-9 else []
    if abs(wx * uy - wy * ux) > 1e-7 * length:
        return []
    t = sorted(((p[0] - a[0]) * ux + (p[1] - a[1]) * uy) / (length * length) for p in (c, d))
    low, high = max(0.0, t[0]), min(1.0, t[1])
    return [low, high] if high - low > 1e-9 else [low] if high >= low - 1e-9 else []


def segment_gap(a: Point, b: Point, c: Point, d: Point) -> float:
    if meeting(a, b, c, d):
        return 0.0
    return min(point_gap(a, c, d), point_gap(b, c, d), point_gap(c, a, b), point_gap(d, a, b))


def point_gap(p: Point, a: Point, b: Point) -> float:
    """Distance of a point and a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = 0.0 if square == 0 else ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square
    t = 0.0 if t < 0.0 else 1.0 if t > 1.0 else t
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def turn(a: Point, b: Point, c: Point) -> float:
    u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
    n = math.hypot(*u) * math.hypot(*v)
    return 0.0 if n == 0 else math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / n))))


def turns_over(a: Point, b: Point, c: Point, most: float) -> bool:
    """Whether a way turns by more than ``most`` degrees (some more than 90); the angle itself is only taken near 90."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    dot = ux * vx + uy * vy
    return dot < 0 and turn(a, b, c) > most


def line_length(line: list[Point]) -> float:
    return sum(dist(a, b) for a, b in zip(line, line[1:]))


def sub_line(line: list[Point], low: float, high: float) -> list[Point]:
    """The stretch of a line between two measures."""
    out, at = [], 0.0
    for a, b in zip(line, line[1:]):
        n = dist(a, b)
        point = lambda m, a=a, b=b, at=at, n=n: (a[0] + (b[0] - a[0]) * (m - at) / n, a[1] + (b[1] - a[1]) * (m - at) / n)
        if n and at + n >= low and at <= high:
            for p in (point(max(low, at)), point(min(high, at + n))):
                if not out or dist(out[-1], p) > 1e-9:
                    out.append(p)
        at += n
    return out


def measure(line: list[Point], p: Point) -> float:
    """Measure of the line's point nearest to p."""
    best, at = (math.inf, 0.0), 0.0
    for a, b in zip(line, line[1:]):
        t, q = nearest_on(p, a, b)
        best = min(best, (dist(p, q), at + t * dist(a, b)))
        at += dist(a, b)
    return best[1]


def last_contact(line: list[Point], other: list[Point]) -> float | None:
    """The greatest measure along a line, short of its end, at which it meets another line."""
    best, at, total = None, 0.0, line_length(line)
    for a, b in zip(line, line[1:]):
        n = dist(a, b)
        for c, d in zip(other, other[1:]):
            for t in meeting(a, b, c, d):
                if at + t * n < total - EPS and (best is None or at + t * n > best):
                    best = at + t * n
        at += n
    return best


def neighbours(points: list[Point], k: int) -> list[list[int]]:
    """Of each point the k nearest others, nearest first (ties: in order), by a grid that is searched in growing rings."""
    if len(points) < 2:
        return [[] for _ in points]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    span = max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
    cell = max(span / max(1.0, math.sqrt(len(points) / max(1, k))) / 2, span / 2048)
    home = [(math.floor((x - min(xs)) / cell), math.floor((y - min(ys)) / cell)) for x, y in points]
    grid: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(home):
        grid.setdefault(c, []).append(i)
    wanted, last, out = min(k, len(points) - 1), math.ceil(span / cell) + 1, []
    for i, (p, (cx, cy)) in enumerate(zip(points, home, strict=True)):
        found: list[tuple[float, int]] = []
        for r in range(last + 1):
            ring = [(cx, cy)] if not r else [(cx + d, cy + e) for d in range(-r, r + 1) for e in ((-r, r) if abs(d) < r else range(-r, r + 1))]
            found += [(dist(p, points[j]), j) for c in ring for j in grid.get(c, ()) if j != i]
            if len(found) >= wanted:  # whatever is further out is more than r cells away
                found.sort()
                if found[wanted - 1][0] < r * cell or r == last:
                    break
        out.append([j for _, j in found[:wanted]])
    return out


def capsule_span(a: Point, b: Point, c: Point, d: Point, r: float) -> tuple[float, float] | None:
    """Shares of a-b between which it is within r of the segment c-d: one span, since what is near a segment is convex."""
    found: list[float] = []
    for q in (c, d):  # the discs at its ends
        ux, uy, wx, wy = b[0] - a[0], b[1] - a[1], a[0] - q[0], a[1] - q[1]
        square, half, rest = ux * ux + uy * uy, ux * wx + uy * wy, wx * wx + wy * wy - r * r
        if square == 0:
            if rest <= 0:
                found += [0.0, 1.0]
        elif half * half - square * rest >= 0:
            root = math.sqrt(half * half - square * rest)
            found += [(-half - root) / square, (-half + root) / square]
    n = dist(c, d)
    if n:  # the band between them
        low, high = -math.inf, math.inf
        for vx, vy, least, most in (((d[0] - c[0]) / n, (d[1] - c[1]) / n, 0.0, n), (-(d[1] - c[1]) / n, (d[0] - c[0]) / n, -r, r)):
            start, step = (a[0] - c[0]) * vx + (a[1] - c[1]) * vy, (b[0] - a[0]) * vx + (b[1] - a[1]) * vy
            if abs(step) > 1e-12:
                x, y = sorted(((least - start) / step, (most - start) / step))
                low, high = max(low, x), min(high, y)
            elif not least <= start <= most:
                low, high = 1.0, 0.0
        if low <= high:
            found += [low, high]
    if not found or max(found) <= 0 or min(found) >= 1:
        return None
    return max(0.0, min(found)), min(1.0, max(found))


def length_within(line: list[Point], others: list[list[Point]], r: float) -> float:
    """How much of a line runs within r of one of the others: spans by leg and segment, merged."""
    total = 0.0
    for a, b in zip(line, line[1:]):
        end = 0.0
        for low, high in sorted(s for other in others for c, d in zip(other, other[1:]) if (s := capsule_span(a, b, c, d, r))):
            total += max(0.0, high - max(low, end)) * dist(a, b)
            end = max(end, high)
    return total


@dataclass
class Shape:
    """An obstacle: polygons as lists of rings (the first is the shell), and open lines (a point is a line of one)."""

    key: str
    kind: str
    polygons: list[list[list[Point]]] = field(default_factory=list)
    lines: list[list[Point]] = field(default_factory=list)
    width: float = 0.0  # of an existing pipe
    box: tuple[float, float, float, float] | None = field(default=None, repr=False)
    sides: list[tuple[Point, Point]] | None = field(default=None, repr=False)

    def edges(self) -> list[tuple[Point, Point]]:
        if self.sides is None:
            lines = [ring for rings in self.polygons for ring in rings]
            self.sides = [e for ring in lines for e in zip(ring, ring[1:])] + [e for line in self.lines for e in zip(line, line[1:] or line)]
        return self.sides

    def contains(self, p: Point) -> bool:
        for rings in self.polygons:
            inside = False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                    if point_gap(p, (x1, y1), (x2, y2)) <= 1e-9:
                        return True
                    if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                return True
        return False

    def beyond(self, line: list[Point], reach: float) -> bool:
        """Whether the boxes of the obstacle and of a line are further apart than reach (a quick test before gap_line)."""
        if self.box is None:
            points = [p for e in self.edges() for p in e]
            self.box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else (math.inf, math.inf, -math.inf, -math.inf)
        xs, ys = [p[0] for p in line], [p[1] for p in line]
        return min(xs) > self.box[2] + reach or max(xs) < self.box[0] - reach or min(ys) > self.box[3] + reach or max(ys) < self.box[1] - reach

    def gap(self, a: Point, b: Point) -> float:
        """Distance to a segment; 0 if they meet."""
        if self.polygons and self.contains(a):
            return 0.0
        best = math.inf
        low_x, high_x, low_y, high_y = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
        for c, d in self.edges():
            far = best + 1e-3  # an edge whose box is further away can't come nearer, nor meet within the tolerances of meeting()
            if min(c[0], d[0]) - high_x > far or low_x - max(c[0], d[0]) > far or min(c[1], d[1]) - high_y > far or low_y - max(c[1], d[1]) > far:
                continue
            best = min(best, segment_gap(a, b, c, d))
            if best == 0.0:
                break
        return best

    def gap_line(self, line: list[Point]) -> float:
        return min((self.gap(a, b) for a, b in zip(line, line[1:] or line)), default=math.inf)


def band(line: list[Point], half: float) -> list[list[list[Point]]]:
    """A line with a width, as one rectangle for each segment (flat ends)."""
    out = []
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        n = math.hypot(x2 - x1, y2 - y1)
        if n:
            ox, oy = -(y2 - y1) / n * half, (x2 - x1) / n * half
            ring = [(x1 + ox, y1 + oy), (x2 + ox, y2 + oy), (x2 - ox, y2 - oy), (x1 - ox, y1 - oy)]
            out.append([[*ring, ring[0]]])
    return out
