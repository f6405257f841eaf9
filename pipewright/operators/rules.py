"""Legality and weighted length of a route: clearances, crossings of roads and lines, exemptions at both ends."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pipewright.functions import catalog as cat
from pipewright.functions.planar import EPS, Point, Shape, dist, line_length, meeting, nearest_on, sub_line, turns_over

HARD = frozenset(("oks", "park", "social_area", "prohibited_site", "water", "railway"))
SPECIAL = frozenset(("road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network"))
MOST_TURN, LEAST_ANGLE = 90.0001, 45.0
ROOT_DISC = 1e-3  # m around a root in which a contact with its own pipe is no crossing


def clearance(shape: Shape, dn_idx: int) -> float:
    """Distance that the axis of a new pipe keeps from an obstacle."""
    dn = cat.PIPES[dn_idx][0]
    own = {"road": 1.5, "tram_tracks": 1.5, "gas_pipeline": 2.20, "power_cable": 2.10}.get(shape.kind, 1.0)
    if shape.kind == "oks":
        own = 5.0 if dn < 500 else 7.0 if dn < 900 else 9.0
    if shape.kind == "heat_network":
        own += shape.width / 2
    return own + cat.PIPES[dn_idx][4] / 2


@dataclass
class Check:
    code: str = ""  # empty: legal
    weighted: float = 0.0
    intervals: list[tuple[float, float, float, str]] = field(default_factory=list)  # from, to, k, obstacle

    @property
    def legal(self) -> bool:
        return not self.code


def sweep(length: float, events: list[tuple[float, float, float, str]]) -> list[tuple[float, float, float]]:
    """Pieces (from, to, k): cut at all ends, each with the greatest k that covers it, 1 where none does."""
    cuts = sorted({0.0, length, *(min(length, max(0.0, x)) for e in events for x in e[:2])})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a > EPS:
            out.append((a, b, max([1.0, *(k for low, high, k, _ in events if low <= (a + b) / 2 <= high)])))
    return out


def _crossings(shape: Shape, line: list[Point]) -> tuple[list[tuple[float, float]], str]:
    """Measures between which a line is inside an obstacle (equal ones where it crosses a line), and a failure."""
    out, at = [], 0.0
    if not shape.polygons:
        for a, b in zip(line, line[1:]):
            n = dist(a, b)
            for c, d in shape.edges():
                hit = meeting(a, b, c, d)
                if len(hit) == 2:
                    return [], "ALONG_EXISTING_LINE"
                out += [(at + t * n, at + t * n) for t in hit]
            at += n
        return sorted({(round(x, 6), round(y, 6)) for x, y in out}), ""
    cuts, total = {0.0, line_length(line)}, line_length(line)
    for a, b in zip(line, line[1:]):
        n = dist(a, b)
        cuts.add(at)
        cuts.update(at + t * n for c, d in shape.edges() for t in meeting(a, b, c, d))
        at += n
    for low, high in zip(ordered := sorted(cuts), ordered[1:]):
        if high - low > EPS and shape.contains(sub_line(line, low, (low + high) / 2)[-1]):
            if out and low - out[-1][1] <= EPS:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
    if any(low <= EPS or high >= total - EPS for low, high in out):
        return [], "INCOMPLETE_SPECIAL"
    return out, ""


def _angle(shape: Shape, line: list[Point], at: float) -> float:
    """Least angle in degrees between the line and the edges that it passes at a measure."""
    near = sub_line(line, max(0.0, at - 0.5), at + 0.5)
    u, here = (near[-1][0] - near[0][0], near[-1][1] - near[0][1]), sub_line(line, at, at + 1e-6)[0]
    angles = []
    for c, d in shape.edges():
        if dist(here, nearest_on(here, c, d)[1]) <= 1e-3 and c != d:
            v = (d[0] - c[0], d[1] - c[1])
            angles.append(math.degrees(math.acos(min(1.0, abs(u[0] * v[0] + u[1] * v[1]) / (math.hypot(*u) * math.hypot(*v))))))
    return min(angles, default=0.0)


def _special(shape: Shape, line: list[Point], radius: float, root: Point | None, width_known: bool) -> tuple[str, list[tuple[float, float, float, str]]]:
    """(failure, priced intervals) of a line and something that may be crossed; root: where the line starts on this pipe."""
    spans, code = _crossings(shape, line)
    if code:
        return code, []
    free = _tie_in(shape, line, root, radius) if root else None
    if free is not None:  # the contact at the root is no crossing; later ones are
        spans = [s for s in spans if s[1] > ROOT_DISC]
    if spans and not width_known:
        return "ROAD_WIDTH_REQUIRED", []
    road = shape.kind in ("road", "tram_tracks")
    if not spans and road and shape.gap_line(line) <= 1e-9:
        return "TANGENT_SPECIAL", []
    pad = 3.0 if road else 2.0
    total, k = line_length(line), cat.TARIFF.get(shape.kind, cat.TARIFF_OTHER)
    events = []
    for low, high in spans:
        low_pad, high_pad = max(0.0, low - pad), min(total, high + pad)
        if low - pad < -EPS or high + pad > total + EPS:
            return "INCOMPLETE_SPECIAL", []
        piece = sub_line(line, low_pad, high_pad)
        if abs(dist(piece[0], piece[-1]) - line_length(piece)) > 1e-6:
            return "BEND_INSIDE_SPECIAL", []
        if road and _angle(shape, line, low) < LEAST_ANGLE - 1e-4:
            return "CROSSING_ANGLE", []
        events.append((low_pad, high_pad, k, shape.key))
    at = free or 0.0
    for low, high, _, _ in [*events, (total, total, 0.0, "")]:
        rest = sub_line(line, at, low) if low - at > EPS else []
        if len(rest) > 1 and shape.gap_line(rest) < radius - EPS:
            return "RULE_CONFLICT" if events or free is not None else f"CLEARANCE:{shape.key}", []
        at = max(at, high)
    return "", events


def _terminal(shape: Shape, line: list[Point], target: Point, radius: float) -> bool:
    """Whether a line may enter the target's own building: by its last leg, at a nearest point of the wall, the rest clear."""
    a, b = line[-2], line[-1]
    if dist(b, target) > 0.01 or shape.gap(a, a) < radius - EPS:
        return False
    hits = sorted({round(t, 9) for c, d in shape.edges() for t in meeting(a, b, c, d)})
    reach = min(dist(target, nearest_on(target, c, d)[1]) for c, d in shape.edges())
    inside = (1 - hits[0]) * dist(a, b) if hits else 0.0
    return (len(hits) == 1 and abs(inside - reach) <= 0.01 or not hits) and (len(line) < 3 or shape.gap_line(line[:-1]) >= radius - EPS)


def _tie_in(shape: Shape, line: list[Point], root: Point, radius: float) -> float | None:
    """Up to which measure a line may be too close to the pipe that it starts on, or None: its first leg touches the pipe
    at the root alone and leaves the least clearance; the stretch ends where it leaves the clearance of its size."""
    if dist(line[0], root) > 0.01 or min(dist(root, nearest_on(root, c, d)[1]) for c, d in shape.edges()) > 0.01:
        return None
    a, b = line[0], line[1]
    if any(t * dist(a, b) > 0.01 for c, d in shape.edges() for t in meeting(a, b, c, d)):
        return None
    if shape.gap(b, b) < clearance(shape, 0) - EPS:
        return None
    low, high = 0.0, 1.0  # where the leg is out of reach, by halving
    if shape.gap(b, b) >= radius:
        for _ in range(45):
            mid = (low + high) / 2
            p = (a[0] + mid * (b[0] - a[0]), a[1] + mid * (b[1] - a[1]))
            low, high = (mid, high) if shape.gap(p, p) < radius else (low, mid)
    return high * dist(a, b)


def check(line: list[Point], dn_idx: int, obstacles: list[Shape], target: Point | None = None, root: tuple[Point, str] | None = None, unknown_width: frozenset[str] = frozenset()) -> Check:
    """Judge a route of a pipe size; root: its point and the key of the existing pipe that it is on."""
    if len(line) < 2 or line_length(line) <= EPS:
        return Check("ZERO_LENGTH")
    if any(turns_over(a, b, c, MOST_TURN) for a, b, c in zip(line, line[1:], line[2:])):
        return Check("TURN_OVER_90")
    events: list[tuple[float, float, float, str]] = []
    for shape in obstacles:
        radius = clearance(shape, dn_idx)
        if shape.beyond(line, radius) or shape.gap_line(line) >= radius - EPS:
            continue
        if shape.kind == "oks" and target and shape.contains(target):
            if not _terminal(shape, line, target, radius):
                return Check(f"CLEARANCE:{shape.key}")
        elif shape.kind in HARD:
            return Check(f"CLEARANCE:{shape.key}")
        elif shape.kind not in SPECIAL:
            return Check("UNSUPPORTED_RESTRICTION")
        else:
            start = root[0] if root and root[1] == shape.key and shape.kind == "heat_network" else None
            code, own = _special(shape, line, radius, start, shape.key not in unknown_width)
            if code:
                return Check(code)
            events += own
    return Check("", sum((b - a) * k for a, b, k in sweep(line_length(line), events)), events)


class Judge:
    """``check`` against the obstacles of one territory, which remembers its last verdicts: searches for different consumers
    try the same legs around the same corners, and states are judged again with each pipe that is added."""

    MOST = 200_000  # verdicts kept

    def __init__(self, obstacles: list[Shape], unknown_width: frozenset[str] = frozenset()):
        self.obstacles, self.unknown_width = obstacles, unknown_width
        self.seen: dict[tuple, Check] = {}

    def __call__(self, line: list[Point], dn_idx: int, target: Point | None = None, root: tuple[Point, str] | None = None) -> Check:
        key = (tuple(line), dn_idx, target, root)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) >= self.MOST:
                self.seen.clear()
            found = self.seen[key] = check(line, dn_idx, self.obstacles, target, root, self.unknown_width)
        return found
