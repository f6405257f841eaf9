"""Legs against polygons and lines as rows, against plain geometry on random figures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pipewright.functions.planar import Shape, capsule_span, last_contact, line_length, measure, sub_line
from pipewright.operators import polygons
from pipewright.operators.selection import accept_offers, select_diverse


def ring(r, x, y, size, n):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    points = [(x + size * r.uniform(0.5, 1) * math.cos(a), y + size * r.uniform(0.5, 1) * math.sin(a)) for a in turns]
    return [*points, points[0]]


@pytest.fixture(scope="module")
def figures():
    r = random.Random(8)
    shapes = []
    for i in range(12):
        x, y = r.uniform(0, 120), r.uniform(0, 120)
        shapes.append(Shape(str(i), "park", [[ring(r, x, y, 30, 7), *([ring(r, x, y, 6, 4)] if i % 2 else [])]]))
    legs = [((r.uniform(0, 120), r.uniform(0, 120)), (r.uniform(0, 120), r.uniform(0, 120))) for _ in range(40)]
    return shapes, legs


@pytest.fixture(scope="module")
def met(spark, figures):
    shapes, legs = figures
    edges = spark.createDataFrame([(int(s.key), *a, *b) for s in shapes for a, b in s.edges()], "shape long, ex1 double, ey1 double, ex2 double, ey2 double")
    lines = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(legs)], "leg long, ax double, ay double, bx double, by double")
    return polygons.near_polygons(lines.repartition(3), edges.repartition(3), "shape", 8.0, 16.0).cache()


def test_spans_inside_and_near(met, figures):
    shapes, legs = figures
    inside, near = {}, {}
    for rows, out in ((polygons.inside_spans(met, ["leg", "shape"]), inside), (polygons.within(met, ["leg", "shape"], F.lit(8.0)), near)):
        for x in rows.collect():
            out.setdefault((x["leg"], x["shape"]), []).append((x["low"], x["high"]))
    n = 1500
    for i, (a, b) in enumerate(legs):
        for s in shapes:
            for found, reach in ((inside, 0.0), (near, 8.0)):
                spans = found.get((i, int(s.key)), [])
                for k in range(0, n, 7):
                    t = (k + 0.5) / n
                    if any(abs(t - x) < 1e-3 for span in spans for x in span):
                        continue
                    p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                    gap = 0.0 if s.contains(p) else s.gap(p, p)
                    if abs(gap - reach) > 1e-3 or not reach:
                        assert any(x <= t <= y for x, y in spans) == (s.contains(p) if not reach else gap <= reach)


def test_gaps(met, figures):
    shapes, legs = figures
    got = {(x["leg"], x["shape"]): x["dist"] for x in polygons.gaps(met, ["leg", "shape"]).collect()}
    for i, leg in enumerate(legs):
        for s in shapes:
            gap = s.gap(*leg)
            if gap <= 8.0:
                assert got[i, int(s.key)] == pytest.approx(gap, abs=1e-6)


def test_last_contacts(spark):
    r = random.Random(3)
    lines = [(k, (r.uniform(0, 60), r.uniform(0, 60)), (r.uniform(0, 60), r.uniform(0, 60))) for k in range(8)]
    lines += [(20, (0.0, 10.0), (40.0, 10.0))]
    routes = [[(r.uniform(0, 60), r.uniform(0, 60)) for _ in range(r.randint(2, 4))] for _ in range(60)]
    routes += [[(5.0, 10.0), (25.0, 10.0), (25.0, 12.0)], [(50.0, 10.0), (10.0, 10.0)], [(10.0, 5.0), (10.0, 10.0)]]  # along the line, ending on it, touching at the end
    rows = []
    for i, line in enumerate(routes):
        start = 0.0
        for a, b in zip(line, line[1:]):
            rows.append((i, start, line_length(line), *a, *b))
            start += math.dist(a, b)
    legs = spark.createDataFrame(rows, "route long, start double, total double, ax double, ay double, bx double, by double")
    pipes = spark.createDataFrame([(k, *a, *b) for k, a, b in lines], "pipe long, x1 double, y1 double, x2 double, y2 double")
    got = {x["route"]: x for x in polygons.last_contacts(legs, "route", pipes, "pipe", ("x1", "y1", "x2", "y2"), 16.0).collect()}
    for i, line in enumerate(routes):
        best = max((m for _, a, b in lines if (m := last_contact(line, [a, b])) is not None), default=None)
        assert (i in got) == (best is not None)
        if best is not None:
            assert got[i]["measure"] == pytest.approx(best, abs=1e-6)
            _, a, b = lines[min(got[i]["pipe"], 8)]
            assert got[i]["along"] == pytest.approx(measure([a, b], sub_line(line, best, best)[0]), abs=1e-5)


def test_capsule_span_edges():
    assert capsule_span((0, 0), (10, 0), (5, 1), (5, 9), 2.0) == pytest.approx((0.5 - math.sqrt(3) / 10, 0.5 + math.sqrt(3) / 10))
    assert capsule_span((0, 0), (10, 0), (0, 5), (10, 5), 2.0) is None
    assert capsule_span((3, 0), (3, 0), (0, 1), (10, 1), 2.0) in (None, (0.0, 1.0))
    assert capsule_span((0, 1), (10, 1), (2, 0), (4, 0), 1.5) == pytest.approx(((2 - math.sqrt(1.25)) / 10, (4 + math.sqrt(1.25)) / 10))


def test_offers_are_taken_in_rounds(spark):
    r = random.Random(2)
    rows = [(t, g, k + 1) for t in range(200) for k, g in enumerate(r.sample(range(30), 4))] + [(500 + i, 0, 1) for i in range(3000)] + [(None, 1, 1), (9000, None, 1), (0, 7, 1)]
    rows += [rows[0]] * 3
    taken, places = {}, {}
    offers = {}
    for t, g, k in rows:
        if t is not None and g is not None:
            offers.setdefault((k, t), set()).add(g)
    df = spark.createDataFrame(rows, "taker long, giver long, turn int").repartition(3)
    got = {x["taker"]: (x["giver"], x["turn"]) for x in accept_offers(df.where("taker <> 0 OR turn > 1"), "taker", "giver", "turn", 5, 4).collect()}
    for k in range(1, 5):
        for t in sorted(t for kk, t in offers if kk == k and not (t == 0 and k == 1)):
            [g] = offers[k, t]
            if t not in taken and places.get(g, 0) < 5:
                taken[t] = (g, k)
                places[g] = places.get(g, 0) + 1
    assert got == taken


def test_faults_of_rings(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    move = lambda ring, x, y, k=1.0: [[k * a + x, k * b + y] for a, b in ring]
    cases = {
        "fine": [[square, move(square, 2, 2, 0.2), move(square, 5, 5, 0.2)]],
        "two parts": [[square], [move(square, 5, 5)]],  # parts are judged each
        "bow": [[[[0.0, 0.0], [10.0, 10.0], [10.0, 0.0], [0.0, 10.0], [0.0, 0.0]]]],
        "spike": [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [10.0, -5.0], [0.0, 10.0], [0.0, 0.0]]]],
        "open": [[square[:-1] + [[0.0, 0.5]]]],
        "flat": [[[[0.0, 0.0], [10.0, 0.0], [5.0, 0.0], [0.0, 0.0]]]],
        "twice": [[[[0.0, 0.0], [0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]],
        "short": [[[[0.0, 0.0], [10.0, 0.0], [0.0, 0.0]]]],
        "hole away": [[square, move(square, 20, 20, 0.2)]],
        "hole across": [[square, move(square, 8, 5, 0.3)]],
        "hole touches": [[square, [[0.0, 5.0], [4.0, 3.0], [4.0, 7.0], [0.0, 5.0]]]],
        "pinched": [[[[0.0, 0.0], [5.0, 5.0], [10.0, 0.0], [10.0, 10.0], [5.0, 5.0], [0.0, 10.0], [0.0, 0.0]]]],
    }
    want = {
        "bow": {"SELF_CROSSING", "NO_AREA"}, "spike": {"SELF_CROSSING"}, "open": {"NOT_CLOSED"}, "flat": {"SELF_CROSSING", "NO_AREA"}, "twice": {"NO_LENGTH", "SELF_CROSSING"},
        "short": {"TOO_FEW_SIDES", "SELF_CROSSING"}, "hole away": {"HOLE_OUTSIDE"}, "hole across": {"SELF_CROSSING"}, "pinched": {"SELF_CROSSING"},
    }
    shapes = spark.createDataFrame(list(cases.items()), "name string, rings array<array<array<array<double>>>>").repartition(3)
    got = {}
    for r in polygons.ring_faults(polygons.sides(shapes, ["name"]), ["name"], 4.0).collect():
        got.setdefault(r["name"], set()).add(r["fault"])
    assert got == want


def test_diverse_choice_is_greedy(spark):
    r = random.Random(12)
    candidates, parts = [], []
    for g in range(25):
        for k in range(r.randint(1, 12)):
            candidates.append((g, k, r.randint(1, 2), round(r.uniform(1, 1.6), 3), f"s{k}", r.randint(0, 1)))
            parts += [(g, k, p, float(r.randint(1, 9))) for p in r.sample(range(6), r.randint(1, 4))]
    want = set()
    for g in range(25):
        own = [c for c in candidates if c[0] == g]
        top = max(c[2] for c in own)
        own = [c for c in own if c[2] == top]
        least = min(c[3] for c in own)
        weights = {c[1]: {p: w for gg, k, p, w in parts if (gg, k) == (g, c[1])} for c in own}
        chosen = []
        for c in sorted((c for c in own if c[3] <= least * 1.35), key=lambda c: (c[3], c[4])):
            share = lambda a, b: sum(w for p, w in weights[a].items() if p in weights[b]) / sum(weights[a].values())  # noqa: E731, B023
            if all(c[5] != t[5] or min(share(c[1], t[1]), share(t[1], c[1])) < 0.5 for t in chosen) and len(chosen) < 3:
                chosen.append(c)
        want |= {(g, c[1], n) for n, c in enumerate(chosen, 1)}
    df = spark.createDataFrame(candidates, "g long, k long, connected long, score double, signature string, kind long").repartition(3)
    owned = spark.createDataFrame(parts, "g long, k long, part long, weight double").repartition(3)
    got = {(x["g"], x["k"], x["rn"]) for x in select_diverse(df, owned, ["g"], "k", 3, 0.35, 0.5).collect()}
    assert got == want
    assert {n for *_, n in want} == {1, 2, 3}


def test_stretches_along_sides_and_through_corners_go_by_their_middle(spark):
    """A ray to the right from the middle holds a left side and not a right one; corners that are only passed are no way in."""
    square = [(1, *s) for s in ((0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, 0.0))]
    legs = [(1, 0.0, -5.0, 0.0, 15.0), (2, 10.0, 15.0, 10.0, -5.0), (3, -5.0, 5.0, 5.0, -5.0), (4, 5.0, -5.0, 5.0, 5.0), (5, 10.0, -5.0, 10.0, 15.0)]
    shapes = polygons.with_edges(spark.createDataFrame(square, "shape long, ex1 double, ey1 double, ex2 double, ey2 double"), "shape")
    pairs = polygons.spatial.extent_join(spark.createDataFrame(legs, "leg long, ax double, ay double, bx double, by double"), polygons.LEG, shapes, polygons.BOX, 0.0, 16.0)
    found = polygons.inside_stretches(pairs, ["leg", "shape"], shapes, "shape").collect()
    assert sorted((r["leg"], r["low"], r["high"]) for r in found) == [(1, 0.25, 0.75), (4, 0.5, 1.0)]
