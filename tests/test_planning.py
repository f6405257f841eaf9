"""Rules, routes, sizes and plans on scenes with known results."""

from __future__ import annotations

import itertools
import json
import math
import random
import time

import pytest

from pipewright.functions import catalog as cat
from pipewright.functions.planar import Shape, band, length_within, line_length, nearest_on, neighbours, sub_line
from pipewright.operators.routing import counted_search, search
from pipewright.operators.rules import check
from pipewright.operators.sizing import Edge, flows, size_tree
from pipewright.plans.planner import Network, Options, Piece, Planner, RoadData, export, load, plan, plan_rows, roots, verify

X, Y = 414000.0, 6179000.0


def at(x, y):
    return [X + x, Y + y]


def feature(key, kind, shape, coords, restriction=None, flow=None, diameter=None, width=None):
    return {"id_key": key, "object_type": kind, "restriction_type": restriction, "flow": flow, "diameter": diameter, "width": width, "shape": shape, "coords": json.dumps(coords)}


PIPE = feature("s:pipe", "heat_network", "LineString", [at(-10, 0), at(10, 0)], diameter=100)
CHAMBER = feature("s:chamber", "heat_chamber", "Point", at(0, 0))
BASIC = [PIPE, CHAMBER, feature("s:t", "oks_connection_point", "Point", at(0, 100), flow=20.0)]
STRAIGHT = [(0.0, 0.0), (0.0, 100.0)]


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


def summaries(rows):
    return [r for r in rows if r["object_type"] == "variant_summary"]


def test_control_case():
    rows = plan_rows(BASIC, "a", Options())
    (s,) = summaries(rows)
    assert s["cost"] == pytest.approx(13_974_800, abs=10)
    assert s["score"] == pytest.approx(0.6912944, abs=1e-6)
    assert s["tie_ins"] == 1
    pipes = [r for r in rows if r["object_type"] == "heat_network"]
    assert sum(r["length"] for r in pipes) == pytest.approx(100)
    assert {r["diameter"] for r in pipes} == {100}
    assert len({r["id"] for r in rows}) == len(rows)


def test_order_of_features_does_not_matter():
    turned = [BASIC[2], BASIC[1], PIPE | {"coords": json.dumps([at(10, 0), at(-10, 0)])}]
    a, b = (summaries(plan_rows(f, "a", Options()))[0]["score"] for f in (BASIC, turned))
    assert a == pytest.approx(b, abs=1e-8)


def test_shared_stem_is_cheaper_than_two_pipes():
    targets = [feature(f"s:t{i}", "oks_connection_point", "Point", at(x, 120), flow=20.0) for i, x in enumerate((-10, 10))]
    s = summaries(plan_rows([PIPE, CHAMBER, *targets], "a", Options(beam_width=2)))[0]
    alone = math.hypot(10, 120) * 89_748 + 5_000_000
    assert s["pending"] == "[]" and s["cost"] < 2 * alone and s["length"] < 2 * math.hypot(10, 120)


def test_local_search_never_worsens():
    targets = [feature(f"s:t{i}", "oks_connection_point", "Point", at(x, y), flow=15.0) for i, (x, y) in enumerate(((-25, 90), (20, 130), (35, 60)))]
    before, after = (summaries(plan_rows([PIPE, CHAMBER, *targets], "a", Options(beam_width=1, refinements=1, local_search=n)))[0] for n in (0, 3))
    assert after["pending"] == before["pending"] == "[]" and after["score"] <= before["score"] + 1e-12


def test_detaching_dissolves_junctions():
    targets = [feature(f"s:t{i}", "oks_connection_point", "Point", at(x, 120), flow=20.0) for i, x in enumerate((-10, 10))]
    p = Planner(load([PIPE, CHAMBER, *targets]), Options(beam_width=2, local_search=0))
    n = next(n for n in p.run() if any(k.startswith("junction:") for k in n.points))
    left = p.evaluate(p.detach(n, "s:t1"))
    assert left and left.served == {"s:t0"} and len(left.pieces) == 1 and set(left.points) == {left.pieces[0].start, "s:t0"}


def two_targets(*places, flow=10.0):
    return [PIPE, CHAMBER, *(feature(f"s:{k}", "oks_connection_point", "Point", at(x, y), flow=flow) for k, (x, y) in zip("abcdefgh", places, strict=False))]


def connected_to(p, key, line):
    """A network of one straight pipe from the chamber."""
    [root] = [r for r in roots(p.t, p.by_key[key], Options(), 0) if r.chamber]
    return p.evaluate(Network({root.key: root}, {root.key: root.point, key: p.by_key[key].point}, [Piece(root.key, key, [tuple(at(*x)) for x in line])], frozenset([key]))), root


def test_overlapping_routes_become_a_shared_stem():
    p = Planner(load(two_targets((0, 100), (50, 100))), Options(beam_width=2, local_search=0))
    n, root = connected_to(p, "s:a", [(0, 0), (0, 100)])
    route = [tuple(at(*x)) for x in ((0, 0), (0, 50), (50, 100))]
    joined = p.accepted(n, root, p.by_key["s:b"], route)
    assert joined and joined.served == {"s:a", "s:b"} and len(joined.pieces) == 3
    [stem] = [x for x in joined.pieces if x.start == root.key]
    assert joined.flow[stem.end] == pytest.approx(20) and line_length(stem.line) == pytest.approx(50)
    assert verify(p.t, export(p.t, joined, "a", 1)) == []
    assert len(n.pieces) == 1 and n.served == {"s:a"}
    through = [tuple(at(*x)) for x in ((0, 0), (0, 100), (50, 100))]
    assert p.joined(n, p.by_key["s:b"], through) is None  # a consumer is no junction


def test_seed_serves_consumers_before_any_beam():
    long = feature("s:pipe", "heat_network", "LineString", [at(-100, 0), at(100, 0)], diameter=200)
    features = [long, *two_targets((-80, 80), (-20, 110), (0, 90), (20, 110), (80, 80))[2:]]
    p = Planner(load(features), Options())
    n = p.seed()
    assert n.served == set(p.by_key) and p.spent <= Options().total_expansions * 3 // 4
    assert verify(p.t, export(p.t, n, "a", 1)) == []
    full = Planner(load(two_targets((-20, 110), (0, 90), (20, 110))), Options())
    assert full.seed().served == {"s:a", "s:b"}  # two places are left at the only tie-in: taken in the order of keys
    tiny = Planner(load(features), Options(total_expansions=1))
    tiny.run()
    assert tiny.spent <= 1


def test_exports_name_the_pipe_of_a_new_tie_in():
    long = feature("s:pipe", "heat_network", "LineString", [at(-100, 0), at(100, 0)], diameter=200)
    p = Planner(load([long, *two_targets((-80, 80), (80, 80))[2:]]), Options())
    rows = export(p.t, p.seed(), "a", 1)
    chambers = [r for r in rows if r["object_type"] == "heat_chamber"]
    assert chambers and all(r["existing_object_id"] == "s:pipe" for r in chambers)
    assert summaries(rows)[0]["description"].startswith(f"verified: {len(chambers)} tie-ins")


def test_a_hopeless_consumer_does_not_starve_the_next():
    moat = feature("s:moat", "restriction", "Polygon", [[at(*x) for x in box(-120, 60, -40, 140)], [at(*x) for x in box(-110, 70, -50, 130)]], restriction="water")
    house = feature("s:house", "restriction", "Polygon", [[at(*x) for x in box(-20, 40, 20, 60)]], restriction="oks")
    features = [*two_targets((-80, 100), (0, 110)), moat, house]
    p = Planner(load(features), Options(total_expansions=3000))
    with p.within(500):
        assert p.attach(p.evaluate(Network()), p.by_key["s:a"], "balanced") == []
    assert p.spent <= 500 and p.most == 3000
    assert p.attach(p.evaluate(Network()), p.by_key["s:b"], "balanced")


def test_only_moving_a_subtree_helps():
    near = feature("s:near", "heat_network", "LineString", [at(180, 90), at(220, 90)], diameter=100)
    p = Planner(load([*two_targets((190, 130), (210, 130)), near]), Options())
    [root] = [r for r in roots(p.t, p.by_key["s:a"], Options(max_tie_ins=16, initial_tie_ins=16), 0) if r.chamber]
    junction = f"junction:{round((X + 200) * 1000)}:{round((Y + 110) * 1000)}"
    spot = tuple(at(200, 110))
    pieces = [Piece(root.key, junction, [root.point, spot]), *(Piece(junction, k, [spot, p.by_key[k].point]) for k in ("s:a", "s:b"))]
    n = p.evaluate(Network({root.key: root}, {root.key: root.point, junction: spot, **{k: x.point for k, x in p.by_key.items()}}, pieces, frozenset(p.by_key)))
    assert n
    # a consumer alone can leave the long stem only by a stem of its own
    alone = [x for k in p.by_key for x in p.attach(p.detach(n, k), p.by_key[k], "balanced") if len(x.roots) == 1]
    assert all(x.length > 200 for x in alone)
    whole = [x for x in p.moved(n, "balanced", 0) if len(x.roots) == 1 and x.length < 100]
    assert whole and all(x.served == n.served and junction in x.points for x in whole)
    better = p.improve(n, "balanced")
    assert better.score < n.score / 2 and verify(p.t, export(p.t, better, "a", 1)) == []


def test_another_way_leaves_the_corridor():
    house = Shape("h", "oks", [[box(-10.0, 40.0, 11.0, 60.0)]])
    first, _ = counted_search((0.0, 0.0), (0.0, 100.0), 3, [house], None, "compact", 2, 1500, 24, frozenset())
    other, _ = counted_search((0.0, 0.0), (0.0, 100.0), 3, [house], None, "compact", 2, 1500, 24, frozenset(), avoid=([first.line], 5.0))
    side = lambda line: math.copysign(1, max((x for x, _ in line), key=abs))
    assert side(first.line) == -side(other.line)
    assert length_within(other.line, [first.line], 5.0) < length_within(first.line, [first.line], 5.0) == pytest.approx(line_length(first.line))


def test_neighbours_of_the_visibility_graph():
    r = random.Random(4)
    for n, k in ((0, 3), (1, 3), (2, 5), (40, 7), (300, 16)):
        points = [(r.choice([r.uniform(0, 500), 50.0]), r.choice([r.uniform(0, 9), 3.0])) for _ in range(n)]
        want = [sorted((math.dist(p, q), j) for j, q in enumerate(points) if j != i)[:k] for i, p in enumerate(points)]
        assert neighbours(points, k) == [[j for _, j in x] for x in want]
    many = [(r.uniform(0, 1000), r.uniform(0, 1000)) for _ in range(5000)]
    began = time.time()
    assert all(len(x) == 24 for x in neighbours(many, 24))
    assert time.time() - began < 6  # a second and a half on a machine of its own


def test_length_within_a_corridor():
    r = random.Random(6)
    for _ in range(60):
        line, other = ([(r.uniform(0, 40), r.uniform(0, 40)) for _ in range(r.randint(2, 4))] for _ in range(2))
        got, n = length_within(line, [other], 6.0), 4000
        near = lambda p: min(math.dist(p, nearest_on(p, c, d)[1]) for c, d in zip(other, other[1:])) <= 6.0
        want = sum(near(sub_line(line, m, m)[0]) for m in ((i + 0.5) * line_length(line) / n for i in range(n))) * line_length(line) / n
        assert got == pytest.approx(want, abs=line_length(line) * 3e-3)


def test_approach_blocked_and_flow_beyond_the_catalogue():
    inner = [feature("s:own", "restriction", "Polygon", [[at(*x) for x in box(-10, 90, 10, 104)]], restriction="oks"), feature("s:park", "restriction", "Polygon", [[at(*x) for x in box(-30, 106, 30, 112)]], restriction="park")]
    codes = {(r["object_type"], r["id"]) for r in plan_rows([*two_targets((0, 100)), *inner], "a", Options(total_expansions=500))}
    assert ("diagnostic:TERMINAL_APPROACH_BLOCKED", "s:a") in codes
    codes = {(r["object_type"], r["id"]) for r in plan_rows(two_targets((0, 100), flow=1e6), "a", Options(total_expansions=500))}
    assert ("diagnostic:NO_SUPPORTED_DIAMETER_FOR_CANDIDATE", "s:a") in codes


def test_road_crossings():
    road = Shape("r", "road", [[box(-50.0, 40.0, 50.0, 60.0)]])
    assert check(STRAIGHT, 3, [road]).weighted == pytest.approx(115.6)
    assert check([(-80, 20), (80, 70)], 3, [road]).code == "CROSSING_ANGLE"
    assert check([(0, 0), (0, 50), (30, 100)], 3, [road]).code == "BEND_INSIDE_SPECIAL"
    assert check(STRAIGHT, 3, [Shape("r", "road", band([(-50.0, 50.0), (50.0, 50.0)], 5.0))]).weighted == pytest.approx(109.6)
    assert check(STRAIGHT, 3, [Shape("r", "road", lines=[[(-50.0, 50.0), (50.0, 50.0)]])], unknown_width=frozenset("r")).code == "ROAD_WIDTH_REQUIRED"


def test_a_tie_in_may_cross_its_own_pipe_later():
    pipe = Shape("p", "heat_network", lines=[[(-50.0, 0.0), (200.0, 0.0), (200.0, 100.0), (-50.0, 100.0)]], width=0.51)
    other = Shape("q", "heat_network", lines=pipe.lines, width=0.51)
    line = [(0.0, 0.0), (0.0, 50.0), (0.0, 160.0)]
    judged = check(line, 3, [pipe], root=((0.0, 0.0), "p"))
    assert judged.legal and judged.intervals == [(98.0, 102.0, cat.TARIFF_OTHER, "p")] and judged.weighted == pytest.approx(160 + 4 * (cat.TARIFF_OTHER - 1))
    assert check(line[1:], 3, [other]).intervals == [(48.0, 52.0, cat.TARIFF_OTHER, "q")]
    assert check(line, 3, [other], root=((0.0, 0.0), "p")).code == "INCOMPLETE_SPECIAL"  # another pipe at the start
    back = [(0.0, 0.0), (0.0, 50.0), (60.0, 50.0), (60.0, 0.5)]
    assert check(back, 3, [pipe], root=((0.0, 0.0), "p")).code == "RULE_CONFLICT"


def test_codes_beside_and_across():
    road = Shape("r", "road", [[box(-50.0, 40.0, 50.0, 60.0)]])
    assert check([(-80, 61), (80, 61)], 3, [road]).code == "CLEARANCE:r"
    assert check([(-80, 60), (80, 60)], 3, [road]).code == "CROSSING_ANGLE"
    tip = Shape("r", "road", [[[(-20.0, 40.0), (0.0, 20.0), (20.0, 40.0), (0.0, 60.0), (-20.0, 40.0)]]])
    assert check([(-80, 60), (80, 60)], 3, [tip]).code == "TANGENT_SPECIAL"
    lane = Shape("r", "road", lines=[[(-50.0, 50.0), (50.0, 50.0)]])
    assert check([(-80, 51), (80, 51)], 3, [lane], unknown_width=frozenset("r")).code == "CLEARANCE:r"
    gas = Shape("g", "gas_pipeline", lines=[[(-50.0, 50.0), (50.0, 50.0)]])
    assert check([(-2, 0), (-2, 40), (2, 60), (2, 100)], 0, [gas]).code in ("", "RULE_CONFLICT")  # the angle is asked of roads and tracks alone
    assert check([(-60, 0), (60, 100)], 0, [Shape("q", "power_cable", lines=[[(0.0, -60.0), (0.0, 160.0)]])]).code != "CROSSING_ANGLE"


@pytest.mark.parametrize(("dn_idx", "legal"), [(3, True), (15, True), (16, False), (17, False)])
def test_wide_pipes_cannot_cross_roads(dn_idx, legal):
    road = Shape("r", "road", [[box(-50.0, 40.0, 50.0, 60.0)]])
    assert check(STRAIGHT, dn_idx, [road]).legal is legal


def test_lines_and_holes_and_own_buildings():
    assert check(STRAIGHT, 3, [Shape("g", "gas_pipeline", lines=[[(-10.0, 50.0), (10.0, 50.0)]])]).code == "RULE_CONFLICT"
    water = Shape("w", "water", [[box(-100.0, -100.0, 100.0, 100.0), box(-20.0, -20.0, 20.0, 20.0)]])
    assert check([(-5, 0), (5, 0)], 3, [water]).legal
    assert check([(0, 0), (0, 60)], 3, [water]).code == "CLEARANCE:w"
    own = Shape("o", "oks", [[box(-10.0, 90.0, 10.0, 110.0)]])
    assert check(STRAIGHT, 3, [own], target=(0.0, 100.0)).legal
    assert check(STRAIGHT, 3, [own]).code == "CLEARANCE:o"
    assert check(STRAIGHT, 3, [own, Shape("w", "water", [[box(-2.0, 92.0, 2.0, 94.0)]])], target=(0.0, 100.0)).code == "CLEARANCE:w"


def test_detour_around_a_building():
    house = Shape("h", "oks", [[box(-10.0, 40.0, 10.0, 60.0)]])
    found = search((0.0, 0.0), (0.0, 100.0), 3, [house], None)
    assert found and 100 < line_length(found.line) < 419 and check(found.line, 3, [house]).legal


def test_sizes_follow_the_longest_way_not_the_sum():
    edges = [Edge("a", "root", 150, 150), Edge("b", "a", 100, 100), Edge("c", "a", 100, 100)]
    flows(edges, {"b": 1.0, "c": 1.0})
    assert edges[0].flow == 2.0
    cost, chosen = size_tree("root", edges, 3, True)
    assert max(chosen.values()) <= 2
    with pytest.raises(ValueError, match="cycle"):
        flows([Edge("a", "b", 1, 1), Edge("b", "a", 1, 1)], {})


def test_sizes_obey_capacity_and_order():
    edges = [Edge("a", "root", 50, 50), Edge("b", "a", 300, 300), Edge("c", "a", 20, 20)]
    flows(edges, {"b": 3.0, "c": 18.0})
    _, chosen = size_tree("root", edges, 3, False)
    assert chosen["a"] >= max(chosen["b"], chosen["c"])
    assert all(cat.PIPES[chosen[e.node]][1] >= e.flow for e in edges)


def brute_sizes(root, edges, existing, on_chamber):
    """The least cost over all choices of sizes, by trying each."""
    best = math.inf
    children = {e.node: [c for c in edges if c.parent == e.node] for e in edges} | {root: [e for e in edges if e.parent == root]}
    for choice in itertools.product(range(12), repeat=len(edges)):
        dn = dict(zip([e.node for e in edges], choice, strict=True))

        def run(e, dn=dn):
            return e.length + max([run(c) for c in children[e.node] if dn[c.node] == dn[e.node]], default=0.0)

        if any(cat.PIPES[dn[e.node]][1] < e.flow or run(e) > cat.PIPES[dn[e.node]][2] for e in edges):
            continue
        if any(dn[c.node] > dn[e.node] or len(children[e.node]) == 1 and dn[c.node] != dn[e.node] for e in edges for c in children[e.node]):
            continue
        cost = sum(e.weighted * cat.PIPES[dn[e.node]][3] for e in edges) + sum(cat.chamber_price(cat.PIPES[dn[e.node]][0]) for e in edges if len(children[e.node]) > 1)
        top = max([existing, *(dn[e.node] for e in children[root])])
        best = min(best, cost + (cat.TIE_IN_PRICE * len(children[root]) if on_chamber else cat.chamber_price(cat.PIPES[top][0])))
    return best


def test_sizes_are_the_cheapest_of_all():
    r = random.Random(4)
    for trial in range(25):
        edges = []
        for i in range(r.randint(2, 4)):
            parent = "root" if i == 0 else r.choice(["root", *(e.node for e in edges)])
            length = r.uniform(20, 900)
            edges.append(Edge(f"n{i}", parent, length, length * r.uniform(1, 1.5)))
        flows(edges, {e.node: r.uniform(1, 25) for e in edges})
        want = brute_sizes("root", edges, 3, trial % 2 == 0)
        found = size_tree("root", edges, 3, trial % 2 == 0)
        again = size_tree("root", edges[::-1], 3, trial % 2 == 0)
        assert (found is None and again is None) if want == math.inf else found[0] == pytest.approx(want) == again[0]
        if found:
            assert set(found[1]) == {e.node for e in edges}


def test_long_chains():
    edges = [Edge(str(i + 1), str(i), 0.1, 0.1) for i in range(3000)]
    flows(edges, {"3000": 5.0})
    assert edges[0].flow == 5.0
    cost, chosen = size_tree("0", edges, 3, True)
    assert len(chosen) == 3000 and len(set(chosen.values())) == 1
    with pytest.raises(ValueError, match="cycle"):
        flows([*edges, Edge("0", "3000", 1.0, 1.0)], {})


def test_a_way_that_is_too_long_for_its_size_gets_the_next():
    planner = Planner(load(BASIC), Options())
    calls = []
    planner.route = lambda start, goal, pipe, dn, profile: calls.append(dn) or ("found" if len(calls) == 3 else None)
    assert planner.widened((0.0, 0.0), planner.t.targets[0], None, 3, "balanced") == "found"
    assert calls == sorted(set(calls)) and [cat.PIPES[i][2] for i in calls] == sorted({cat.PIPES[i][2] for i in calls})


def test_expansions_are_counted():
    house = feature("s:house", "restriction", "Polygon", [[at(-20, 40), at(20, 40), at(20, 60), at(-20, 60), at(-20, 40)]], restriction="oks")
    rows = [*BASIC, house]
    planner = Planner(load(rows), Options())
    planner.run()
    assert planner.spent > 3 * len(planner.routes) / 2
    short = Planner(load(rows), Options(total_expansions=40))
    short.run()
    assert short.spent <= 40 + len(short.routes)


def test_search_statistics():
    (row,) = [r for r in plan_rows(BASIC, "a", Options()) if r["object_type"] == "search_statistics"]
    counters = json.loads(row["id"])
    assert row["variant"] is None and counters["variants"] >= 1 and counters["candidates"] >= 1 and counters["route_calls"] >= 1 and not counters["budget_exhausted"]


def test_new_ids_avoid_those_in_use():
    own = feature("s:new:1:1", "restriction", "Point", at(500, 500), restriction="water")
    rows = plan_rows([*BASIC, own], "a", Options())
    made = [r for r in rows if r["variant"] == 1]
    assert made and "new:1:1" not in {r["id"] for r in made} and verify(load([*BASIC, own]), made) == []
    assert "DUPLICATE_ID" in verify(load([*BASIC, feature("s:" + made[0]["id"], "restriction", "Point", at(500, 500), restriction="water")]), made)


def test_ids_of_two_kinds_and_duplicates():
    t = load([PIPE, feature("n:1", "oks_connection_point", "Point", at(0, 50), flow=1.0), feature("s:1", "oks_connection_point", "Point", at(0, 60), flow=1.0)])
    assert len(t.targets) == 2
    with pytest.raises(ValueError, match="duplicate"):
        load([PIPE, PIPE])


def test_bad_input_and_empty_plans():
    assert summaries(plan_rows([PIPE], "a", Options())) == []
    rows = plan_rows([*BASIC, feature("s:f", "oks_future", "Polygon", [box(*at(50, 50), *at(60, 60))])], "a", Options())
    assert summaries(rows) == [] and any(r["object_type"] == "diagnostic:UNSUPPORTED_RESTRICTION" for r in rows)
    with pytest.raises(ValueError):
        load([feature("s:t", "oks_connection_point", "Point", at(0, 1), flow=0.0)])
    with pytest.raises(ValueError):
        Options(beam_width=0)


def test_road_data_that_are_required():
    codes = lambda roads: {r["object_type"] for r in plan_rows(BASIC, "a", Options(), roads) if r["variant"] == 0}
    box = (*at(-50, -50), *at(50, 150))
    assert codes(RoadData(True, "error", box)) == {"diagnostic:OSM_DATA_UNAVAILABLE"}
    assert codes(RoadData(True, "ready", None)) == {"diagnostic:OSM_COVERAGE_INCOMPLETE"}
    assert codes(RoadData(True, "ready", box)) == set()
    short = plan_rows(BASIC, "a", Options(), RoadData(True, "ready", (*at(-50, -50), *at(50, 105))))
    assert summaries(short) == [] and json.loads(next(r["id"] for r in short if r["object_type"] == "diagnostic:OSM_COVERAGE_INCOMPLETE"))[3] >= Y + 115


def test_budget_ends_the_search():
    rows = plan_rows(BASIC, "a", Options(total_expansions=1, expansions_per_route=1))
    assert len(summaries(rows)) <= 1


@pytest.mark.parametrize(("change", "code"), [({"cost": 0.0}, "WRONG_PIPE_PRICE"), ({"flow": 1.0}, "INVALID_FLOW"), ({"coords": json.dumps([at(0, 0), at(0, 50)])}, "WRONG_LENGTH")])
def test_tampering_is_found(change, code):
    rows = [r for r in plan_rows(BASIC, "a", Options()) if r["variant"] == 1]
    t = load(BASIC)
    assert verify(t, rows) == []
    changed = [r | change if r["object_type"] == "heat_network" else r for r in rows]
    assert code in verify(t, changed)


ROAD = feature("s:road", "restriction", "LineString", [at(-200, 50), at(200, 50)], restriction="road", width=8.0)
FORK = [PIPE, feature("s:t", "oks_connection_point", "Point", at(-20, 120), flow=5.0), feature("s:u", "oks_connection_point", "Point", at(20, 120), flow=5.0)]


def pipe_row(key, start, end, line, flow, dn=100, **more):
    n = line_length([tuple(p) for p in line])
    price = next(p[3] for p in cat.PIPES if p[0] == dn)
    return {"id": key, "object_type": "heat_network", "start_node": start, "end_node": end, "flow": flow, "diameter": dn, "length": n, "laying_method": "base", "special_coefficient": 1.0, "cost": n * price, "coords": json.dumps(line)} | more


def node_row(key, kind, p, dn=None):
    return {"id": key, "object_type": kind, "diameter": dn, "cost": cat.chamber_price(dn) if dn else None, "coords": json.dumps(p)}


def total_row(t, rows, pending=()):
    """A summary that agrees with the other rows, whatever is wrong with them."""
    pipes, chambers = [r for r in rows if r["object_type"] == "heat_network"], {k for k, _ in t.chambers}
    ties, length = sum(r["start_node"] in chambers for r in pipes), sum(r["length"] for r in pipes)
    cost = sum(r["cost"] or 0.0 for r in rows) + ties * cat.TIE_IN_PRICE
    penalty = sum(cat.PENDING_BASE + cat.PENDING_PER_FLOW * x.flow for x in t.targets if x.key in pending)
    score = cat.COST_SHARE * (cost + penalty) / cat.COST_UNIT + cat.LENGTH_SHARE * length / cat.LENGTH_UNIT
    return {"id": "sum", "object_type": "variant_summary", "cost": cost, "length": length, "score": score, "pending": json.dumps(list(pending)), "tie_ins": ties, "penalty": penalty}


def fork(dn=100, branch=100, top=100, kind="heat_chamber", mid=100):
    a, b = at(0, 0), at(0, 60)
    return [
        node_row("a", "heat_chamber", a, top), node_row("b", kind, b, mid if kind == "heat_chamber" else None),
        pipe_row("1", "a", "b", [a, b], 10.0, dn), pipe_row("2", "b", "s:t", [b, at(-20, 120)], 5.0, branch), pipe_row("3", "b", "s:u", [b, at(20, 120)], 5.0, branch),
    ]


HOUSE = feature("s:h", "restriction", "Polygon", [[at(x, y) for x, y in box(-5, 40, 5, 60)]], restriction="oks")


@pytest.mark.parametrize(("features", "rows", "codes"), [
    (FORK, fork(), set()),
    (BASIC, [pipe_row("1", "s:chamber", "s:t", [at(0, 0), at(0, 100)], 20.0)], set()),
    ([*BASIC, HOUSE], [pipe_row("1", "s:chamber", "s:t", [at(0, 0), at(0, 100)], 20.0)], {"INVALID_GEOMETRY:CLEARANCE:s:h"}),
    ([*BASIC, ROAD], [pipe_row("1", "s:chamber", "s:t", [at(0, 0), at(0, 100)], 20.0)], {"WRONG_SPECIAL_INTERVAL_PRICE"}),
    (BASIC, [pipe_row("1", "s:chamber", "s:t", [at(0, 0), at(0, 100)], 20.0, 50)], {"INVALID_NETWORK:FLOW_OR_CAPACITY"}),
    (FORK, fork(kind="technical_node"), {"MISSING_BRANCH_CHAMBER"}),
    (FORK, fork(branch=125, mid=125), {"INVALID_NETWORK:DIAMETER_MONOTONICITY"}),
    (FORK, fork(top=125), {"WRONG_CHAMBER_DIAMETER"}),
    (FORK, [r | {"cost": 1.0} if r["id"] == "b" else r for r in fork()], {"WRONG_CHAMBER_PRICE"}),
    (FORK, [*fork(), node_row("z", "technical_node", at(5, 5))], {"INVALID_NETWORK:UNREACHABLE_COMPONENT"}),
    (FORK, [r | {"coords": json.dumps(at(1, 60))} if r["id"] == "b" else r for r in fork()], {"INVALID_NETWORK:GEOMETRY_ENDPOINT", "INVALID_NETWORK:CROSSING_WITHOUT_NODE"}),
    ([PIPE, feature("s:t", "oks_connection_point", "Point", at(0, 600), flow=1.0)], [node_row("a", "heat_chamber", at(0, 0), 100), pipe_row("1", "a", "s:t", [at(0, 0), at(0, 600)], 1.0)], {"INVALID_NETWORK:CONTINUOUS_LENGTH"}),
    ([PIPE, BASIC[2]], [node_row("a", "heat_chamber", at(0, 20), 100), pipe_row("1", "a", "s:t", [at(0, 20), at(0, 100)], 20.0)], {"INVALID_NEW_TIE_IN"}),
    (BASIC, [node_row("a", "heat_chamber", at(2, 0), 100), pipe_row("1", "a", "s:t", [at(2, 0), at(0, 100)], 20.0)], {"INVALID_NETWORK:CAMERA_WITHIN_10M"}),
    (FORK, [node_row("a", "heat_chamber", at(-5, 0), 100), node_row("c", "heat_chamber", at(5, 0), 100), pipe_row("1", "a", "s:u", [at(-5, 0), at(20, 120)], 5.0), pipe_row("2", "c", "s:t", [at(5, 0), at(-20, 120)], 5.0)], {"INVALID_NETWORK:CROSSING_WITHOUT_NODE"}),
])
def test_rows_that_agree_but_break_a_rule(features, rows, codes):
    t = load(features)
    assert set(verify(t, [*rows, total_row(t, rows)])) == codes


def test_pending_ids_are_known_and_single():
    t, rows = load(BASIC), [pipe_row("1", "s:chamber", "s:t", [at(0, 0), at(0, 100)], 20.0)]
    assert set(verify(t, [*rows, total_row(t, rows, ["x", "x"])])) == {"UNKNOWN_PENDING_TARGET", "DUPLICATE_PENDING_TARGET"}


def test_planned_variants_pass_across_a_road():
    rows = plan_rows([*FORK, ROAD], "a", Options())
    assert summaries(rows) and not any(r["object_type"] == "diagnostic:OUTPUT_VALIDATION_FAILED" for r in rows)


def test_plan_many_territories(spark):
    rows = [f | {"territory": t} for t in ("a", "b") for f in BASIC]
    schema = "territory string, id_key string, object_type string, restriction_type string, flow double, diameter int, width double, shape string, coords string"
    order = [c.split()[0] for c in schema.split(", ")]
    found = plan(spark.createDataFrame([[r[c] for c in order] for r in rows], schema)).where("object_type = 'variant_summary'").collect()
    assert sorted(r["territory"] for r in found) == ["a", "b"]


def test_every_edge_of_the_forest_is_sized(spark):
    from pipewright.plans.demo import dp_assign
    from pipewright.plans.scenes import heap

    sf = "/root/testdata/sf0.001"
    assert sorted(r["node"] for r in dp_assign(spark, sf).collect()) == sorted(r["node"] for r in heap(spark, sf).collect())


def test_registered_plans_search_in_full():
    from pipewright.plans.demo import DEMO_OPTIONS

    assert DEMO_OPTIONS == Options()
