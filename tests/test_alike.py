"""Territories that are equal but for their ids are planned once, and each gets the plan that it would have by itself."""

from __future__ import annotations

import json

from pipewright.operators.rules import Judge, check
from pipewright.functions.planar import Shape
from pipewright.plans.planner import PLAN_SCHEMA, Options, alike, plan, plan_rows

SCHEMA = "territory string, id_key string, object_type string, restriction_type string, flow double, diameter int, width double, shape string, coords string"


def _objects(t: str, a: str = "n:a", b: str = "n:b", x: int = -15) -> list[tuple]:
    return [
        (t, f"{a}{t}", "oks_connection_point", None, 6.0, None, None, "Point", json.dumps([x, 80])), (t, f"{b}{t}", "oks_connection_point", None, 9.0, None, None, "Point", "[18, 90]"),
        (t, f"s:pipe{t}", "heat_network", None, None, 100, None, "LineString", "[[-30,0],[30,0]]"), (t, f"s:road{t}", "restriction", "road", None, None, 8.0, "LineString", "[[-200,40],[200,40]]"),
    ]


def test_equal_territories_are_planned_once_with_their_own_ids(spark):
    rows = [*_objects("1"), *_objects("2"), *_objects("3", x=-20), *_objects("4", a="n:b", b="n:a"), *_objects("5", a="n:a", b="n:a5")]
    features = spark.createDataFrame(rows, SCHEMA)
    by = {r["territory"]: r["as_territory"] for r in alike(features).collect()}
    # the order of ids and other places tell territories apart; where an id begins another one's, a territory stands for itself
    assert by == {"1": "1", "2": "1", "3": "3", "4": "4", "5": "5"}
    options = Options(total_expansions=300, local_search=0, beam_width=1, initial_tie_ins=1, max_tie_ins=1, refinements=1)
    names = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
    got = plan(features.where("territory IN ('1', '2')"), options).collect()
    for t in ("1", "2"):
        own = [dict(zip(SCHEMA.replace(" string", "").replace(" double", "").replace(" int", "").split(", "), r, strict=True)) for r in rows if r[0] == t]
        want = [tuple(r[c] for c in names) for r in plan_rows(iter(own), t, options)]
        assert any(t in (r[4] or "") or t in (r[5] or "") for r in want)
        plain = lambda r: repr([float(v) if isinstance(v, int) else v for v in r])
        assert sorted(map(plain, want)) == sorted(plain(r) for r in got if r["territory"] == t)


def test_verdicts_are_remembered():
    road = Shape("r", "road", [[[(-50.0, 40.0), (50.0, 40.0), (50.0, 48.0), (-50.0, 48.0), (-50.0, 40.0)]]])
    judge = Judge([road])
    line = [(0.0, 0.0), (0.0, 100.0)]
    assert judge(line, 3) == check(line, 3, [road])
    assert judge(line, 3) is judge(list(line), 3)
