"""Exported variants with a known fault each: what verification has to find, state by state.

Every customer makes a territory: an existing pipe with a chamber, two consumers, and an exported variant
that connects them by a stem, a junction and two branches. One thing is then changed, by the customer's
key, and the codes that must follow are listed beside the change.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.functions import catalog as cat
from pipewright.plans.planner import PLAN_SCHEMA
from pipewright.plans.verification import violations
from pipewright.session import table

FEATURES = "id_key string, object_type string, restriction_type string, flow double, diameter int, width double, shape string, coords string"
_BRANCH = math.hypot(20, 40)
_J, _A, _B, _C = "new:1:1", "n:a", "n:b", "s:chamber"
_HOUSE = [[-20 + i * 5 * -1 / math.sqrt(5) + j * 20 * 2 / math.sqrt(5), 100 + i * 5 * 2 / math.sqrt(5) + j * 20 / math.sqrt(5)] for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))]  # around a consumer, square to its branch


def _pipe(key: str, start: str, end: str, flow: float, dn: int, line: list) -> dict:
    length = sum(math.dist(p, q) for p, q in zip(line, line[1:]))
    return {
        "id": key, "object_type": "heat_network", "start_node": start, "end_node": end, "flow": flow, "diameter": cat.PIPES[dn][0], "length": length, "laying_method": "base",
        "special_coefficient": 1.0, "cost": length * cat.PIPES[dn][3], "crossed": "[]", "coords": json.dumps(line),
    }


def _summary(rows: dict[str, dict], ties: int = 1, penalty: float = 0.0, pending: tuple[str, ...] = ()) -> dict:
    cost = sum(r.get("cost") or 0.0 for r in rows.values()) + ties * cat.TIE_IN_PRICE
    length = sum(r.get("length") or 0.0 for r in rows.values())
    score = cat.COST_SHARE * (cost + penalty) / cat.COST_UNIT + cat.LENGTH_SHARE * length / cat.LENGTH_UNIT
    return {"id": "new:1:9", "object_type": "variant_summary", "cost": cost, "length": length, "score": score, "pending": json.dumps(pending), "tie_ins": ties, "penalty": penalty}


def _chamber(key: str, point: tuple, dn: int = 3) -> dict:
    return {"id": key, "object_type": "heat_chamber", "diameter": cat.PIPES[dn][0], "cost": cat.chamber_price(cat.PIPES[dn][0]), "coords": json.dumps(point)}


def _rows() -> dict[str, dict]:
    rows = {
        "junction": _chamber(_J, (0, 60)), "stem": _pipe("new:1:2", _C, _J, 20.0, 3, [(0, 0), (0, 60)]),
        "left": _pipe("new:1:3", _J, _A, 10.0, 2, [(0, 60), (-20, 100)]), "right": _pipe("new:1:4", _J, _B, 10.0, 2, [(0, 60), (20, 100)]),
    }
    return rows | {"summary": _summary(rows)}


def _feature(key: str, kind: str, shape: str, coords: object, restriction: str | None = None, flow: float | None = None, diameter: int | None = None) -> dict:
    return {"id_key": key, "object_type": kind, "restriction_type": restriction, "flow": flow, "diameter": diameter, "width": None, "shape": shape, "coords": json.dumps(coords)}


def _given() -> list[dict]:
    return [
        _feature("s:pipe", "heat_network", "LineString", [[-30, 0], [30, 0]], diameter=100), _feature(_C, "heat_chamber", "Point", [0, 0]),
        _feature(_A, "oks_connection_point", "Point", [-20, 100], flow=10.0), _feature(_B, "oks_connection_point", "Point", [20, 100], flow=10.0),
    ]


def _box(x1: float, y1: float, x2: float, y2: float) -> list:
    return [[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]


def _again(rows: dict[str, dict], **of_summary: object) -> dict[str, dict]:
    """The rows with a summary that fits them."""
    rest = {k: r for k, r in rows.items() if k != "summary"}
    return rest | {"summary": _summary(rest, **of_summary)}


def cases() -> list[tuple[dict[str, dict], list[dict], set[str]]]:
    """(exported rows, features, codes) of each kind of fault."""
    out: list[tuple[dict[str, dict], list[dict], set[str]]] = []
    money, size = {"CALCULATED_COST", "SCORE"}, {"NETWORK_LENGTH", "SCORE"}

    def changed(row: str, codes: set[str], fit: bool = False, **values: object) -> None:
        rows = _rows()
        rows[row] |= values
        out.append((_again(rows) if fit else rows, _given(), codes))

    def more(codes: set[str], add: dict[str, dict] | None = None, drop: tuple[str, ...] = (), features: list[dict] | None = None, **of_summary: object) -> None:
        rows = {k: r for k, r in (_rows() | (add or {})).items() if k not in drop}
        out.append((_again(rows, **of_summary) if "summary" in rows and "summary" not in (add or {}) else rows, features or _given(), codes))

    more(set())
    changed("left", {"WRONG_LENGTH"} | size, length=_BRANCH + 1)
    changed("left", {"WRONG_PIPE_PRICE"} | money, cost=_BRANCH * cat.PIPES[2][3] + 1000)
    changed("stem", {"INVALID_COEFFICIENT"}, fit=True, special_coefficient=0.5, cost=30 * cat.PIPES[3][3])
    changed("stem", {"WRONG_LAYING_METHOD"}, laying_method="special")
    changed("left", {"DUPLICATE_ID"}, id="new:1:2")
    changed("left", {"DUPLICATE_ID"}, id="pipe")
    changed("left", {"MISSING_NODE_REFERENCE", "INVALID_NETWORK:TARGET_ACCOUNTING"}, end_node="new:1:77")
    changed("left", {"INVALID_FLOW"}, flow=9.0)
    changed("left", {"UNKNOWN_DIAMETER", "WRONG_PIPE_PRICE"}, diameter=81)
    more({"INVALID_NETWORK:TARGET_ACCOUNTING", "INVALID_FLOW"}, pending=(_A,), penalty=cat.PENDING_BASE + 10 * cat.PENDING_PER_FLOW)
    more({"UNKNOWN_PENDING_TARGET"}, pending=("n:z",))
    more({"UNKNOWN_PENDING_TARGET", "DUPLICATE_PENDING_TARGET"}, pending=("n:z", "n:z"))
    changed("junction", {"MISSING_BRANCH_CHAMBER"}, fit=True, object_type="technical_node", diameter=None, cost=None)
    changed("junction", {"WRONG_CHAMBER_DIAMETER"}, diameter=150)
    changed("junction", {"WRONG_CHAMBER_PRICE"}, fit=True, cost=3_000_500.0)
    more({"MISSING_SUMMARY"}, drop=("summary",))
    more({"INVALID_SUMMARY"}, add={"second": _rows()["summary"] | {"id": "new:1:8"}, "summary": _rows()["summary"]})
    changed("summary", {"SCORE"}, score=2.5)
    changed("summary", {"TIE_IN_COUNT"}, tie_ins=2)
    changed("summary", {"PENALTY"}, penalty=1000.0)
    changed("summary", {"CALCULATED_COST"}, cost=1.0)
    changed("summary", {"NETWORK_LENGTH"}, length=1.0)
    more({"INVALID_NETWORK:CYCLE", "INVALID_NETWORK:GEOMETRY_ENDPOINT", "TIE_IN_COUNT", *money}, add={"stem": _pipe("new:1:2", _B, _J, 20.0, 3, [(0, 0), (0, 60)]), "summary": _rows()["summary"]})
    changed("stem", {"INVALID_NETWORK:GEOMETRY_ENDPOINT", "WRONG_LENGTH", "WRONG_PIPE_PRICE"}, coords=json.dumps([(0, 0), (0, 58)]))
    more({"INVALID_GEOMETRY:CLEARANCE"}, features=[*_given(), _feature("s:pond", "restriction", "Polygon", [_box(1, 20, 9, 30)], "water")])
    more(set(), features=[*_given(), _feature("s:moat", "restriction", "Polygon", [_box(-60, -60, 60, 150), _box(-45, -50, 45, 130)], "water"), _feature("s:house", "restriction", "Polygon", [_HOUSE], "oks")])
    more({"INVALID_NETWORK:UNREACHABLE_COMPONENT"}, add={"lost": _chamber("new:1:5", (50, 50), 0)})
    more({"CAMERA_NOT_ON_NETWORK"}, features=[_feature("s:pipe", "heat_network", "LineString", [[-30, -7], [30, -7]], diameter=100), *_given()[1:]])
    more({"DUPLICATE_EDGE", "INVALID_NETWORK:ROOT_OR_CYCLE"}, add={"again": _rows()["left"] | {"id": "new:1:6"}})
    more({"INVALID_NETWORK:DIAMETER_MONOTONICITY", "WRONG_CHAMBER_DIAMETER"}, add={"left": _pipe("new:1:3", _J, _A, 10.0, 4, [(0, 60), (-20, 100)])})
    more({"INVALID_NETWORK:FLOW_OR_CAPACITY"}, add={"left": _pipe("new:1:3", _J, _A, 10.0, 1, [(0, 60), (-20, 100)])})
    more({"INVALID_NETWORK:CROSSING_WITHOUT_NODE"}, add={"left": _pipe("new:1:3", _J, _A, 10.0, 2, [(0, 60), (20, 70), (20, 80), (-20, 100)]), "right": _pipe("new:1:4", _J, _B, 10.0, 2, [(0, 60), (0, 80), (20, 90), (20, 100)])})
    half = {"right": _pipe("new:1:4", _J, "new:1:5", 10.0, 2, [(0, 60), (10, 80)]), "rest": _pipe("new:1:6", "new:1:5", _B, 10.0, 2, [(10, 80), (20, 100)])}
    node = {"id": "new:1:5", "object_type": "technical_node", "coords": json.dumps((10, 80))}
    more(set(), add=half | {"node": node})
    more({"UNNECESSARY_CHAMBER"}, add=half | {"node": _chamber("new:1:5", (10, 80), 2)})
    more({"CONSTANT_FLOW_CHAIN_CHANGED"}, add=half | {"node": node, "right": _pipe("new:1:4", _J, "new:1:5", 10.0, 3, [(0, 60), (10, 80)])})
    more({"INVALID_NETWORK:TARGET_NOT_TERMINAL"}, add={"junction": _chamber(_J, (0, 60)), "right": _pipe("new:1:4", _A, _B, 10.0, 2, [(-20, 100), (20, 100)]), "left": _pipe("new:1:3", _J, _A, 20.0, 3, [(0, 60), (-20, 100)])} | {"junction": {"id": _J, "object_type": "technical_node", "coords": json.dumps((0, 60))}})
    far = [(0, 60), (0, 600), (-20, 600), (-20, 100)]
    more({"INVALID_NETWORK:CONTINUOUS_LENGTH"}, add={"left": _pipe("new:1:3", _J, _A, 10.0, 2, far)})
    tie = {"stem": _pipe("new:1:2", "new:1:7", _J, 20.0, 3, [(5, 0), (0, 60)]), "root": _chamber("new:1:7", (5, 0))}
    more({"INVALID_NETWORK:CAMERA_WITHIN_10M"}, add=tie, ties=0)
    more({"INVALID_NEW_TIE_IN"}, add={"stem": _pipe("new:1:2", "new:1:7", _J, 20.0, 3, [(15, 20), (0, 60)]), "root": _chamber("new:1:7", (15, 20))}, ties=0)
    busy = [_feature(f"s:pipe{i}", "heat_network", "LineString", [[0, 0], [x, -40]], diameter=100) for i, x in enumerate((-20, 20))]
    more({"INVALID_NETWORK:CHAMBER_DEGREE"}, features=[*_given(), *busy])
    changed("junction", {"NODE_NOT_POINT"}, coords="null")
    changed("left", {"PIPE_NOT_LINE", "WRONG_LENGTH", "WRONG_PIPE_PRICE"}, coords="[[0, 60]]")
    more({"UNSUPPORTED_OUTPUT_OBJECT"}, add={"odd": {"id": "new:1:5", "object_type": "pump"}})
    return out


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Exports and features of all customers' territories."""
    found = cases()
    columns = [c.split()[0] for c in PLAN_SCHEMA.split(", ") if c.split()[0] not in ("territory", "variant")]
    schema = ", ".join(c for c in PLAN_SCHEMA.split(", ") if c.split()[0] not in ("territory", "variant"))
    rows = [(k, *(r.get(c) for c in columns)) for k, (made, _, _) in enumerate(found) for r in made.values()]
    given = [(k, *f.values()) for k, (_, features, _) in enumerate(found) for f in features]
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("territory"), (F.col("c_custkey") % len(found)).cast("int").alias("fault"))
    small = lambda data, s: F.broadcast(spark.createDataFrame(data, f"fault int, {s}"))  # noqa: E731  some 250 rows, fixed above
    exports = keys.join(small(rows, schema), "fault").drop("fault").withColumn("variant", F.lit(1))
    return exports, keys.join(small(given, FEATURES), "fault").drop("fault")


def verify_tampered(spark: SparkSession, d: str) -> DataFrame:
    """What verification finds in exported variants that were tampered with: a fault in each, by the customer's key."""
    return violations(*_tables(spark, d))


def _sql() -> str:
    found = cases()
    codes = ", ".join(f"({k}, '{code}')" for k, (_, _, expected) in enumerate(found) for code in sorted(expected))
    return f"""WITH expected(fault, code) AS (VALUES {codes})
SELECT CAST(c_custkey AS VARCHAR) AS territory, 1 AS variant, code FROM customer JOIN expected ON c_custkey % {len(found)} = fault"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"verify_tampered": verify_tampered}
ORACLE_SQL = {"verify_tampered": _sql()}
