"""DuckDB SQL for the registered queries, written independently of the DataFrame operators."""

from __future__ import annotations

from pipewright.functions import catalog as cat
from pipewright.functions import geometry as geo
from pipewright.plans.queries import HIGHWAYS
from pipewright.plans.scenes import HARD, HEAP_SQL, KINDS, SPECIAL, _sql_case, sql

_CAT = ",\ncat(dn_idx, dn, capacity, max_length, price, width, chamber) AS (VALUES " + ", ".join(
    f"({i}, {p[0]}, CAST({p[1]} AS DOUBLE), CAST({p[2]} AS DOUBLE), CAST({p[3]} AS DOUBLE), CAST({p[4]} AS DOUBLE), CAST({cat.chamber_price(p[0])} AS DOUBLE))" for i, p in enumerate(cat.PIPES)
) + ")"
_T = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / (({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))))"


def _t(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    return _T.format(px=px, py=py, x1=x1, y1=y1, x2=x2, y2=y2)


def _psd(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    t = _t(px, py, x1, y1, x2, y2)
    return f"sqrt(({px} - {x1} - {t} * ({x2} - {x1})) * ({px} - {x1} - {t} * ({x2} - {x1})) + ({py} - {y1} - {t} * ({y2} - {y1})) * ({py} - {y1} - {t} * ({y2} - {y1})))"


def _side(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"(({c} - {a}) * ({f} - {b}) - ({d} - {b}) * ({e} - {a}))"


def _cross(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return f"({_side(*a, *b[:2])} * {_side(*a, *b[2:])} < 0 AND {_side(*b, *a[:2])} * {_side(*b, *a[2:])} < 0)"


def _segments(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    ends = ", ".join((_psd(*a[:2], *b), _psd(*a[2:], *b), _psd(*b[:2], *a), _psd(*b[2:], *a)))
    return f"CASE WHEN {_cross(a, b)} THEN 0 ELSE least({ends}) END"


def _names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TARIFF = "CAST(CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cat.TARIFF.items()) + f" ELSE {cat.TARIFF_OTHER} END AS DOUBLE)"
_CLEAR = """CAST(CASE WHEN kind = 'oks' THEN CASE WHEN dn < 500 THEN 5.0 WHEN dn < 900 THEN 7.0 ELSE 9.0 END
  WHEN kind IN ('road', 'tram_tracks') THEN 1.5 WHEN kind = 'gas_pipeline' THEN 2.2 WHEN kind = 'power_cable' THEN 2.1 ELSE 1.0 END AS DOUBLE)"""
_SCORE = "CAST(0.7 AS DOUBLE) * cost / CAST(25000000 AS DOUBLE) + CAST(0.3 AS DOUBLE) * length / CAST(100 AS DOUBLE)"
_PIPE = ("p.x1", "p.y1", "p.x2", "p.y2")
_NEAR = sql("consumer", "pipe") + f""",
dist AS (SELECT c.ckey, c.flow, p.pkey, p.dn_idx, {_psd("c.x", "c.y", *_PIPE)} AS dist FROM consumer c CROSS JOIN pipe p),
near AS (SELECT *, row_number() OVER (PARTITION BY ckey ORDER BY dist, pkey) AS rn FROM dist QUALIFY rn <= 4)"""
_RAW = ",\nraw AS (SELECT bkey, kind AS restriction_type, CASE bkey % 3 WHEN 0 THEN 'restriction' WHEN 1 THEN 'oks_existing' ELSE 'oks_future' END AS object_type FROM box)"
_NORMAL = "CASE object_type WHEN 'restriction' THEN restriction_type WHEN 'oks_existing' THEN 'oks' ELSE object_type END"
_SIZED = HEAP_SQL + _CAT + """,
sized AS (SELECT h.node, h.up, h.length, f.flow, coalesce((SELECT min(dn_idx) FROM cat WHERE capacity >= round(f.flow, 6) AND max_length >= h.length), -1) AS dn_idx
  FROM heap h JOIN flows f ON f.node = h.node)"""
_ROOTED = ",\ntop(node, root) AS (SELECT node, up FROM heap WHERE up < 16 UNION ALL SELECT h.node, t.root FROM top t JOIN heap h ON h.up = t.node)"
_LEGS = ",\nlegs AS (SELECT okey, dn_idx, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS b_y FROM route UNION ALL SELECT okey, dn_idx, x1, y1, x2, y2 FROM route)"
_BOX = ("b.x1", "b.y1", "b.x2", "b.y2")
_LEG = ("l.ax", "l.ay", "l.bx", "l.b_y")
_EDGES = [("b.x1", "b.y1", "b.x2", "b.y1"), ("b.x2", "b.y1", "b.x2", "b.y2"), ("b.x2", "b.y2", "b.x1", "b.y2"), ("b.x1", "b.y2", "b.x1", "b.y1")]
_PIECES = sql("event") + f""",
ev AS (SELECT ukey, greatest(CAST(0 AS DOUBLE), from_m) AS f, least(CAST(120 AS DOUBLE), to_m) AS t, {_TARIFF} AS k FROM event),
cuts AS (SELECT ukey, f AS m FROM ev WHERE f < t UNION SELECT ukey, t FROM ev WHERE f < t UNION SELECT ukey, CAST(0 AS DOUBLE) FROM ev UNION SELECT ukey, CAST(120 AS DOUBLE) FROM ev),
pieces AS (SELECT ukey, m AS from_m, lead(m) OVER (PARTITION BY ukey ORDER BY m) AS to_m FROM cuts),
priced AS (SELECT p.ukey, p.from_m, p.to_m, greatest(coalesce(max(e.k), 1), CAST(1 AS DOUBLE)) AS k
  FROM pieces p LEFT JOIN ev e ON e.ukey = p.ukey AND e.f <= (p.from_m + p.to_m) / 2 AND e.t >= (p.from_m + p.to_m) / 2
  WHERE p.to_m - p.from_m > 0.0001 GROUP BY 1, 2, 3)"""
_SIGN = "string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey)"
_CANDIDATES = f"""WITH li AS (SELECT l_orderkey, sum(l_quantity) AS length, count(*) AS connected, {_SIGN} AS signature FROM lineitem GROUP BY 1),
c AS (SELECT o_custkey, o_orderkey, connected, round({_SCORE.replace("cost", "(o_totalprice * 1000)")}, 6) AS score, signature FROM orders JOIN li ON o_orderkey = l_orderkey)"""


def _utm_sql() -> str:
    s = "sin(radians(lat))"
    t = f"sinh(atanh({s}) - {geo.ECCENTRICITY!r}::DOUBLE * atanh({geo.ECCENTRICITY!r}::DOUBLE * {s}))"
    x = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos(2 * {j} * xi) * sinh(2 * {j} * eta)" for j, a in enumerate(geo.ALPHA, 1))])
    y = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin(2 * {j} * xi) * cosh(2 * {j} * eta)" for j, a in enumerate(geo.ALPHA, 1))])
    return sql("consumer") + f""",
t AS (SELECT ckey, {t} AS t, radians(lon - 39) AS lam FROM consumer),
g AS (SELECT ckey, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT ckey, round(500000 + {geo.K0 * geo.RADIUS!r}::DOUBLE * ({x}), 4) AS x, round({geo.K0 * geo.RADIUS!r}::DOUBLE * ({y}), 4) AS y FROM g"""


ORACLE_SQL: dict[str, str] = {
    "cheapest_tie_in": _NEAR + _CAT + f""",
sized AS (SELECT *, (SELECT min(c.dn_idx) FROM cat c WHERE c.capacity >= near.flow AND c.max_length >= near.dist) AS idx FROM near),
priced AS (SELECT s.*, c.dn, s.dist AS length, s.dist * c.price + (SELECT chamber FROM cat g WHERE g.dn_idx = greatest(s.idx, s.dn_idx)) AS cost FROM sized s JOIN cat c ON c.dn_idx = s.idx),
scored AS (SELECT *, {_SCORE} AS score FROM priced)
SELECT ckey, pkey, dn, round(length, 4) AS length, round(cost, 2) AS cost, round(score, 6) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY ckey ORDER BY scored.score, pkey) = 1""",
    "knn_tie_in": _NEAR + " SELECT ckey, pkey, round(dist, 4) AS dist, CAST(rn AS INTEGER) AS rn FROM near",
    "inventory_counts": sql("box") + " SELECT coalesce(kind, '*') AS kind, count(*) AS n FROM box GROUP BY GROUPING SETS ((kind), ())",
    "type_normalise": sql("box") + _RAW + f", n AS (SELECT bkey, {_NORMAL} AS kind FROM raw) SELECT bkey, kind, CASE WHEN kind IN ({_names(HARD)}) THEN 'hard' WHEN kind IN ({_names(SPECIAL)}) THEN 'special' ELSE 'unsupported' END AS class FROM n",
    "unsupported_types": sql("box") + _RAW + f", n AS (SELECT bkey, {_NORMAL} AS kind FROM raw) SELECT kind, count(*) AS n, min(bkey) AS first FROM n WHERE kind NOT IN ({_names(KINDS)}) GROUP BY kind",
    "id_identity_dups": """WITH i AS (SELECT CAST(user_id AS VARCHAR) AS t, CASE WHEN event_id % 2 = 0 THEN 'n:' ELSE 's:' END AS m FROM events)
SELECT 'upload' AS mode, t AS id_key, count(*) AS n FROM i GROUP BY t HAVING count(*) > 1 UNION ALL SELECT 'plan', m || t, count(*) FROM i GROUP BY m || t HAVING count(*) > 1""",
    "diag_dedupe": "SELECT event_type AS code, user_id AS object_key, min(event_id) AS first FROM events GROUP BY 1, 2",
    "dn_minimum": sql("consumer") + _CAT + ", l AS (SELECT ckey, flow, CAST(ckey * 13 % 12000 AS DOUBLE) AS length FROM consumer) SELECT ckey, flow, length, coalesce((SELECT min(dn_idx) FROM cat WHERE capacity >= l.flow * 50 AND max_length >= l.length), -1) AS dn_idx FROM l",
    "dn_lookup": sql("pipe") + _CAT + ", p AS (SELECT pkey, CASE WHEN pkey % 7 = 0 THEN 99 ELSE dn END AS dn FROM pipe JOIN cat USING (dn_idx)) SELECT p.pkey, p.dn, cat.dn_idx AS idx FROM p LEFT JOIN cat ON cat.dn = p.dn",
    "clearance_radius": sql("box") + _CAT + f""", b AS (SELECT bkey, kind, n.dn, n.width AS nw, e.width AS ew FROM box JOIN cat n ON n.dn_idx = bkey % 18 JOIN cat e ON e.dn_idx = 3 + bkey % 10),
c AS (SELECT *, CASE WHEN kind = 'heat_network' THEN 1 + ew / 2 ELSE {_CLEAR} END AS clear FROM b)
SELECT bkey, kind, round(clear, 4) AS clearance, round(clear + nw / 2, 4) AS radius, {_TARIFF} AS k FROM c""",
    "utm_forward": _utm_sql(),
    "utm_roundtrip": sql("consumer") + " SELECT ckey, round(lon, 6) AS lon, round(lat, 6) AS lat FROM consumer",
    "point_key_mm": sql("consumer") + " SELECT ckey, CAST(CAST(floor((x + flow / 7) * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor((y - flow / 3) * 1000 + 0.5) AS BIGINT) AS VARCHAR) AS key FROM consumer",
    "turn_angles": sql("route") + """, v AS (SELECT okey, x1 - x0 AS ux, y1 - y0 AS uy, x2 - x1 AS vx, y2 - y1 AS vy FROM route),
a AS (SELECT okey, degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) AS t FROM v)
SELECT okey, round(t, 6) AS turn, t <= 90.0001 AS allowed FROM a""",
    "segment_lengths": sql("route") + _LEGS.replace("SELECT okey, dn_idx, x0", "SELECT okey, 0 AS seg, x0").replace("SELECT okey, dn_idx, x1", "SELECT okey, 1, x1") + """,
m AS (SELECT okey, seg, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS len FROM legs),
r AS (SELECT *, sum(len) OVER (PARTITION BY okey ORDER BY seg) AS m_to FROM m)
SELECT okey, seg, round(len, 4) AS length, round(m_to - len, 4) AS m_from, round(m_to, 4) AS m_to FROM r""",
    "project_point_measure": sql("consumer", "pipe") + f" SELECT c.ckey, p.pkey, round({_t('c.x', 'c.y', *_PIPE)} * sqrt((p.x2 - p.x1) * (p.x2 - p.x1) + (p.y2 - p.y1) * (p.y2 - p.y1)), 4) AS measure, round({_psd('c.x', 'c.y', *_PIPE)}, 4) AS dist FROM consumer c JOIN pipe p ON p.pkey = c.ckey % (SELECT max(s_suppkey) + 1 FROM supplier)",
    "clip_to_bbox": sql("pipe") + """, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM pipe),
t AS (SELECT *, CASE WHEN dy = 0 AND (y1 < 1000 OR y1 > 3000) THEN 2 WHEN dy = 0 THEN greatest(0, (CASE WHEN dx > 0 THEN 1000 - x1 ELSE 3000 - x1 END) / dx)
    ELSE greatest(0, (CASE WHEN dx > 0 THEN 1000 - x1 ELSE 3000 - x1 END) / dx, (CASE WHEN dy > 0 THEN 1000 - y1 ELSE 3000 - y1 END) / dy) END AS t0,
  CASE WHEN dy = 0 THEN least(1, (CASE WHEN dx > 0 THEN 3000 - x1 ELSE 1000 - x1 END) / dx)
    ELSE least(1, (CASE WHEN dx > 0 THEN 3000 - x1 ELSE 1000 - x1 END) / dx, (CASE WHEN dy > 0 THEN 3000 - y1 ELSE 1000 - y1 END) / dy) END AS t1 FROM d)
SELECT pkey, round(x1 + t0 * dx, 4) AS cx1, round(y1 + t0 * dy, 4) AS cy1, round(x1 + t1 * dx, 4) AS cx2, round(y1 + t1 * dy, 4) AS cy2 FROM t WHERE t0 <= t1""",
    "bbox": sql("consumer", "chamber", "pipe", "box") + """, p AS (SELECT 'consumer' AS layer, x, y FROM consumer UNION ALL SELECT 'chamber', hx, hy FROM chamber UNION ALL SELECT 'pipe', x1, y1 FROM pipe UNION ALL SELECT 'pipe', x2, y2 FROM pipe
  UNION ALL SELECT 'box', x1, y1 FROM box UNION ALL SELECT 'box', x2, y2 FROM box)
SELECT layer, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p GROUP BY layer""",
    "near_obstacles": sql("consumer", "box") + """, d AS (SELECT ckey, bkey, kind, greatest(x1 - x, 0, x - x2) AS dx, greatest(y1 - y, 0, y - y2) AS dy FROM consumer JOIN box ON x BETWEEN x1 - 12 AND x2 + 12 AND y BETWEEN y1 - 12 AND y2 + 12)
SELECT ckey, bkey, kind, round(sqrt(dx * dx + dy * dy), 4) AS dist FROM d WHERE sqrt(dx * dx + dy * dy) <= 12""",
    "own_buildings": sql("consumer", "box") + " SELECT ckey, bkey, kind FROM consumer JOIN box ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2",
    "chamber_snap": sql("pipe", "chamber") + """, n AS (SELECT pkey, hkey, sqrt((hx - x1) * (hx - x1) + (hy - y1) * (hy - y1)) AS dist FROM pipe JOIN chamber ON abs(hx - x1) <= 10 AND abs(hy - y1) <= 10)
SELECT p.pkey, coalesce('chamber:' || CAST(n.hkey AS VARCHAR), 'pipe:' || CAST(p.pkey AS VARCHAR)) AS root, round(coalesce(n.dist, 0), 4) AS dist FROM pipe p LEFT JOIN n ON n.pkey = p.pkey AND n.dist <= 10""",
    "existing_degree": sql("lattice") + """, s AS (SELECT DISTINCT x1 AS px, y1 AS py FROM lattice),
t AS (SELECT px, py, CASE WHEN (px = x1 AND py = y1) OR (px = x2 AND py = y2) THEN 1 ELSE 2 END AS n FROM s JOIN lattice ON px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2)
SELECT px, py, CAST(sum(n) AS BIGINT) AS degree FROM t GROUP BY 1, 2""",
    "existing_dn": sql("lattice") + ", s AS (SELECT DISTINCT x1 AS px, y1 AS py FROM lattice) SELECT px, py, max(dn_idx) AS dn_idx FROM s JOIN lattice ON px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY 1, 2",
    "hard_violations": sql("route", "box") + _LEGS + _CAT + f""",
near AS (SELECT l.okey, b.bkey, b.kind, c.dn, c.width, CASE WHEN l.ax BETWEEN b.x1 AND b.x2 AND l.ay BETWEEN b.y1 AND b.y2 THEN 0 ELSE least({", ".join(_segments(_LEG, e) for e in _EDGES)}) END AS dist
  FROM legs l JOIN box b ON b.kind IN ({_names(HARD)}) AND greatest(l.ax, l.bx) >= b.x1 - 12 AND least(l.ax, l.bx) <= b.x2 + 12 AND greatest(l.ay, l.b_y) >= b.y1 - 12 AND least(l.ay, l.b_y) <= b.y2 + 12
  JOIN cat c ON c.dn_idx = l.dn_idx),
m AS (SELECT okey, bkey, kind, min(dist) AS dist, min({_CLEAR} + width / 2) AS radius FROM near GROUP BY 1, 2, 3)
SELECT okey, bkey, kind, round(dist, 4) AS dist FROM m WHERE dist < radius - 0.0001""",
    "road_intervals": sql("consumer", "box") + f" SELECT ckey, bkey, kind, greatest(CAST(0 AS DOUBLE), y1 - 3) AS from_m, least(CAST(4000 AS DOUBLE), y2 + 3) AS to_m, {_TARIFF} AS k FROM consumer JOIN box ON x > x1 AND x < x2 AND kind IN ('road', 'tram_tracks')",
    "cost_intervals": _PIECES + " SELECT ukey, from_m, to_m, k FROM priced",
    "weighted_length": _PIECES + " SELECT ukey, round(sum((to_m - from_m) * k), 4) AS weighted, round(sum(to_m - from_m), 4) AS length FROM priced GROUP BY ukey",
    "crossing_pairs": sql("dense") + f" SELECT a.pkey, b.pkey AS qkey FROM dense a JOIN dense b ON a.pkey < b.pkey AND {_cross(('a.x1', 'a.y1', 'a.x2', 'a.y2'), _BOX)}",
    "flow_rollup": sql("consumer") + _SIZED + " SELECT node, round(flow, 4) AS flow, dn_idx FROM sized",
    "longest_same_dn": sql("consumer") + _SIZED + """,
runs(node, tip, dn_idx, run) AS (SELECT node, node, dn_idx, length FROM sized UNION ALL SELECT r.node, s.node, r.dn_idx, r.run + s.length FROM runs r JOIN sized s ON s.up = r.tip AND s.dn_idx = r.dn_idx),
m AS (SELECT node, dn_idx, max(run) AS run FROM runs GROUP BY 1, 2)
SELECT node, m.dn_idx, round(run, 4) AS run, run > max_length AS too_long FROM m LEFT JOIN cat ON cat.dn_idx = m.dn_idx""",
    "node_degrees": sql("consumer") + HEAP_SQL + """, e AS (SELECT node, 1 AS i, 0 AS o FROM heap UNION ALL SELECT up, 0, 1 FROM heap)
SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM e GROUP BY node""",
    "chamber_cost": sql("consumer") + _SIZED + """, e AS (SELECT node, dn_idx, 0 AS child FROM sized UNION ALL SELECT up, dn_idx, 1 FROM sized),
n AS (SELECT node, max(dn_idx) AS dn_idx, CAST(sum(child) AS BIGINT) AS children FROM e GROUP BY node)
SELECT node, children, chamber AS price FROM n LEFT JOIN cat USING (dn_idx) WHERE children > 1 OR node < 16""",
    "tie_in_cost": sql("consumer") + HEAP_SQL + " SELECT up AS root, count(*) AS n, count(*) * CAST(5000000 AS DOUBLE) AS cost FROM heap WHERE up < 16 AND up % 2 = 0 GROUP BY up",
    "pending_penalty": sql("consumer") + " SELECT ckey % 8 AS part, count(*) AS n, round(sum(CAST(100000000 AS DOUBLE) + CAST(500000 AS DOUBLE) * flow), 2) AS penalty FROM consumer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = ckey AND o_orderkey % 7 = 0) GROUP BY 1",
    "network_score": sql("consumer") + _SIZED + _ROOTED + f""", s AS (SELECT root, sum(length * price) AS cost, sum(length) AS length FROM sized JOIN top USING (node) JOIN cat USING (dn_idx) GROUP BY root)
SELECT root, round(cost, 2) AS cost, round(length, 4) AS length, round({_SCORE}, 6) AS score FROM s""",
    "target_orders": sql("consumer") + """ SELECT ckey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY flow DESC, ckey) AS INTEGER) AS by_flow,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY (x - 2000) * (x - 2000) + (y - 2000) * (y - 2000) DESC, ckey) AS INTEGER) AS by_distance FROM consumer JOIN customer ON c_custkey = ckey""",
    "signature_hash": f"SELECT l_orderkey AS okey, {_SIGN} AS signature, md5({_SIGN}) AS digest FROM lineitem GROUP BY l_orderkey",
    "beam_retain": _CANDIDATES + ", d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey, signature ORDER BY o_orderkey) = 1) SELECT o_custkey, o_orderkey, connected, score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY connected DESC, score, signature) AS INTEGER) AS rn FROM d QUALIFY rn <= 4",
    "select_variants": _CANDIDATES + """, f AS (SELECT * FROM c QUALIFY connected = max(connected) OVER (PARTITION BY o_custkey)),
n AS (SELECT * FROM f QUALIFY score <= min(score) OVER (PARTITION BY o_custkey) * CAST(1.35 AS DOUBLE))
SELECT o_custkey, o_orderkey, connected, score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY score, signature) AS INTEGER) AS rn FROM n QUALIFY rn <= 3""",
    "pareto_labels": """SELECT DISTINCT l_partkey, l_extendedprice, l_quantity FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey
  AND b.l_extendedprice <= a.l_extendedprice AND b.l_quantity <= a.l_quantity AND (b.l_extendedprice < a.l_extendedprice OR b.l_quantity < a.l_quantity))""",
    "consumer_groups": sql("consumer") + HEAP_SQL + _ROOTED + " SELECT root, count(*) AS n, md5(string_agg(CAST(node AS VARCHAR), ',' ORDER BY node)) AS digest FROM heap JOIN top USING (node) WHERE leaf_flow > 0 GROUP BY root",
    "tamper_check": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS found FROM lineitem GROUP BY 1)
SELECT o_orderkey AS okey, round(o_totalprice, 2) AS stated, round(found, 2) AS found, 'COST_TOTAL' AS code FROM orders JOIN l ON o_orderkey = l_orderkey
WHERE abs(l.found - o_totalprice) > greatest(CAST(0.02 AS DOUBLE), CAST(0.000001 AS DOUBLE) * abs(o_totalprice))""",
    "chain_collapse": """WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM a)
SELECT user_id, island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "shortest_path_small": """WITH RECURSIVE legs AS (SELECT n AS a, (3 * n + 1) % 25 AS b, 7 + n % 4 AS w FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) UNION ALL SELECT n, (n + 1) % 25, 5 FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)
  UNION ALL SELECT n, (n + 5) % 25, 11 + n % 3 FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)),
p(a, cost, hops) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 UNION ALL SELECT l.b, p.cost + l.w, p.hops + 1 FROM p JOIN legs l ON l.a = p.a WHERE p.hops < 6)
SELECT a AS node, min(cost) AS cost FROM p GROUP BY a""",
    "budget_cutoff": "SELECT user_id, event_id, CAST(sum(1 + event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS used FROM events QUALIFY used <= 40",
    "layer_summary": sql("box") + _RAW + """, l AS (SELECT CASE WHEN object_type = 'oks_existing' OR object_type = 'restriction' AND restriction_type = 'oks' THEN 'buildings' WHEN object_type = 'restriction' THEN 'restriction/' || restriction_type ELSE object_type END AS layer FROM raw)
SELECT layer, count(*) AS n, CASE WHEN layer = 'buildings' THEN 0 WHEN starts_with(layer, 'restriction/') THEN 1 ELSE 2 END AS rank FROM l GROUP BY layer""",
    "osm_convert_dedupe": f"WITH w AS (SELECT p_partkey % 500 AS way, {_sql_case('p_size', HIGHWAYS)} AS highway FROM part) SELECT 'way/' || CAST(way AS VARCHAR) AS id, min(highway) AS highway FROM w WHERE highway <> 'footway' AND way NOT IN (SELECT s_suppkey * 5 FROM supplier) GROUP BY way",
    "width_parse": r"""WITH t AS (SELECT p_partkey AS bkey, CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '.5 m') WHEN 1 THEN concat(p_size, ' lanes') WHEN 2 THEN '0' WHEN 3 THEN concat(' ', p_size, 'm') ELSE concat('-', p_size) END AS text FROM part),
w AS (SELECT bkey, text, TRY_CAST(regexp_extract(text, '^\s*(\d+(?:\.\d+)?)\s*m?\s*$', 1) AS DOUBLE) AS w FROM t)
SELECT bkey, text, CASE WHEN w > 0 THEN w END AS width FROM w""",
}
