"""Registered queries for rules that a plan is held against, each with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.functions import catalog as cat
from pipewright.functions import geometry as geo
from pipewright.operators import spatial
from pipewright.operators.numbering import numbered
from pipewright.plans.queries import SEGMENT, _cols, _raw_types, _road_events
from pipewright.plans.scenes import HARD, HEAP_SQL, heap, scene, sql
from pipewright.session import table
from pipewright.sources.geojson import refused

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, text
        return f

    return register


@query(sql("consumer", "box") + """
SELECT bkey, kind, EXISTS (SELECT 1 FROM consumer WHERE x BETWEEN x1 - 0.000001 AND x2 + 0.000001 AND y BETWEEN y1 - 0.000001 AND y2 + 0.000001) AS connected FROM box""")
def building_connections(spark: SparkSession, d: str) -> DataFrame:
    """Whether a connection point is in or on each building."""
    boxes = scene(spark, d, "box")
    places, extents = scene(spark, d, "consumer").select("x", "y").distinct(), boxes.select(*SEGMENT).distinct()
    near = spatial.range_join(places, "x", "y", extents, SEGMENT, 1e-6, 64.0)
    gap = geo.point_box_distance(*_cols("x", "y", *SEGMENT))
    served = near.where(gap <= 1e-6).select(*SEGMENT).distinct().withColumn("connected", F.lit(True))
    return boxes.join(served, list(SEGMENT), "left").select("bkey", "kind", F.coalesce("connected", F.lit(False)).alias("connected"))


@query(sql("box") + """,
raw AS (SELECT bkey, kind AS restriction_type, CASE bkey % 3 WHEN 0 THEN 'restriction' WHEN 1 THEN 'oks_existing' ELSE 'oks_future' END AS object_type FROM box)
SELECT object_type, restriction_type, count(*) AS n, min(bkey) AS first, max(bkey) AS last, CAST(sum(bkey) AS BIGINT) AS keys FROM raw GROUP BY 1, 2""")
def layer_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of each map layer, by their count, ends and sum of keys."""
    groups = _raw_types(spark, d).groupBy("object_type", "restriction_type")
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min("bkey").alias("first"), F.max("bkey").alias("last"), F.sum("bkey").alias("keys"))


@query(sql("pipe", "chamber") + """,
used AS (SELECT hkey, count(p.pkey) AS degree FROM chamber LEFT JOIN pipe p ON abs(hx - x1) <= 0.01 AND abs(hy - y1) <= 0.01 AND sqrt((hx - x1) * (hx - x1) + (hy - y1) * (hy - y1)) <= 0.01 GROUP BY hkey),
near AS (SELECT p.pkey, c.hkey, sqrt((hx - x1) * (hx - x1) + (hy - y1) * (hy - y1)) AS dist FROM pipe p JOIN chamber c ON abs(hx - x1) <= 10 AND abs(hy - y1) <= 10)
SELECT pkey, min(n.hkey) AS hkey, count(*) AS n, 'CAMERA_WITHIN_10M' AS code FROM near n JOIN used u ON u.hkey = n.hkey WHERE dist > 0.01 AND dist <= 10 AND degree < 4 GROUP BY pkey""")
def unused_chambers(spark: SparkSession, d: str) -> DataFrame:
    """Tie-ins on bare pipes that a chamber with a free place is within 10 m of."""
    starts = scene(spark, d, "pipe").select("pkey", "x1", "y1")
    chambers = scene(spark, d, "chamber").withColumns({"hx2": F.col("hx"), "hy2": F.col("hy")})
    near = spatial.range_join(starts, "x1", "y1", chambers, ("hx", "hy", "hx2", "hy2"), 10.0, 64.0)
    near = near.withColumn("dist", geo.distance(*_cols("x1", "y1", "hx", "hy"))).where("dist <= 10").select("pkey", "hkey", "dist")
    free = near.groupBy("hkey").agg(F.count_if(F.col("dist") <= 0.01).alias("degree")).where("degree < 4")
    return near.where("dist > 0.01").join(free, "hkey").groupBy("pkey").agg(F.min("hkey").alias("hkey"), F.count(F.lit(1)).alias("n"), F.lit("CAMERA_WITHIN_10M").alias("code"))


_EXIT = 5.5  # m: a building's clearance for the smallest pipe, and a half more


def _exits(x: str, y: str) -> list[tuple[str, str, str, str, str]]:
    """(distance to the wall, extent x1, y1, x2, y2) of the straight ways out of a box, in both dialects."""
    return [
        (f"({x} - x1)", f"(x1 - {_EXIT})", y, x, y), (f"(x2 - {x})", x, y, f"(x2 + {_EXIT})", y),
        (f"({y} - y1)", x, f"(y1 - {_EXIT})", x, y), (f"(y2 - {y})", x, y, x, f"(y2 + {_EXIT})"),
    ]


@query(sql("consumer", "box") + """,
own AS (SELECT ckey, x, y, bkey, x1, y1, x2, y2 FROM consumer JOIN box ON kind = 'oks' AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2),
ways AS (""" + " UNION ALL ".join(f"SELECT ckey, bkey, {w} AS gap, {a} AS ex1, {b} AS ey1, {c} AS ex2, {e} AS ey2 FROM own" for w, a, b, c, e in _exits("x", "y")) + """),
nearest AS (SELECT * FROM ways QUALIFY gap <= min(gap) OVER (PARTITION BY ckey, bkey) + 0.000001),
judged AS (SELECT n.ckey, n.bkey, NOT EXISTS (SELECT 1 FROM box b WHERE b.kind IN (""" + ", ".join(f"'{k}'" for k in HARD) + """) AND b.bkey <> n.bkey
  AND b.x1 - 1 < n.ex2 AND b.x2 + 1 > n.ex1 AND b.y1 - 1 < n.ey2 AND b.y2 + 1 > n.ey1) AS free FROM nearest n)
SELECT ckey, bkey, count(*) AS ways, count(*) FILTER (free) AS free, CASE WHEN NOT bool_or(free) THEN 'TERMINAL_APPROACH_BLOCKED' END AS code FROM judged GROUP BY ckey, bkey""")
def terminal_approach(spark: SparkSession, d: str) -> DataFrame:
    """Consumers in a building: how many of the nearest ways out pass no other hard obstacle within 1 m, and the code where none does."""
    buildings = scene(spark, d, "box").where("kind = 'oks'")
    own = spatial.range_join(scene(spark, d, "consumer"), "x", "y", buildings, SEGMENT, 0.0, 64.0).where("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
    way = lambda w, *extent: F.struct(F.expr(w).alias("gap"), *(F.expr(e).cast("double").alias(n) for e, n in zip(extent, ("ex1", "ey1", "ex2", "ey2"), strict=True)))
    ways = own.select("ckey", "bkey", F.explode(F.array(*(way(*e) for e in _exits("x", "y")))).alias("w")).select("ckey", "bkey", "w.*")
    least = F.min("gap").over(Window.partitionBy("ckey", "bkey"))
    nearest = ways.withColumn("_least", least).where(F.col("gap") <= F.col("_least") + 1e-6).withColumn("way", F.struct("ex1", "ey1", "ex2", "ey2"))
    others = scene(spark, d, "box").where(F.col("kind").isin(HARD)).select(F.col("bkey").alias("other"), *SEGMENT)
    met = spatial.extent_join(nearest, ("ex1", "ey1", "ex2", "ey2"), others, SEGMENT, 1.0, 64.0).where("other <> bkey AND x1 - 1 < ex2 AND x2 + 1 > ex1 AND y1 - 1 < ey2 AND y2 + 1 > ey1")
    blocked = met.select("ckey", "bkey", "way").distinct().groupBy("ckey", "bkey").agg(F.count(F.lit(1)).alias("blocked"))
    total = nearest.groupBy("ckey", "bkey").agg(F.count(F.lit(1)).alias("ways"))
    free = total.join(blocked, ["ckey", "bkey"], "left").withColumn("free", F.col("ways") - F.coalesce("blocked", F.lit(0)))
    return free.select("ckey", "bkey", "ways", "free", F.when(F.col("free") == 0, "TERMINAL_APPROACH_BLOCKED").alias("code"))


@query(sql("route") + """,
l AS (SELECT okey, sqrt((x2 - x0) * (x2 - x0) + (y2 - y0) * (y2 - y0)) AS chord,
  sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) + sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM route)
SELECT okey, round(length - chord, 4) AS excess, abs(length - chord) <= 0.000001 AS straight FROM l""")
def straight_routes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a route is as long as its chord."""
    lengths = scene(spark, d, "route").select(
        "okey", geo.distance(*_cols("x0", "y0", "x2", "y2")).alias("chord"), (geo.distance(*_cols("x0", "y0", "x1", "y1")) + geo.distance(*_cols("x1", "y1", "x2", "y2"))).alias("length")
    )
    excess = F.col("length") - F.col("chord")
    return lengths.select("okey", F.round(excess, 4).alias("excess"), (F.abs(excess) <= 1e-6).alias("straight"))


@query(sql("route") + """,
r AS (SELECT okey, x0, y0, x1, y1, x2, y2, x0 + okey % 60 - 30 AS x3, y0 + okey % 50 AS y3 FROM route),
s AS (SELECT okey, ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) * ((x1 - x0) * (y3 - y0) - (y1 - y0) * (x3 - x0)) < 0
    AND ((x3 - x2) * (y0 - y2) - (y3 - y2) * (x0 - x2)) * ((x3 - x2) * (y1 - y2) - (y3 - y2) * (x1 - x2)) < 0 AS first,
  ((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) * ((x2 - x1) * (y0 - y1) - (y2 - y1) * (x0 - x1)) < 0
    AND ((x0 - x3) * (y1 - y3) - (y0 - y3) * (x1 - x3)) * ((x0 - x3) * (y2 - y3) - (y0 - y3) * (x2 - x3)) < 0 AS second,
  abs((x0 * y1 - x1 * y0) + (x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y0 - x0 * y3)) / 2 AS area FROM r)
SELECT okey, first OR second AS crosses_itself, round(area, 4) AS area, NOT (first OR second) AND area > 0 AS valid FROM s""")
def ring_validity(spark: SparkSession, d: str) -> DataFrame:
    """Rings of four corners: whether two sides cross, and whether the ring encloses anything."""
    ring = scene(spark, d, "route").withColumns({"x3": F.expr("x0 + okey % 60 - 30"), "y3": F.expr("y0 + okey % 50")})
    at = lambda i: _cols(f"x{i}", f"y{i}")
    crossed = geo.crosses((*at(0), *at(1)), (*at(2), *at(3))) | geo.crosses((*at(1), *at(2)), (*at(3), *at(0)))
    turns = [at(i)[0] * at((i + 1) % 4)[1] - at((i + 1) % 4)[0] * at(i)[1] for i in range(4)]
    area = F.abs(turns[0] + turns[1] + turns[2] + turns[3]) / 2
    out = ring.select("okey", crossed.alias("crosses_itself"), area.alias("area"))
    return out.select("okey", "crosses_itself", F.round("area", 4).alias("area"), (~F.col("crosses_itself") & (F.col("area") > 0)).alias("valid"))


@query("""WITH used AS (SELECT DISTINCT s_suppkey * 3 + 1 AS n FROM supplier),
free AS (SELECT n, row_number() OVER (ORDER BY n) AS rn FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + (SELECT count(*) FROM used) + 1)) AS n) WHERE n NOT IN (SELECT n FROM used)),
wanted AS (SELECT c_custkey AS ckey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
SELECT ckey, 'new:' || CAST(n AS VARCHAR) AS id FROM wanted JOIN free USING (rn)""")
def serial_ids(spark: SparkSession, d: str) -> DataFrame:
    """New ids in the order of keys, without numbers that existing objects have.

    Rows are numbered with counts by range of keys, so that no task sorts them all."""
    used = table(spark, d, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("n")).distinct()
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("ckey"))
    most = wanted.count() + used.count()
    free = spark.range(1, most + 1).withColumnRenamed("id", "n").join(used, "n", "left_anti")
    return numbered(wanted, [], [F.col("ckey")]).join(numbered(free, [], [F.col("n")]), "rn").select("ckey", F.concat(F.lit("new:"), F.col("n").cast("string")).alias("id"))


@query(sql("consumer", "box") + """,
ev AS (SELECT ckey, bkey, greatest(CAST(0 AS DOUBLE), y1 - 3) AS f, least(CAST(4000 AS DOUBLE), y2 + 3) AS t FROM consumer JOIN box ON x > x1 AND x < x2 AND kind IN ('road', 'tram_tracks')),
cuts AS (SELECT ckey, f AS m FROM ev UNION SELECT ckey, t FROM ev),
pieces AS (SELECT ckey, m AS from_m, lead(m) OVER (PARTITION BY ckey ORDER BY m) AS to_m FROM cuts)
SELECT p.ckey, from_m, to_m, string_agg(CAST(bkey AS VARCHAR), ',' ORDER BY bkey) AS crossed FROM pieces p JOIN ev e ON e.ckey = p.ckey AND (from_m + to_m) / 2 BETWEEN f AND t GROUP BY 1, 2, 3""")
def piece_obstacles(spark: SparkSession, d: str) -> DataFrame:
    """The obstacles that each piece of a line crosses, as an exported pipe lists them."""
    events = _road_events(spark, d).select("x", "bkey", F.col("from").alias("f"), F.col("to").alias("t"))
    cuts = events.select("x", F.explode(F.array("f", "t")).alias("from_m")).distinct()
    line = Window.partitionBy("x").orderBy("from_m")
    pieces = cuts.withColumns({"i": F.row_number().over(line), "to_m": F.lead("from_m").over(line)})
    # an event goes to the pieces from its first cut to its last: as many rows as are listed, none that is thrown away
    first, last = (pieces.select("x", F.col("from_m").alias(c), F.col("i").alias(n)) for c, n in (("f", "low"), ("t", "high")))
    covered = events.join(first, ["x", "f"]).join(last, ["x", "t"]).where("low < high").select("x", "bkey", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("i"))
    met = pieces.where("to_m IS NOT NULL").join(covered, ["x", "i"])
    crossed = F.array_join(F.transform(F.array_sort(F.collect_list("bkey")), lambda b: b.cast("string")), ",")
    found = met.groupBy("x", "from_m", "to_m").agg(crossed.alias("crossed"))
    return spatial.expanded(scene(spark, d, "consumer").select("ckey", "x"), ["x"], found, "from_m", ("from_m", "to_m", "crossed")).select("ckey", "from_m", "to_m", "crossed")


@query(sql("lattice") + """,
e AS (SELECT pkey, x1 AS x, y1 AS y FROM lattice UNION ALL SELECT pkey, x2, y2 FROM lattice)
SELECT a.pkey, b.pkey AS qkey, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.y = b.y AND a.pkey < b.pkey GROUP BY 1, 2""")
def shared_ends(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pipes that end in common points, which may touch there and nowhere else."""
    ends = scene(spark, d, "lattice").select("pkey", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    other = ends.select(F.col("pkey").alias("qkey"), "p")
    return ends.join(other, "p").where("pkey < qkey").groupBy("pkey", "qkey").agg(F.count(F.lit(1)).alias("common"))


@query(sql("consumer") + HEAP_SQL + """,
e AS (SELECT node, up, count(*) OVER (PARTITION BY up) AS siblings FROM heap)
SELECT count(DISTINCT up) FILTER (up < 16) AS roots, count(DISTINCT up) FILTER (up >= 16 AND siblings > 1) AS branches, count(*) AS pipes FROM e""")
def description_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a variant's description states: roots, branches, pipes."""
    ups = heap(spark, d).groupBy("up").agg(F.count(F.lit(1)).alias("n"))
    return ups.agg(F.count_if(F.col("up") < 16).alias("roots"), F.count_if((F.col("up") >= 16) & (F.col("n") > 1)).alias("branches"), F.coalesce(F.sum("n"), F.lit(0)).alias("pipes"))


@query(sql("consumer") + """
SELECT ckey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('17:' || CAST(ckey AS VARCHAR)), ckey) AS INTEGER) AS by_chance FROM consumer JOIN customer ON c_custkey = ckey""")
def shuffled_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's consumers in an order that a seed (17) decides."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ckey"), F.col("c_nationkey").alias("part"))
    mixed = F.md5(F.concat(F.lit("17:"), F.col("ckey").cast("string")).cast("binary"))
    return numbered(c, ["part"], [mixed, F.col("ckey")], "by_chance").select("ckey", F.col("by_chance").cast("int").alias("by_chance"))


@query("""WITH f AS (SELECT p_partkey AS k, 'area' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 5 WHEN 0 THEN '.geojson' WHEN 1 THEN '.JSON' WHEN 2 THEN '.csv' WHEN 3 THEN 'json' ELSE '.json' END AS name, p_partkey % 7 AS size FROM part)
SELECT k, name, CASE WHEN NOT regexp_matches(lower(name), '\\.(geojson|json)$') THEN 'WRONG_TYPE' WHEN size = 0 THEN 'EMPTY_FILE' END AS refused FROM f""")
def upload_check(spark: SparkSession, d: str) -> DataFrame:
    """Files that are refused before they are read: not GeoJSON by name, or empty."""
    ending = F.expr("CASE p_partkey % 5 WHEN 0 THEN '.geojson' WHEN 1 THEN '.JSON' WHEN 2 THEN '.csv' WHEN 3 THEN 'json' ELSE '.json' END")
    files = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("area"), F.col("p_partkey").cast("string"), ending).alias("name"), (F.col("p_partkey") % 7).alias("size"))
    return files.select("k", "name", refused(F.col("name"), F.col("size")).alias("refused"))


_WIDTHS = ", ".join(f"({i}, CAST({p[4]} AS DOUBLE))" for i, p in enumerate(cat.PIPES))


@query(sql("route", "pipe") + f""",
w(dn_idx, width) AS (VALUES {_WIDTHS}),
r AS (SELECT okey, r.dn_idx, x0, y0, x1, y1, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, 1 + w.width / 2 + (SELECT width FROM w WHERE dn_idx = 0) / 2 AS radius FROM route r JOIN w ON w.dn_idx = r.dn_idx)
SELECT okey, round(radius, 4) AS radius, round(least(len, radius), 4) AS exempt, len >= radius AS allowed FROM r""")
def tie_in_exemption(spark: SparkSession, d: str) -> DataFrame:
    """How far a route may keep close to the pipe that it starts from at a right angle, and whether its first leg leads out of that."""
    radius = 1 + cat.width(F.col("dn_idx")) / 2 + cat.width(F.lit(0)) / 2
    r = scene(spark, d, "route").select("okey", geo.distance(*_cols("x0", "y0", "x1", "y1")).alias("len"), radius.alias("r"))
    return r.select("okey", F.round("r", 4).alias("radius"), F.round(F.least("len", "r"), 4).alias("exempt"), (F.col("len") >= F.col("r")).alias("allowed"))
