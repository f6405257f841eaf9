"""Verification of exported variants, all of them in one job: rows of violations by joins, without a loop over states.

A state is a variant of a territory. Its pipes are the edges of a forest; what a tree has to add up to is
rolled up by pointer doubling over all states at once, and geometry is compared through grids whose
keys hold the territory. A state whose pipes refer to unknown or repeated nodes is told so and isn't
judged further; the same goes for one with a cycle. Valid states are those without a row
(``valid_states``). Many rows are dealt by the keys of every join in as many partitions as their number needs,
so that what a task sorts doesn't grow with the tables. Not judged here, but by ``planner.verify``: prices of
special stretches, and rules that need a route as a whole (turns between pipes, clearance of special obstacles).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.functions import catalog as cat
from pipewright.functions import geometry as geo
from pipewright.operators import forest, polygons, spatial
from pipewright.operators.rules import HARD
from pipewright.session import cut, joined, portions, spread

STATE = ["territory", "variant"]
LINE, POINT = "array<array<double>>", "array<double>"
OBJECTS = ("heat_chamber", "technical_node", "heat_network", "variant_summary")
SHAPES = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}
ON, SNAP, CELL = 0.01, 10.0, 64.0


def near(a: Column, b: Column) -> Column:
    """Equal to 2 cm (or 2 units of money), or to a millionth; a null never is."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.02), 1e-6 * F.abs(b)), F.lit(False))


def _coded(df: DataFrame, code: str, *condition: Column) -> DataFrame:
    df = df.where(condition[0]) if condition else df
    return df.select(*STATE, F.lit(code).alias("code"))


def _judged(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """A row for each condition (by its code) that a row of df meets; df is read once for all."""
    return df.select(*STATE, F.explode_outer(F.array(*(F.when(c, F.lit(code)) for code, c in conditions.items()))).alias("code")).where("code IS NOT NULL")


def _legs(pipes: DataFrame) -> DataFrame:
    """territory, variant, start_node, end_node, dn, seg, ax, ay, bx, by of pipes with a line."""
    points = F.transform(F.slice("line", F.lit(2), F.size("line")), lambda p, i: F.struct(i.alias("seg"), F.get("line", i)[0].alias("ax"), F.get("line", i)[1].alias("ay"), p[0].alias("bx"), p[1].alias("by")))
    return pipes.where("size(line) > 1").select(*STATE, "start_node", "end_node", "dn", F.explode(points).alias("s")).select(*STATE, "start_node", "end_node", "dn", "s.*")


def _edges_of(features: DataFrame) -> DataFrame:
    """territory, shape, kind, ex1, ey1, ex2, ey2: sides of hard polygons, holes as well."""
    kind = F.when(F.col("object_type") == "restriction", F.col("restriction_type")).when(F.col("object_type") == "oks_existing", "oks").otherwise(F.col("object_type"))
    hard = features.withColumn("kind", kind).where(F.col("kind").isin(*HARD) & F.col("shape").isin(*SHAPES))
    rings = F.when(F.col("shape") == "Polygon", F.from_json("coords", SHAPES["Polygon"])).otherwise(F.flatten(F.from_json("coords", SHAPES["MultiPolygon"])))
    side = lambda ring: F.transform(F.slice(ring, F.lit(2), F.size(ring)), lambda p, i: F.struct(F.get(ring, i)[0].alias("ex1"), F.get(ring, i)[1].alias("ey1"), p[0].alias("ex2"), p[1].alias("ey2")))
    return hard.select("territory", F.col("id_key").alias("shape"), "kind", F.explode(F.flatten(F.transform(rings, side))).alias("s")).select("territory", "shape", "kind", "s.*")


def _existing_legs(features: DataFrame) -> DataFrame:
    """territory, pipe, dn, seg, last, x1, y1, x2, y2 of the existing network."""
    pipes = features.where("object_type = 'heat_network' AND shape = 'LineString'").select("territory", F.col("id_key").alias("pipe"), cat.index_of(F.col("diameter")).alias("dn"), F.from_json("coords", LINE).alias("line"))
    points = F.transform(F.slice("line", F.lit(2), F.size("line")), lambda p, i: F.struct(i.alias("seg"), F.get("line", i)[0].alias("x1"), F.get("line", i)[1].alias("y1"), p[0].alias("x2"), p[1].alias("y2")))
    return pipes.select("territory", "pipe", "dn", (F.size("line") - 2).alias("last"), F.explode(points).alias("s")).select("territory", "pipe", "dn", "last", "s.*")


def _met_pipes(points: DataFrame, key: list[str], existing: DataFrame, parts: int) -> DataFrame:
    """key, degree, dn: how many ends of existing pipes are at a point (a pipe that passes has two), and their largest size.

    Points that no pipe is at are absent."""
    met = spatial.range_join(points, "x", "y", existing, ("x1", "y1", "x2", "y2"), ON, CELL, ("territory",), parts)
    met = met.where(geo.point_segment_distance(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))) <= ON)
    at = lambda a, b: geo.distance(F.col("x"), F.col("y"), F.col(a), F.col(b)) <= ON
    end = (F.col("seg") == 0) & at("x1", "y1") | (F.col("seg") == F.col("last")) & at("x2", "y2")
    each = spread(met.select(*key, "pipe", "dn", end.alias("_end")), parts, *key).groupBy(*key, "pipe").agg(F.max("dn").alias("dn"), F.max("_end").alias("_end"))
    return each.groupBy(*key).agg(F.sum(F.when(F.col("_end"), 1).otherwise(2)).alias("degree"), F.max("dn").alias("dn"))


def violations(exports: DataFrame, features: DataFrame) -> DataFrame:
    """territory, variant, code: everything that is wrong with the exported variants (rows of ``plan``), each code once.

    features are the rows that the territories were planned from. Rows without a variant are passed over; an empty table
    gives an empty result; a null in a value that is judged counts as wrong."""
    exports = exports.where("variant > 0")
    parts = portions(exports, features)
    deal = lambda df, *keys: spread(df, parts, *keys)
    join = lambda left, right, keys, how="inner": joined(left, right, keys, parts, how)
    rows = cut(deal(exports, *STATE, "id"))
    states = deal(rows.select(*STATE), *STATE).distinct()
    found: list[DataFrame] = []
    length = F.aggregate(F.sequence(F.lit(1), F.size("line") - 1), F.lit(0.0), lambda acc, i: acc + geo.distance(F.get("line", i - 1)[0], F.get("line", i - 1)[1], F.get("line", i)[0], F.get("line", i)[1]))
    pipes = rows.where("object_type = 'heat_network'").withColumn("line", F.from_json("coords", LINE)).withColumn("measured", F.when(F.size("line") > 1, length))
    pipes = cut(pipes.withColumn("dn", cat.index_of(F.col("diameter"))))
    stated = rows.where("object_type IN ('heat_chamber', 'technical_node')").withColumn("p", F.from_json("coords", POINT))
    stated = cut(stated.select(*STATE, F.col("id").alias("node"), "object_type", "diameter", "cost", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))

    # rows by themselves
    found.append(_judged(rows, {"INVALID_ID": F.coalesce(F.trim("id") == "", F.lit(True)), "UNSUPPORTED_OUTPUT_OBJECT": ~F.coalesce(F.col("object_type").isin(*OBJECTS), F.lit(False))}))
    found.append(_coded(stated, "NODE_NOT_POINT", F.col("x").isNull() | F.col("y").isNull()))
    found.append(_judged(pipes, {
        "PIPE_NOT_LINE": F.col("measured").isNull(),
        "INVALID_GEOMETRY:ZERO_LENGTH": F.col("measured") <= geo.EPS,
        "WRONG_LENGTH": ~near(F.col("length"), F.col("measured")),
        "UNKNOWN_DIAMETER": F.col("dn").isNull(),
        "INVALID_COEFFICIENT": ~F.coalesce(F.col("special_coefficient").between(1, 1e9), F.lit(False)),
        "WRONG_PIPE_PRICE": ~near(F.col("cost"), F.col("measured") * F.coalesce(cat.price(F.col("dn")), F.lit(0.0)) * F.col("special_coefficient")),
        "WRONG_LAYING_METHOD": F.coalesce((F.col("laying_method") == "special") != (F.col("special_coefficient") > 1), F.lit(True)),
    }))

    # ids and references
    targets = features.where("object_type = 'oks_connection_point'").select("territory", F.col("id_key").alias("node"), F.col("flow").alias("demand"), F.from_json("coords", POINT).alias("p"))
    chambers = features.where("object_type = 'heat_chamber'").select("territory", F.col("id_key").alias("node"), F.from_json("coords", POINT).alias("p"))
    given = features.select("territory", F.regexp_replace("id_key", "^[sn]:", "").alias("id"))
    twice = deal(rows.select(*STATE, "id"), *STATE, "id").groupBy(*STATE, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").unionByName(join(rows.select(*STATE, "id"), given, ["territory", "id"], "left_semi").select(*STATE, "id", F.lit(1).cast("long").alias("n")))
    found.append(_coded(twice, "DUPLICATE_ID"))
    known = stated.select(*STATE, "node", "x", "y").unionByName(
        join(states, targets.select("territory", "node", "p").unionByName(chambers), ["territory"]).select(*STATE, "node", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    )
    known = cut(deal(known, *STATE, "node").dropDuplicates([*STATE, "node"]))
    for end, at in (("start_node", F.get("line", F.lit(0))), ("end_node", F.element_at("line", -1))):
        met = join(pipes.where("size(line) > 1").select(*STATE, end, "line"), known.withColumnRenamed("node", end), [*STATE, end], "left")
        found.append(_coded(join(pipes.select(*STATE, end), known.withColumnRenamed("node", end), [*STATE, end], "left_anti"), "MISSING_NODE_REFERENCE"))
        found.append(_coded(met, "INVALID_NETWORK:GEOMETRY_ENDPOINT", geo.distance(at[0], at[1], F.col("x"), F.col("y")) > ON))
    found.append(_coded(deal(pipes, *STATE, "start_node", "end_node").groupBy(*STATE, "start_node", "end_node").count().where("count > 1"), "DUPLICATE_EDGE"))
    found.append(_coded(deal(pipes, *STATE, "end_node").groupBy(*STATE, "end_node").count().where("count > 1"), "INVALID_NETWORK:ROOT_OR_CYCLE"))

    # states whose pipes make trees
    unsound = reduce(DataFrame.unionByName, found).where(F.col("code").isin("DUPLICATE_ID", "MISSING_NODE_REFERENCE", "INVALID_NETWORK:ROOT_OR_CYCLE", "UNKNOWN_DIAMETER", "PIPE_NOT_LINE"))
    sound = cut(join(states, unsound.select(*STATE), STATE, "left_anti"))
    name = lambda c: F.concat_ws("\x01", "territory", "variant", c)
    edges = cut(join(pipes, sound, STATE, "left_semi").withColumns({"node": name("end_node"), "up": name("start_node")}))
    circles = forest.cyclic(edges.select("node", "up"), parts)
    turning = deal(join(edges.select(*STATE, "node"), circles, ["node"], "left_semi").select(*STATE), *STATE).distinct()
    found.append(_coded(turning, "INVALID_NETWORK:CYCLE"))
    trees = cut(join(edges, turning, STATE, "left_anti"))
    sound = join(sound, turning, STATE, "left_anti")

    # consumers
    summaries = rows.where("object_type = 'variant_summary'")
    pending = summaries.select(*STATE, F.explode(F.from_json("pending", "array<string>")).alias("node"))
    found.append(_coded(deal(pending, *STATE, "node").groupBy(*STATE, "node").count().where("count > 1"), "DUPLICATE_PENDING_TARGET"))
    pending = deal(pending, *STATE, "node").distinct()
    found.append(_coded(join(pending, targets.select("territory", "node"), ["territory", "node"], "left_anti"), "UNKNOWN_PENDING_TARGET"))
    owed = join(states, targets.select("territory", "node", "demand"), ["territory"])
    owed = join(owed, pending.withColumn("waits", F.lit(True)), [*STATE, "node"], "left")
    ends = deal(pipes.select(*STATE, F.col("end_node").alias("node")), *STATE, "node").distinct().withColumn("reached", F.lit(True))
    owed = cut(owed.join(ends, [*STATE, "node"], "left").select(*STATE, "node", "demand", F.col("waits").isNotNull().alias("waits"), F.col("reached").isNotNull().alias("reached")))
    found.append(_coded(owed, "INVALID_NETWORK:TARGET_ACCOUNTING", F.col("waits") == F.col("reached")))
    demand = owed.where("NOT waits").select(*STATE, F.col("node").alias("end_node"), "demand")
    weighed = join(trees, demand, [*STATE, "end_node"], "left").select("node", "up", F.col("measured").alias("length"), F.coalesce("demand", F.lit(0.0)).alias("demand"))
    total = forest.subtree_sum(weighed, "demand", parts)
    flowing = join(trees.select(*STATE, "node", "flow"), total, ["node"])
    found.append(_coded(flowing, "INVALID_FLOW", ~near(F.col("flow"), F.col("total")) | ~(F.col("flow") > 0)))
    found.append(_coded(trees, "INVALID_NETWORK:FLOW_OR_CAPACITY", F.col("flow") > cat._pick(F.col("dn"), [p[1] for p in cat.PIPES]) + 1e-6))

    # sizes along the way
    above = trees.select(F.col("node").alias("up"), F.col("dn").alias("above"), F.col("flow").alias("flow_above"))
    found.append(_coded(join(trees.select(*STATE, "up", "dn"), above, ["up"]), "INVALID_NETWORK:DIAMETER_MONOTONICITY", F.col("above") < F.col("dn")))
    runs = forest.longest_run(trees.select("node", "up", F.col("measured").alias("length"), "dn"), "dn", parts)
    found.append(_coded(join(trees.select(*STATE, "node", "dn"), runs, ["node"]), "INVALID_NETWORK:CONTINUOUS_LENGTH", F.col("run") > cat.max_length(F.col("dn")) + 1e-6))

    # nodes: what comes in, what goes out, what of the existing network is there
    into = trees.select(*STATE, F.col("end_node").alias("node"), F.col("dn").alias("dn_in"), F.col("flow").alias("flow_in"), F.col("diameter").alias("mm_in"))
    out = deal(trees.select(*STATE, F.col("start_node").alias("node"), "dn", "flow", "diameter"), *STATE, "node").groupBy(*STATE, "node").agg(F.count(F.lit(1)).alias("children"), F.max("dn").alias("dn_out"), F.max("flow").alias("flow_out"), F.max("diameter").alias("mm_out"))
    nodes = join(into, out, [*STATE, "node"], "full").withColumn("children", F.coalesce("children", F.lit(0)))
    places = join(known, sound, STATE, "left_semi")
    existing = cut(deal(_existing_legs(features), "territory", "pipe", "seg"))
    nodes = join(nodes, places, [*STATE, "node"]).join(deal(stated.select(*STATE, "node", "object_type", "diameter", "cost"), *STATE, "node"), [*STATE, "node"], "left")
    nodes = join(nodes, targets.select("territory", "node", F.lit(True).alias("target")), ["territory", "node"], "left")
    nodes = nodes.join(deal(chambers.select("territory", "node", F.lit(True).alias("old")), "territory", "node"), ["territory", "node"], "left")
    nodes = cut(nodes)
    roots = nodes.where("dn_in IS NULL")
    held = cut(_met_pipes(roots.select(*STATE, "node", "x", "y"), [*STATE, "node"], existing, parts))
    roots = join(roots, held.withColumnRenamed("dn", "dn_held"), [*STATE, "node"], "left")
    passing = F.col("dn_in").isNotNull() & (F.col("children") == 1) & F.col("target").isNull()
    found.append(_judged(nodes, {
        "INVALID_NETWORK:TARGET_NOT_TERMINAL": F.col("target").isNotNull() & (F.col("children") > 0),
        "INVALID_NETWORK:CHAMBER_DEGREE": F.col("dn_in").isNotNull() & (F.col("children") > 3),
        "CONSTANT_FLOW_CHAIN_CHANGED": passing & ((F.col("mm_in") != F.col("mm_out")) | ~near(F.col("flow_in"), F.col("flow_out"))),
        "UNNECESSARY_CHAMBER": passing & ~F.coalesce(F.col("object_type") == "technical_node", F.lit(False)),
    }))
    found.append(_judged(roots, {
        "INVALID_NEW_TIE_IN": F.col("old").isNull() & F.col("degree").isNull(),
        "CAMERA_NOT_ON_NETWORK": F.col("old").isNotNull() & F.col("degree").isNull(),
        "INVALID_NETWORK:CHAMBER_DEGREE": F.col("children") + F.coalesce("degree", F.lit(0)) > 4,
    }))
    found.append(_coded(join(join(stated.select(*STATE, "node"), sound, STATE, "left_semi"), nodes.select(*STATE, "node"), [*STATE, "node"], "left_anti"), "INVALID_NETWORK:UNREACHABLE_COMPONENT"))
    judged = join(nodes.where(~passing & F.col("object_type").isNotNull()), held.select(*STATE, "node", F.col("dn").alias("dn_held")), [*STATE, "node"], "left")
    branch = F.col("dn_in").isNull() | (F.col("children") > 1)
    right = F.greatest(F.coalesce("dn_in", F.lit(0)), F.coalesce("dn_out", F.lit(0)), F.coalesce("dn_held", F.lit(0)))
    found.append(_judged(judged, {
        "MISSING_BRANCH_CHAMBER": (F.col("object_type") == "heat_chamber") != branch,
        "WRONG_CHAMBER_DIAMETER": (F.col("object_type") == "heat_chamber") & branch & ~F.coalesce(F.col("diameter") == cat.diameter(right), F.lit(False)),
        "WRONG_CHAMBER_PRICE": (F.col("object_type") == "heat_chamber") & branch & ~near(F.col("cost"), cat.chamber(right)),
    }))

    # a chamber with a free place within 10 m of a new tie-in
    old = chambers.select("territory", F.col("node").alias("chamber"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    degrees = _met_pipes(old, ["territory", "chamber"], existing, parts)
    free = join(old, degrees.select("territory", "chamber", "degree"), ["territory", "chamber"]).select("territory", "chamber", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("x").alias("hx2"), F.col("y").alias("hy2"), "degree")
    bare = roots.where("old IS NULL").select(*STATE, "node", "x", "y")
    close = spatial.range_join(bare, "x", "y", free, ("hx", "hy", "hx2", "hy2"), SNAP, CELL, ("territory",), parts).where(geo.distance(*map(F.col, ("x", "y", "hx", "hy"))) <= SNAP)
    close = join(close, out.select(*STATE, F.col("node").alias("chamber"), "children"), [*STATE, "chamber"], "left")
    found.append(_coded(close, "INVALID_NETWORK:CAMERA_WITHIN_10M", F.col("degree") + F.coalesce("children", F.lit(0)) < 4))

    # geometry: hard obstacles but a consumer's own building, and pipes that meet elsewhere than in a node
    legs = cut(_legs(trees))
    sides = _edges_of(features)
    met = polygons.near_polygons(legs, sides, "shape", 12.0, CELL, ("kind",), ("territory",), parts)
    gaps = polygons.gaps(met, [*STATE, "start_node", "end_node", "dn", "seg", "shape", "kind"])
    hit = gaps.where(F.col("dist") < cat.clearance(F.col("kind"), cat.diameter(F.col("dn"))) + cat.width(F.col("dn")) / 2 - geo.EPS)
    spot = targets.select("territory", F.col("node").alias("chain_end"), F.col("p")[0].alias("ax"), F.col("p")[1].alias("ay")).withColumns({"bx": F.col("ax") + 1.0, "by": F.col("ay")})
    own = polygons.inside_spans(polygons.near_polygons(spot, sides.where("kind = 'oks'"), "shape", 1.0, CELL, keys=("territory",), parts=parts), ["territory", "chain_end", "shape"]).where("low = 0").select("territory", "chain_end", "shape")
    next_pipe = join(trees.select("up", F.col("node").alias("further")), nodes.where(passing).select(name("node").alias("up")), ["up"])
    chains = forest.roots(join(trees.select("node"), next_pipe.withColumnRenamed("up", "node"), ["node"]).select("node", F.col("further").alias("up")), parts)
    ends_of = join(trees.select(*STATE, "end_node", "node"), chains, ["node"], "left").select(*STATE, "end_node", F.substring_index(F.coalesce("root", "node"), "\x01", -1).alias("chain_end"))
    hit = join(join(hit, ends_of, [*STATE, "end_node"]), own, ["territory", "chain_end", "shape"], "left_anti")
    found.append(_coded(hit, "INVALID_GEOMETRY:CLEARANCE"))
    other = legs.select(*STATE, F.col("start_node").alias("s2"), F.col("end_node").alias("e2"), F.col("seg").alias("seg2"), *(F.col(a).alias(b) for a, b in zip(polygons.LEG, polygons.EDGE, strict=True)))
    pairs = spatial.extent_join(legs, polygons.LEG, other, polygons.EDGE, ON, CELL, tuple(STATE), parts).where("end_node < e2")
    shares = pairs.withColumn("_t", F.explode(geo.meeting(tuple(map(F.col, polygons.LEG)), tuple(map(F.col, polygons.EDGE)))))
    spots = shares.select(*STATE, "start_node", "end_node", "s2", "e2", *((F.col(a) + F.col("_t") * (F.col(b) - F.col(a))).alias(c) for a, b, c in (("ax", "bx", "mx"), ("ay", "by", "my"))))
    for end in ("start_node", "end_node"):  # what meets in a node of both is no crossing
        shared = known.select(*STATE, F.col("node").alias(end), F.col("x").alias("nx"), F.col("y").alias("ny"))
        spots = join(spots, shared, [*STATE, end], "left")
        common = (F.col(end) == F.col("s2")) | (F.col(end) == F.col("e2"))
        spots = spots.where(~(common & (geo.distance(*map(F.col, ("mx", "my", "nx", "ny"))) <= 0.05))).drop("nx", "ny")
    found.append(_coded(spots, "INVALID_NETWORK:CROSSING_WITHOUT_NODE"))

    # totals
    per = deal(rows.select(*STATE, "object_type", "cost", "length"), *STATE).groupBy(*STATE).agg(
        F.count_if(F.col("object_type") == "variant_summary").alias("summaries"), F.coalesce(F.sum(F.when(F.col("object_type") == "heat_network", F.col("cost"))), F.lit(0.0)).alias("pipes"),
        F.coalesce(F.sum(F.when(F.col("object_type") == "heat_network", F.col("length"))), F.lit(0.0)).alias("run"), F.coalesce(F.sum(F.when(F.col("object_type") == "heat_chamber", F.col("cost"))), F.lit(0.0)).alias("built"),
    )
    found.append(_judged(per, {"MISSING_SUMMARY": F.col("summaries") == 0, "INVALID_SUMMARY": F.col("summaries") > 1}))
    ties = join(pipes.select(*STATE, "start_node"), chambers.select("territory", F.col("node").alias("start_node")), ["territory", "start_node"], "left_semi")
    ties = deal(ties, *STATE).groupBy(*STATE).agg(F.count(F.lit(1)).alias("ties"))
    due = deal(owed.where("waits"), *STATE).groupBy(*STATE).agg(F.sum(cat.pending_penalty(F.col("demand"))).alias("due"))
    sums = summaries.select(*STATE, F.col("cost").alias("stated_cost"), F.col("length").alias("stated_length"), "penalty", "tie_ins", "score")
    sums = deal(sums, *STATE).join(per.where("summaries = 1"), STATE).join(ties, STATE, "left").join(due, STATE, "left").fillna(0, ["ties", "due"])
    sums = sums.withColumn("total", F.col("pipes") + F.col("built") + F.col("ties") * F.lit(float(cat.TIE_IN_PRICE)))
    found.append(_judged(sums, {
        "CALCULATED_COST": ~near(F.col("stated_cost"), F.col("total")),
        "NETWORK_LENGTH": ~near(F.col("stated_length"), F.col("run")),
        "PENALTY": ~near(F.col("penalty"), F.col("due")),
        "TIE_IN_COUNT": ~F.coalesce(F.col("tie_ins") == F.col("ties"), F.lit(False)),
        "SCORE": ~F.coalesce(F.abs(F.col("score") - cat.score(F.col("total") + F.col("due"), F.col("run"))) <= 1e-5, F.lit(False)),
    }))
    return deal(reduce(DataFrame.unionByName, found), *STATE, "code").distinct()


def valid_states(exports: DataFrame, features: DataFrame) -> DataFrame:
    """territory, variant of the exported states that nothing is wrong with."""
    states = exports.where("variant > 0").select(*STATE).distinct()
    return states.join(violations(exports, features).select(*STATE).distinct(), STATE, "left_anti")
