"""Roads from map data: ways of an area become road features of a territory, clipped to it and without those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.functions import geometry as geo

#: Classes of ways that carry vehicles.
HIGHWAYS = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service",
]
SCHEMA = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>, remark string"


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """id, tags, geometry of the ways in saved responses; a response with a remark is incomplete and raises."""
    responses = spark.read.option("multiLine", True).schema(SCHEMA).json(path)
    checked = responses.select(F.when(F.col("remark").isNotNull(), F.raise_error(F.concat(F.lit("incomplete response: "), "remark"))).otherwise(F.col("elements")).alias("elements"))
    return checked.select(F.explode("elements").alias("e")).where("e.type = 'way'").select("e.id", "e.tags", "e.geometry")


def parsed_width(text: Column) -> Column:
    """Metres of ``7.5`` or ``7.5 m``; null for other texts and for 0."""
    value = F.try_to_number(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*m?\s*$", 1), F.lit("999999999.999999")).cast("double")
    return F.when(value > 0, value)


def bounds(points: DataFrame) -> DataFrame:
    """One row with the box of points(x, y)."""
    return points.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def clip_lines(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """lines(id, geometry) -> id, part, line: the stretches inside a box; a line that comes back has several parts."""
    pairs = F.expr("transform(sequence(1, size(geometry) - 1), i -> struct(i AS i, geometry[i - 1].lon AS x1, geometry[i - 1].lat AS y1, geometry[i].lon AS x2, geometry[i].lat AS y2))")
    s = lines.where(F.size("geometry") > 1).select("id", F.explode(pairs).alias("s")).select("id", "s.*")
    enter, leave = geo.clip(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], box)
    s = s.withColumns({"t0": enter, "t1": leave}).where("t0 < t1")
    w = Window.partitionBy("id").orderBy("i")
    goes_on = (F.lag("i").over(w) == F.col("i") - 1) & (F.lag("t1").over(w) == 1) & (F.col("t0") == 0)
    s = s.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda t: F.struct((F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1"))).alias("lon"), (F.col("y1") + F.col(t) * (F.col("y2") - F.col("y1"))).alias("lat"))
    parts = s.select("id", "part", "i", at("t0").alias("a"), at("t1").alias("b")).groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("p"))
    return parts.select("id", "part", F.concat(F.array(F.col("p")[0]["a"]), F.col("p")["b"]).alias("line"))


def convert(ways: DataFrame, box: tuple[float, float, float, float], existing: DataFrame) -> DataFrame:
    """Road features of ways: id, osm_id, highway, name, bridge, tunnel, layer, width_m, width_source, lines; a row for each way.

    existing(id, restriction_type, osm_id) are the territory's features: ways that its roads stand for
    (``way/7`` or ``7``) are left out. Lines are clipped to the box; a way that comes back into it has
    several, one outside none and no row. An id that the territory uses already gets a suffix, again
    and again until it is new. A way without two finite points raises."""
    tags = lambda k: F.col("tags")[k]
    usable = ways.where(F.coalesce(tags("highway").isin(HIGHWAYS), F.lit(False)) & ~F.coalesce(tags("area") == "yes", F.lit(False))).dropDuplicates(["id"])
    has = existing.where("restriction_type = 'road' AND osm_id IS NOT NULL").select(F.regexp_replace("osm_id", "^way/", "").alias("own")).distinct()
    fresh = usable.withColumn("own", F.col("id").cast("string")).join(has, "own", "left_anti")
    finite = F.coalesce((F.size("geometry") >= 2) & F.forall("geometry", lambda g: g["lon"].isNotNull() & g["lat"].isNotNull() & ~F.isnan(g["lon"]) & ~F.isnan(g["lat"])), F.lit(False))
    sound = fresh.withColumn("geometry", F.when(finite, F.col("geometry")).otherwise(F.raise_error(F.concat(F.lit("bad geometry of way "), "own"))))
    lines = clip_lines(sound.select("id", "geometry"), box).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "line")))["line"].alias("lines"))
    suffix = ":import"
    used = existing.select(F.col("id").cast("string").alias("used")).where(F.col("used").rlike(f"^external:osm:way:[^:]*({suffix})*$"))
    taken = used.groupBy(F.regexp_extract("used", "^external:osm:way:([^:]*)", 1).alias("own")).agg(
        F.collect_set(((F.length("used") - F.length(F.regexp_replace("used", suffix, ""))) / len(suffix)).cast("int")).alias("counts")
    )
    free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("counts")), F.col("counts"))), F.lit(0))
    width = parsed_width(tags("width"))
    return fresh.join(lines, "id").join(taken, "own", "left").select(
        F.concat(F.lit("external:osm:way:"), "own", F.repeat(F.lit(suffix), free)).alias("id"), F.concat(F.lit("way/"), "own").alias("osm_id"), F.lit("road").alias("restriction_type"),
        tags("highway").alias("highway"), F.coalesce(tags("name"), F.lit("")).alias("name"), *[F.coalesce(tags(k), F.lit(v)).alias(k) for k, v in (("bridge", "no"), ("tunnel", "no"), ("layer", "0"))],
        width.alias("width_m"), F.when(width.isNotNull(), "osm_width_tag").otherwise("unknown").alias("width_source"), "lines",
    )
