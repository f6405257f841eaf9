"""GeoJSON territories: reading, structural validation, inventory, projection, and writing of variants.

A file is read whole and parsed to one VARIANT, which keeps the difference between a number and a
text, rejects duplicate keys, and is exploded to a row per feature in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.functions import geometry as geo
from pipewright.functions.catalog import TIE_IN_PRICE
from pipewright.operators.polygons import ring_faults, sides
from pipewright.session import cut

TYPES = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"]
#: How deep the positions lie in the coordinates of each type.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def parse(texts: DataFrame, text: str = "value") -> DataFrame:
    """texts with ``doc`` (VARIANT, null if it isn't one JSON object without duplicate keys) and ``features``."""
    # the parser tolerates what follows a document; inside brackets it has to be a list of one
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]")))
    alone = (F.try_variant_get(listed, "$[1]", "variant").isNull()) & F.rtrim(F.translate(F.col(text), "\n\r\t", "   ")).endswith("}")
    return texts.withColumn("doc", F.when(alone, F.try_variant_get(listed, "$[0]", "variant")))


def refused(name: Column, size: Column) -> Column:
    """Why a file isn't taken, by its name and size; null if it is."""
    return F.when(~F.lower(name).rlike(r"\.(geojson|json)$"), "WRONG_TYPE").when(size == 0, "EMPTY_FILE")


def refusals(spark: SparkSession, path: str) -> DataFrame:
    """Rows like those of ``inspect`` for the files that aren't taken; nothing of their content is read.

    Spark's readers pass over files without any bytes, so those come from the list of the folder."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_size_bytes"))
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [s for found in system.globStatus(top) or [] for s in (system.listStatus(found.getPath()) if found.isDirectory() else [found])]
    empty = [(s.getPath().toString(), 0) for s in listed if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith(("_", "."))]
    files = files.unionByName(spark.createDataFrame(empty, "path string, file_size_bytes long"))
    told = files.withColumn("error", refused(F.col("path"), F.col("file_size_bytes"))).where("error IS NOT NULL")
    empty = F.create_map().cast("map<string,bigint>")
    return told.select("path", "file_size_bytes", F.lit(0).cast("long").alias("total_objects"), empty.alias("type_counts"), empty.alias("restriction_counts"), "error")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, file_size, value, doc: one row for each file that is taken."""
    files = spark.read.option("wholetext", True).text(path)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), "value")
    return parse(named.where(refused(F.col("path"), F.col("file_size")).isNull()))


def features(docs: DataFrame) -> DataFrame:
    """path, pos (from 0), feature (VARIANT) of each feature."""
    listed = F.try_variant_get("doc", "$.features", "array<variant>")
    return docs.select("path", F.posexplode(listed).alias("pos", "feature"))


def kind_of(v: Column) -> Column:
    """'object', 'array', 'string', 'number', 'boolean' or 'null' of a VARIANT; null if there is none."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    )


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def id_text(v: Column) -> Column:
    return get(v, "$", "string")


def id_key(v: Column) -> Column:
    """``s:<text>`` or ``n:<number without trailing zeros>``: 1 and 1.0 are one id, "1" is another."""
    text = id_text(v)  # without trailing zeros, but for doubles
    large = get(v, "$", "decimal(38,0)").cast("string")
    small = F.regexp_replace(get(v, "$", "decimal(38,18)").cast("string"), r"\.?0*$", "")
    number = F.when(text.contains("E"), F.coalesce(F.when(F.abs(get(v, "$", "double")) >= 1, large).otherwise(small), text)).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return F.when(kind_of(v) == "string", F.concat(F.lit("s:"), id_text(v))).when(kind_of(v) == "number", F.concat(F.lit("n:"), number))


def _position_ok(p: Column) -> Column:
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(p) >= 2) & finite & (F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90)


def _line_ok(line: Column) -> Column:
    return (F.size(line) >= 2) & F.forall(line, _position_ok)


def _polygon_ok(rings: Column) -> Column:
    return (F.size(rings) >= 1) & F.forall(rings, lambda r: (F.size(r) >= 4) & F.forall(r, _position_ok) & (r[0] == F.element_at(r, -1)))


def coordinates(geometry: Column, depth: int) -> Column:
    return get(geometry, "$.coordinates", "array<" * (depth + 1) + "double" + ">" * (depth + 1))


def simple_geometry_ok(geometry: Column) -> Column:
    """Structure of a geometry that isn't a collection: known type, numbers only, sizes, closed rings, longitude and latitude in range."""
    schema = F.schema_of_variant(get(geometry, "$.coordinates", "variant"))
    numbers = schema.startswith("ARRAY") & ~schema.rlike("STRING|BOOLEAN|OBJECT|VARIANT|VOID|DATE|TIMESTAMP|BINARY")
    kind = get(geometry, "$.type", "string")
    checks = {
        "Point": _position_ok(coordinates(geometry, 0)),
        "MultiPoint": (F.size(coordinates(geometry, 1)) >= 1) & F.forall(coordinates(geometry, 1), _position_ok),
        "LineString": _line_ok(coordinates(geometry, 1)),
        "MultiLineString": (F.size(coordinates(geometry, 2)) >= 1) & F.forall(coordinates(geometry, 2), _line_ok),
        "Polygon": _polygon_ok(coordinates(geometry, 2)),
        "MultiPolygon": (F.size(coordinates(geometry, 3)) >= 1) & F.forall(coordinates(geometry, 3), _polygon_ok),
    }
    ok = reduce(lambda acc, k: acc.when(kind == k, F.coalesce(checks[k], F.lit(False))), TYPES[1:], F.when(kind == "Point", F.coalesce(checks["Point"], F.lit(False))))
    return F.coalesce(numbers, F.lit(False)) & F.coalesce(ok, F.lit(False))


def bad_geometries(found: DataFrame) -> DataFrame:
    """path, pos of features with a malformed geometry; collections are opened level by level."""
    # written once: every level below asks whether it is the last, and all of them are told together
    level = cut(found.select("path", "pos", get(F.col("feature"), "$.geometry", "variant").alias("g")).where(kind_of(F.col("g")) == "object"))
    bad = []
    while True:
        is_collection = F.coalesce(get(F.col("g"), "$.type", "string") == "GeometryCollection", F.lit(False))
        bad.append(level.where(~is_collection & ~simple_geometry_ok(F.col("g"))).select("path", "pos"))
        inner = level.where(is_collection)
        listed = get(F.col("g"), "$.geometries", "array<variant>")
        bad.append(inner.where(listed.isNull()).select("path", "pos"))
        if inner.isEmpty():
            break
        level = inner.select("path", "pos", F.explode(listed).alias("g"))
    return reduce(DataFrame.unionByName, bad).distinct()


RULES = [
    "NOT_A_FEATURE", "GEOMETRY_MISSING", "GEOMETRY_INVALID", "PROPERTIES_MISSING", "ID_INVALID", "ID_DUPLICATE", "OBJECT_TYPE_MISSING", "RESTRICTION_TYPE_MISSING",
]


def violations(found: DataFrame) -> DataFrame:
    """path, pos, rule: everything that is wrong with features, in the order of RULES within a feature."""
    f = F.col("feature")
    props, ident = get(f, "$.properties", "variant"), get(f, "$.properties.id", "variant")
    text = lambda path: F.coalesce(F.trim(F.when(kind_of(get(f, path, "variant")) == "string", get(f, path, "string"))), F.lit(""))
    checked = found.select(
        "path", "pos", id_text(ident).alias("id_text"),
        F.coalesce(kind_of(f) != "object", F.lit(True)).alias("no_object"), F.coalesce(get(f, "$.type", "string") != "Feature", F.lit(True)).alias("no_feature"),
        F.coalesce(kind_of(get(f, "$.geometry", "variant")) != "object", F.lit(True)).alias("no_geometry"),
        F.coalesce(kind_of(props) != "object", F.lit(True)).alias("no_properties"),
        F.coalesce(~kind_of(ident).isin("string", "number") | (F.trim(id_text(ident)) == ""), F.lit(True)).alias("no_id"),
        (text("$.properties.object_type") == "").alias("no_type"),
        ((text("$.properties.object_type") == "restriction") & (text("$.properties.restriction_type") == "")).alias("no_restriction"),
    )
    again = F.row_number().over(Window.partitionBy("path", "id_text").orderBy("pos")) > 1
    checked = checked.withColumn("again", F.col("id_text").isNotNull() & ~F.col("no_id") & again)
    checked = checked.join(bad_geometries(found).withColumn("bad", F.lit(True)), ["path", "pos"], "left")
    tests = [
        F.col("no_object") | F.col("no_feature"), F.col("no_geometry"), F.coalesce("bad", F.lit(False)), F.col("no_properties"), F.col("no_id"), F.col("again"), F.col("no_type"), F.col("no_restriction"),
    ]
    listed = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(i).alias("n"), F.lit(r).alias("rule"))) for i, (t, r) in enumerate(zip(tests, RULES, strict=True))]))
    return checked.select("path", "pos", F.explode(listed).alias("v")).select("path", "pos", "v.n", "v.rule")


def inspect(docs: DataFrame) -> DataFrame:
    """A row for each file: size, number of objects, counts by type and by kind of restriction, and the first error (null: none).

    The first error is the first violated rule of the first feature that has one, with its number from 1."""
    found = features(docs)
    kinds = found.select("path", get(F.col("feature"), "$.properties.object_type", "string").alias("t"), get(F.col("feature"), "$.properties.restriction_type", "string").alias("r"))
    counts = kinds.groupBy("path", "t", "r").agg(F.count(F.lit(1)).alias("n"))
    entries = lambda rows, name: rows.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    by_type = entries(counts.where("t IS NOT NULL").groupBy("path", F.col("t").alias("k")).agg(F.sum("n").alias("n")), "type_counts")
    by_kind = entries(counts.where("t = 'restriction' AND r IS NOT NULL").groupBy("path", F.col("r").alias("k")).agg(F.sum("n").alias("n")), "restriction_counts")
    total = counts.groupBy("path").agg(F.sum("n").alias("total_objects"))
    first = violations(found).groupBy("path").agg(F.min_by(F.struct("pos", "rule"), F.struct("pos", "n")).alias("e")).select("path", F.concat(F.lit("feature "), (F.col("e.pos") + 1).cast("string"), F.lit(": "), F.col("e.rule")).alias("feature_error"))
    doc = F.col("doc")
    root = (
        F.when(doc.isNull() | (kind_of(doc) != "object"), "NOT_JSON_OBJECT").when(F.coalesce(get(doc, "$.type", "string") != "FeatureCollection", F.lit(True)), "NOT_A_FEATURE_COLLECTION")
        .when(F.coalesce(kind_of(get(doc, "$.features", "variant")) != "array", F.lit(True)), "FEATURES_MISSING")
    )
    out = docs.select("path", "file_size", root.alias("root_error"))
    for part in (total, by_type, by_kind, first):
        out = out.join(part, "path", "left")
    empty = F.create_map().cast("map<string,bigint>")
    return out.select(
        "path", F.col("file_size").alias("file_size_bytes"), F.coalesce("total_objects", F.lit(0)).alias("total_objects"), F.coalesce("type_counts", empty).alias("type_counts"),
        F.coalesce("restriction_counts", empty).alias("restriction_counts"), F.coalesce("root_error", "feature_error").alias("error"),
    )


def _metric(geometry: Column, depth: int) -> Column:
    """JSON of the coordinates in metres; further ordinates than two are dropped."""
    def project(c: Column, left: int) -> Column:
        if left:
            return F.transform(c, lambda x: project(x, left - 1))
        x, y = geo.utm(c[0], c[1])
        return F.array(x, y)

    return F.to_json(project(coordinates(geometry, depth), depth))


def _outside(c: Column, depth: int) -> Column:
    """Whether some position has a latitude that the projection doesn't cover."""
    return F.exists(c, lambda x: _outside(x, depth - 1)) if depth else (c[1] < 0) | (c[1] > 84)


def planning_features(found: DataFrame) -> DataFrame:
    """Rows for plans.planner.plan: typed properties, and coordinates in metres (zone 37 north), a row per feature.

    The first collection level isn't planned with. Latitudes outside 0 to 84 raise, and so do polygons that aren't valid:
    rings that cross or touch themselves, have no area, or holes outside their shell."""
    f = F.col("feature")
    geometry = get(f, "$.geometry", "variant")
    kind = get(geometry, "$.type", "string")
    coords = reduce(lambda acc, k: acc.when(kind == k, _metric(geometry, DEPTH[k])), TYPES[1:], F.when(kind == "Point", _metric(geometry, 0)))
    outside = reduce(lambda acc, k: acc.when(kind == k, _outside(coordinates(geometry, DEPTH[k]), DEPTH[k])), TYPES[1:], F.when(kind == "Point", _outside(coordinates(geometry, 0), 0)))
    guard = F.when(outside, F.raise_error(F.lit("latitude outside the projection"))).otherwise(kind)
    number = lambda path: F.when(kind_of(get(f, path, "variant")) == "number", get(f, path, "double"))
    planned = found.select(
        F.col("path").alias("territory"), id_key(get(f, "$.properties.id", "variant")).alias("id_key"), get(f, "$.properties.object_type", "string").alias("object_type"),
        get(f, "$.properties.restriction_type", "string").alias("restriction_type"), number("$.properties.flow_tph").alias("flow"), number("$.properties.diameter").cast("int").alias("diameter"),
        number("$.properties.width_m").alias("width"), guard.alias("shape"), coords.alias("coords"),
    )
    planned = cut(planned)  # coordinates are read and projected once
    key = ["territory", "id_key"]
    many = F.from_json("coords", "array<array<array<array<double>>>>")
    rings = F.when(F.col("shape") == "Polygon", F.array(F.from_json("coords", "array<array<array<double>>>"))).when(F.col("shape") == "MultiPolygon", many)
    areas = planned.select(*key, rings.alias("rings")).where("rings IS NOT NULL")
    faults = ring_faults(sides(areas, key), key).groupBy(*key).agg(F.min("fault").alias("_fault"))
    told = F.raise_error(F.concat(F.lit("polygon "), "id_key", F.lit(" is not valid: "), "_fault"))
    return planned.join(faults, key, "left").withColumn("shape", F.when(F.col("_fault").isNotNull(), told).otherwise(F.col("shape"))).drop("_fault")


def variant_features(plan: DataFrame) -> DataFrame:
    """territory, variant, feature: JSON of one GeoJSON feature of a planned variant for each row of plan().

    Nulls that the format requires (depths, the summary's geometry) are written; coordinates are degrees with ten decimals."""
    point = F.from_json("coords", "array<double>")
    line = F.from_json("coords", "array<array<double>>")

    def degrees(p: Column) -> Column:
        lon, lat = geo.lonlat(p[0], p[1])
        return F.array(F.round(lon, 10), F.round(lat, 10))

    own_id = lambda c: F.regexp_replace(c, "^[sn]:", "")
    is_pipe, is_summary = F.col("object_type") == "heat_network", F.col("object_type") == "variant_summary"
    common = [F.col("id"), F.col("object_type"), F.concat(F.lit("variant_"), F.col("variant").cast("string")).alias("variant_id")]
    pipe = F.struct(
        *common, own_id("start_node").alias("start_node_id"), own_id("end_node").alias("end_node_id"), F.col("flow").alias("flow_tph"), "diameter", "length", "laying_method", "special_coefficient",
        F.lit(None).cast("double").alias("depth_start"), F.lit(None).cast("double").alias("depth_end"), "cost", F.transform(F.from_json("crossed", "array<string>"), own_id).alias("crossed_obstacle_ids"),
    )
    summary = F.struct(
        *common, F.col("variant").alias("rank"), F.col("cost").alias("construction_cost"), F.col("tie_ins").alias("existing_chamber_tie_in_count"), (F.col("tie_ins") * F.lit(TIE_IN_PRICE)).alias("existing_chamber_tie_in_cost"),
        F.col("penalty").alias("unconnected_penalty"), (F.col("cost") + F.col("penalty")).alias("calculated_cost"), F.col("length").alias("new_network_length"), "score", "description", F.transform(F.from_json("pending", "array<string>"), own_id).alias("unconnected_oks_ids"),
    )
    node = F.struct(*common, "diameter", "cost", own_id("existing_object_id").alias("existing_object_id"))
    write = lambda geometry, properties: F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})
    nothing = F.lit(None).cast("struct<type:string,coordinates:array<double>>")
    feature = (
        F.when(is_pipe, write(F.struct(F.lit("LineString").alias("type"), F.transform(line, degrees).alias("coordinates")), pipe)).when(is_summary, write(nothing, summary))
        .otherwise(write(F.struct(F.lit("Point").alias("type"), degrees(point).alias("coordinates")), node))
    )
    return plan.where("variant > 0").select("territory", "variant", feature.alias("feature"))


def write_variants(plan: DataFrame, path: str) -> None:
    """A file in path for each territory and variant: a FeatureCollection with a description of the variant."""
    said = plan.where("object_type = 'variant_summary' AND variant > 0").select("territory", "variant", "description")
    listed = variant_features(plan).groupBy("territory", "variant").agg(F.sort_array(F.collect_list("feature")).alias("f")).join(said, ["territory", "variant"], "left")
    head = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.lit("VALID").alias("validation_status"), "description"))
    text = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"features":['), F.array_join("f", ","), F.lit("]}"))
    listed.select("territory", "variant", text.alias("value")).write.mode("overwrite").partitionBy("territory", "variant").text(path)
