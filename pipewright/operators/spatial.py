"""Range and nearest-neighbour joins over a grid of cells: equi-joins that Spark partitions by cell."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.session import cut, joined


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def range_join(points: DataFrame, px: str, py: str, shapes: DataFrame, extent: tuple[str, str, str, str], radius: float, cell: float | None = None, keys: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Pairs of a point and a shape whose extent (x1, y1, x2, y2, in any order), widened by radius, holds the point.

    A point lies in one cell, so every pair comes once; exact conditions are for the caller to add. keys: columns of
    both sides that have to be equal as well; parts: how many partitions both sides are dealt in (0: as Spark does)."""
    cell = cell or max(radius, 1.0)
    x1, y1, x2, y2 = (F.col(c) for c in extent)
    left = points.withColumns({"_gx": F.floor(F.col(px) / cell), "_gy": F.floor(F.col(py) / cell)})
    right = shapes.withColumn("_gx", _cells(F.least(x1, x2) - radius, F.greatest(x1, x2) + radius, cell))
    right = right.withColumn("_gy", _cells(F.least(y1, y2) - radius, F.greatest(y1, y2) + radius, cell))
    return joined(left, right, [*keys, "_gx", "_gy"], parts).drop("_gx", "_gy")


def in_cells(df: DataFrame, extent: tuple[str, str, str, str], r: float | Column, cell: float) -> DataFrame:
    """A row for each cell (_gx, _gy) that a shape's extent, widened by r, is in."""
    x1, y1, x2, y2 = (F.col(c) for c in extent)
    df = df.withColumn("_gx", _cells(F.least(x1, x2) - r, F.greatest(x1, x2) + r, cell))
    return df.withColumn("_gy", _cells(F.least(y1, y2) - r, F.greatest(y1, y2) + r, cell))


def extent_join(left: DataFrame, a: tuple[str, str, str, str], right: DataFrame, b: tuple[str, str, str, str], radius: float | Column, cell: float, keys: tuple[str, ...] = (), parts: int = 0, placed: bool = False) -> DataFrame:
    """Pairs of shapes (with equal keys) whose extents come within radius (a number, or a column of the right side); each pair once: in the first cell that both are in.

    parts: as for ``range_join``; placed: with that cell (_gx, _gy), by which pairs are dealt."""
    def spread(df: DataFrame, extent: tuple[str, str, str, str], r: float | Column, tag: str) -> DataFrame:
        x1, y1, x2, y2 = (F.col(c) for c in extent)
        low_x, low_y = F.least(x1, x2) - r, F.least(y1, y2) - r
        high_x, high_y = F.greatest(x1, x2) + r, F.greatest(y1, y2) + r
        df = df.withColumns({f"_x{tag}": F.floor(low_x / cell), f"_y{tag}": F.floor(low_y / cell), f"_lx{tag}": low_x, f"_ly{tag}": low_y, f"_hx{tag}": high_x, f"_hy{tag}": high_y})
        return in_cells(df, extent, r, cell)

    pairs = joined(spread(left, a, 0.0, "a"), spread(right, b, radius, "b"), [*keys, "_gx", "_gy"], parts)
    first = (F.col("_gx") == F.greatest("_xa", "_xb")) & (F.col("_gy") == F.greatest("_ya", "_yb"))
    meet = (F.col("_lxa") <= F.col("_hxb")) & (F.col("_lxb") <= F.col("_hxa")) & (F.col("_lya") <= F.col("_hyb")) & (F.col("_lyb") <= F.col("_hya"))
    return pairs.where(first & meet).drop(*([] if placed else ["_gx", "_gy"]), *[f"_{n}{t}" for n in ("x", "y", "lx", "ly", "hx", "hy") for t in "ab"])


def with_lists(pairs: DataFrame, lists: DataFrame, extent: tuple[str, str, str, str], r: float | Column, cell: float, key: str, parts: int) -> DataFrame:
    """pairs of ``extent_join`` (placed, dealt in ``parts``) with the columns of lists(key, extent, ...) of one of their sides.

    Lists go to the cells that pairs were met in, so pairs stay where they are."""
    there = in_cells(lists, extent, r, cell).drop(*extent).repartition(parts, "_gx", "_gy")
    return pairs.join(there.hint("shuffle_hash"), ["_gx", "_gy", key])


def portions_of(spark: SparkSession) -> int:
    """A number of partitions for few rows that make many: Spark doesn't merge partitions of a set number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of keys in a set number of partitions, which Spark doesn't merge: few rows that make many are no small work."""
    return df.repartition(portions_of(df.sparkSession), *keys)


LIST = 512  # entries of one list at most


def listed(df: DataFrame, keys: list[str], number: str, *columns: str) -> DataFrame:
    """keys, _list: rows of equal keys as lists of structs of ``columns``, in the order of a number and at most LIST long, so that none grows with the table.

    Rows are dealt by their keys once; what is dealt by them already stays where it is."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return df.withColumn("_part", F.floor((rank - 1) / LIST)).groupBy(*keys, "_part").agg(F.collect_list(F.struct(*columns)).alias("_list")).drop("_part")


def expanded(points: DataFrame, place: list[str], found: DataFrame, number: str, columns: tuple[str, ...]) -> DataFrame:
    """points joined on ``place`` with found(place, number, columns): what was found for a place, for each point at it.

    A place is searched once, however many points share it; the rows that come out are made last, from lists, and not shuffled."""
    lists = listed(found, place, number, *columns)
    return dealt(points, *place).join(dealt(lists, *place).hint("merge"), place).select(*points.columns, F.inline("_list"))


def nearest(points: DataFrame, key: str, px: str, py: str, shapes: DataFrame, extent: tuple[str, str, str, str], dist: Column, tie: str, k: int) -> DataFrame:
    """The k nearest shapes of each point, with columns dist and rn; exact.

    Rounds of a range join with a growing radius: a point with k shapes within the radius is done.
    The first radius is chosen for the density of shapes, and only open points go to the next round.
    Points at one place share their shapes, so a place is searched once; of shapes with one extent only the first k can be among them."""
    everyone, place, key = points, [px, py], "_place"
    points = points.select(*place).distinct().withColumn(key, F.struct(*place))
    first = Window.partitionBy(*extent).orderBy(tie)
    shapes = cut(shapes.withColumn("_of", F.row_number().over(first)).where(F.col("_of") <= k).drop("_of"))
    together = lambda parts: everyone.join(reduce(DataFrame.unionByName, parts).drop(key), place)
    box = shapes.agg(
        F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{name}{i}") for i, c in enumerate(extent) for name, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    if not box["n"]:
        return range_join(everyone, px, py, shapes, extent, 1.0).withColumns({"dist": dist, "rn": F.lit(1)}).limit(0)
    span = points.agg(F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"), F.max(py).alias("y1")).first()
    xs = [v for v in (span["x0"], span["x1"], *(box[f"{s}{i}"] for s in ("lo", "hi") for i in (0, 2))) if v is not None]
    ys = [v for v in (span["y0"], span["y1"], *(box[f"{s}{i}"] for s in ("lo", "hi") for i in (1, 3))) if v is not None]
    reach = math.hypot(max(xs) - min(xs), max(ys) - min(ys)) + 1.0
    radius = max(1.0, math.sqrt((max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1) * 2 * k / box["n"]))
    enough, open_, done = min(k, box["n"]), points, []
    order = Window.partitionBy(key).orderBy("dist", tie)
    while True:
        last = radius >= reach
        near = range_join(open_, px, py, shapes, extent, radius).withColumn("dist", dist).where(F.col("dist") <= radius)
        ranked = near.withColumns({"rn": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
        solved = cut(ranked.where((F.col("_n") >= enough) & (F.col("rn") <= k)).drop("_n"))
        done.append(solved)
        if last:
            return together(done)
        open_ = cut(open_.join(solved.select(key).distinct(), key, "left_anti"))
        if open_.isEmpty():
            return together(done)
        radius *= 2.5
