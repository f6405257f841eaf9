"""Planar geometry on coordinate columns, in metres; everything stays in JVM expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-4


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share (0 to 1) of a segment at which it comes nearest to a point; 0 for a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / F.when(square > 0, square)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = along(px, py, x1, y1, x2, y2)
    return distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle: on which side of a-b the point c is."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross properly: the ends of each lie on both sides of the other."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def segment_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    ends = F.least(
        point_segment_distance(a[0], a[1], *b), point_segment_distance(a[2], a[3], *b), point_segment_distance(b[0], b[1], *a), point_segment_distance(b[2], b[3], *a)
    )
    return F.when(crosses(a, b), 0.0).otherwise(ends)


def meeting(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shares of the segment a (x1, y1, x2, y2) at which it meets b: none, one, or both ends of an overlap; an array."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    ux, uy, vx, vy, wx, wy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    cross, square = ux * vy - uy * vx, ux * ux + uy * uy
    slant = F.abs(cross) > 1e-9 * F.sqrt(square) * F.sqrt(vx * vx + vy * vy)
    t, s = (wx * vy - wy * vx) / F.when(slant, cross), (wx * uy - wy * ux) / F.when(slant, cross)
    hit = t.between(-1e-9, 1 + 1e-9) & s.between(-1e-9, 1 + 1e-9)
    share = lambda x, y: ((x - ax) * ux + (y - ay) * uy) / F.when(square > 0, square)
    low = F.greatest(F.lit(0.0), F.least(share(cx, cy), share(dx, dy)))
    high = F.least(F.lit(1.0), F.greatest(share(cx, cy), share(dx, dy)))
    along_it = (F.abs(wx * uy - wy * ux) <= 1e-7 * F.sqrt(square)) & (square > 0) & (high >= low - 1e-9)
    none = F.array().cast("array<double>")
    parallel = F.when(along_it, F.when(high - low > 1e-9, F.array(low, high)).otherwise(F.array(low))).otherwise(none)
    return F.when(slant, F.when(hit, F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))).otherwise(none)).otherwise(parallel)


def with_near_span(df: DataFrame, low: str, high: str, a: tuple[str, ...], b: tuple[str, ...], r: Column) -> DataFrame:
    """df with the shares between which the segment a is within r of the segment b; nulls if it never is.

    What is near a segment is convex, so it is one span: that of the discs at b's ends and of the band between them.
    It is made column by column, so that what several terms share is computed once for a row."""
    ax, ay, bx, by = map(F.col, a)
    cx, cy, dx, dy = map(F.col, b)
    ux, uy, vx, vy, square, n, reach = map(F.col, ("_ux", "_uy", "_vx", "_vy", "_square", "_n", "_r"))
    keep = [c for c in df.columns if c not in (low, high)]
    df = df.withColumns({"_ux": bx - ax, "_uy": by - ay, "_vx": dx - cx, "_vy": dy - cy, "_r": r}).withColumns({"_square": ux * ux + uy * uy, "_n": F.sqrt(vx * vx + vy * vy)})
    ends = (("1", cx, cy), ("2", dx, dy))
    df = df.withColumns({f"_h{i}": ux * (ax - qx) + uy * (ay - qy) for i, qx, qy in ends} | {f"_w{i}": (ax - qx) * (ax - qx) + (ay - qy) * (ay - qy) - reach * reach for i, qx, qy in ends})
    rest = lambda i: F.col(f"_h{i}") * F.col(f"_h{i}") - square * F.col(f"_w{i}")
    df = df.withColumns({f"_q{i}": F.sqrt(F.when((rest(i) >= 0) & (square > 0), rest(i))) for i in "12"})
    # along the segment from 0 to n, and across it from -r to r
    df = df.withColumns({"_s1": ((ax - cx) * vx + (ay - cy) * vy) / n, "_d1": (ux * vx + uy * vy) / n, "_s2": ((ay - cy) * vx - (ax - cx) * vy) / n, "_d2": (uy * vx - ux * vy) / n})
    bounds = {"1": (F.lit(0.0), n), "2": (-reach, reach)}
    step = lambda i: F.when(F.abs(F.col(f"_d{i}")) > 1e-12, F.col(f"_d{i}"))
    df = df.withColumns({f"_{k}{i}": (bounds[i][j] - F.col(f"_s{i}")) / step(i) for i in "12" for j, k in enumerate("xy")})
    always = lambda i: F.col(f"_s{i}").between(*bounds[i])
    df = df.withColumns(
        {f"_b{i}": F.coalesce(F.least(f"_x{i}", f"_y{i}"), F.when(always(i), float("-inf")).otherwise(2.0)) for i in "12"}
        | {f"_e{i}": F.coalesce(F.greatest(f"_x{i}", f"_y{i}"), F.when(always(i), float("inf")).otherwise(-1.0)) for i in "12"}
    )
    df = df.withColumns({"_b": F.greatest("_b1", "_b2"), "_e": F.least("_e1", "_e2")})
    df = df.withColumn("_band", (n > 0) & (F.col("_b") <= F.col("_e")))
    out = {f"_{k}": f(*((sign * F.col(f"_q{i}") - F.col(f"_h{i}")) / square for i in "12"), F.when(F.col("_band"), F.col(end))) for k, f, sign, end in (("low", F.least, -1, "_b"), ("high", F.greatest, 1, "_e"))}
    df = df.withColumns(out)
    some = (F.col("_high") > 0) & (F.col("_low") < 1)
    return df.select(*keep, F.when(some, F.greatest(F.col("_low"), F.lit(0.0))).alias(low), F.when(some, F.least(F.col("_high"), F.lit(1.0))).alias(high))


def with_box_distance(df: DataFrame, name: str, a: tuple[str, ...], box: tuple[str, ...]) -> DataFrame:
    """df with the distance of a segment and an axis-parallel box (x1, y1, x2, y2), 0 if they meet.

    It is made column by column, so that what several terms share is computed once for a row. They meet
    unless x, y or the segment's normal separates them."""
    ax, ay, bx, by = map(F.col, a)
    x1, y1, x2, y2 = map(F.col, box)
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    dx, dy, square = F.col("_dx"), F.col("_dy"), F.col("_square")
    keep = [c for c in df.columns if c != name]
    df = df.withColumns({"_dx": bx - ax, "_dy": by - ay}).withColumn("_square", F.greatest(dx * dx + dy * dy, F.lit(1e-300)))
    along_it = lambda x, y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square))
    df = df.withColumns({f"_t{i}": along_it(x, y) for i, (x, y) in enumerate(corners)} | {f"_s{i}": dx * (y - ay) - dy * (x - ax) for i, (x, y) in enumerate(corners)})
    df = df.withColumns({f"_u{i}": x - ax - F.col(f"_t{i}") * dx for i, (x, _) in enumerate(corners)} | {f"_v{i}": y - ay - F.col(f"_t{i}") * dy for i, (_, y) in enumerate(corners)})
    gap = lambda v, low, high: F.greatest(low - v, F.lit(0.0), v - high)
    df = df.withColumns({"_u4": gap(ax, x1, x2), "_v4": gap(ay, y1, y2), "_u5": gap(bx, x1, x2), "_v5": gap(by, y1, y2)})
    least = F.least(*(F.col(f"_u{i}") * F.col(f"_u{i}") + F.col(f"_v{i}") * F.col(f"_v{i}") for i in range(6)))
    sides = [F.col(f"_s{i}") for i in range(4)]
    over = (F.least(ax, bx) <= x2) & (F.greatest(ax, bx) >= x1) & (F.least(ay, by) <= y2) & (F.greatest(ay, by) >= y1)
    df = df.withColumns({"_least": least, "_meet": over & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)})
    return df.select(*keep, F.when(F.col("_meet"), 0.0).otherwise(F.sqrt("_least")).alias(name))


def with_segment_distance(df: DataFrame, name: str, a: tuple[str, ...], b: tuple[str, ...]) -> DataFrame:
    """df with the distance of two segments, 0 if they cross; made column by column, so that what terms share is computed once for a row."""
    ax, ay, bx, by = map(F.col, a)
    cx, cy, dx, dy = map(F.col, b)
    keep = [c for c in df.columns if c != name]
    ux, uy, vx, vy, wx, wy, zx, zy, uu, vv = map(F.col, ("_ux", "_uy", "_vx", "_vy", "_wx", "_wy", "_zx", "_zy", "_uu", "_vv"))
    # w: from a to c, z: from b to d
    df = df.withColumns({"_ux": bx - ax, "_uy": by - ay, "_vx": dx - cx, "_vy": dy - cy, "_wx": cx - ax, "_wy": cy - ay, "_zx": dx - bx, "_zy": dy - by})
    df = df.withColumns({"_uu": F.greatest(ux * ux + uy * uy, F.lit(1e-300)), "_vv": F.greatest(vx * vx + vy * vy, F.lit(1e-300))})
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    df = df.withColumns({
        "_t0": share((wx * ux + wy * uy) / uu), "_t1": share(((dx - ax) * ux + (dy - ay) * uy) / uu), "_t2": share(-(wx * vx + wy * vy) / vv), "_t3": share(((bx - cx) * vx + (by - cy) * vy) / vv),
        "_s0": ux * wy - uy * wx, "_s1": ux * (dy - ay) - uy * (dx - ax), "_s2": vy * wx - vx * wy, "_s3": vx * (by - cy) - vy * (bx - cx),
    })
    t = [F.col(f"_t{i}") for i in range(4)]
    df = df.withColumns({
        "_x0": wx - t[0] * ux, "_y0": wy - t[0] * uy, "_x1": dx - ax - t[1] * ux, "_y1": dy - ay - t[1] * uy,
        "_x2": -wx - t[2] * vx, "_y2": -wy - t[2] * vy, "_x3": bx - cx - t[3] * vx, "_y3": by - cy - t[3] * vy,
    })
    least = F.least(*(F.col(f"_x{i}") * F.col(f"_x{i}") + F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(4)))
    crossed = (F.col("_s0") * F.col("_s1") < 0) & (F.col("_s2") * F.col("_s3") < 0)
    return df.select(*keep, F.when(crossed, 0.0).otherwise(F.sqrt(least)).alias(name))


def point_box_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx = F.greatest(x1 - px, F.lit(0.0), px - x2)
    dy = F.greatest(y1 - py, F.lit(0.0), py - y2)
    return F.sqrt(dx * dx + dy * dy)


def millimetre_key(x: Column, y: Column) -> Column:
    """Key of a point rounded to millimetres, halves upwards."""
    whole = lambda v: F.floor(v * 1000 + 0.5).cast("bigint").cast("string")
    return F.concat(whole(x), F.lit(":"), whole(y))


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees by which the way a-b-c turns at b; 0 where a leg has no length."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    lengths = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cos = (ux * vx + uy * vy) / F.when(lengths > 0, lengths)
    return F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), F.lit(0.0))


def clip(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Shares (enter, leave) of a segment inside a box, by parametric clipping; enter > leave if it stays outside."""
    left, low, right, high = map(F.lit, box)
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for start, step, least, most in ((x1, x2 - x1, left, right), (y1, y2 - y1, low, high)):
        a, b = (least - start) / F.when(step != 0, step), (most - start) / F.when(step != 0, step)
        outside = (step == 0) & ((start < least) | (start > most))
        enter.append(F.when(outside, 2.0).otherwise(F.coalesce(F.least(a, b), F.lit(0.0))))
        leave.append(F.coalesce(F.greatest(a, b), F.lit(1.0)))
    return F.greatest(*enter), F.least(*leave)


# Transverse Mercator by the Krueger series on WGS84, zone 37 north.
A, INVERSE_FLATTENING, K0, LON0, EAST0 = 6378137.0, 298.257223563, 0.9996, 39.0, 500000.0


def _series() -> tuple[float, list[float], list[float], float]:
    f = 1 / INVERSE_FLATTENING
    n = f / (2 - f)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, alpha, beta, math.sqrt(f * (2 - f))


RADIUS, ALPHA, BETA, ECCENTRICITY = _series()


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in m of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + K0 * RADIUS * x, K0 * RADIUS * y


def lonlat(x: Column, y: Column, rounds: int = 4) -> tuple[Column, Column]:
    """Degrees of easting and northing."""
    xi, eta = y / (K0 * RADIUS), (x - EAST0) / (K0 * RADIUS)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    lam = F.atan2(F.sinh(q), F.cos(p))
    s = F.sin(p) / F.cosh(q)
    # isometric latitude to latitude by fixed-point rounds
    psi, phi_sin = F.atanh(s), s
    for _ in range(rounds):
        phi_sin = F.tanh(psi + F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * phi_sin))
    return LON0 + F.degrees(lam), F.degrees(F.asin(phi_sin))
