"""Overlay of polygon layers with convex cells: shapes and areas, not only membership.

A layer of shapes is a table ``poly_id, ring, points`` with the corners of each ring in order, the first one not
repeated. Holes are rings that lie inside an odd number of the polygon's other rings, whichever way they turn. A ring is clipped by one
half-plane after the other in a fold over its array of corners, so clipping moves no rows; big rings are halved first, so no row that
is dealt to cells holds more than about ``most`` corners. A clipped ring may run along the cell's side where a concave
ring leaves and enters again; its area counts nothing twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.operators.hexgrid import hex_centre
from landtrace.operators.polygons import points_inside

POINTS = "array<struct<x:double,y:double>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _next(points: Column, i: Column) -> Column:
    return F.get(points, (i + 1) % F.size(points))


def half_plane(a: Column | float, b: Column | float, c: Column | float) -> Column:
    """Points with a x + b y <= c."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in ((a, "a"), (b, "b"), (c, "c"))])


def clipped(points: Column, planes: Column) -> Column:
    """What is left of a ring within all half-planes; an empty array if nothing is."""

    def cut(ring: Column, h: Column) -> Column:
        sided = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (h["a"] * p["x"] + h["b"] * p["y"] - h["c"]).alias("d")))

        def corner(p: Column, q: Column) -> Column:
            t = p["d"] / (p["d"] - q["d"])
            met = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
            own = F.struct(p["x"].alias("x"), p["y"].alias("y"))
            stays, crosses = p["d"] <= 0, (p["d"] <= 0) != (q["d"] <= 0)
            return F.when(stays & crosses, F.array(own, met)).when(stays, F.array(own)).when(crosses, F.array(met)).otherwise(
                F.array().cast(POINTS))

        return _let(sided, lambda s: F.flatten(F.transform(s, lambda p, i: corner(p, _next(s, i)))))

    return F.aggregate(planes, points.cast(POINTS), cut)


def signed_area(points: Column) -> Column:
    """Shoelace area, positive if the ring turns left; corners are taken from the first one, which keeps digits."""

    def turn(p: Column, i: Column) -> Column:
        o, q = F.get(points, F.lit(0)), _next(points, i)
        return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])

    return F.aggregate(F.transform(points, turn), F.lit(0.0), lambda s, v: s + v) / 2


def ring_edges(rings: DataFrame) -> DataFrame:
    """The layer as directed edges ``poly_id, ring, x1, y1, x2, y2``."""
    pairs = F.transform("points", lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), _next(F.col("points"), i)["x"].alias("x2"), _next(F.col("points"), i)["y"].alias("y2")))
    return rings.select("poly_id", "ring", F.inline(pairs))


def mark_holes(rings: DataFrame, bucket: float = 1.0) -> DataFrame:
    """``rings`` with ``hole``: whether the ring lies inside an odd number of its polygon's other rings.

    Rings of a polygon don't cross, so one corner of each is enough; it is looked up in the grid index of all rings.
    """
    ids = F.struct("poly_id", "ring")
    edges = ring_edges(rings).select(ids.alias("poly_id"), "x1", "y1", "x2", "y2")
    corners = rings.filter(F.size("points") > 0).select(
        ids.alias("_own"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    around = points_inside(corners, edges, bucket).filter(
        (F.col("poly_id.poly_id") == F.col("_own.poly_id")) & (F.col("poly_id.ring") != F.col("_own.ring")))
    depth = around.groupBy(F.col("_own.poly_id").alias("poly_id"), F.col("_own.ring").alias("ring")).agg(F.count("*").alias("_depth"))
    return rings.join(depth, ["poly_id", "ring"], "left").withColumn("hole", F.coalesce(F.col("_depth") % 2 == 1, F.lit(False))).drop("_depth")


def _spans(points: Column) -> list[Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]


def halved(rings: DataFrame, most: int = 256) -> DataFrame:
    """Rings in pieces of about ``most`` corners or fewer, cut at the middle corner along the wider side.

    The pieces' areas add up to the ring's. One small aggregate finds the largest ring and with it the number of passes; no
    pass moves rows.
    """
    largest = rings.agg(F.max(F.size("points"))).first()[0] or 0
    passes = math.ceil(math.log2(largest / most)) + 3 if largest > most else 0  # cuts add corners, so a few more
    for _ in range(passes):
        left, right, low, high = _spans(F.col("points"))
        wide = (right - left) >= (high - low)
        places = F.when(wide, F.transform("points", lambda p: p["x"])).otherwise(F.transform("points", lambda p: p["y"]))
        start, end = (F.when(wide, a).otherwise(b) for a, b in ((left, low), (right, high)))
        middle = F.get(F.array_sort(places), F.floor(F.size("points") / 2).cast("int"))
        # corners that an earlier cut put on the ring's own edge divide nothing
        middle = F.when((middle > start) & (middle < end), middle).otherwise((start + end) / 2)
        split = rings.withColumns({"_wide": wide, "_at": middle})
        along = [F.when(F.col("_wide"), F.lit(1.0)).otherwise(F.lit(0.0)), F.when(F.col("_wide"), F.lit(0.0)).otherwise(F.lit(1.0))]
        sides = [clipped(F.col("points"), F.array(half_plane(s * along[0], s * along[1], s * F.col("_at")))) for s in (1, -1)]
        both = F.when(F.size("points") > most, F.array(*sides)).otherwise(F.array(F.col("points").cast(POINTS)))
        rings = split.withColumn("points", F.explode(both)).drop("_wide", "_at").filter(F.size("points") >= 3)
    return rings


def _range(low: Column, high: Column) -> Column:
    return F.sequence(F.ceil(low).cast("long"), F.floor(high).cast("long"))


def hexagon_planes(q: Column, r: Column, size: float, origin: tuple[float, float]) -> Column:
    """The six sides of a hexagon ``size`` wide."""
    cx, cy = hex_centre(q, r, size)
    planes = []
    for k in range(6):
        a, b = math.cos(math.radians(60 * k)), math.sin(math.radians(60 * k))
        planes.append(half_plane(a, b, a * (cx + origin[0]) + b * (cy + origin[1]) + size / 2))
    return F.array(*planes)


def clip_to_hexagons(rings: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0), most: int = 256) -> DataFrame:
    """(hex_q, hex_r, and the columns of ``rings``) with ``points`` cut to each hexagon that the ring reaches.

    A ring that was halved comes in pieces; sums over them are those of the whole.
    """
    pieces = halved(rings, most)
    side = size / math.sqrt(3)
    left, right, low, high = _spans(F.col("points"))
    boxed = pieces.withColumns({"_l": left - origin[0], "_h": right - origin[0], "_b": low - origin[1], "_t": high - origin[1]})
    rows = boxed.withColumn("hex_r", F.explode(_range(
        F.col("_b") / (1.5 * side) - 0.7, F.col("_t") / (1.5 * side) + 0.7)))  # a hexagon reaches 2/3 of a row up and down
    shift = F.col("hex_r") / 2
    cells = rows.withColumn("hex_q", F.explode(_range(F.col("_l") / size - shift - 0.51, F.col("_h") / size - shift + 0.51)))
    cut = clipped(F.col("points"), hexagon_planes(F.col("hex_q"), F.col("hex_r"), size, origin))
    return cells.withColumn("points", cut).filter(F.size("points") >= 3).drop("_l", "_h", "_b", "_t")


def clip_to_tiles(rings: DataFrame, width: float, origin: tuple[float, float] = (0.0, 0.0), most: int = 256) -> DataFrame:
    """(tile_x, tile_y, and the columns of ``rings``) with ``points`` cut to each square of a grid that the ring reaches."""
    pieces = halved(rings, most)
    left, right, low, high = _spans(F.col("points"))

    def number(v: Column, start: float) -> Column:
        return F.floor((v - start) / width).cast("long")

    cells = pieces.withColumn("tile_x", F.explode(F.sequence(number(left, origin[0]), number(right, origin[0]))))
    cells = cells.withColumn("tile_y", F.explode(F.sequence(number(low, origin[1]), number(high, origin[1]))))
    x, y = origin[0] + F.col("tile_x") * width, origin[1] + F.col("tile_y") * width
    planes = F.array(half_plane(-1, 0, -x), half_plane(1, 0, x + width), half_plane(0, -1, -y), half_plane(0, 1, y + width))
    return cells.withColumn("points", clipped(F.col("points"), planes)).filter(F.size("points") >= 3)


def clipped_areas(parts: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Area of each polygon in each cell: that of its outer rings less that of its holes (``parts`` with ``hole``)."""
    area = F.abs(signed_area(F.col("points"))) * F.when(F.col("hole"), -1.0).otherwise(1.0)
    return parts.groupBy(*cell, "poly_id").agg(F.sum(area).alias("area"), F.count("*").alias("n_rings")).filter(F.col("area") > 0)
