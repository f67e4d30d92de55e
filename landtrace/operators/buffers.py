"""Buffers as shapes: geodesic circles, boxes that meet, and unions along scan lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtrace.functions.geometry import EARTH_RADIUS
from landtrace.functions.geometry import bucket as bucket_of


def circle(lon: Column, lat: Column, metres: float, corners: int = 64) -> Column:
    """Corners of the geodesic circle around a point, turning left from the north, as ``array<struct<x, y>>``.

    Longitudes run on beyond 180 degrees where the circle crosses the date line, so the ring stays in one piece. A circle that
    holds a pole is not a ring in degrees.
    """
    delta = metres / EARTH_RADIUS
    phi = F.radians(lat)
    points = []
    for k in range(corners):
        theta = 2 * math.pi * k / corners
        sine = F.sin(phi) * math.cos(delta) + F.cos(phi) * (math.sin(delta) * math.cos(theta))
        turn = F.atan2(F.lit(-math.sin(theta) * math.sin(delta)) * F.cos(phi), F.lit(math.cos(delta)) - F.sin(phi) * sine)
        points.append(F.struct((lon + F.degrees(turn)).alias("x"), F.degrees(F.asin(sine)).alias("y")))
    return F.array(*points)


def buffer_rings(points: DataFrame, key: str, metres: float, corners: int = 64) -> DataFrame:
    """A layer of shapes (``poly_id, ring, points``) with a circle of ``metres`` around each point (x, y)."""
    return points.select(F.col(key).alias("poly_id"), F.lit(0).alias("ring"), circle(F.col("x"), F.col("y"), metres, corners).alias("points"))


def boxes_of(rings: DataFrame) -> DataFrame:
    """(poly_id, x_min, x_max, y_min, y_max) of each polygon."""
    sides = []
    for c in "xy":
        values = F.transform("points", (lambda p: p["x"]) if c == "x" else (lambda p: p["y"]))
        sides += [F.min(F.array_min(values)).alias(f"{c}_min"), F.max(F.array_max(values)).alias(f"{c}_max")]
    return rings.groupBy("poly_id").agg(*sides)


def boxes_meeting(a: DataFrame, b: DataFrame, bucket: float, equal: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose boxes (x_min to y_max) share a point, and that agree on the columns ``equal``.

    Boxes meet in the cells of a grid, ``bucket`` wide, that both reach; a pair is reported in one of them, that of the lower left corner
    of what they share. ``b``'s box columns are dropped; its other columns must have other names than ``a``'s.
    """
    sides = ["x_min", "x_max", "y_min", "y_max"]

    def dealt(boxes: DataFrame) -> DataFrame:
        for name, c in (("_bx", "x"), ("_by", "y")):
            boxes = boxes.withColumn(name, F.explode(F.sequence(bucket_of(F.col(f"{c}_min"), bucket), bucket_of(F.col(f"{c}_max"), bucket))))
        return boxes

    def whole(boxes: DataFrame) -> DataFrame:
        return boxes.filter((F.col("x_min") <= F.col("x_max")) & (F.col("y_min") <= F.col("y_max")))

    there = dealt(whole(b)).withColumnsRenamed({s: f"_{s}" for s in sides})
    met = dealt(whole(a)).join(there, ["_bx", "_by", *equal])
    left, low = F.greatest("x_min", "_x_min"), F.greatest("y_min", "_y_min")
    once = (bucket_of(left, bucket) == F.col("_bx")) & (bucket_of(low, bucket) == F.col("_by"))
    share = (left <= F.least("x_max", "_x_max")) & (low <= F.least("y_max", "_y_max"))
    return met.filter(once & share).drop("_bx", "_by", *[f"_{s}" for s in sides])


def scan_spans(edges: DataFrame, step: float) -> DataFrame:
    """(line, poly_id, xa, xb): where polygons hold the lines y = (line + 0.5) * step, by the even-odd rule."""
    y = (F.col("line") + 0.5) * step
    lines = F.sequence(bucket_of(F.least("y1", "y2"), step) - 1, bucket_of(F.greatest("y1", "y2"), step) + 1)
    crossings = edges.withColumn("line", F.explode(lines)).filter((F.col("y1") > y) != (F.col("y2") > y)).select(
        "line", "poly_id", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("xa"))
    along = Window.partitionBy("poly_id", "line").orderBy("xa")
    spans = crossings.withColumns({"_k": F.row_number().over(along), "xb": F.lead("xa").over(along)})
    return spans.filter("_k % 2 = 1").select("line", "poly_id", "xa", "xb")


def union_spans(spans: DataFrame) -> DataFrame:
    """(line, xa, xb): overlapping spans of a line become one; the union of all polygons as a shape of scan lines."""
    along = Window.partitionBy("line").orderBy("xa", "xb")
    reached = F.max("xb").over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", F.coalesce((F.col("xa") > reached).cast("int"), F.lit(1)))
    runs = starts.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("line", "_run").agg(F.min("xa").alias("xa"), F.max("xb").alias("xb")).drop("_run")
