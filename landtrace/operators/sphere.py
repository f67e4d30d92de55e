"""Points against polygon layers on the sphere: great-circle edges, nearest polygon, adaptive cells.

Everything is measured in the space around the unit sphere, where a straight line between two points grows with
their great-circle distance. That space is cut into cubes that are halved ``BITS`` times per level, so the
date line and the poles are places like any other. A cell is cut on until it holds few enough items; an item that shares
a smallest cell with too many others gets a part of that cell. So no leaf, whatever the density, has more than
``most`` items, and finding the leaves takes a fixed number of passes over counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtrace.functions.geometry import EARTH_RADIUS
from landtrace.operators.polygons import EDGE, home_polygon
from landtrace.sources.scratch import scratch_path

BITS = 3
LEVELS = 6
DEPTH = BITS * LEVELS
SIDE = 1 << DEPTH  # cells along an axis on the last level
AXES = ("x", "y", "z")


def unit_vector(lon: Column, lat: Column) -> Column:
    """(x, y, z) on the unit sphere."""
    lam, phi = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct(
        (a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"),
        (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def _scaled(a: Column, s: Column) -> Column:
    return F.struct(*[(a[c] * s).alias(c) for c in AXES])


def _sum(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] + b[c]).alias(c) for c in AXES])


def chord(a: Column, b: Column) -> Column:
    """Straight distance of two points of the unit sphere; exact also for close ones."""
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in AXES[1:]), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def metres_of(chord_length: Column) -> Column:
    """Great-circle distance that belongs to a chord."""
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), chord_length / 2))


def arc_pieces(edges: DataFrame, max_arc: float = 1.0) -> DataFrame:
    """``edges`` cut along their great circles into pieces of at most ``max_arc`` degrees.

    Adds ``a``, ``b`` (ends) and ``m`` (middle) as unit vectors and ``r``, half the piece's chord, and sets
    x1 to y2 to the piece's ends. An edge that joins opposite points of the sphere has no great circle; it counts as its ends.
    """
    ends = edges.withColumns({"_a": unit_vector(F.col("x1"), F.col("y1")), "_b": unit_vector(F.col("x2"), F.col("y2"))})
    ends = ends.withColumn("_angle", 2 * F.asin(F.least(F.lit(1.0), chord(F.col("_a"), F.col("_b")) / 2)))
    n = F.greatest(F.lit(1), F.ceil(F.col("_angle") / math.radians(max_arc))).cast("int")
    each = ends.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(part: Column) -> Column:
        t, whole = part / F.col("_n"), F.sin("_angle")
        inner = _sum(
            _scaled(F.col("_a"), F.sin((1 - t) * F.col("_angle")) / whole), _scaled(F.col("_b"), F.sin(t * F.col("_angle")) / whole))
        return F.when(part <= 0, F.col("_a")).when(part >= F.col("_n"), F.col("_b")).when(
            whole < 1e-12, F.when(t < 0.5, F.col("_a")).otherwise(F.col("_b"))).otherwise(inner)

    # a generator's columns are computed once, however often they are used after it
    cut = each.select("*", F.inline(F.array(F.struct(
        at(F.col("_k")).alias("a"), at(F.col("_k") + 1).alias("b"), at(F.col("_k") + 0.5).alias("m")))))
    first, last = F.col("_k") == 0, F.col("_k") + 1 == F.col("_n")
    kept = [c for c in edges.columns if c not in EDGE]
    return cut.select(
        *kept, F.when(first, F.col("x1")).otherwise(F.degrees(F.atan2("a.y", "a.x"))).alias("x1"),
        F.when(first, F.col("y1")).otherwise(F.degrees(F.asin("a.z"))).alias("y1"),
        F.when(last, F.col("x2")).otherwise(F.degrees(F.atan2("b.y", "b.x"))).alias("x2"),
        F.when(last, F.col("y2")).otherwise(F.degrees(F.asin("b.z"))).alias("y2"), "a", "b", "m",
        F.greatest(chord(F.col("a"), F.col("m")), chord(F.col("b"), F.col("m"))).alias("r"))


def arc_chord(p: Column, a: Column, b: Column) -> Column:
    """Chord from a point to the nearest point of the great-circle arc from ``a`` to ``b`` (shorter than a half circle)."""
    n = cross(a, b)
    size = F.sqrt(dot(n, n))
    inside = (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0) & (size > 1e-15)
    sine = F.least(F.lit(1.0), F.abs(dot(n, p)) / size)  # of the angle between the point and the circle's plane
    # the chord of a small angle from its sine, without losing digits
    off = F.sqrt(2 * (1 - F.sqrt(F.greatest(F.lit(0.0), 1 - sine * sine))))
    close = sine / F.sqrt((1 + F.sqrt(F.greatest(F.lit(0.0), 1 - sine * sine))) / 2)
    ends = F.least(chord(p, a), chord(p, b))
    return F.when(inside, F.least(F.when(sine < 0.1, close).otherwise(off), ends)).otherwise(ends)


def _last_cells(v: Column) -> list[Column]:
    """Cell of a unit vector on the last level, by axis."""
    return [F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.floor((v[c] + 1) * (SIDE / 2)))).cast("long") for c in AXES]


def cell_code(level: Column, cell: list[Column]) -> Column:
    """One number for the ancestor, on ``level``, of a cell of the last level."""
    shift = ((F.lit(LEVELS) - level) * BITS).cast("int")
    code = level.cast("long")
    for c in cell:
        code = code * SIDE + F.call_function("shiftright", c, shift)
    return code


def _code_parts(code: Column) -> tuple[Column, list[Column]]:
    axes = [F.shiftright(code, k * DEPTH).bitwiseAND(F.lit(SIDE - 1).cast("long")) for k in (2, 1, 0)]
    return F.shiftright(code, 3 * DEPTH).cast("int"), axes


def leaf_cells(items: DataFrame, v: str, most: int) -> DataFrame:
    """Add ``_leaf`` (its cell's code) and ``_part`` to each item, so that no more than about ``most`` items have the same two.

    ``v`` names the unit vector. Cells are cut on while they hold more than ``most`` items; items of a smallest cell
    are dealt into parts by their hash.
    """
    last = [F.col(f"_{c}") for c in AXES]
    placed = items.withColumns(dict(zip([f"_{c}" for c in AXES], _last_cells(F.col(v)))))
    cells = placed.groupBy(*last).agg(F.count("*").alias("_n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_level")
    codes = cells.select(*last, "_n", levels).withColumn("_code", cell_code(F.col("_level"), last))
    sizes = codes.groupBy("_code").agg(F.sum("_n").alias("_size"))
    fits = (F.col("_size") <= most) | (F.col("_level") == LEVELS)
    leaves = codes.join(sizes, "_code").filter(fits).groupBy(*last).agg(
        F.min(F.struct("_level", "_code", "_size")).alias("_best")).select(
        *last, F.col("_best._code").alias("_leaf"), F.ceil(F.col("_best._size") / most).cast("long").alias("_parts"))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in items.columns]), F.col("_parts")).alias("_part")
    names = [f"_{c}" for c in AXES]
    return placed.join(leaves, names).select(*items.columns, "_leaf", part)


def _towards(leaf: Column, level: int) -> Column:
    """The leaf's ancestor on ``level``, or the leaf itself if it lies higher."""
    own, axes = _code_parts(leaf)
    up = F.greatest(F.lit(0), own - level)
    shift = (up * BITS).cast("int")
    code = F.least(own, F.lit(level)).cast("long")
    for c in axes:
        code = code * SIDE + F.call_function("shiftright", c, shift)
    return code


def _box(code: Column) -> list[tuple[Column, Column]]:
    level, axes = _code_parts(code)
    width = F.pow(F.lit(2.0), F.lit(1) - level * BITS)
    return [(c * width, (c + 1) * width) for c in axes]


def leaf_pairs(points: DataFrame, arcs: DataFrame) -> DataFrame:
    """(_leaf, _there): for each leaf of ``points`` (_leaf) the leaves of ``arcs`` (_leaf, r) that can hold a nearest arc.

    Pairs are refined from the whole space down, level by level. The middle of an arc lies in its cell, so the
    far corner of any cell bounds the distance to the nearest arc; cells whose arcs, reaching out of them by at most the largest
    ``r``, begin beyond the least bound drop out. One small action finds how deep the leaves go.
    """
    here = points.select("_leaf").distinct()
    there = arcs.groupBy("_leaf").agg(F.max("r").alias("r"))
    deepest = here.select("_leaf").unionByName(there.select("_leaf")).agg(F.max(_code_parts(F.col("_leaf"))[0])).first()[0] or 0
    pairs = None
    for level in range(1, max(1, deepest) + 1):
        up, now = (_towards(F.col("_leaf"), k) for k in (level - 1, level))
        p = here.select(up.alias("_p0"), now.alias("_p")).distinct()
        e = there.groupBy(up.alias("_e0"), now.alias("_e")).agg(F.max("r").alias("r"))
        if pairs is None:  # the children of the one cell of level 0, at most 512 on each side
            tried = p.join(e, F.col("_p0") == F.col("_e0")).select("_p", "_e", "r")
        else:
            above = pairs.select(F.col("_p").alias("_p0"), F.col("_e").alias("_e0"))
            tried = above.join(p, "_p0").join(e, "_e0").select("_p", "_e", "r")
        near, far = F.lit(0.0), F.lit(0.0)
        for (a, b), (c, d) in zip(_box(F.col("_p")), _box(F.col("_e"))):
            gap = F.greatest(F.lit(0.0), c - b, a - d)
            reach = F.greatest(d - a, b - c)
            near, far = near + gap * gap, far + reach * reach
        bounded = tried.withColumns({"_near": F.sqrt(near) - F.col("r"), "_far": F.sqrt(far)})
        least = F.min("_far").over(Window.partitionBy("_p"))
        pairs = bounded.withColumn("_least", least).filter(F.col("_near") <= F.col("_least") + 1e-9).select("_p", "_e")
    return pairs.select(F.col("_p").alias("_leaf"), F.col("_e").alias("_there"))


def _written(df: DataFrame, label: str) -> DataFrame:
    """Computed once, in shared scratch space, because every level reads it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_on_sphere(
    points: DataFrame, edges: DataFrame, max_arc: float = 1.0, bucket: float = 1.0, most_points: int = 256, most_arcs: int = 32,
) -> DataFrame:
    """Each distinct point row with its nearest polygon and the great-circle distance in metres (0 inside one).

    ``points`` has x (longitude) and y (latitude) in degrees and any other columns; ``edges`` are great-circle arcs. Inside is told
    by the even-odd rule on pieces of at most ``max_arc`` degrees, straight in degrees; ``bucket`` is the cell width of that
    test. The smallest ``poly_id`` wins a tie. A point with a missing or NaN coordinate has no polygon.
    """
    pieces = arc_pieces(edges, max_arc)
    placed = _written(home_polygon(points.distinct(), pieces.select("poly_id", "ring", *EDGE), bucket), "home")
    known = F.coalesce((F.abs("x") <= 540) & (F.abs("y") <= 90), F.lit(False))
    settled = placed.filter(F.col("_home").isNotNull() | ~known).select(
        *points.columns, F.col("_home").alias("poly_id"), F.when(F.col("_home").isNotNull(), 0.0).alias("distance"))
    free = placed.filter(F.col("_home").isNull() & known).select(*points.columns)
    free = _written(leaf_cells(free.withColumn("_v", unit_vector(F.col("x"), F.col("y"))), "_v", most_points), "points")
    arcs = _written(leaf_cells(pieces.select("poly_id", "a", "b", "m", "r"), "m", most_arcs), "arcs")
    tried = leaf_pairs(free, arcs).join(arcs.select(F.col("_leaf").alias("_there"), "poly_id", "a", "b"), "_there").drop("_there")
    found = free.join(tried, "_leaf", "left")
    off = F.when(F.col("poly_id").isNotNull(), F.struct(arc_chord(F.col("_v"), F.col("a"), F.col("b")).alias("d"), "poly_id"))
    best = found.groupBy("_leaf", *[c for c in free.columns if c not in ("_leaf", "_v")]).agg(F.min(off).alias("_b"))
    return settled.unionByName(best.select(
        *points.columns, F.col("_b.poly_id").alias("poly_id"), metres_of(F.col("_b.d")).alias("distance")))
