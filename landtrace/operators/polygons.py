"""Points against polygon layers, on a square grid of ``bucket`` wide cells.

A layer is a table of directed edges ``poly_id, ring, x1, y1, x2, y2``. It is indexed by
grid cell once; points then meet their cell's entry in one equi-join and everything else
happens inside the joined row. If the index is small Spark broadcasts it and points are
never shuffled; a crowded cell is split by the adaptive skew join. Layers are administrative
maps of fixed size, and ``bucket`` sets how many of their edges share a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtrace.functions.geometry import bucket as bucket_of
from landtrace.functions.geometry import great_circle

EDGE = ["x1", "y1", "x2", "y2"]
BRANCH = 32
NOWHERE = -(2**62)


def _between(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def edge_cells(edges: DataFrame, bucket: float) -> DataFrame:
    """Every grid cell an edge passes through: by columns, then the rows within a column."""
    slop = bucket * 1e-9
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    cols = edges.withColumn("bx", _between(bucket_of(left - slop, bucket), bucket_of(right + slop, bucket)))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))

    def height(x: Column) -> Column:
        at = F.col("y1") + (F.least(F.greatest(x, left), right) - F.col("x1")) * slope
        return F.least(F.greatest(at, low), high)

    a, b = height(F.col("bx") * bucket - slop), height((F.col("bx") + 1) * bucket + slop)
    steep = F.col("x1") == F.col("x2")
    bottom = F.when(steep, low).otherwise(F.least(a, b))
    top = F.when(steep, high).otherwise(F.greatest(a, b))
    return cols.withColumn("by", _between(bucket_of(bottom - slop, bucket), bucket_of(top + slop, bucket)))


def centre_cells(edges: DataFrame, bucket: float) -> DataFrame:
    """Cells whose centre is inside a polygon, filled between scan-line crossings."""
    y = (F.col("by") + 0.5) * bucket
    crossings = edges.withColumn(
        "by",
        _between(bucket_of(F.least("y1", "y2"), bucket) - 1, bucket_of(F.greatest("y1", "y2"), bucket) + 1),
    ).filter((F.col("y1") > y) != (F.col("y2") > y)).select(
        "poly_id", "by",
        (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("xa"),
    )
    line = Window.partitionBy("poly_id", "by").orderBy("xa")
    spans = crossings.withColumns({"k": F.row_number().over(line), "xb": F.lead("xa").over(line)})
    x = (F.col("bx") + 0.5) * bucket
    return (
        spans.filter("k % 2 = 1")
        .withColumn("bx", _between(bucket_of(F.col("xa"), bucket) - 1, bucket_of(F.col("xb"), bucket) + 1))
        .filter((x >= F.col("xa")) & (x < F.col("xb")))
        .select("bx", "by", "poly_id")
    )


def polygon_index(edges: DataFrame, bucket: float) -> DataFrame:
    """Per grid cell the polygons reaching it, each with its state at the cell centre and
    the edges inside the cell."""
    crossed = edge_cells(edges, bucket).select(
        "bx", "by", "poly_id", F.lit(0).alias("centre"), F.struct(*EDGE).alias("edge")
    )
    filled = centre_cells(edges, bucket).select("bx", "by", "poly_id", F.lit(1).alias("centre"))
    entry = F.struct("poly_id", "centre", "edges")
    return (
        crossed.unionByName(filled, allowMissingColumns=True)
        .groupBy("bx", "by", "poly_id")
        .agg(F.max("centre").alias("centre"), F.collect_list("edge").alias("edges"))
        .groupBy("bx", "by").agg(F.collect_list(entry).alias("polys"))
    )


def _holding(polys: Column, x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Ids of the polygons holding (x, y): the state at the cell centre, flipped for every
    edge met going along the row to the centre column and along that to the centre."""

    def flips(edge: Column) -> Column:
        x1, y1, x2, y2 = (edge[c] for c in EDGE)
        at_y = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        at_x = y1 + (cx - x1) * (y2 - y1) / (x2 - x1)
        along_row = F.when((y1 > y) != (y2 > y), (at_y > x) != (at_y > cx)).otherwise(False)
        along_col = F.when((x1 > cx) != (x2 > cx), (at_x > y) != (at_x > cy)).otherwise(False)
        return along_row != along_col

    inside = F.filter(polys, lambda p: (p.centre + F.size(F.filter(p.edges, flips))) % 2 == 1)
    return F.transform(inside, lambda p: p.poly_id)


def _in_cell(points: DataFrame, bucket: float) -> DataFrame:
    """Add the cell of each point; a missing coordinate gets a cell that no edge reaches.

    Never being NULL, the join keys need no ``IS NOT NULL`` filter. Spark would push that,
    with the whole computation of the coordinates, down to the scan of the source.
    """
    return points.withColumns({
        b: F.coalesce(bucket_of(F.col(c), bucket), F.lit(NOWHERE)) for b, c in (("bx", "x"), ("by", "y"))
    })


def _found(bucket: float) -> Column:
    cx, cy = (F.col("bx") + 0.5) * bucket, (F.col("by") + 0.5) * bucket
    return _holding(F.col("polys"), F.col("x"), F.col("y"), cx, cy)


def points_inside(points: DataFrame, edges: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Points with ``poly_id`` of every polygon they lie in (even-odd rule, holes included)."""
    found = _in_cell(points, bucket).join(polygon_index(edges, bucket), ["bx", "by"])
    return found.select(*points.columns, F.explode(_found(bucket)).alias("poly_id"))


def _parents(cells: DataFrame, x: str, y: str, level: int) -> list[Column]:
    """The cell's ancestor ``level`` levels up."""
    return [F.floor(F.col(c) / BRANCH**level).alias(c) for c in (x, y)]


def nearest_cells(cells: DataFrame, occupied: DataFrame, bucket: float, extent: float) -> DataFrame:
    """For each of ``cells`` (bx, by) the ``occupied`` cells (ex, ey) that can hold a point's nearest edge.

    Pairs of cells are refined from the four quadrants down. No point of a cell is farther from
    the nearest edge than the far corner of any occupied cell, so occupied cells that begin
    beyond the least such distance drop out, and nothing is lost. Each level reads the one
    above it once; cells, not edges, are compared, so no key gathers the edges of a large area.
    """
    levels = max(1, math.ceil(math.log(extent / bucket, BRANCH) + 1e-9))
    quadrants = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ex"), F.lit(j).cast("bigint").alias("ey")) for i in (-1, 0) for j in (-1, 0)])
    pairs = cells.select(*_parents(cells, "bx", "by", levels)).distinct().select("bx", "by", F.inline(quadrants))
    pairs = pairs.select("bx", "by", "ex", "ey").join(
        occupied.select(*_parents(occupied, "ex", "ey", levels)).distinct(), ["ex", "ey"], "left_semi")
    for level in reversed(range(levels)):
        here = cells.select(*_parents(cells, "bx", "by", level))
        there = occupied.select(*_parents(occupied, "ex", "ey", level))
        if level:
            here, there = here.distinct(), there.distinct()
        here = here.select("bx", "by", *[F.floor(F.col(c) / BRANCH).alias(f"p{c}") for c in ("bx", "by")])
        there = there.select("ex", "ey", *[F.floor(F.col(c) / BRANCH).alias(f"p{c}") for c in ("ex", "ey")])
        up = pairs.select(*[F.col(c).alias(f"p{c}") for c in ("bx", "by", "ex", "ey")])
        tried = up.join(here, ["pbx", "pby"]).join(there, ["pex", "pey"]).select("bx", "by", "ex", "ey")
        dx, dy = F.abs(F.col("bx") - F.col("ex")), F.abs(F.col("by") - F.col("ey"))
        near, far = [F.greatest(d - 1, F.lit(0)) for d in (dx, dy)], [d + 1 for d in (dx, dy)]
        bound = F.min(far[0] * far[0] + far[1] * far[1]).over(Window.partitionBy("bx", "by"))
        pairs = tried.withColumns({"_near": near[0] * near[0] + near[1] * near[1], "_far": bound}).filter(
            "_near <= _far").select("bx", "by", "ex", "ey")
    return pairs


def nearest_edges(cells: DataFrame, edges: DataFrame, bucket: float, extent: float) -> DataFrame:
    """Per cell (bx, by) all edges that can be the nearest one of some point in the cell, as ``near``."""
    known = F.greatest(*[F.abs(c) for c in EDGE]) <= extent
    edges = edges.filter(known | F.assert_true(known, F.lit("edge outside extent")).isNull())
    inside = edge_cells(edges, bucket).select(F.col("bx").alias("ex"), F.col("by").alias("ey"), "poly_id", *EDGE)
    pairs = nearest_cells(cells, inside.select("ex", "ey").distinct(), bucket, extent)
    run, rise = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    edge = F.struct(
        "poly_id", "x1", "y1", run.alias("run"), rise.alias("rise"), (run * run + rise * rise).alias("size")
    )
    return pairs.join(inside, ["ex", "ey"]).groupBy("bx", "by").agg(F.collect_set(edge).alias("near"))


def home_polygon(points: DataFrame, edges: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Each point once with its cell and ``_home``, the smallest ``poly_id`` that it lies in (NULL outside all)."""
    at_home = F.array_min(_found(bucket))
    placed = _in_cell(points, bucket).join(polygon_index(edges, bucket), ["bx", "by"], "left")
    return placed.select("bx", "by", *points.columns, at_home.alias("_home"))


def nearest_polygon(points: DataFrame, edges: DataFrame, bucket: float = 1.0, extent: float = 180.0) -> DataFrame:
    """Each point once, with its nearest polygon and the distance (0 inside one).

    Points inside a polygon are settled first; edges are searched only around the cells of the
    others. The smallest ``poly_id`` wins a tie. ``extent`` bounds the coordinates of the layer
    (180 for degrees); an edge beyond it is an error.
    """
    placed = home_polygon(points, edges, bucket)
    outside = F.col("_home").isNull() & (F.col("bx") != NOWHERE) & (F.col("by") != NOWHERE)
    cells = placed.filter(outside).select("bx", "by").distinct()
    found = placed.join(nearest_edges(cells, edges, bucket, extent), ["bx", "by"], "left")
    x, y = F.col("x"), F.col("y")
    along = F.transform("near", lambda e: F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(
            (x - e.x1) * e.run + (y - e.y1) * e.rise, e["size"]))).alias("t"), e.alias("e"),
    ))
    off = F.transform(along, lambda a: F.struct(
        (x - (a.e.x1 + a.t * a.e.run)).alias("x"), (y - (a.e.y1 + a.t * a.e.rise)).alias("y"), a.e.poly_id.alias("poly_id"),
    ))
    ranked = F.transform(off, lambda o: F.struct((o.x * o.x + o.y * o.y).alias("d"), o.poly_id.alias("poly_id")))
    home = F.struct(F.lit(0.0).alias("d"), F.col("_home").alias("poly_id"))
    best = F.when(F.col("_home").isNotNull(), home).otherwise(F.array_min(ranked))
    return found.select(*points.columns, best.alias("_b")).select(
        *points.columns, F.col("_b.poly_id").alias("poly_id"), F.sqrt("_b.d").alias("distance")
    )


def polygons_touching(a: DataFrame, b: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Pairs (``poly_id``, ``other_id``) of the two layers that share at least a point."""
    ours = edge_cells(a, bucket).select("bx", "by", "poly_id", *EDGE)
    theirs = edge_cells(b, bucket).select(
        "bx", "by", F.col("poly_id").alias("other_id"), *[F.col(c).alias(f"o{c}") for c in EDGE]
    )

    def side(ax, ay, bx, by, px, py) -> Column:
        turn = (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))
        return F.signum(turn)

    boxes = (
        (F.least("x1", "x2") <= F.greatest("ox1", "ox2")) & (F.least("ox1", "ox2") <= F.greatest("x1", "x2"))
        & (F.least("y1", "y2") <= F.greatest("oy1", "oy2")) & (F.least("oy1", "oy2") <= F.greatest("y1", "y2"))
    )
    cross = (
        (side("x1", "y1", "x2", "y2", "ox1", "oy1") * side("x1", "y1", "x2", "y2", "ox2", "oy2") <= 0)
        & (side("ox1", "oy1", "ox2", "oy2", "x1", "y1") * side("ox1", "oy1", "ox2", "oy2", "x2", "y2") <= 0)
    )
    crossing = ours.join(theirs, ["bx", "by"]).filter(boxes & cross).select("poly_id", "other_id")

    def corners(layer: DataFrame, name: str) -> DataFrame:
        corner = F.min(F.struct("x1", "y1")).alias("c")
        return layer.groupBy(F.col("poly_id").alias(name), "ring").agg(corner).select(
            name, F.col("c.x1").alias("x"), F.col("c.y1").alias("y")
        )

    ours_in = points_inside(corners(a, "own"), b, bucket).select(
        F.col("own").alias("poly_id"), F.col("poly_id").alias("other_id"))
    theirs_in = points_inside(corners(b, "other_id"), a, bucket).select("poly_id", "other_id")
    return crossing.unionByName(ours_in).unionByName(theirs_in).distinct()


def within_distance(df: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """Rows of ``df`` (x = lon, y = lat) within ``metres`` of a row of ``centres``.

    Both sides carry a latitude band and a longitude step fixed by the band. A row of
    ``df`` has one such bucket; a centre is repeated over the few buckets its circle can
    touch, also where it crosses the date line (longitudes run from -180 to 180). ``centres``
    columns other than x, y are kept, with ``cx, cy`` and ``distance``.
    """
    angle = metres / 6371008.8
    height = math.degrees(angle) * (1 + 1e-9)

    def lon_step(band: Column) -> Column:
        reach = F.least(F.lit(89.0), F.greatest(F.abs(band), F.abs(band + 1)) * height)
        return F.lit(height) / F.cos(F.radians(reach))

    rows = df.withColumn("_band", bucket_of(F.col("y"), height))
    rows = rows.withColumn("_col", F.floor(F.col("x") / lon_step(F.col("_band"))).cast("bigint"))
    others = [c for c in centres.columns if c not in ("x", "y")]
    spread = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(angle)) / F.cos(F.radians("cy"))))) * (1 + 1e-9)
    spread = F.when(F.abs("cy") + height >= 90, F.lit(360.0)).otherwise(spread)
    left, right = F.col("cx") - spread, F.col("cx") + spread

    def columns_of(shift: int, crosses: Column) -> Column:
        step = lon_step(F.col("_band"))
        span = F.sequence(*[F.floor((side + shift) / step).cast("bigint") for side in (left, right)])
        return F.when(crosses, span).otherwise(F.array().cast("array<bigint>"))

    around = (
        centres.select(*others, F.col("x").alias("cx"), F.col("y").alias("cy"))
        .withColumn("_band", _between(bucket_of(F.col("cy"), height) - 1, bucket_of(F.col("cy"), height) + 1))
        .withColumn("_col", F.explode(F.array_distinct(F.concat(
            columns_of(0, F.lit(True)), columns_of(360, left < -180), columns_of(-360, right > 180)))))
    )
    return (
        rows.join(around, ["_band", "_col"])
        .withColumn("distance", great_circle(F.col("cx"), F.col("cy"), F.col("x"), F.col("y")))
        .filter(F.col("distance") <= metres)
        .select(*df.columns, *others, "cx", "cy", "distance")
    )
