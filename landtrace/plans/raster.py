"""Conversions back on the grid, and hexagon summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.operators.hexgrid import hex_bin, hex_centre, zonal_majority
from landtrace.operators.overlay import clip_to_hexagons, clipped_areas, mark_holes
from landtrace.operators.polygons import points_inside
from landtrace.operators.tiles import block_mode, mosaic, rasterize, tile_offsets


def rasterize_conversions(c_length: DataFrame, mask: DataFrame, meta: DataFrame) -> DataFrame:
    """Dense six-band grid of every tile and conversion."""
    return rasterize(c_length, mask, meta)


def mosaic_tiles(c_length: DataFrame, mask: DataFrame, meta: DataFrame) -> DataFrame:
    """The tiles of each conversion in one common dense grid."""
    return mosaic(c_length, mask, meta, tile_offsets(meta))


def _zones(cells, step, size, factor, min_n, na_rm, x0, y0, origin) -> DataFrame:
    """(hex_q, hex_r, c_length, n): majority lengths of all hexagons, from the modes of blocks of pixels."""
    blocks = block_mode(cells, "row", "col", "c_length", factor, na_rm).select(
        (F.lit(x0) + (F.col("block_col") + 0.5) * (factor * step)).alias("x"),
        (F.lit(y0) + (F.col("block_row") + 0.5) * (factor * step)).alias("y"), "c_length",
    )
    return zonal_majority(hex_bin(blocks, "x", "y", size, origin), ["hex_q", "hex_r"], "c_length", min_n)


def hex_majority_length(
    cells: DataFrame, edges: DataFrame, step: float, size: float = 0.1, factor: int = 10,
    min_n: int = 20, na_rm: bool = False, x0: float = 0.0, y0: float = 0.0, bucket: float = 1.0,
) -> DataFrame:
    """Majority length per hexagon whose centre lies in the area of interest.

    ``cells`` holds global ``row``, ``col`` and ``c_length``; blocks of ``factor`` pixels of
    ``step`` degrees are reduced to their mode before being binned.
    """
    zones = _zones(cells, step, size, factor, min_n, na_rm, x0, y0, (0.0, 0.0))
    x, y = hex_centre(F.col("hex_q"), F.col("hex_r"), size)
    return points_inside(zones.withColumns({"x": x, "y": y}), edges, bucket)


def hex_majority_shapes(
    cells: DataFrame, rings: DataFrame, step: float, size: float = 0.1, factor: int = 10, min_n: int = 20,
    na_rm: bool = False, x0: float = 0.0, y0: float = 0.0, origin: tuple[float, float] | None = None,
) -> DataFrame:
    """Majority length per hexagon, cut to the area of interest: a row for each hexagon, majority and polygon that share an area.

    ``area`` is the shared area in square degrees, ``shape`` its rings as (ring, hole, points). ``rings`` is a layer of shapes.
    The hexagon grid starts at ``origin``, which is the raster's corner (``x0``, ``y0``) if not given.
    """
    origin = (x0, y0) if origin is None else origin
    zones = _zones(cells, step, size, factor, min_n, na_rm, x0, y0, origin)
    wanted = zones.select("hex_q", "hex_r").distinct()
    parts = clip_to_hexagons(mark_holes(rings), size, origin).join(wanted, ["hex_q", "hex_r"], "left_semi")
    by = ["hex_q", "hex_r", "poly_id"]
    shapes = parts.groupBy(*by).agg(F.collect_list(F.struct("ring", "hole", "points")).alias("shape"))
    return zones.join(clipped_areas(parts, ["hex_q", "hex_r"]).drop("n_rings").join(shapes, by), ["hex_q", "hex_r"])
