"""From yearly class tables to conversions, follow-up classes and the cell mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.functions.text import point_text
from landtrace.operators.cycles import CELL, band_join, cycle_bounds, number_cycles, segment_cycles
from landtrace.operators.ids import surrogate_ids
from landtrace.operators.panel import ever_class, mask_cells, year_bands
from landtrace.operators.polygons import nearest_polygon
from landtrace.operators.sphere import nearest_on_sphere
from landtrace.operators.series import band_series, series_classes, series_cycles
from landtrace.spec import ConversionSpec


def select_candidate_cells(wide: DataFrame, spec: ConversionSpec, prefix: str = "classification") -> DataFrame:
    """Cells that were ever natural and ever agriculture, in any order. A row-local filter."""
    bands = list(year_bands(wide, prefix).values())
    return mask_cells(wide, ever_class(bands, spec.natural) & ever_class(bands, spec.agriculture))


def conversion_cycles(
    panel: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL, classes: DataFrame | None = None
) -> DataFrame:
    """Conversions of a long panel, by windows over one exchange on the cell.

    ``classes`` may give the anthropic classes as a dictionary table.
    """
    return number_cycles(cycle_bounds(segment_cycles(panel, spec, keys, classes), spec, keys), keys)


def conversion_classes(panel: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL) -> DataFrame:
    """Classes during and after each conversion of a long panel, joined on the cell."""
    return band_join(panel, conversion_cycles(panel, spec, keys), spec.after, keys)


def wide_conversion_cycles(
    wide: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL, prefix: str = "classification"
) -> DataFrame:
    """Conversions of a wide table; no shuffle."""
    return series_cycles(wide, band_series(year_bands(wide, prefix)), spec, keys)


def wide_conversion_classes(
    wide: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL, prefix: str = "classification"
) -> DataFrame:
    """Follow-up classes of a wide table; no shuffle."""
    return series_classes(wide, band_series(year_bands(wide, prefix)), spec, keys)


def with_cell_ids(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Global ``cell_id`` for rows keyed by tile and cell number; cells off the mask drop out.

    Joining after the cycles were found moves the conversions only, not the year bands.
    """
    ids = mask.select("tile_id", "tile_cell_id", "cell_id")
    return df.join(ids, ["tile_id", "tile_cell_id"]).drop("tile_cell_id")


def extract_mask(
    mask_wide: DataFrame, edges: DataFrame, bucket: float = 1.0, extent: float = 180.0, decimals: int | None = None,
    spherical: bool = False,
) -> DataFrame:
    """Mask cells with a global id, the nearest municipality and the point as text.

    Coordinates are degrees. ``spherical`` measures along great circles; else degrees are a plane, in which a degree of
    longitude is as long as one of latitude.
    """
    cells = surrogate_ids(mask_wide.filter(F.col("area") != 0))
    placed = nearest_on_sphere(cells, edges, bucket=bucket) if spherical else nearest_polygon(cells, edges, bucket, extent)
    return placed.select(
        "cell_id", "tile_id", "tile_cell_id", "area", F.col("poly_id").alias("code_muni"), "x", "y",
        point_text(F.col("x"), F.col("y"), decimals).alias("coords"),
    )
