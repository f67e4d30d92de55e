"""Yearly image composites and their display bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.operators.aggregates import value_range
from landtrace.operators.buffers import boxes_meeting

# Source bands of the display channels.
COMPOSITES = {
    "natural": ("red_median", "green_median", "blue_median"),
    "infrared": ("swir1_median", "nir_median", "blue_median"),
}


def yearly_composite(
    scenes: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str],
    first: int, last: int, year: str = "year",
) -> DataFrame:
    """Per cell and year each band from the last scene that has a value there."""
    on_top = [
        F.max(F.when(F.col(b).isNotNull(), F.struct(*order, F.col(b).alias("_v"))))["_v"].alias(b) for b in bands
    ]
    return scenes.filter(F.col(year).between(first, last)).groupBy(*keys, year).agg(*on_top)


def scenes_by_footprint(
    footprints: DataFrame, areas: DataFrame, first: int, last: int, year: str = "year", bucket: float = 1.0,
) -> DataFrame:
    """Scenes of each year whose footprint box shares a point with an area's box; columns of both, the box being the area's.

    Only boxes are compared, before any pixel is read. ``bucket`` should be about the width of a footprint.
    """
    return boxes_meeting(areas, footprints.filter(F.col(year).between(first, last)), bucket)


def area_composite(
    pixels: DataFrame, footprints: DataFrame, areas: DataFrame, area: str, scene: str, keys: Sequence[str], bands: Sequence[str],
    order: Sequence[str], first: int, last: int, year: str = "year", bucket: float = 1.0,
) -> DataFrame:
    """``yearly_composite`` of each area's box from the scenes that its box was found to meet.

    ``pixels`` (scene, year, x, y, ...) are read for those scenes only; of them, those inside the box count.
    """
    chosen = scenes_by_footprint(footprints, areas, first, last, year, bucket).select(
        area, scene, year, "x_min", "x_max", "y_min", "y_max")
    inside = pixels.join(chosen, [scene, year]).filter(
        F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max")))
    return yearly_composite(inside, [area, *keys], bands, order, first, last, year)


def minmax_scale(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bands on 0-1 by the smallest and largest value over all of them; missing counts as 0."""
    filled = df.fillna(0, subset=list(bands))
    bounds = value_range(filled, bands).select(F.struct("low", "high")).scalar()
    low, high = bounds["low"], bounds["high"]
    return filled.withColumns({b: F.try_divide(F.col(b) - low, high - low) for b in bands})


def composite_bands(df: DataFrame, kind: str, season: str) -> DataFrame:
    """Display channels of a composite: ``natural`` or ``infrared`` in a season, or ``ndvi``."""
    if kind == "ndvi":
        return df.select("x", "y", "ndvi_amp")
    channels = zip(("red", "green", "blue"), COMPOSITES[kind])
    return df.select("x", "y", *[F.col(f"{band}_{season}").alias(name) for name, band in channels])
