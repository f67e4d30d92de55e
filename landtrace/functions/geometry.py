"""Grid, ellipsoid and segment arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and mean earth radius, metres.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
EARTH_RADIUS = 6371008.8


def cell_row(cell: Column, n_col) -> Column:
    """Zero-based raster row of a one-based linear cell number."""
    return F.floor((cell - 1) / n_col).cast("int")


def cell_col(cell: Column, n_col) -> Column:
    return ((cell - 1) % n_col).cast("int")


def cell_number(row: Column, col: Column, n_col) -> Column:
    return (row * n_col + col + 1).cast("int")


def centre_x(col: Column, x_min: Column, x_max: Column, n_col: Column) -> Column:
    return x_min + (col + 0.5) * (x_max - x_min) / n_col


def centre_y(row: Column, y_min: Column, y_max: Column, n_row: Column) -> Column:
    return y_max - (row + 0.5) * (y_max - y_min) / n_row


def _authalic(lat: Column) -> Column:
    ecc = math.sqrt(FLATTENING * (2 - FLATTENING))
    s = F.sin(F.radians(lat))
    return s / (1 - ecc * ecc * s * s) + F.log((1 + ecc * s) / (1 - ecc * s)) / (2 * ecc)


def pixel_area(lat: Column, step: float) -> Column:
    """Area (m2) of a ``step`` x ``step`` degree pixel centred at ``lat``."""
    semi_minor = SEMI_MAJOR * (1 - FLATTENING)
    scale = math.radians(step) * semi_minor**2 / 2
    return F.lit(scale) * (_authalic(lat + step / 2) - _authalic(lat - step / 2))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
        * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    )
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def segment_sq_distance(px, py, x1, y1, x2, y2) -> Column:
    """Squared distance from a point to a segment (a zero-length one is a point)."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size)))
    t = F.coalesce(t, F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def bucket(col: Column, size: float) -> Column:
    return F.floor(col / size).cast("bigint")
