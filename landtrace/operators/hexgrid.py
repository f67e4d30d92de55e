"""Hexagonal zones as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.operators.aggregates import majority


def _nearest(col: Column) -> Column:
    return F.floor(col + 0.5)


def hex_bin(df: DataFrame, x: str, y: str, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Axial index (``hex_q``, ``hex_r``) of the hexagon, ``size`` wide, around each point; ``origin`` is the centre of (0, 0)."""
    side = size / math.sqrt(3)
    px, py = F.col(x) - origin[0], F.col(y) - origin[1]
    q = (px * (math.sqrt(3) / 3) - py / 3) / side
    r = (py * (2 / 3)) / side
    rq, rr, rs = _nearest(q), _nearest(r), _nearest(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    fix_q = (dq > dr) & (dq > ds)
    return df.withColumns({
        "hex_q": F.when(fix_q, -rr - rs).otherwise(rq).cast("bigint"),
        "hex_r": F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("bigint"),
    })


def hex_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    side = size / math.sqrt(3)
    return (q + r / 2) * (side * math.sqrt(3)), r * (side * 1.5)


def zonal_majority(df: DataFrame, zone: list[str], value: str, min_n: int = 20) -> DataFrame:
    """Most frequent values of each zone (ties kept) seen more than ``min_n`` times."""
    return majority(df.filter(F.col(value).isNotNull()), zone, value).filter(F.col("n") > min_n)
