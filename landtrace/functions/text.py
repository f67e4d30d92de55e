"""Parsing of band names, tile paths and point text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(col: Column) -> Column:
    """First run of digits as int; NULL when there is none."""
    return F.regexp_extract(col, r"([0-9]+)", 1).try_cast("int")


def code_after(path: Column, prefix: str) -> Column:
    """Digits and dashes that follow ``prefix`` in a path; NULL when absent."""
    return F.nullif(F.regexp_extract(path, prefix + r"([0-9-]+)", 1), F.lit(""))


def point_text(x: Column, y: Column, decimals: int | None = None) -> Column:
    """``POINT (x y)``; ``decimals`` fixes the number of places."""
    if decimals is not None:
        x, y = (c.cast(f"decimal(18,{decimals})") for c in (x, y))
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def point_xy(wkt: Column) -> tuple[Column, Column]:
    """The two coordinates of ``POINT (x y)`` as doubles."""
    pattern = r"POINT *\(([^ ]+) ([^ )]+)\)"
    return tuple(F.regexp_extract(wkt, pattern, i).try_cast("double") for i in (1, 2))


def tile_path(folder: str, tile: Column, cycle: Column | None = None) -> Column:
    """Folder of a tile (and cycle) in a Hive-partitioned table."""
    if cycle is None:
        return F.format_string(f"{folder}/tile_id=%d", tile)
    return F.format_string(f"{folder}/tile_id=%d/agri_cycle=%d", tile, cycle)
