"""Rasters as tables: tiling, extents, dense grids, mosaics and block aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.functions.geometry import cell_col, cell_number, cell_row
from landtrace.operators.cycles import LENGTH_COLUMNS
from landtrace.spec import TILE_DIM


def assign_tiles(df: DataFrame, row: str, col: str, dim: int = TILE_DIM) -> DataFrame:
    """Tile indices and the one-based cell number inside a ``dim`` x ``dim`` tile.

    Only rows that exist get a tile, so empty tiles never appear.
    """
    r, c = F.col(row), F.col(col)
    return df.withColumns({
        "tile_row": F.floor(r / dim).cast("int"),
        "tile_col": F.floor(c / dim).cast("int"),
        "tile_cell_id": cell_number(r % dim, c % dim, dim),
    })


def tile_metadata(
    cells: DataFrame, catalog: DataFrame, sizes: DataFrame, step: float, crs: str = "EPSG:4326"
) -> DataFrame:
    """Extent of every tile from the centres of its cells, whichever of them are present.

    ``catalog`` numbers the tiles (``tile_id, tile_code``); ``sizes`` has the columns and rows
    of each by its code (``tile_code, n_col, n_row``), so tiles at the edge may be smaller.
    """
    tiles = catalog.select("tile_id", "tile_code").join(sizes.select("tile_code", "n_col", "n_row"), "tile_code")
    cell = F.col("tile_cell_id")
    left = F.col("x") - (cell_col(cell, F.col("n_col")) + 0.5) * step
    top = F.col("y") + (cell_row(cell, F.col("n_col")) + 0.5) * step
    extent = cells.select("tile_id", "tile_cell_id", "x", "y").join(tiles, "tile_id").groupBy("tile_id").agg(
        F.round(F.min(left), 9).alias("x_min"), F.round(F.max(top), 9).alias("y_max")
    )
    return extent.join(tiles, "tile_id").select(
        "tile_id", "tile_code", "x_min", F.round(F.col("x_min") + F.col("n_col") * step, 9).alias("x_max"),
        F.round(F.col("y_max") - F.col("n_row") * step, 9).alias("y_min"), "y_max",
        "n_col", "n_row", (F.col("n_col") * F.col("n_row")).alias("n_cell"), F.lit(crs).alias("crs"),
    )


def _on_tiles(c_length: DataFrame, mask: DataFrame, meta: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Sparse conversions with their row and column in the tile."""
    return (
        c_length.select("cell_id", "agri_cycle", *bands)
        .join(mask.select("cell_id", "tile_id", "tile_cell_id"), "cell_id")
        .join(meta.select("tile_id", "n_col"), "tile_id")
        .select("tile_id", "agri_cycle", cell_row(F.col("tile_cell_id"), F.col("n_col")).alias("row"),
                cell_col(F.col("tile_cell_id"), F.col("n_col")).alias("col"), *bands)
    )


def _filled(lines: DataFrame, cols: Column, bands: Sequence[str]) -> Column:
    """Entries of a line for all of ``cols``: those in ``found``, and NULL bands elsewhere."""
    found = F.coalesce("found", F.array().cast(lines.schema["found"].dataType))
    empty = [F.lit(None).cast(lines.schema["found"].dataType.elementType[b].dataType).alias(b) for b in bands]
    gaps = F.transform(
        F.array_except(cols, F.transform(found, lambda c: c["col"])), lambda c: F.struct(c.alias("col"), *empty)
    )
    return F.concat(found, gaps)


def rasterize(
    c_length: DataFrame, mask: DataFrame, meta: DataFrame, bands: Sequence[str] = LENGTH_COLUMNS
) -> DataFrame:
    """Dense grid per (tile, conversion): a row per cell, NULL bands where nothing happened.

    Only the sparse conversions are shuffled. They are gathered per raster line (at most
    ``n_col`` entries), the lines are matched with the skeleton of all lines, and each line
    is filled up to ``n_col`` cells inside its own row.
    """
    where = ["tile_id", "agri_cycle"]
    lines = _on_tiles(c_length, mask, meta, bands).groupBy(*where, "row").agg(
        F.collect_list(F.struct("col", *bands)).alias("found"))
    skeleton = (
        lines.select(*where).distinct()
        .join(meta.select("tile_id", "n_row", "n_col"), "tile_id")
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_row") - 1)))
        .drop("n_row")
    )
    cols = F.sequence(F.lit(0), F.col("n_col") - 1)
    return (
        skeleton.join(lines, [*where, "row"], "left")
        .select(*where, "row", "n_col", F.inline(_filled(lines, cols, bands)))
        .select(*where, cell_number(F.col("row"), F.col("col"), F.col("n_col")).alias("tile_cell_id"),
                "row", "col", *bands)
    )


def mosaic(
    c_length: DataFrame, mask: DataFrame, meta: DataFrame, offsets: DataFrame, bands: Sequence[str] = LENGTH_COLUMNS
) -> DataFrame:
    """One dense grid per conversion over all tiles that have it; the last tile with a value is on top.

    ``offsets`` places each tile: ``tile_id, row_offset, col_offset, tile_order``. Tiles that
    overlap are settled among the sparse conversions. Only then the lines of the common grid
    are filled, each inside its own row, over the columns of the tiles it crosses.
    """
    cells = _on_tiles(c_length, mask, meta, bands)
    placed = cells.join(offsets, "tile_id").select(
        "agri_cycle", (F.col("row") + F.col("row_offset")).alias("row"),
        (F.col("col") + F.col("col_offset")).alias("col"), "tile_order", *bands,
    )
    on_top = [F.max_by(b, F.when(F.col(b).isNotNull(), F.col("tile_order"))).alias(b) for b in bands]
    lines = placed.groupBy("agri_cycle", "row", "col").agg(*on_top).groupBy("agri_cycle", "row").agg(
        F.collect_list(F.struct("col", *bands)).alias("found"))
    extents = meta.select("tile_id", "n_row", "n_col").join(offsets, "tile_id")
    crossed = (
        cells.select("tile_id", "agri_cycle").distinct().join(extents, "tile_id")
        .withColumn("row", F.explode(F.sequence(F.col("row_offset"), F.col("row_offset") + F.col("n_row") - 1)))
        .groupBy("agri_cycle", "row").agg(F.collect_set(F.struct("col_offset", "n_col")).alias("tiles"))
    )
    cols = F.array_distinct(F.flatten(F.transform("tiles", lambda t: F.sequence(
        t["col_offset"], t["col_offset"] + t["n_col"] - 1))))
    return (
        crossed.join(lines, ["agri_cycle", "row"], "left")
        .select("agri_cycle", "row", F.inline(_filled(lines, cols, bands)))
    )


def tile_offsets(meta: DataFrame) -> DataFrame:
    """Row and column offset of each tile in the common grid, from the extents."""
    corner = meta.agg(F.struct(F.min("x_min").alias("x"), F.max("y_max").alias("y"))).scalar()
    x0, y0 = corner["x"], corner["y"]
    dx = (F.col("x_max") - F.col("x_min")) / F.col("n_col")
    dy = (F.col("y_max") - F.col("y_min")) / F.col("n_row")
    return meta.select(
        "tile_id",
        F.round((y0 - F.col("y_max")) / dy).cast("int").alias("row_offset"),
        F.round((F.col("x_min") - x0) / dx).cast("int").alias("col_offset"),
        F.col("tile_id").alias("tile_order"),
    )


def block_mode(df: DataFrame, row: str, col: str, value: str, factor: int, na_rm: bool = False) -> DataFrame:
    """Modal value of ``factor`` x ``factor`` blocks, the smallest one on ties.

    Without ``na_rm`` a block counts only if all its cells hold a value. A block has at most
    ``factor`` squared cells, which bounds the aggregation buffer.
    """
    block = df.select(
        F.floor(F.col(row) / factor).cast("int").alias("block_row"),
        F.floor(F.col(col) / factor).cast("int").alias("block_col"), F.col(value),
    ).groupBy("block_row", "block_col")
    out = block.agg(F.count(value).alias("n"), F.mode(value, True).alias(value))
    whole = "n > 0" if na_rm else f"n = {factor * factor}"
    return out.filter(whole).drop("n")


def crop(df: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    """Rows inside a box; plain range filters, so they reach the Parquet scan."""
    return df.filter(F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max))
