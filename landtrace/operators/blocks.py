"""Rasters in square blocks: a row per block with an array per band, constant runs compressed.

A block has ``side`` x ``side`` cells, numbered along its rows; no row ever holds more, however wide the raster is. A band
is the array of its runs ``start, n, v``; cells in no run are empty. Blocks without a value aren't stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.functions.geometry import cell_number
from landtrace.operators.cycles import LENGTH_COLUMNS
from landtrace.operators.tiles import _on_tiles

BLOCK = ["block_row", "block_col"]


def _block(row: Column, col: Column, side: int) -> list[Column]:
    """Block indices and the cell's place in the block."""
    return [
        F.floor(row / side).cast("int").alias("block_row"), F.floor(col / side).cast("int").alias("block_col"),
        ((row % side) * side + col % side).cast("int").alias("pos"),
    ]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _indices(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def runs_of(cells: Column, band: str) -> Column:
    """Runs of one band of ``cells`` (pos, order, bands), which are sorted; of a cell's values the last one that isn't NULL counts."""

    def last(some: Column) -> Column:
        return F.filter(some, lambda c, i: F.coalesce(F.get(some, i + 1)["pos"] != c["pos"], F.lit(True)))

    def runs(some: Column) -> Column:
        def begins(i: Column) -> Column:
            now, before = F.get(some, i), F.get(some, i - 1)
            return (i == 0) | (now["pos"] != before["pos"] + 1) | (now[band] != before[band])

        def made(starts: Column) -> Column:
            return F.transform(starts, lambda s, k: F.struct(
                F.get(some, s)["pos"].alias("start"), (F.coalesce(F.get(starts, k + 1), F.size(some)) - s).alias("n"),
                F.get(some, s)[band].alias("v")))

        return _let(F.filter(_indices(some), begins), made)

    return _let(F.filter(cells, lambda c: c[band].isNotNull()), lambda known: _let(last(known), runs))


def values_of(runs: Column, cells: Column | int, kind: str) -> Column:
    """All ``cells`` values of a band, empty ones as NULL."""
    cells = cells if isinstance(cells, Column) else F.lit(cells)
    none = F.lit(None).cast(kind)

    def filled(some: Column) -> Column:
        def piece(r: Column, k: Column) -> Column:
            before = F.get(some, k - 1)
            gap = r["start"] - F.coalesce(before["start"] + before["n"], F.lit(0))
            return F.concat(F.array_repeat(none, gap), F.array_repeat(r["v"], r["n"]))

        end = F.coalesce(F.get(some, F.size(some) - 1)["start"] + F.get(some, F.size(some) - 1)["n"], F.lit(0))
        return F.concat(F.flatten(F.transform(some, piece)), F.array_repeat(none, cells - end))

    return _let(F.coalesce(runs, F.array().cast(f"array<struct<start:int,n:int,v:{kind}>>")), filled)


def _gathered(cells: DataFrame, key: Sequence[str], bands: Sequence[str], order: str | None) -> DataFrame:
    """One row per ``key`` and block, a column of runs per band; ``cells`` has pos, the bands and, where tiles overlap, ``order``."""
    entry = F.struct("pos", *([order] if order else []), *bands)
    found = cells.groupBy(*key, *BLOCK).agg(F.array_sort(F.collect_list(entry)).alias("_cells"))
    return found.select(*key, *BLOCK, *[runs_of(F.col("_cells"), b).alias(b) for b in bands])


def block_raster(
    c_length: DataFrame, mask: DataFrame, meta: DataFrame, bands: Sequence[str] = LENGTH_COLUMNS, side: int = 256,
) -> DataFrame:
    """The stored form of every tile and conversion: ``tile_id, agri_cycle, block_row, block_col`` and the bands."""
    cells = _on_tiles(c_length, mask, meta, bands)
    placed = cells.select("tile_id", "agri_cycle", *_block(F.col("row"), F.col("col"), side), *bands)
    return _gathered(placed, ["tile_id", "agri_cycle"], bands, None)


def raster_cells(blocks: DataFrame, meta: DataFrame, bands: Sequence[str] = LENGTH_COLUMNS, side: int = 256) -> DataFrame:
    """``block_raster`` unpacked: a row per cell of every tile and conversion, NULL bands where nothing happened."""
    kinds = {b: blocks.schema[b].dataType.elementType["v"].dataType.simpleString() for b in bands}
    where = ["tile_id", "agri_cycle"]
    frame = blocks.select(*where).distinct().join(meta.select("tile_id", "n_row", "n_col"), "tile_id")
    for name, size in (("block_row", "n_row"), ("block_col", "n_col")):
        frame = frame.withColumn(name, F.explode(F.sequence(F.lit(0), F.floor((F.col(size) - 1) / side).cast("int"))))
    dense = frame.join(blocks, [*where, *BLOCK], "left").select(
        *where, "n_row", "n_col", *BLOCK, *[values_of(F.col(b), side * side, kinds[b]).alias(b) for b in bands])
    entries = F.arrays_zip(*[F.col(b) for b in bands])
    cells = dense.select(*where, "n_row", "n_col", *BLOCK, F.posexplode(entries).alias("_pos", "_v"))
    row, col = F.col("block_row") * side + F.floor(F.col("_pos") / side).cast("int"), F.col("block_col") * side + F.col("_pos") % side
    cells = cells.withColumns({"row": row, "col": col}).filter("row < n_row and col < n_col")
    return cells.select(
        *where, cell_number(F.col("row"), F.col("col"), F.col("n_col")).alias("tile_cell_id"), "row", "col",
        *[F.col("_v")[b].alias(b) for b in bands])


def block_mosaic(
    c_length: DataFrame, mask: DataFrame, meta: DataFrame, offsets: DataFrame, bands: Sequence[str] = LENGTH_COLUMNS,
    side: int = 256,
) -> DataFrame:
    """One raster per conversion over all its tiles, in blocks of the common grid; the last tile with a value is on top.

    ``covers`` lists the parts (r0, r1, c0, c1 within the block) that the conversion's tiles cover; other cells don't exist.
    """
    cells = _on_tiles(c_length, mask, meta, bands)
    placed = cells.join(offsets, "tile_id").withColumns({"_r": F.col("row") + F.col("row_offset"), "_c": F.col("col") + F.col("col_offset")})
    found = _gathered(
        placed.select("agri_cycle", *_block(F.col("_r"), F.col("_c"), side), "tile_order", *bands), ["agri_cycle"], bands, "tile_order")
    tiles = cells.select("tile_id", "agri_cycle").distinct().join(meta.select("tile_id", "n_row", "n_col"), "tile_id").join(offsets, "tile_id")
    for name, first, size in (("block_row", "row_offset", "n_row"), ("block_col", "col_offset", "n_col")):
        tiles = tiles.withColumn(name, F.explode(F.sequence(
            F.floor(F.col(first) / side).cast("int"), F.floor((F.col(first) + F.col(size) - 1) / side).cast("int"))))

    def inside(first: str, size: str, block: str) -> list[Column]:
        low = F.col(first) - F.col(block) * side
        return [F.greatest(F.lit(0), low), F.least(F.lit(side - 1), low + F.col(size) - 1)]

    (r0, r1), (c0, c1) = inside("row_offset", "n_row", "block_row"), inside("col_offset", "n_col", "block_col")
    covers = tiles.groupBy("agri_cycle", *BLOCK).agg(
        F.collect_set(F.struct(r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))).alias("covers"))
    return covers.join(found, ["agri_cycle", *BLOCK], "left")


def mosaic_cells(blocks: DataFrame, bands: Sequence[str] = LENGTH_COLUMNS, side: int = 256) -> DataFrame:
    """``block_mosaic`` unpacked: a row per cell that a tile of the conversion covers."""
    kinds = {b: blocks.schema[b].dataType.elementType["v"].dataType.simpleString() for b in bands}
    one = F.flatten(F.transform("covers", lambda t: F.flatten(F.transform(F.sequence(t["r0"], t["r1"]), lambda r: F.transform(
        F.sequence(t["c0"], t["c1"]), lambda c: (r * side + c).cast("int"))))))
    places = F.when(F.size("covers") > 1, F.array_distinct(one)).otherwise(one)
    dense = blocks.select("agri_cycle", *BLOCK, places.alias("_at"), *[values_of(F.col(b), side * side, kinds[b]).alias(b) for b in bands])
    cells = dense.select("agri_cycle", *BLOCK, F.inline(F.transform("_at", lambda p: F.struct(
        p.alias("_pos"), *[F.get(F.col(b), p).alias(b) for b in bands]))))
    return cells.select(
        "agri_cycle", (F.col("block_row") * side + F.floor(F.col("_pos") / side)).cast("int").alias("row"),
        (F.col("block_col") * side + F.col("_pos") % side).cast("int").alias("col"), *bands)
