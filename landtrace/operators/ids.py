"""Consecutive ids without sorting the table in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
FANOUT = 1_024


def surrogate_ids(
    df: DataFrame, tile: str = "tile_id", cell: str = "tile_cell_id", name: str = "cell_id",
    chunk: int = CHUNK, fanout: int = FANOUT,
) -> DataFrame:
    """Number rows 1, 2, 3... in (tile, cell) order. Cells are unique within a tile.

    Tiles are cut into chunks of ``chunk`` consecutive cell numbers and rows are numbered
    within a chunk, so even a tile with most of the rows is spread over many tasks. Where a
    chunk starts is found from counts alone, added up in three levels - chunks in a tile,
    tiles in a block of ``fanout`` tiles, blocks - each over few rows.
    """
    parts = df.withColumn("_chunk", F.floor((F.col(cell) - 1) / chunk).cast("int"))
    counts = parts.groupBy(tile, "_chunk").agg(F.count("*").alias("_n"))
    tiles = counts.groupBy(tile).agg(F.sum("_n").alias("_tn"))
    tiles = tiles.withColumn("_block", F.floor(F.col(tile) / fanout).cast("bigint"))
    blocks = tiles.groupBy("_block").agg(F.sum("_tn").alias("_bn"))

    def before(size: str, window) -> Column:
        return F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)

    # one row per `fanout` tiles: the only window without a partition key
    blocks = blocks.select("_block", before("_bn", Window.orderBy("_block")).alias("_at_block"))
    tiles = tiles.select(
        tile, "_block", before("_tn", Window.partitionBy("_block").orderBy(tile)).alias("_at_tile")
    ).join(blocks, "_block")
    starts = counts.select(
        tile, "_chunk", before("_n", Window.partitionBy(tile).orderBy("_chunk")).alias("_at_chunk")
    ).join(tiles, tile).select(
        tile, "_chunk", (F.col("_at_block") + F.col("_at_tile") + F.col("_at_chunk")).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy(tile, "_chunk").orderBy(cell))
    return (
        parts.withColumn("_rank", within).join(starts, [tile, "_chunk"])
        .select((F.col("_start") + F.col("_rank")).alias(name), *df.columns)
    )
