"""Tile catalogues built from file listings.

A listing has one row per file and Spark's own file index holds it on the driver. Numbering
sorts one row per tile in one place, which is few next to the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landtrace.functions.text import code_after


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Paths below ``root`` whose name matches; contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(root).select("path", "length")
    )


def tile_catalog(listing: DataFrame, prefix: str) -> DataFrame:
    """Tile code parsed from the file name, numbered in code order, however many files a tile has.

    ``path`` is the first of its files.
    """
    files = listing.select(code_after(F.col("path"), prefix).alias("tile_code"), "path")
    tiles = files.filter("tile_code is not null").groupBy("tile_code").agg(F.min("path").alias("path"))
    return tiles.select(F.row_number().over(Window.orderBy("tile_code")).alias("tile_id"), "tile_code", "path")


def dedupe_listing(*listings: DataFrame, key: str = "name", drop: tuple[str, ...] = ()) -> DataFrame:
    """Union of repeated listings: the first entry of each name, without folder entries."""
    tagged = [df.withColumn("_turn", F.lit(i)) for i, df in enumerate(listings)]
    rows = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in listings[0].columns if c != key]
    first = F.min(F.struct("_turn", *rest)).alias("_first")
    return (
        rows.filter(~F.col(key).isin(*drop) if drop else F.lit(True))
        .groupBy(key).agg(first).select(key, *[F.col("_first")[c].alias(c) for c in rest])
    )
