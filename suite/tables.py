"""Land-cover style views over the given tables.

Line items become yearly classes of a cell (a part), parts become pixels of tiles of
10 x 10 cells (numbered from the north-west) on a grid 50 cells wide, nations become administrative polygons.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landtrace import ConversionSpec, class_table
from landtrace.operators.panel import rows_to_bands
from landtrace.operators.tiles import tile_metadata
from landtrace.plans.conversion import conversion_classes, conversion_cycles

YEARS = range(1985, 2013)
IMAGE_BANDS = [f"{band}_median_{season}" for band in ("blue", "green", "red", "nir", "swir1") for season in ("dry", "wet")] + [
    "ndvi_amp"]
STEP = 0.1
SIDE = 10

# corners of a nation's polygon (ring 0) and of the hole in it (ring 1), inside a unit square
CORNERS = [
    (0, [(0.11, 0.13), (0.93, 0.07), (0.57, 0.48), (0.88, 0.91), (0.07, 0.86)]),
    (1, [(0.22, 0.31), (0.36, 0.34), (0.27, 0.52)]),
]
SEGMENTS = [
    (ring, *points[i], *points[(i + 1) % len(points)])
    for ring, points in CORNERS for i in range(len(points))
]
# a supplier's plot: a diamond around its place on the grid
PLOT = [(0, 0.23, 0.0, 0.0, 0.19), (0, 0.0, 0.19, -0.23, 0.0), (0, -0.23, 0.0, 0.0, -0.19), (0, 0.0, -0.19, 0.23, 0.0)]


class Tables:
    """The views at one scale factor; every one is lazy."""

    spec = ConversionSpec()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _codes(self) -> DataFrame:
        """Unreduced (cell, year, class) rows of the line items."""
        line = F.col("l_linenumber")
        year = 1985 + (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
        code = (
            F.when(line.isin(1, 2), 3).when(line.isin(3, 4), 15).when(line == 5, 39).when(line == 6, 48).otherwise(33)
        )
        return self.read("lineitem").select(
            F.col("l_partkey").alias("cell_id"), year.cast("int").alias("year"), code.alias("class_code")
        )

    @cached_property
    def panel(self) -> DataFrame:
        return self._codes.groupBy("cell_id", "year").agg(F.min("class_code").alias("class_code"))

    @cached_property
    def panel_events(self) -> DataFrame:
        kind = F.col("event_type")
        code = (
            F.when(kind == "view", 3).when(kind == "click", 15).when(kind == "purchase", 39)
            .when(kind == "signup", 41).otherwise(25)
        )
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        return (
            self.read("events")
            .groupBy(F.col("user_id").alias("cell_id"), (day + 1985).cast("int").alias("year"))
            .agg(F.min(code).alias("class_code"))
        )

    @cached_property
    def wide(self) -> DataFrame:
        """One row per cell, a band per year, 0 where nothing was seen."""
        return rows_to_bands(self._codes, YEARS, ["cell_id"])

    @cached_property
    def bands(self) -> list[str]:
        return [f"classification_{y}" for y in YEARS]

    @cached_property
    def mask(self) -> DataFrame:
        key = F.col("p_partkey")
        row, col = F.floor(key / 50), key % 50
        return self.read("part").select(
            key.alias("cell_id"),
            (F.floor(col / 10) + 5 * F.floor(row / 10) + 1).cast("int").alias("tile_id"),
            ((9 - row % 10) * 10 + key % 10 + 1).cast("int").alias("tile_cell_id"),
            F.col("p_retailprice").cast("decimal(18,4)").alias("area"),
            (key % 25).cast("int").alias("code_muni"),
            (col.cast("double") / 10 + 0.05).alias("x"),
            (row.cast("double") / 10 + 0.05).alias("y"),
        )

    @cached_property
    def mask_wide(self) -> DataFrame:
        """Mask pixels before ids; some have no area."""
        area = F.when(F.col("cell_id") % 13 == 0, 0).otherwise(F.col("area").cast("double"))
        return self.mask.select("tile_id", "tile_cell_id", "x", "y", area.alias("area"))

    @cached_property
    def tiles(self) -> DataFrame:
        """The catalogue: a number and a code for each tile."""
        return self.mask.select("tile_id").distinct().withColumn("tile_code", F.format_string("%010d", "tile_id"))

    @cached_property
    def sizes(self) -> DataFrame:
        return self.tiles.select("tile_code", F.lit(SIDE).alias("n_col"), F.lit(SIDE).alias("n_row"))

    @cached_property
    def meta(self) -> DataFrame:
        return tile_metadata(self.mask, self.tiles, self.sizes, STEP)

    @cached_property
    def municip(self) -> DataFrame:
        return self.read("nation").select(
            F.col("n_nationkey").alias("code_muni"), F.col("n_name").alias("name_state")
        )

    def _layer(self, df: DataFrame, name: str, x, y, segments) -> DataFrame:
        parts = F.inline(F.array(*[
            F.struct(F.lit(r).alias("ring"), *[F.lit(v).alias(n) for v, n in zip(s, ("a", "b", "c", "d"))])
            for r, *s in segments
        ]))
        return df.select(F.col(name).cast("int").alias("poly_id"), x.alias("x0"), y.alias("y0"), parts).select(
            "poly_id", "ring",
            (F.col("x0") + F.col("a")).alias("x1"), (F.col("y0") + F.col("b")).alias("y1"),
            (F.col("x0") + F.col("c")).alias("x2"), (F.col("y0") + F.col("d")).alias("y2"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        key = F.col("n_nationkey")
        x, y = (key % 5).cast("double"), F.floor(key / 5).cast("double")
        return self._layer(self.read("nation"), "n_nationkey", x, y, SEGMENTS)

    @cached_property
    def rings(self) -> DataFrame:
        """The nations' polygons as shapes."""
        key = F.col("n_nationkey")
        x, y = (key % 5).cast("double"), F.floor(key / 5).cast("double")
        shapes = F.inline(F.array(*[
            F.struct(F.lit(ring).alias("ring"), F.array(*[
                F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in points]).alias("points")) for ring, points in CORNERS]))
        return self.read("nation").select(key.cast("int").alias("poly_id"), shapes)

    @cached_property
    def plots(self) -> DataFrame:
        key = F.col("s_suppkey")
        x, y = (key % 37).cast("double") / 7, F.floor(key / 37).cast("double") / 3
        return self._layer(self.read("supplier"), "s_suppkey", x, y, PLOT)

    @cached_property
    def classes(self) -> DataFrame:
        return class_table(self.spark)

    @cached_property
    def c_length(self) -> DataFrame:
        return conversion_cycles(self.panel, self.spec)

    @cached_property
    def c_classes(self) -> DataFrame:
        return conversion_classes(self.panel, self.spec)

    @cached_property
    def tiled(self) -> DataFrame:
        """Conversions with their tile."""
        return self.c_length.join(self.mask.select("cell_id", "tile_id"), "cell_id")

    @cached_property
    def observed(self) -> DataFrame:
        """One interpreted sample per cell; some saw no conversion (0)."""
        first = self.c_length.filter("agri_cycle = 1").select("cell_id", "forest_year", "agri_year")
        cell = F.col("cell_id")
        rows = self.mask.select("cell_id").join(first, "cell_id", "left")
        rows = rows.select(
            cell.alias("sample_id"), cell,
            F.when(cell % 11 == 0, 0).otherwise(F.coalesce("forest_year", F.lit(1999)) + cell % 7 - 3)
            .cast("int").alias("forest_year"),
            F.when(cell % 17 == 0, 0).otherwise(F.coalesce("agri_year", F.lit(2003)) + cell % 5 - 2)
            .cast("int").alias("agri_year"),
        )
        return rows.withColumn("c_length", F.col("agri_year") - F.col("forest_year"))

    @cached_property
    def grid(self) -> DataFrame:
        """First conversions with global raster row and column."""
        key = F.col("cell_id")
        return self.c_length.filter("agri_cycle = 1").select(
            F.floor(key / 50).cast("int").alias("row"), (key % 50).cast("int").alias("col"), "c_length"
        )

    @cached_property
    def scenes(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year"),
            F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("part"),
            F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice")).alias("nir"),
            F.col("l_quantity").alias("red"),
        )

    @cached_property
    def image(self) -> DataFrame:
        """One pixel per part with seasonal bands."""
        price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
        key = F.col("p_partkey")
        seasonal = {
            f"{band}_median_{season}": F.when(key % (7 + i + j) != 0, price * (i + 1) + size * (j + 1))
            for i, band in enumerate(("blue", "green", "red", "nir", "swir1"))
            for j, season in enumerate(("dry", "wet"))
        }
        return self.read("part").select(
            ((key % 50).cast("double") / 10 + 0.05).alias("x"),
            (F.floor(key / 50).cast("double") / 10 + 0.05).alias("y"),
            *[c.alias(n) for n, c in seasonal.items()], (size / 50).alias("ndvi_amp"),
        )
