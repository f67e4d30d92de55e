"""Class dictionary and the parameters of a conversion analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CLASS_SCHEMA = "class_name string, class_code int, class_type string, class_color string"

# Land-cover legend (name, code, type, colour).
CLASS_ROWS = [
    ("Forest", 1, "natural", "#129912"),
    ("Forest Formation", 3, "natural", "#006400"),
    ("Savanna Formation", 4, "natural", "#00ff00"),
    ("Mangrove", 5, "natural", "#687537"),
    ("Wooded Restinga", 49, "natural", "#6b9932"),
    ("Non Forest Natural Formation", 10, "natural", "#BBFCAC"),
    ("Wetlands", 11, "natural", "#45C2A5"),
    ("Grassland", 12, "natural", "#B8AF4F"),
    ("Salt Flat", 32, "natural", "#968c46"),
    ("Rocky Outcrop", 29, "natural", "#665a3a"),
    ("Herbaceous Sandbank Vegetation", 50, "natural", "#66ffcc"),
    ("Other non Forest Formations", 13, "natural", "#f1c232"),
    ("Farming", 14, "anthropic", "#FFFFB2"),
    ("Pasture", 15, "anthropic", "#FFD966"),
    ("Agriculture", 18, "anthropic", "#E974ED"),
    ("Temporary Crop", 19, "anthropic", "#D5A6BD"),
    ("Soybean", 39, "anthropic", "#e075ad"),
    ("Sugar Cane", 20, "anthropic", "#C27BA0"),
    ("Rice", 40, "anthropic", "#982c9e"),
    ("Cotton", 62, "anthropic", "#660066"),
    ("Other Temporary Crops", 41, "anthropic", "#e787f8"),
    ("Perennial Crop", 36, "anthropic", "#f3b4f1"),
    ("Coffee", 46, "anthropic", "#cca0d4"),
    ("Citrus", 47, "anthropic", "#d082de"),
    ("Other Perennial Crop", 48, "anthropic", "#cd49e4"),
    ("Forest Plantation", 9, "anthropic", "#ad4413"),
    ("Mosaic Agriculture and Pasture", 21, "anthropic", "#fff3bf"),
    ("Non Vegetated Area", 22, "mosaic", "#EA9999"),
    ("Beach Dune and Sand Spot", 23, "natural", "#DD7E6B"),
    ("Urban Area", 24, "anthropic", "#aa0000"),
    ("Mining", 30, "anthropic", "#af2a2a"),
    ("Other non Vegetated Areas", 25, "mosaic", "#ff3d3d"),
    ("Water", 26, "mosaic", "#0000FF"),
    ("River Lake and Ocean", 33, "natural", "#0000FF"),
    ("Aquaculture", 31, "anthropic", "#02106f"),
    ("Non Observed", 27, None, "#D5D5E5"),
]

# Default class sets, follow-up years and tile side in pixels.
NATURAL_CODES = (3,)
AGRICULTURE_CODES = (18, 19, 39, 20, 40, 62, 41, 36, 46, 47, 48)
ANTHROPIC_CODES = tuple(code for _, code, kind, _ in CLASS_ROWS if kind == "anthropic")
FOLLOW_UP_YEARS = 5
TILE_DIM = 1536

# Column order of the follow-up table; other classes come after, by name.
FOLLOW_UP_CLASSES = (
    "Soybean",
    "Sugar Cane",
    "Cotton",
    "Other Temporary Crops",
    "Other Perennial Crop",
    "Pasture",
    "Forest Formation",
    "Savanna Formation",
    "Grassland",
)

# Display names of the three measures of a conversion.
MEASURE_LABELS = {
    "forest_year": "Deforestation",
    "agri_year": "Agriculture Establishment",
    "c_length": "Conversion Length",
}


@dataclass(frozen=True)
class ConversionSpec:
    """Class sets of an analysis as literal ``IN`` lists. A dictionary table of any size is joined instead."""

    natural: tuple[int, ...] = NATURAL_CODES
    agriculture: tuple[int, ...] = AGRICULTURE_CODES
    anthropic: tuple[int, ...] = ANTHROPIC_CODES
    after: int = FOLLOW_UP_YEARS


def class_table(spark: SparkSession) -> DataFrame:
    """The built-in legend as a DataFrame."""
    return spark.createDataFrame(CLASS_ROWS, CLASS_SCHEMA)
