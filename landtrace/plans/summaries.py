"""Area, frequency, ridge and follow-up summaries of conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.functions.values import square_km, year_start
from landtrace.operators.aggregates import histogram, shares, total
from landtrace.operators.joins import at_lag, decode_codes, with_area
from landtrace.operators.reshape import crosstab_percent, in_category_order
from landtrace.operators.sampling import hash_sample
from landtrace.spec import FOLLOW_UP_CLASSES


def area_by_year(c_length: DataFrame, mask: DataFrame) -> DataFrame:
    """Area (km2) of first conversions by event, forest type, length and year.

    The area is summed to the few distinct year pairs before the two year columns are
    melted, so the melt handles the reduced table.
    """
    keys = ["forest_type", "agri_year", "forest_year", "agri_code", "c_length"]
    first = c_length.filter("agri_cycle = 1").select("cell_id", *keys)
    sums = with_area(first, mask).groupBy(*keys).agg(total(F.col("area")).alias("total_area"))
    events = sums.unpivot(
        ["forest_type", "c_length", "total_area"], ["agri_year", "forest_year"], "conversion", "year"
    )
    by_year = events.groupBy("conversion", "forest_type", "c_length", "year").agg(
        F.sum("total_area").alias("total_area")
    )
    return by_year.withColumns({
        "year": year_start(F.col("year")), "total_area": square_km(F.col("total_area").cast("double")),
    })


def length_frequency(c_length: DataFrame, fraction: float = 0.01, seed: int = 2) -> DataFrame:
    """Histogram of conversion length over a reproducible sample of conversions."""
    return histogram(hash_sample(c_length, ["cell_id", "agri_cycle"], fraction, seed), "c_length")


def length_ridges(
    c_length: DataFrame, mask: DataFrame, municip: DataFrame, fraction: float = 0.01, seed: int = 1,
    since: int = 1995,
) -> DataFrame:
    """Sampled lengths of first conversions with state and establishment date."""
    first = c_length.filter("agri_cycle = 1").select("cell_id", "agri_year", "c_length")
    located = with_area(hash_sample(first, "cell_id", fraction, seed), mask, ["code_muni"])
    named = located.join(municip.select("code_muni", "name_state"), "code_muni", "left")
    return (
        named.select("agri_year", "c_length", "name_state").dropna("any")
        .withColumn("agri_year", year_start(F.col("agri_year")))
        .filter(F.year("agri_year") >= since)
    )


def followup_counts(
    c_length: DataFrame, c_classes: DataFrame, lag: int = 5, keys: Sequence[str] = ("cell_id",)
) -> DataFrame:
    """Cells by crop and by the class found ``lag`` years after establishment."""
    return histogram(at_lag(c_length, c_classes, lag, keys), "agri_code", "class_code", name="count")


def followup_shares(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts as percentages, codes replaced by class names."""
    parts = shares(counts, ["agri_code"], "count")
    for col in ("agri_code", "class_code"):
        parts = decode_codes(parts, classes, col, f"_{col}")
    return parts.select(
        F.col("_agri_code").alias("agri_code"), F.col("_class_code").alias("class_code"), "perc", "total_perc"
    )


def followup_crosstab(
    counts: DataFrame, classes: DataFrame, ordered: Sequence[str] = FOLLOW_UP_CLASSES, places: int | None = None
) -> DataFrame:
    """Crop by class table in percent, with the share of each crop in front."""
    table = crosstab_percent(
        followup_shares(counts, classes), ["total_perc", "agri_code"], "class_code", "perc", ordered
    )
    if places is not None:
        table = table.withColumns({c: F.bround(c, places) for c in ["total_perc", *ordered]})
    return in_category_order(table, ["agri_code"], ordered)
