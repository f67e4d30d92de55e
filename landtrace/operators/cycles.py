"""Conversion cycles from a long panel (one row per cell and year).

A cell is one short series: ``(cell, year)`` is unique, so a window over a cell
holds at most one row per mapped year whatever the size of the table. All steps
cluster by the cell key, so Spark plans one exchange for the whole chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landtrace.functions.values import in_codes
from landtrace.spec import ConversionSpec

CELL = ("cell_id",)
LENGTH_COLUMNS = ("agri_code", "forest_year", "agri_year", "c_length", "c_cycle", "forest_type")


def mark_classes(panel: DataFrame, classes: DataFrame) -> DataFrame:
    """Add ``_anthropic`` by a join with a class dictionary."""
    anthropic = classes.filter(F.col("class_type") == "anthropic").select("class_code").distinct()
    marked = panel.join(anthropic.withColumn("_anthropic", F.lit(True)), "class_code", "left")
    return marked.select(*panel.columns, F.coalesce("_anthropic", F.lit(False)).alias("_anthropic"))


def segment_cycles(
    panel: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL, classes: DataFrame | None = None
) -> DataFrame:
    """Add ``c_cycle``: a cycle opens at a natural year whose last marked year was anthropic.

    Years of unmarked classes (mosaic, water, unknown codes) carry the mark on. With
    ``classes`` that dictionary says which classes are anthropic, in place of ``spec``.
    """
    code = F.col("class_code")
    natural = in_codes(code, spec.natural)
    anthropic = in_codes(code, spec.anthropic)
    if classes is not None:
        panel, anthropic = mark_classes(panel, classes), F.col("_anthropic")
    series = Window.partitionBy(*keys).orderBy("year")
    was_anthropic = F.last(
        F.when(anthropic, True).when(natural, False), ignorenulls=True
    ).over(series.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce(natural & was_anthropic, F.lit(False)).cast("int")
    return (
        panel.withColumn("_opened", opened)
        .withColumn(
            "c_cycle",
            (F.sum("_opened").over(series.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int"),
        )
        .drop("_opened", "_anthropic")
    )


def cycle_bounds(segmented: DataFrame, spec: ConversionSpec, keys: Sequence[str] = CELL) -> DataFrame:
    """One row per cycle holding both a natural and an agriculture year."""
    code, year = F.col("class_code"), F.col("year")
    agriculture = in_codes(code, spec.agriculture)
    return (
        segmented.groupBy(*keys, "c_cycle")
        .agg(
            F.min_by(F.when(agriculture, code), F.when(agriculture, year)).alias("agri_code"),
            (F.max(F.when(in_codes(code, spec.natural), year)) + 1).cast("int").alias("forest_year"),
            F.min(F.when(agriculture, year)).alias("agri_year"),
        )
        .filter("forest_year is not null and agri_year is not null")
        .select(
            *keys, "agri_code", "forest_year", "agri_year",
            (F.col("agri_year") - F.col("forest_year")).alias("c_length"), "c_cycle",
        )
    )


def number_cycles(bounds: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """``agri_cycle`` counts the conversions of a cell; primary forest is 1, secondary 2."""
    order = Window.partitionBy(*keys).orderBy("c_cycle")
    return bounds.select(
        *keys, *LENGTH_COLUMNS[:5],
        F.when(F.col("c_cycle") == 1, 1).when(F.col("c_cycle") > 1, 2).alias("forest_type"),
        F.row_number().over(order).alias("agri_cycle"),
    )


def band_join(
    panel: DataFrame, cycles: DataFrame, after: int, keys: Sequence[str] = CELL
) -> DataFrame:
    """Panel years inside each conversion and ``after`` years past establishment.

    An equi-join on the cell with a year range. Both sides are clustered by cell, and
    later cycles see the same years again when the ranges overlap.
    """
    spans = cycles.select(*keys, "agri_cycle", "forest_year", "agri_year")
    return (
        panel.join(spans, list(keys))
        .filter((F.col("year") > F.col("forest_year")) & (F.col("year") <= F.col("agri_year") + after))
        .select(*keys, "agri_cycle", "year", "class_code")
    )
