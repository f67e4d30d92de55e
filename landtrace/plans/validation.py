"""Sampling of cells for interpretation and comparison with what was observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.functions.values import label_of
from landtrace.operators.aggregates import error_metrics, quantile_bands
from landtrace.operators.joins import cross_sequence, pair_measures
from landtrace.operators.panel import null_sentinels, shift_columns
from landtrace.operators.polygons import within_distance
from landtrace.operators.sampling import sample_n
from landtrace.spec import MEASURE_LABELS

YEARS = ("forest_year", "agri_year")
MEASURES = (*YEARS, "c_length")


def draw_validation_sample(mask: DataFrame, n: int = 100, seed: int = 123) -> DataFrame:
    """``n`` mask cells with their coordinates; the same ones on every run."""
    return sample_n(mask.select("cell_id", "tile_id", "tile_cell_id", "x", "y"), "cell_id", n, seed)


def sample_surroundings(mask: DataFrame, sample: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Mask cells within ``metres`` of a sampled cell."""
    centres = sample.select(F.col("cell_id").alias("sample_cell"), "x", "y")
    return within_distance(mask.select("cell_id", "x", "y"), centres, metres)


def compare_measures(estimated: DataFrame, observed: DataFrame, base_year: int = 0) -> DataFrame:
    """Observed minus estimated year and length of each conversion of an observed cell.

    Observed zeros count as "none". ``base_year`` turns years into indices.
    """
    clean = null_sentinels(observed, YEARS, "c_length")
    if base_year:
        clean, estimated = (shift_columns(df, YEARS, base_year) for df in (clean, estimated))
    return pair_measures(estimated, clean, MEASURES, label_of(F.col("var"), MEASURE_LABELS))


def validation_metrics(comparison: DataFrame, by: Sequence[str] = ("var",)) -> DataFrame:
    return error_metrics(comparison, by)


def error_quantile_bands(comparison: DataFrame, low: int = -1, high: int = 36) -> DataFrame:
    """Error envelopes of each measure, repeated along the plotted index."""
    bands = quantile_bands(comparison, ["var"], "difference")
    return cross_sequence(bands, low, high, ["estimated", "observed"])
