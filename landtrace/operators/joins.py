"""Joins with small tables, key lists and dense sequences.

Dimension joins carry no broadcast hint: Spark broadcasts a side whose measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.operators.panel import measures_to_rows


def decode_codes(df: DataFrame, classes: DataFrame, col: str, name: str, how: str = "inner") -> DataFrame:
    """Add the class name of code column ``col`` as ``name`` (may be used for several roles)."""
    names = classes.select(F.col("class_code").alias(col), F.col("class_name").alias(name))
    return df.join(names, col, how)


def densify(
    df: DataFrame, skeleton: DataFrame, keys: Sequence[str], n_col: str, cell: str, chunk: int = 1_024
) -> DataFrame:
    """Every cell 1..``n_col`` of each skeleton row, with the matching row of ``df`` or NULLs.

    The rows of ``df`` are gathered by ``chunk`` cells and joined with the chunks of the skeleton;
    each chunk is then filled inside its own row, so no dense row is shuffled. A cell that
    ``df`` has several times comes as often.
    """
    values = [c for c in df.columns if c not in (*keys, cell)]
    found = df.groupBy(*keys, F.floor((F.col(cell) - 1) / chunk).alias("_chunk")).agg(
        F.collect_list(F.struct(F.col(cell).cast("int").alias(cell), *values)).alias("_found"))
    last = F.floor((F.col(n_col) - 1) / chunk)
    chunks = skeleton.filter(F.col(n_col) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    low = (F.col("_chunk") * chunk + 1).cast("int")
    cells = F.sequence(low, F.least(low + chunk - 1, F.col(n_col)))
    here = F.filter(F.coalesce("_found", F.array().cast(found.schema["_found"].dataType)), lambda r: r[cell] <= F.col(n_col))
    empty = [F.lit(None).cast(df.schema[v].dataType).alias(v) for v in values]
    gaps = F.transform(
        F.array_except(cells, F.transform(here, lambda r: r[cell])), lambda c: F.struct(c.alias(cell), *empty))
    rest = [c for c in skeleton.columns if c != n_col]
    return chunks.join(found, [*keys, "_chunk"], "left").select(*rest, F.inline(F.concat(here, gaps)))


def cross_sequence(df: DataFrame, low: int, high: int, names: Sequence[str]) -> DataFrame:
    """Repeat each row for low..high; every column in ``names`` holds the step."""
    steps = df.withColumn(names[0], F.explode(F.sequence(F.lit(low), F.lit(high))))
    return steps.withColumns({n: F.col(names[0]) for n in names[1:]})


def matched_rows(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``wanted``."""
    return df.join(wanted.select(key), key, "left_semi")


def unmatched_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def at_lag(c_length: DataFrame, c_classes: DataFrame, lag: int, keys: Sequence[str], cycle: int = 1) -> DataFrame:
    """Class found ``lag`` years after establishment, for one conversion of each cell.

    With the cycle fixed the cell alone is the join key, which both sides are clustered by.
    """
    starts = c_length.filter(F.col("agri_cycle") == cycle).select(*keys, "agri_cycle", "agri_code", "agri_year")
    found = c_classes.filter(F.col("agri_cycle") == cycle).select(*keys, "year", "class_code")
    return (
        starts.join(found, list(keys))
        .withColumn("year", F.col("year") - F.col("agri_year"))
        .filter(F.col("year") == lag)
        .drop("agri_year")
    )


def with_area(c_length: DataFrame, mask: DataFrame, cols: Sequence[str] = ("area",)) -> DataFrame:
    """Mask attributes of each conversion; cells outside the mask keep NULLs."""
    return c_length.join(mask.select("cell_id", *cols), "cell_id", "left")


def pair_measures(estimated: DataFrame, observed: DataFrame, measures: Sequence[str], labels: Column | None = None) -> DataFrame:
    """Estimated and observed measures side by side, one row per (cell, cycle, measure)."""
    known = measures_to_rows(
        observed.select("sample_id", "cell_id", *measures), measures, "var", "observed"
    )
    wanted = matched_rows(estimated, observed, "cell_id")
    pairs = measures_to_rows(wanted, measures, "var", "estimated").join(known, ["cell_id", "var"])
    pairs = pairs.withColumn("difference", F.col("observed") - F.col("estimated"))
    return pairs if labels is None else pairs.withColumn("var", labels)
