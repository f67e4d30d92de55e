"""Shaping of yearly class tables: bands, measures, masks and cleaning."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.functions.values import in_codes, positive_or_null


def year_bands(df: DataFrame, prefix: str = "classification") -> dict[int, str]:
    """Year -> column name of the yearly bands, read from the schema only."""
    named = ((re.search(r"\d+", c), c) for c in df.columns if c.startswith(prefix))
    return {int(found.group()): c for found, c in sorted(named, key=lambda p: p[1]) if found}


def bands_to_rows(df: DataFrame, id_cols: Sequence[str], prefix: str = "classification") -> DataFrame:
    """One row per cell and present year. Years are literals, so nothing is parsed per row."""
    bands = year_bands(df, prefix)
    pairs = [x for year, c in bands.items() for x in (F.lit(year), F.col(c).cast("int"))]
    rows = df.select(*id_cols, F.stack(F.lit(len(bands)), *pairs).alias("year", "class_code"))
    return rows.filter(F.col("class_code") != 0)


def rows_to_bands(
    panel: DataFrame, years: Sequence[int], id_cols: Sequence[str], prefix: str = "classification"
) -> DataFrame:
    """One row per cell; absent years are 0.

    A pivot with given values: (cell, year) is reduced map-side first, then spread out. One
    conditional aggregate per year would generate a method too large for the JIT compiler.
    The bands get their names as fields of one struct: as dozens of aliases, each with a default,
    they would have the optimizer derive a variant of every later filter per subset of bands.
    """
    spread = panel.groupBy(*id_cols).pivot("year", list(years)).agg(F.min("class_code"))
    bands = F.struct(*[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"{prefix}_{y}") for y in years])
    return spread.select(*id_cols, F.inline(F.array(bands)))


def measures_to_rows(df: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Melt ``cols`` into (name, value); all other columns stay."""
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, list(cols), name, value)


def drop_empty_cells(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Drop cells that are NULL in every band."""
    return df.dropna("all", subset=list(bands))


def remap_bands(df: DataFrame, bands: Sequence[str], codes: Sequence[int]) -> DataFrame:
    """1 where a band holds one of ``codes``, otherwise 0."""
    return df.withColumns(
        {b: F.coalesce(in_codes(F.col(b), codes), F.lit(False)).cast("int") for b in bands}
    )


def any_nonzero(bands: Sequence[str]) -> Column:
    """True when some band is neither 0 nor NULL."""
    return reduce(Column.__or__, (F.coalesce(F.col(b) != 0, F.lit(False)) for b in bands))


def ever_class(bands: Sequence[str], codes: Sequence[int]) -> Column:
    """True when some band ever holds one of ``codes``."""
    return F.exists(F.array(*[F.col(b) for b in bands]), lambda v: F.coalesce(in_codes(v, codes), F.lit(False)))


def mask_cells(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a condition over many bands, all bands kept."""
    return df.filter(condition)


def shift_columns(df: DataFrame, cols: Sequence[str], by: int) -> DataFrame:
    return df.withColumns({c: F.col(c) - by for c in cols})


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in table order."""
    return df.columns[df.columns.index(first): df.columns.index(last) + 1]


def null_sentinels(df: DataFrame, year_cols: Sequence[str], length_col: str) -> DataFrame:
    """Years of 0 or less mean "none"; the length holds only when every year does."""
    dated = reduce(Column.__and__, (F.col(c) > 0 for c in year_cols))
    return df.select(
        *[
            positive_or_null(F.col(c)).alias(c) if c in year_cols
            else F.when(dated, F.col(c)).alias(c) if c == length_col
            else F.col(c)
            for c in df.columns
        ]
    )


def keep_groups_having(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """All rows of the groups in which every condition holds for at least one row.

    The qualifying keys come from a map-side combined aggregate and are matched by a
    semi-join, so the rows of a very large group are never gathered in one task.
    """
    kept = df.groupBy(*keys).agg(*[F.bool_or(c).alias(name) for name, c in conditions.items()])
    kept = kept.filter(" and ".join(f"`{name}`" for name in conditions)).select(*keys)
    return df.join(kept, list(keys), "left_semi")
