"""Conversion cycles when the whole series of a cell lies in one row.

The series is an array of (year, class) in year order, built from the wide layout (one
column per year). Cycles and follow-up classes are a fold over the array and an
``explode``, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.operators.cycles import CELL
from landtrace.spec import ConversionSpec

_CYCLE = "array<struct<agri_code:int,forest_year:int,agri_year:int,c_cycle:int>>"


def band_series(bands: Mapping[int, str]) -> Column:
    """Present (non-zero) years of a wide row in order, as ``array<struct<year, class_code>>``."""
    cells = ", ".join(
        f"named_struct('year', {year}, 'class_code', cast(`{bands[year]}` as int))" for year in sorted(bands)
    )
    return F.expr(f"filter(array({cells}), c -> c.class_code != 0)")


def fold_cycles(series: str, spec: ConversionSpec) -> Column:
    """All complete cycles in array column ``series``, as an array of structs.

    The state ``s`` of the fold holds the open cycle: its number, whether the last marked
    year was anthropic, the last natural year and the first agriculture year and class.
    Cells without both a natural and an agriculture year are not folded.
    """
    natural, anthropic, agriculture = (
        f"v.class_code in ({', '.join(map(str, codes))})"
        for codes in (spec.natural, spec.anthropic, spec.agriculture)
    )
    opens = f"({natural} and s.was_anthropic)"
    first = f"({agriculture} and ({opens} or s.agri is null))"
    closed = f"""case when s.forest is not null and s.agri is not null
        then concat(s.closed, array(named_struct('agri_code', s.code, 'forest_year', s.forest + 1,
                                                 'agri_year', s.agri, 'c_cycle', s.cycle)))
        else s.closed end"""
    start = f"""named_struct('cycle', 1, 'was_anthropic', false, 'forest', cast(null as int),
        'agri', cast(null as int), 'code', cast(null as int), 'closed', cast(array() as {_CYCLE}))"""
    step = f"""named_struct(
        'cycle', s.cycle + int({opens}),
        'was_anthropic', case when {anthropic} then true when {natural} then false else s.was_anthropic end,
        'forest', if({natural}, v.year, s.forest),
        'agri', case when {first} then v.year when not {opens} then s.agri end,
        'code', case when {first} then v.class_code when not {opens} then s.code end,
        'closed', if({opens}, {closed}, s.closed))"""
    candidate = f"exists(`{series}`, v -> {natural}) and exists(`{series}`, v -> {agriculture})"
    fold = f"aggregate(`{series}`, {start}, (s, v) -> {step}, s -> {closed})"
    return F.expr(f"if({candidate}, {fold}, cast(array() as {_CYCLE}))")


def series_cycles(
    rows: DataFrame, series: Column, spec: ConversionSpec,
    keys: Sequence[str] = CELL, keep: Sequence[str] = (),
) -> DataFrame:
    """Conversion table of the cells in ``rows``; ``keep`` columns are carried along."""
    rows = rows.select(*keys, *keep, series.alias("_s"))
    cycles = rows.select(*keys, *keep, F.posexplode(fold_cycles("_s", spec)).alias("pos", "c"))
    return cycles.select(
        *keys, *keep, "c.agri_code", "c.forest_year", "c.agri_year",
        (F.col("c.agri_year") - F.col("c.forest_year")).alias("c_length"), "c.c_cycle",
        F.when(F.col("c.c_cycle") == 1, 1).otherwise(2).alias("forest_type"),
        (F.col("pos") + 1).alias("agri_cycle"),
    )


def series_classes(
    rows: DataFrame, series: Column, spec: ConversionSpec,
    keys: Sequence[str] = CELL, keep: Sequence[str] = (),
) -> DataFrame:
    """Classes during and after every conversion; later cycles may see a year again."""
    rows = rows.select(*keys, *keep, series.alias("_s"))
    rows = rows.select(
        *keys, *keep, "_s", F.posexplode(fold_cycles("_s", spec)).alias("pos", "c")
    )
    inside = F.filter(
        "_s",
        lambda v: (v.year > F.col("c.forest_year")) & (v.year <= F.col("c.agri_year") + spec.after),
    )
    return rows.select(
        *keys, *keep, (F.col("pos") + 1).alias("agri_cycle"), F.explode(inside).alias("v")
    ).select(*keys, *keep, "agri_cycle", "v.year", "v.class_code")
