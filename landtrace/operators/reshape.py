"""Crosstabs, category order and added rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.functions.values import rank_of


def crosstab_percent(df: DataFrame, rows: Sequence[str], col: str, value: str, values: Sequence[str]) -> DataFrame:
    """One column per listed category. The list is given, so no extra job looks for it, and
    a crosstab of counted classes is small enough for plain conditional aggregates."""
    return df.groupBy(*rows).agg(*[F.max(F.when(F.col(col) == v, F.col(value))).alias(str(v)) for v in values])


def in_category_order(df: DataFrame, cols: Sequence[str], ordered: Sequence[str]) -> DataFrame:
    """Sort by listed order, other categories after it by name. For final small results."""
    return df.orderBy(*[key for c in cols for key in (rank_of(F.col(c), ordered), F.col(c))])


def mirror_rows(df: DataFrame, col: str) -> DataFrame:
    """The rows once more with ``col`` negated, from a single pass over the input."""
    others = [F.col(c) for c in df.columns if c != col]
    both = F.explode(F.array(F.col(col), -F.col(col))).alias(col)
    return df.select(*others, both).select(*df.columns)

