"""Code sets, sentinels, labels and dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_codes(col: Column, codes: Sequence[int]) -> Column:
    return col.isin(*codes)


def positive_or_null(col: Column) -> Column:
    """0 and below mean "none"."""
    return F.when(col > 0, col)


def label_of(col: Column, labels: Mapping) -> Column:
    """Replace a code by its label; unknown codes give NULL."""
    out = None
    for key, label in labels.items():
        out = F.when(col == key, label) if out is None else out.when(col == key, label)
    return out


def rank_of(col: Column, ordered: Sequence) -> Column:
    """Sort key: position in ``ordered``, and the same last position for all others."""
    return F.coalesce(label_of(col, {v: i for i, v in enumerate(ordered)}), F.lit(len(ordered)))


def year_start(year: Column) -> Column:
    """1 January of a year as DATE."""
    return F.make_date(year, F.lit(1), F.lit(1))


def square_km(area: Column) -> Column:
    return area / F.lit(1e6)


def ticket(key: Column, seed: int) -> Column:
    """Uniform number in [0, 2**32) that depends only on the key and the seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
